"""Distributed matrix products on the ``features`` array.

Spark partitions the rows; numpy multiplies Arrow batches inside the tasks; partial results leave a
task as blocks and are added up by block in a second stage that streams, so no task and no group ever
holds the partial results of all others. Only results as large as the model reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widetab.functions.vectors import array_literal
from widetab.session import task_count

BLOCK = 512
PAIRS_PER_PASS = 64  # block pairs a task accumulates at a time: 128 MB
BLOCK_SCHEMA = "bi int, bj int, n_rows int, n_cols int, cells array<double>"
MAX_BROADCAST_BYTES = 256 << 20
KERNEL_CELLS = 1 << 20  # kernel values or centred cells a task computes at a time: 8 MB
GRAM_LIMIT = 4096  # widest covariance matrix decomposed on the driver: 128 MB
FOLD_BYTES = 512 << 20  # all fold matrices together


def batch_matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows x d matrix of an Arrow list column without copying cell by cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("missing feature values; impute the table first")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), d)


def list_column(matrix: np.ndarray) -> pa.ListArray:
    rows, cols = matrix.shape
    offsets = np.arange(0, rows * cols + 1, cols, dtype=np.int32) if cols else np.zeros(rows + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def _block_batch(bi: int, bj: int, block: np.ndarray) -> pa.RecordBatch:
    rows, cols = block.shape
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.int32()) for v in (bi, bj, rows, cols)] + [list_column(block.reshape(1, -1))],
        names=["bi", "bj", "n_rows", "n_cols", "cells"],
    )


def add_blocks(partials: DataFrame) -> DataFrame:
    """Sum equally keyed blocks in two steps; blocks stream through the tasks that own them.

    A block has as many partial sums as there are tasks. They go to about the root of that many tasks first, whose sums
    meet in one, so that no task receives more than about the root of all partial sums.
    """
    width = max(1, math.isqrt(task_count(partials.sparkSession)))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bi, bj, rows, cols, cells in zip(
                *[batch.column(i).to_pylist() for i in range(4)], batch.column(4)
            ):
                block = cells.values.to_numpy().reshape(rows, cols)
                if (bi, bj) in sums:
                    sums[bi, bj] += block
                else:
                    sums[bi, bj] = block.copy()
        for (bi, bj), block in sums.items():
            yield _block_batch(bi, bj, block)

    salted = partials.withColumn("salt", F.spark_partition_id() % width).repartition("bi", "bj", "salt").drop("salt")
    return salted.mapInArrow(combine, BLOCK_SCHEMA).repartition("bi", "bj").mapInArrow(combine, BLOCK_SCHEMA)


def add_rows(partials: DataFrame) -> np.ndarray:
    """The sum of all arrays of one column; no longer than the model is wide."""
    name = partials.columns[0]
    rows = partials.select(F.posexplode(name).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def partial_blocks(df: DataFrame, columns: list[str], step: Callable, finish: Callable) -> DataFrame:
    """Run ``step(state, *columns)`` over the batches of a task and emit ``finish(state)`` as blocks.

    Input partitions are grouped without a shuffle: a partial result is as large as the model, so
    there should be about as many of them as there are cores, not as many as there are files.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = step(state, *batch.columns)
        if state is not None:
            for bi, bj, block in finish(state):
                yield _block_batch(bi, bj, block)

    return df.select(*columns).coalesce(task_count(df.sparkSession)).mapInArrow(partial, BLOCK_SCHEMA)


def collect_blocks(blocks: DataFrame, n_rows: int, n_cols: int, block: int = BLOCK, symmetric: bool = False) -> np.ndarray:
    """Assemble a model-sized matrix on the driver (its size is checked by the callers)."""
    result = np.zeros((n_rows, n_cols))
    table = blocks.toArrow()
    for bi, bj, rows, cols, cells in zip(*[table.column(i).to_pylist() for i in range(4)], table.column(4)):
        part = cells.values.to_numpy().reshape(rows, cols)
        result[bi * block : bi * block + rows, bj * block : bj * block + cols] = part
        if symmetric and bi != bj:
            result[bj * block : bj * block + cols, bi * block : bi * block + rows] = part.T
    return result


def _pieces(matrix: np.ndarray, symmetric: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    for i in range(0, matrix.shape[0], BLOCK):
        for j in range(i if symmetric else 0, matrix.shape[1], BLOCK):
            yield i // BLOCK, j // BLOCK, matrix[i : i + BLOCK, j : j + BLOCK]


def gram_blocks(df: DataFrame, d: int, shift: np.ndarray | float = 0.0, features: str = "features", group: str | None = None) -> DataFrame:
    """Upper blocks of ``sum_i (x_i - shift)(x_i - shift)'`` keyed by ``(bi <= bj)``.

    A task accumulates a limited number of block pairs in place; a wider table is read once for each
    group of pairs, so the memory of a task does not grow with the square of the width. With ``group``
    (small integers from 0) every group has its own matrix: its block rows start at ``group * blocks``.
    """
    moved = df.sparkSession.sparkContext.broadcast(np.asarray(shift, dtype=np.float64))
    edges = range(0, d, BLOCK)
    pairs = [(i, j) for i in edges for j in edges if i <= j]
    blocks = len(edges)

    def one_pass(chosen: list[tuple[int, int]]) -> DataFrame:
        def step(state, column, groups=None):
            rows = batch_matrix(column, d)
            state = {} if state is None else state
            all_labels = np.zeros(len(rows), dtype=int) if groups is None else groups.to_numpy(zero_copy_only=False)
            for piece in row_pieces(len(rows), d):
                x, labels = rows[piece] - moved.value, all_labels[piece]
                for g in np.unique(labels):
                    part = x if groups is None else x[labels == g]
                    for i, j in chosen:
                        product = part[:, i : i + BLOCK].T @ part[:, j : j + BLOCK]
                        key = (int(g) * blocks + i // BLOCK, j // BLOCK)
                        if key in state:
                            state[key] += product
                        else:
                            state[key] = product
            return state

        def finish(state):
            return ((bi, bj, block) for (bi, bj), block in state.items())

        return partial_blocks(df, [features] if group is None else [features, group], step, finish)

    passes = [one_pass(pairs[i : i + PAIRS_PER_PASS]) for i in range(0, len(pairs), PAIRS_PER_PASS)]
    return add_blocks(reduce(DataFrame.unionAll, passes))


def column_moments(df: DataFrame, features: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column means and population variances, by the built-in aggregates.

    The counts of the features also tell whether all rows are equally wide and complete.
    """
    from widetab.operators.stats import feature_moments

    rows = feature_moments(df, (), features).toPandas().sort_values("feature_idx")
    if rows.empty:
        raise ValueError("the table has no rows")
    if rows["n"].nunique() > 1:
        raise ValueError("missing feature values; impute the table first")
    return int(rows["n"].iloc[0]), rows["mean"].to_numpy(), rows["var_pop"].to_numpy()


def covariance_blocks(df: DataFrame, features: str = "features") -> tuple[DataFrame, int, np.ndarray]:
    """``(blocks of the centred Gram matrix, rows, means)``. Means come first, so nothing cancels."""
    n, means, _ = column_moments(df, features)
    return gram_blocks(df, len(means), means, features), n, means


def fold_matrices_fit(d: int, folds: int, limit: int = FOLD_BYTES) -> bool:
    """Whether the covariance matrices of all folds together are small enough for the driver."""
    return d <= GRAM_LIMIT and 8 * folds * d * d <= limit


def fold_covariances(df: DataFrame, folds: int, fold: str = "fold", features: str = "features") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per fold the ``(rows, means, centred Gram matrix)`` of all *other* folds, from two passes in all.

    A Gram matrix is a sum over rows, so every row is multiplied once for its own fold and the training
    matrix of a fold is the total minus that.
    """
    from widetab.operators.stats import feature_moments

    table = feature_moments(df, [fold], features).toPandas().sort_values([fold, "feature_idx"])
    d = int(table["feature_idx"].max()) + 1
    if (table.groupby(fold)["n"].nunique() > 1).any():
        raise ValueError("missing feature values; impute the table first")
    sizes, sums = np.zeros(folds), np.zeros((folds, d))
    for f, rows in table.groupby(fold):
        sizes[int(f)] = rows["n"].iloc[0]
        sums[int(f)] = rows["n"].iloc[0] * rows["mean"].to_numpy()
    centre = sums.sum(0) / sizes.sum()
    blocks = math.ceil(d / BLOCK)
    grams = np.zeros((folds, d, d))
    collected = gram_blocks(df, d, centre, features, fold).toArrow()
    for bi, bj, rows, cols, cells in zip(*[collected.column(i).to_pylist() for i in range(4)], collected.column(4)):
        f, bi = divmod(bi, blocks)
        part = cells.values.to_numpy().reshape(rows, cols)
        grams[f, bi * BLOCK : bi * BLOCK + rows, bj * BLOCK : bj * BLOCK + cols] = part
        grams[f, bj * BLOCK : bj * BLOCK + cols, bi * BLOCK : bi * BLOCK + rows] = part.T
    result = []
    for f in range(folds):
        n = int(sizes.sum() - sizes[f])
        means = (sums.sum(0) - sums[f]) / max(n, 1)
        moved = means - centre
        result.append((n, means, grams.sum(0) - grams[f] - n * np.outer(moved, moved)))
    return result


def block_cells(blocks: DataFrame) -> DataFrame:
    """``(i, j, value)`` cells with ``i <= j`` of symmetric blocks, without the driver."""
    cells = blocks.select("bi", "bj", "n_cols", F.posexplode("cells").alias("pos", "value"))
    row = F.col("bi") * BLOCK + F.floor(F.col("pos") / F.col("n_cols")).cast("int")
    col = F.col("bj") * BLOCK + F.pmod(F.col("pos"), F.col("n_cols"))
    return cells.select(row.cast("int").alias("i"), col.cast("int").alias("j"), "value").filter("i <= j")


def covariance(df: DataFrame, features: str = "features") -> DataFrame:
    """``(i, j, cov_pop)`` for ``i <= j``."""
    blocks, n, _ = covariance_blocks(df, features)
    return block_cells(blocks).select("i", "j", (F.col("value") / F.lit(float(n))).alias("cov_pop"))


def squared_norms(n: int, means: np.ndarray, variances: np.ndarray, shift: float) -> np.ndarray:
    """Squared length of every column after moving it by ``shift``."""
    return n * (variances + (means - shift) ** 2)


def squared_distances(df: DataFrame, features: str = "features") -> DataFrame:
    """``(i, j, dist2)`` between all feature columns, ``i < j``: ``g_ii + g_jj - 2 g_ij``.

    All columns are first moved by the same number, which keeps distances and limits cancellation. The
    squared lengths follow from the first pass, so the products need no join with their diagonal.
    """
    n, means, variances = column_moments(df, features)
    shift = float(means.mean())
    norms = array_literal(squared_norms(n, means, variances, shift))
    cells = block_cells(gram_blocks(df, len(means), shift, features)).filter("i < j")
    dist2 = F.get(norms, F.col("i")) + F.get(norms, F.col("j")) - 2 * F.col("value")
    return cells.select("i", "j", F.greatest(dist2, F.lit(0.0)).alias("dist2"))


def project(df: DataFrame, matrix: np.ndarray, offset: np.ndarray | None = None, features: str = "features", out: str = "features") -> DataFrame:
    """``features @ matrix - offset`` as an array column; a narrow stage, nothing is shuffled.

    The matrix is broadcast. One that is larger than the limit is applied in column slices, each in
    its own stage of the same pass over the rows, and the slices are put side by side.
    """
    d, k = matrix.shape
    offset = np.zeros(k) if offset is None else np.asarray(offset, dtype=np.float64)
    per_slice = max(1, MAX_BROADCAST_BYTES // (8 * max(1, d)))
    kept = [c for c in df.columns if c != out]
    parts = []
    source, current = "__source", df.withColumn("__source", F.col(features))
    for number, start in enumerate(range(0, k, per_slice)):
        name = f"__slice{number}"
        current = _project_slice(current, matrix[:, start : start + per_slice], offset[start : start + per_slice], source, name, d)
        parts.append(F.col(name))
    return current.select(*[F.col(f"`{c}`") for c in kept], F.concat(*parts).alias(out))


def _project_slice(df, matrix, offset, source, name, d):
    shared = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(matrix), offset))
    position = df.columns.index(source)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, minus = shared.value
        for batch in batches:
            result = batch_matrix(batch.column(position), d) @ weights - minus
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(result)], names=[*names, name])

    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(multiply, schema)


def kernel_rows(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """RBF kernel of a batch of rows against the landmarks."""
    squares = (x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None, :] - 2.0 * (x @ landmarks.T)
    np.maximum(squares, 0.0, out=squares)
    squares *= -gamma
    return np.exp(squares, out=squares)


def row_pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows that have at most ``KERNEL_CELLS`` cells in all, ``width`` in each."""
    step = max(1, KERNEL_CELLS // max(width, 1))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def kernel_project(df: DataFrame, landmarks: np.ndarray, gamma: float, components: np.ndarray, offset: np.ndarray, out: str = "features") -> DataFrame:
    """``kernel(features, landmarks) @ components - offset`` as a narrow stage."""
    m, d = landmarks.shape
    if landmarks.nbytes + components.nbytes > 2 * MAX_BROADCAST_BYTES:
        raise ValueError(f"{m} landmarks of width {d} are too large to broadcast; use fewer landmarks")
    shared = df.sparkSession.sparkContext.broadcast((landmarks, components, offset))
    names = [*[c for c in df.columns if c != out], out]
    source = df.columns.index("features")
    order = [df.columns.index(c) for c in names[:-1]]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, weights, minus = shared.value
        for batch in batches:
            x = batch_matrix(batch.column(source), d)
            for piece in row_pieces(len(x), max(m, weights.shape[1])):
                result = kernel_rows(x[piece], z, gamma) @ weights - minus
                own = batch.slice(piece.start, piece.stop - piece.start)
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in order], list_column(result)], names=names)

    fields = [df.schema[c] for c in names[:-1]]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(multiply, schema)


def normal_equations_pass(df: DataFrame, q: np.ndarray, means: np.ndarray, features: str = "features") -> np.ndarray:
    """``sum_i (x_i - means)' (x_i - means) q``: a d x l product in one pass over the rows.

    A basis that is too large to broadcast is multiplied in column slices, one pass each.
    """
    d, l = q.shape
    per_slice = max(1, MAX_BROADCAST_BYTES // (8 * d))
    if per_slice < l:
        starts = range(0, l, per_slice)
        return np.hstack([normal_equations_pass(df, q[:, i : i + per_slice], means, features) for i in starts])
    shared = df.sparkSession.sparkContext.broadcast((q, means))

    def step(state, column):
        basis, centre = shared.value
        rows = batch_matrix(column, d)
        for piece in row_pieces(len(rows), d):
            x = rows[piece] - centre
            product = x.T @ (x @ basis)
            if state is None:
                state = product
            else:
                state += product
        return state

    blocks = add_blocks(partial_blocks(df, [features], step, lambda s: _pieces(s, symmetric=False)))
    return collect_blocks(blocks, d, l)

"""Ward clustering of feature columns from their pairwise squared distances.

Ward's criterion is reducible, so reciprocal nearest neighbours can be merged in any order and give
the greedy tree (Murtagh 1983). Two realisations give the same tree:

* up to ``LOCAL_LIMIT`` columns the distance matrix is model-sized and a nearest-neighbour chain in
  numpy follows it on the driver;
* beyond that the matrix stays distributed, one row per cluster, and every round merges all
  reciprocal pairs; only nearest-neighbour pointers (one per cluster) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.operators import matrix
from widetab.operators.layout import known_width
from widetab.session import cut_lineage

LOCAL_LIMIT = 4096


def merged_distance(d_ik, d_jk, d_ij, n_i, n_j, n_k):
    """Lance-Williams update of Ward's method for squared distances."""
    return ((n_i + n_k) * d_ik + (n_j + n_k) * d_jk - n_k * d_ij) / (n_i + n_j + n_k)


def chain_merges(dist2: np.ndarray) -> list[tuple[float, int, int]]:
    """``(height, a, b)`` merges of columns by the nearest-neighbour chain; ``a < b`` are members."""
    d = len(dist2)
    dist = np.array(dist2, dtype=float)
    np.fill_diagonal(dist, np.inf)
    size, alive = np.ones(d), np.ones(d, dtype=bool)
    merges, chain = [], []
    for _ in range(d - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            tip = chain[-1]
            near = int(np.argmin(dist[tip]))
            if len(chain) > 1 and dist[tip, chain[-2]] <= dist[tip, near]:
                break
            chain.append(near)
        b, a = sorted((chain.pop(), chain.pop()), reverse=True)
        merges.append((float(dist[a, b]), a, b))
        others = alive.copy()
        others[[a, b]] = False
        dist[a, others] = merged_distance(dist[a, others], dist[b, others], dist[a, b], size[a], size[b], size[others])
        dist[others, a] = dist[a, others]
        alive[b] = False
        dist[b, :] = dist[:, b] = np.inf
        size[a] += size[b]
    return merges


def cut_tree(merges: list[tuple[float, int, int]], d: int, k: int) -> list[list[int]]:
    """``k`` clusters: apply the ``d - k`` lowest merges; numbered by smallest member."""
    parent = list(range(d))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: d - k]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    clusters: dict[int, list[int]] = {}
    for i in range(d):
        clusters.setdefault(root(i), []).append(i)
    return [clusters[r] for r in sorted(clusters)]


def distance_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """``(i, dist ARRAY<DOUBLE>)``: one row of the squared distance matrix per feature."""
    half = matrix.squared_distances(df, features)
    pair = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "dist2")
    both = half.select(F.inline(F.array(pair("i", "j"), pair("j", "i"))))
    d = known_width(df, None, features)
    diagonal = df.sparkSession.range(d).select(
        F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(float("inf")).alias("dist2")
    )
    grouped = both.unionAll(diagonal).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "dist2"))).alias("cells"))
    return cut_lineage(grouped.select("i", F.col("cells.dist2").alias("dist")))


def distributed_merges(rows: DataFrame, d: int) -> list[tuple[float, int, int]]:
    """The same merges from distributed distance rows, all reciprocal pairs of a round at once."""
    spark = rows.sparkSession
    size, alive, merges = np.ones(d), np.ones(d, dtype=bool), []
    while alive.sum() > 1:
        # Nearest neighbour of every cluster, lowest index on ties: one pointer per row.
        best = F.array_min("dist")
        near = rows.select("i", best.alias("h"), (F.array_position("dist", best) - 1).cast("int").alias("nn")).toArrow()
        nn = np.full(d, -1)
        height = np.full(d, np.inf)
        index = near.column("i").to_numpy()
        nn[index], height[index] = near.column("nn").to_numpy(), near.column("h").to_numpy()
        pairs = [(int(i), int(nn[i])) for i in index if i < nn[i] and nn[nn[i]] == i]
        pairs.sort()
        if not pairs:
            # Only ties can hide a reciprocal pair: merge the closest pair of all.
            i = int(min(index, key=lambda c: (height[c], c)))
            pairs = [tuple(sorted((i, int(nn[i]))))]
        merges += [(float(height[a]), a, b) for a, b in pairs]
        rows = cut_lineage(_apply_merges(spark, rows, d, pairs, size.copy(), {a: float(height[a]) for a, _ in pairs}))
        for a, b in pairs:
            alive[b] = False
            size[a] += size[b]
    return merges


def _apply_merges(spark, rows: DataFrame, d: int, pairs, size: np.ndarray, height: dict) -> DataFrame:
    """Combine the rows of each pair, then the columns of each pair inside every row."""
    left = np.array([a for a, _ in pairs])
    right = np.array([b for _, b in pairs])
    shared = spark.sparkContext.broadcast((left, right, size, height))
    partner = {b: a for a, b in pairs}
    target = spark.createDataFrame(
        [(a, a) for a, _ in pairs] + [(b, a) for b, a in partner.items()], "i int, target int"
    )
    placed = rows.join(F.broadcast(target), "i", "left").withColumn("target", F.coalesce("target", "i"))
    placed = placed.repartition("target").sortWithinPartitions("target", "i")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n, h = shared.value
        pair_of = dict(zip(a.tolist(), b.tolist()))
        waiting: dict[int, np.ndarray] = {}
        for batch in batches:
            indices, lists = batch.column("i").to_pylist(), batch.column("dist")
            for pos, i in enumerate(indices):
                row = lists[pos].values.to_numpy().copy()
                goal = batch.column("target")[pos].as_py()
                if goal in pair_of:
                    if goal not in waiting:
                        waiting[goal] = row
                        continue
                    mate = pair_of[goal]
                    other = waiting.pop(goal)
                    row = _finite(merged_distance(other, row, h[goal], n[goal], n[mate], n))
                    own_size, row[[goal, mate]] = n[goal] + n[mate], np.inf
                else:
                    own_size = n[goal]
                # Columns of merged pairs, seen from this (possibly merged) row.
                keep = a != goal
                la, rb = a[keep], b[keep]
                pair_height = np.array([h[int(x)] for x in la])
                row[la] = _finite(merged_distance(row[la], row[rb], pair_height, n[la], n[rb], own_size))
                row[rb] = np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array([goal], pa.int32()), matrix.list_column(row.reshape(1, -1))], names=["i", "dist"]
                )

    return placed.select("i", "dist", "target").mapInArrow(combine, "i int, dist array<double>")


def _finite(values: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(values), values, np.inf)


def ward_clusters(df: DataFrame, k: int, features: str = "features", local_limit: int = LOCAL_LIMIT) -> list[list[int]]:
    """``k`` clusters of feature columns by Ward linkage on the rows of ``df``."""
    n, means, variances = matrix.column_moments(df, features)
    d = len(means)
    if not 1 <= k <= d:
        raise ValueError(f"cannot form {k} clusters from {d} features")
    if d == 1:
        return [[0]]
    if d > local_limit:
        return cut_tree(distributed_merges(distance_rows(df, features), d), d, k)
    shift = float(means.mean())
    gram = matrix.collect_blocks(matrix.gram_blocks(df, d, shift, features), d, d, symmetric=True)
    norms = matrix.squared_norms(n, means, variances, shift)
    return cut_tree(chain_merges(np.maximum(norms[:, None] + norms[None, :] - 2 * gram, 0.0)), d, k)

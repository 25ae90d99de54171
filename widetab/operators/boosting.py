"""Gradient-boosted trees with one softmax over all classes, grown on histograms.

Features are cut into bins once; the table of bins is stored. A round grows one tree per model whose leaves hold a value
for every class. Growing a level is one job: tasks add up gradients per (node, feature, bin, class) for the smaller child
of every split only, the sums are added by model and block of features, the sibling is the parent minus the child, and each
block names its best split of every node. The histograms stay in Spark; the driver gets one line per node and block.

Gradients are rounded to integers before they are added, so sums are exact: the trees do not depend on how rows are
partitioned or on the order in which tasks finish. A share of the training rows, drawn by hash, decides when to stop.

Several models can grow from the same scans (:meth:`HistogramBoosting.fit_folds`): every row then serves all models that
do not hold it out.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from widetab.functions import vectors
from widetab.functions.rng import HASH_BITS, hash52, uniform
from widetab.operators import matrix
from widetab.operators.layout import known_width, to_long
from widetab.operators.target import TargetEncoder, TargetStatistics
from widetab.session import cut_lineage, task_count

UNIT = 1 << 24  # gradients and hessians are integers in this unit
BLOCK_CELLS = 1 << 18  # histogram cells of one feature block
PASS_CELLS = 1 << 25  # histogram cells a task holds at a time; more are added up in further scans
AT_ONCE = 1 << 12  # rows whose quantiles are aggregated at once
MOST_PIVOTS, PIVOT_CELLS = 2048, 1 << 22  # per feature, and of all features
STORED_ROWS = 1 << 20  # distinct rows of a stored partition
EXACT_ROWS = 1 << 28  # rows of a batch, copies counted, whose sums of slopes are exact as doubles
REFRESH = 16  # rounds after which the margins of all rows are stored
LEVEL_SCHEMA = "model int, block int, cells array<long>, counts array<long>, gains array<double>"


class Tree:
    """Nodes in the order of their creation. ``feature`` is -1 at leaves; the right child follows the left one."""

    def __init__(self, classes: int):
        self.feature = np.full(1, -1, np.int32)
        self.bin, self.left = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.value = np.zeros((1, classes))

    def split(self, node: int, feature: int, bin_: int, left: np.ndarray, right: np.ndarray) -> int:
        """Give a leaf two children with these values; the number of the left one."""
        child = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, child
        self.feature = np.append(self.feature, np.full(2, -1, np.int32))
        self.bin, self.left = np.append(self.bin, np.zeros(2, np.int32)), np.append(self.left, np.zeros(2, np.int32))
        self.value = np.vstack([self.value, left, right])
        return child

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(bins), np.int64)
        open_ = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            here = at[open_]
            here = self.left[here] + (bins[open_, self.feature[here]] > self.bin[here])
            at[open_] = here
            open_ = open_[self.feature[here] >= 0]
        return at


def softmax(margins: np.ndarray) -> np.ndarray:
    """Row by row; a single column is a value, not a class."""
    if margins.shape[1] == 1:
        return margins
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slopes(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, in units."""
    if margins.shape[1] == 1:
        g, h = margins - y[:, None], np.ones_like(margins)
    else:
        p = softmax(margins)
        g, h = p.copy(), p * (1 - p)
        g[np.arange(len(y)), y.astype(np.int64)] -= 1
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def losses(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        return 0.5 * (margins[:, 0] - y) ** 2
    p = softmax(margins)[np.arange(len(y)), y.astype(np.int64)]
    return -np.log(np.maximum(p, 1e-15))


class Growth:
    """One model while it grows."""

    def __init__(self, index: int, base: np.ndarray, allowed: np.ndarray | None = None):
        self.index, self.base = index, base
        self.allowed = allowed  # whether each feature may be split on; None allows all
        self.trees: list[Tree] = []  # finished ones
        self.stored = 0  # how many of them are in the stored margins
        self.tree: Tree | None = None
        self.parents: list[int] = []  # places, among the children of the level above, of the nodes that were split
        self.built: list[int] = []  # the child of each that is added up: 0 left, 1 right
        self.nodes: list[int] = []  # nodes of this level, children of the same parent side by side
        self.best = (math.inf, 0)  # loss on the validation rows, and the number of trees that gave it


def partial_histograms(rows: DataFrame, growing: list[Growth], d: int, bins: int, classes: int, first: int, last: int, held_out: bool) -> DataFrame:
    """Sums of a task for features ``first`` to ``last``: per model (small child or root, feature, bin, channel)."""
    channels = 2 * classes + 1
    per_block = max(1, BLOCK_CELLS // (bins * channels))
    new = [(g, g.trees[g.stored:], len(g.nodes) // 2 or 1) for g in growing]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g.index: np.zeros((size, last - first, bins, channels), np.int64) for g, _, size in new}
        spent = {g.index: np.zeros(2, np.int64) for g in growing}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = np.frombuffer(batch.column(0).buffers()[2], np.uint8)
            start = np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset]
            table = table[start:start + n * d].reshape(n, d)
            y, fold, valid, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 5))
            margins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, -1, classes)
            for g, recent, size in new:
                own = np.flatnonzero(fold != g.index)
                x, target = table[own], y[own]
                margin = margins[own, g.index].copy()
                for tree in recent:
                    margin += tree.value[tree.nodes(x)]
                if held_out and not g.nodes:
                    checked = valid[own]
                    loss = losses(margin[checked], target[checked])
                    times = copies[own][checked]
                    spent[g.index] += (int((np.rint(np.minimum(loss, 1e6) * UNIT).astype(np.int64) * times).sum()), int(times.sum()))
                use = ~valid[own]
                slot = np.zeros(len(own), np.int64)
                if g.nodes:
                    slots = np.full(len(g.tree.feature), -1)
                    for i, side in enumerate(g.built):
                        slots[g.nodes[2 * i + side]] = i
                    slot = slots[g.tree.nodes(x)]
                    use &= slot >= 0
                use = np.flatnonzero(use)
                if not len(use):
                    continue
                steep, curved = slopes(margin[use], target[use])
                times = copies[own][use]
                exact = int(times.sum()) < EXACT_ROWS
                where = ((slot[use][:, None] * (last - first) + np.arange(last - first)) * bins + x[use, first:last]).ravel()
                cells = sums[g.index].reshape(-1, channels)
                for c in range(channels):
                    weight = times if c == channels - 1 else (steep if c < classes else curved)[:, c % classes] * times
                    if exact:
                        cells[:, c] += np.bincount(where, np.repeat(weight, last - first), len(cells)).astype(np.int64)
                    else:
                        np.add.at(cells[:, c], where, np.repeat(weight, last - first))
        for g, _, size in new:
            for at in range(first, last, per_block):
                part = sums[g.index][:, at - first:min(at + per_block, last) - first]
                yield _level_batch(g.index, at // per_block, part, spent[g.index] if at == 0 else np.zeros(2, np.int64), np.zeros(0))

    return rows.coalesce(task_count(rows.sparkSession)).mapInArrow(partial, LEVEL_SCHEMA)


def _level_batch(model: int, block: int, cells: np.ndarray, counts: np.ndarray, gains: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(np.ascontiguousarray(v).ravel())) for v in (cells, counts, gains)]
    return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([block], pa.int32()), *lists], names=["model", "block", "cells", "counts", "gains"])


def best_splits(cells: np.ndarray, classes: int, penalty: float, least: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per node: ``(feature, bin, sums of the left side, sums of the node)``, and the gain.

    Ties go to the lowest feature and then the lowest bin. A node without a split has gain 0.
    """
    nodes, features, bins, channels = cells.shape
    left = np.cumsum(cells, axis=2)[:, :, :-1] if bins > 1 else np.zeros((nodes, features, 0, channels), np.int64)
    whole = cells.sum(axis=2)
    right = whole[:, :, None] - left

    def value(x):
        g, h = x[..., :classes] / UNIT, x[..., classes:2 * classes] / UNIT
        return (g * g / (h + penalty)).sum(axis=-1)

    gain = value(left) + value(right) - value(whole)[:, :, None]
    usable = (left[..., -1] >= least) & (right[..., -1] >= least)
    if allowed is not None:
        usable &= allowed[:, None]
    gain = np.where(usable, gain, 0.0).reshape(nodes, -1)
    counts, gains = np.zeros((nodes, 2 + 2 * channels), np.int64), np.zeros(nodes)
    for i in range(nodes):
        at = int(gain[i].argmax()) if gain.shape[1] else 0
        feature, bin_ = divmod(at, max(bins - 1, 1))
        counts[i, 0], counts[i, 1] = feature, bin_
        counts[i, 2 + channels:] = whole[i, 0]
        if gain.shape[1]:
            counts[i, 2:2 + channels], gains[i] = left[i, feature, bin_], gain[i, at]
    return counts, gains


def level_results(partials: DataFrame, above: DataFrame | None, growing: list[Growth], d: int, bins: int, classes: int, penalty: float, least: int) -> DataFrame:
    """Add up the partial sums, derive the siblings from the level above, and find the best splits of every block."""
    channels = 2 * classes + 1
    per_block = max(1, BLOCK_CELLS // (bins * channels))
    plans = {g.index: (list(g.parents), list(g.built), bool(g.nodes), g.allowed) for g in growing}
    marked = partials.withColumn("parent", F.lit(False))
    if above is not None:
        kept = above.filter(F.col("model").isin([g.index for g in growing])).select("model", "block", "cells", F.array().cast("array<long>").alias("counts"), "gains")
        marked = marked.unionByName(kept.withColumn("parent", F.lit(True)))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, parents, spent = {}, {}, {}
        for batch in batches:
            for model, block, cells, counts, parent in zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2), batch.column(3), batch.column(5).to_pylist()):
                width = min(per_block, d - block * per_block)
                values = cells.values.to_numpy().reshape(-1, width, bins, channels)
                if parent:
                    parents[model, block] = values
                elif (model, block) in sums:
                    sums[model, block] += values
                    spent[model, block] += counts.values.to_numpy()
                else:
                    sums[model, block], spent[model, block] = values.copy(), counts.values.to_numpy().copy()
        for (model, block), built in sums.items():
            chosen, sides, below_root, allowed = plans[model]
            if below_root:
                whole, half = parents[model, block][chosen], built
                built = np.empty((2 * len(half), *half.shape[1:]), np.int64)
                for i, side in enumerate(sides):
                    built[2 * i + side], built[2 * i + 1 - side] = half[i], whole[i] - half[i]
            inside = None if allowed is None else allowed[block * per_block:block * per_block + built.shape[1]]
            counts, gains = best_splits(built, classes, penalty, least, inside)
            counts[:, 0] += block * per_block
            yield _level_batch(model, block, built, np.concatenate([spent[model, block], counts.ravel()]), gains)

    return marked.repartition("model", "block").mapInArrow(combine, LEVEL_SCHEMA)


def cut_points(df: DataFrame, bins: int, sample_rows: int, seed: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cuts per feature: exact quantiles of all rows.

    A small table is aggregated at once. Of a larger one at most about ``sample_rows`` rows, drawn by hash, give pivots only:
    a scan counts the values between and on the pivots, which tells where every wanted rank lies, and a second one gathers
    the few ranges between pivots that hold such a rank. The cuts do not depend on the rows drawn.
    """
    n = df.count()
    if not n:
        return []
    if n <= min(sample_rows, AT_ONCE):
        shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        return [points[points < top] for points, top in _per_feature(df, F.percentile("value", shares))]
    drawn = df.filter(hash52(seed, "cuts", F.col("row_id")) < F.lit(int(min(sample_rows / n, 1.0) * (1 << HASH_BITS))))
    d = known_width(df)
    count = min(MOST_PIVOTS, max(4 * bins, PIVOT_CELLS // max(d, 1)))
    found = _per_feature(drawn, F.expr(f"percentile_approx(value, array({', '.join(f'{i / count!r}D' for i in range(count + 1))}))"))
    pivots = [points for points, _ in found] + [np.zeros(0)] * (d - len(found))
    cells, tops = _count_between(df, pivots)
    return [points[points < top] for points, top in zip(_at_ranks(df, pivots, cells, [i / bins for i in range(1, bins)]), tops)]


def _per_feature(df: DataFrame, points) -> list[tuple[np.ndarray, float]]:
    """Per feature the distinct values of an aggregate of its cells, and its largest value."""
    found = to_long(df, ()).groupBy("feature_idx").agg(F.expr("1").alias("_one"), points.alias("points"), F.max("value").alias("top")).collect()
    out = [(np.zeros(0), 0.0)] * len(found)
    for r in found:
        out[r["feature_idx"]] = np.unique(np.array(r["points"], float)), r["top"]
    return out


def _places(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Twice the number of points below every value, and one more for a value that is a point."""
    return np.searchsorted(points, x, side="left") + np.searchsorted(points, x, side="right")


def _count_between(df: DataFrame, pivots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per feature the numbers of values before, on and between its pivots, and its largest value."""
    d, starts = len(pivots), np.concatenate([[0], np.cumsum([2 * len(p) + 1 for p in pivots])])
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, top = np.zeros(starts[-1], np.int64), np.full(d, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix.batch_matrix(batch.column(0), d)
            top = np.maximum(top, x.max(axis=0))
            for j, points in enumerate(shared.value):
                cells[starts[j]:starts[j + 1]] += np.bincount(_places(x[:, j], points), minlength=2 * len(points) + 1)
        seen = np.flatnonzero(cells)
        at = np.concatenate([seen, -1 - np.arange(d)])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([cells[seen], np.zeros(d, np.int64)])), pa.array(np.concatenate([np.full(len(seen), -np.inf), top]))], names=["at", "n", "top"])

    partial = df.select("features").coalesce(task_count(df.sparkSession)).mapInArrow(count, "at bigint, n bigint, top double")
    table = partial.groupBy("at").agg(F.sum("n").alias("n"), F.max("top").alias("top")).toPandas()
    counts, tops = np.zeros(starts[-1], np.int64), np.zeros(d)
    counted = table["at"] >= 0
    counts[table["at"][counted]] = table["n"][counted]
    tops[-1 - table["at"][~counted].to_numpy()] = table["top"][~counted]
    return [counts[a:b] for a, b in zip(starts[:-1], starts[1:])], tops


def _at_ranks(df: DataFrame, pivots: list[np.ndarray], cells: list[np.ndarray], shares: list[float]) -> list[np.ndarray]:
    """Per feature its distinct percentiles, from the counts between its pivots and the values next to the wanted ranks."""
    d, starts = len(pivots), np.concatenate([[0], np.cumsum([2 * len(p) + 1 for p in pivots])])
    known, open_ = {}, set()
    for j in range(d):
        ends = np.cumsum(cells[j])
        for share in shares:
            position = share * float(ends[-1] - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                place = int(np.searchsorted(ends, rank, side="right"))
                if place % 2:
                    known[j, rank] = float(pivots[j][place // 2])
                else:
                    open_.add((j, rank, int(starts[j]) + place, rank - int(ends[place] - cells[j][place])))
    if open_:
        wanted = np.zeros(starts[-1], bool)
        wanted[[at for _, _, at, _ in open_]] = True
        shared = df.sparkSession.sparkContext.broadcast((pivots, wanted))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, marked = shared.value
            searched = np.flatnonzero([marked[a:b].any() for a, b in zip(starts[:-1], starts[1:])])
            for batch in batches:
                x, parts = matrix.batch_matrix(batch.column(0), d), []
                for j in searched:
                    at = starts[j] + _places(x[:, j], points[j])
                    keep = np.flatnonzero(marked[at])
                    values, first, copies = np.unique(x[keep, j], return_index=True, return_counts=True)
                    parts.append((at[keep][first], values, copies))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in zip(*parts)], names=["at", "value", "n"])

        values = df.select("features").mapInArrow(gather, "at bigint, value double, n bigint").groupBy("at", "value").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("at").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = values.withColumn("upto", F.sum("n").over(upto))
        ranks = F.broadcast(df.sparkSession.createDataFrame(sorted(open_), "feature int, rank bigint, at bigint, inside bigint"))
        hit = (F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n"))
        for r in placed.join(ranks, "at").filter(hit).select("feature", "rank", "value").collect():
            known[r["feature"], r["rank"]] = r["value"]
    out = []
    for j in range(d):
        points = []
        for share in shares:
            position = share * float(cells[j].sum() - 1)
            lower, higher = math.floor(position), math.ceil(position)
            low, high = known[j, lower], known[j, higher]
            points.append(low if low == high else (higher - position) * low + (position - lower) * high)
        out.append(np.unique(np.array(points, float)))
    return out


def binned(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``(bins BINARY, y, fold, valid)``: a byte per feature; rows at most a cut are left of it."""
    d = len(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix.batch_matrix(batch.column(0), d)
            table = np.empty(x.shape, np.uint8)
            for j, points in enumerate(cuts):
                table[:, j] = np.searchsorted(points, x[:, j], side="left")
            offsets = pa.array(np.arange(0, (len(x) + 1) * d, d, dtype=np.int32)[:len(x) + 1] if d else np.zeros(len(x) + 1, np.int32))
            column = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([column, *batch.columns[1:]], names=["bins", "y", "fold", "valid"])

    return df.select("features", "y", "fold", "valid").mapInArrow(code, "bins binary, y double, fold int, valid boolean")


def distinct_rows(coded: DataFrame, base: np.ndarray) -> DataFrame:
    """``(bins, y, fold, valid, margins, copies)``, stored: the table that all rounds read.

    Rows with equal bins, target, fold and part get equal margins and slopes in every round, and sums are integers, so
    such rows become one with their number, and the trees stay the same. When most rows differ they are left as they are.
    """
    keys, sc = ["bins", "y", "fold", "valid"], coded.sparkSession.sparkContext
    total, different = coded.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    if 2 * different <= total:
        rows = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).repartition(max(task_count(coded.sparkSession), different // STORED_ROWS))
    else:
        rows = coded.withColumn("copies", F.lit(1).cast("bigint"))
        if coded.rdd.getNumPartitions() < sc.defaultParallelism:
            rows = rows.repartition(sc.defaultParallelism)  # a small file would keep one task busy
    return cut_lineage(rows.select(*keys, vectors.array_literal(base.ravel()).alias("margins"), "copies"))


def stored_margins(rows: DataFrame, growing: list[Growth], d: int, classes: int) -> DataFrame:
    """The table with the margins of all finished trees, stored again."""
    new = [(g.index, g.trees[g.stored:]) for g in growing]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            start = np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset] if n else 0
            table = np.frombuffer(batch.column(0).buffers()[2], np.uint8)[start:start + n * d].reshape(n, d) if n else np.zeros((0, d), np.uint8)
            margins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, -1, classes).copy()
            for index, trees in new:
                for tree in trees:
                    margins[:, index] += tree.value[tree.nodes(table)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], matrix.list_column(margins.reshape(n, -1)), batch.column(5)], names=batch.schema.names)

    out = cut_lineage(rows.mapInArrow(update, rows.schema))
    for g in growing:
        g.stored = len(g.trees)
    return out


class HistogramBoosting:
    """Boosted trees behind the learner interface, for regression, two and more classes.

    Labels of classification are ``0 .. classes - 1``. ``validation`` is the share of the training rows that only decides
    when to stop: after ``patience`` rounds without a loss that is lower by ``tol`` the model keeps its best number of trees,
    at most ``maxIter``. A table without validation rows runs all rounds.
    """

    def __init__(self, task_type: str, classes: int = 0, seed: int = 0, maxIter: int = 100, maxDepth: int = 5, maxBins: int = 64, stepSize: float = 0.3,
                 penalty: float = 3.0, minInstancesPerNode: int = 1, validation: float = 0.1, patience: int = 5, tol: float = 1e-3, sample_rows: int = 1 << 16, categories: Sequence[int] = ()):
        if not 2 <= maxBins <= 256:
            raise ValueError("between 2 and 256 bins are possible")
        self.task_type, self.seed, self.rounds, self.depth, self.bins, self.rate = task_type, seed, maxIter, maxDepth, maxBins, stepSize
        self.classes = 1 if task_type == "regression" else max(classes, 2)
        self.penalty, self.least, self.validation, self.patience, self.tol, self.sample_rows = penalty, minInstancesPerNode, validation, patience, tol, sample_rows
        self.encoder = TargetEncoder(categories, task_type, classes, seed) if categories else None

    def fit(self, df: DataFrame) -> "BoostedModel":
        if self.encoder is None:
            return self._fit_all(df.withColumn("fold", F.lit(-1)), [0])[0]
        statistics = self.encoder.fit(df)
        model = self._fit_all(statistics.transform_training(df).withColumn("fold", F.lit(-1)), [0])[0]
        model.statistics = statistics
        return model

    def fit_folds(self, df: DataFrame, folds: int, fold: str = "fold", selections: Sequence[Sequence[int]] | None = None) -> list["BoostedModel"]:
        """A model per fold without the rows of that fold, and one of all rows, all from the same scans.

        With ``selections`` (one per model) a model only sees those features, in that order. Target statistics differ
        between the folds, so with categories every model has scans of its own.
        """
        if self.encoder is not None:
            narrow = lambda rows, i: rows if selections is None else rows.withColumn("features", vectors.take(F.col("features"), selections[i]))
            return [self.fit(narrow(df.filter(F.col(fold) != i), i)) for i in range(folds)] + [self.fit(narrow(df, folds))]
        rows = df.withColumn("fold", F.col(fold).cast("int"))
        if selections is None:
            return self._fit_all(rows, list(range(folds + 1)))
        union = sorted({j for s in selections for j in s})
        place = {j: at for at, j in enumerate(union)}
        allowed = [np.array([place[j] for j in s], np.int64) for s in selections]
        models = self._fit_all(rows.withColumn("features", vectors.take(F.col("features"), union)), list(range(folds + 1)), allowed)
        return [m.on_features(own) for m, own in zip(models, allowed)]

    def _fit_all(self, df: DataFrame, models: list[int], allowed: list[np.ndarray] | None = None) -> list["BoostedModel"]:
        table = df.select("row_id", "features", F.col("label").cast("double").alias("y"), "fold",
                          (uniform(self.seed, "valid", F.col("row_id")) < self.validation).alias("valid"))
        centre, scale, base = self._start(table, models)
        cuts = cut_points(table, self.bins, self.sample_rows, self.seed)
        if not cuts:
            raise ValueError("the table has no rows")
        scaled = table.withColumn("y", (F.col("y") - F.lit(centre)) / F.lit(scale)) if self.classes == 1 else table
        rows = distinct_rows(binned(scaled, cuts), base)
        growing = [Growth(m, base[m], None if allowed is None else np.isin(np.arange(len(cuts)), allowed[m])) for m in models]
        active = list(growing)
        for done in range(self.rounds):
            active = self._round(rows, active, len(cuts), done)
            if not active:
                break
            if (done + 1) % REFRESH == 0:
                rows = stored_margins(rows, active, len(cuts), self.classes)
        if active and self.validation > 0:
            self._check(self._level(rows, active, len(cuts), None)[1], active)
        kept = [g.trees[:g.best[1]] if g.best[0] < math.inf else g.trees for g in growing]
        return [BoostedModel(trees, g.base, cuts, self.classes, centre, scale) for g, trees in zip(growing, kept)]

    def _start(self, table: DataFrame, models: list[int]) -> tuple[float, float, np.ndarray]:
        """Centre and scale of a regression target, and the margins before the first tree."""
        base = np.zeros((len(models), self.classes))
        if self.classes == 1:
            r = table.agg(F.avg("y").alias("mean"), F.max("y").alias("high"), F.min("y").alias("low")).first()
            if r["mean"] is None:
                raise ValueError("the table has no rows")
            centre = (r["high"] + r["low"]) / 2  # not the mean, whose last digits depend on the order of the rows
            scale = max(r["high"] - r["low"], 1e-300) / 2 if r["high"] > r["low"] else 1.0
            return float(centre), float(scale), base
        counts = np.zeros((len(models), self.classes))
        for r in table.groupBy("fold", "y").count().collect():
            if r["y"] is None or not 0 <= r["y"] < self.classes or r["y"] != int(r["y"]):
                raise ValueError(f"label {r['y']} is not a class below {self.classes}")
            for i, m in enumerate(models):
                if r["fold"] != m:
                    counts[i, int(r["y"])] += r["count"]
        shares = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
        return 0.0, 1.0, np.log(shares)

    def _level(self, rows: DataFrame, growing: list[Growth], d: int, above: DataFrame | None):
        """The stored histograms of a level, and per model ``(loss sum, loss rows, splits per node)``."""
        channels = 2 * self.classes + 1
        per_block = max(1, BLOCK_CELLS // (self.bins * channels))
        slots = sum(len(g.nodes) // 2 or 1 for g in growing)
        step = max(1, PASS_CELLS // (slots * per_block * self.bins * channels)) * per_block
        partials = None
        for first in range(0, d, step):
            part = partial_histograms(rows, growing, d, self.bins, self.classes, first, min(first + step, d), held_out=first == 0)
            partials = part if partials is None else partials.unionAll(part)
        level = level_results(partials, above, growing, d, self.bins, self.classes, self.penalty, self.least).persist()
        found = {g.index: [0, 0, {}] for g in growing}
        for r in sorted(level.select("model", "block", "counts", "gains").collect(), key=lambda r: (r["model"], r["block"])):
            own = found[r["model"]]
            counts = np.array(r["counts"], np.int64)
            own[0], own[1] = own[0] + int(counts[0]), own[1] + int(counts[1])
            for node, (line, gain) in enumerate(zip(counts[2:].reshape(len(r["gains"]), -1), r["gains"])):
                if node not in own[2] or gain > own[2][node][1]:
                    own[2][node] = (line, gain)
        return level, found

    def _check(self, found: dict, growing: list[Growth]) -> list[Growth]:
        """Note the loss on the validation rows; the models that go on."""
        going = []
        for g in growing:
            total, n, _ = found[g.index]
            if n:
                loss = total / n / UNIT
                if loss < g.best[0] - self.tol:
                    g.best = (loss, len(g.trees))
                if len(g.trees) - g.best[1] >= self.patience:
                    continue
            going.append(g)
        return going

    def _round(self, rows: DataFrame, growing: list[Growth], d: int, done: int) -> list[Growth]:
        """Grow one more tree for every model; the models that go on."""
        channels, levels = 2 * self.classes + 1, []
        for g in growing:
            g.tree, g.nodes, g.parents, g.built = Tree(self.classes), [], [], []
        open_, above = growing, None
        for depth in range(self.depth):
            level, found = self._level(rows, open_, d, above)
            levels.append(level)
            if depth == 0:
                open_ = growing = self._check(found, growing)
            deeper = []
            for g in open_:
                nodes = g.nodes or [0]
                g.parents, g.built, children = [], [], []
                for place, node in enumerate(nodes):
                    line, gain = found[g.index][2][place]
                    if not gain > 1e-9:
                        continue
                    left, whole = line[2:2 + channels], line[2 + channels:]
                    child = g.tree.split(node, int(line[0]), int(line[1]), self._leaf(left), self._leaf(whole - left))
                    g.parents.append(place)
                    g.built.append(0 if 2 * left[-1] <= whole[-1] else 1)
                    children += [child, child + 1]
                g.nodes = children
                if children:
                    deeper.append(g)
            open_, above = deeper, level
            if not open_:
                break
        for level in levels:
            level.unpersist()
        going = []
        for g in growing:
            if g.tree.feature[0] >= 0:  # else no split helps, now or later
                g.trees.append(g.tree)
                going.append(g)
            g.nodes, g.tree = [], None
        return going

    def _leaf(self, sums: np.ndarray) -> np.ndarray:
        g, h = sums[:self.classes] / UNIT, sums[self.classes:2 * self.classes] / UNIT
        return -self.rate * g / (h + self.penalty)


class BoostedModel:
    """Trees with their cuts; adds ``prediction`` and, for classes, ``probability``."""

    def __init__(self, trees: list[Tree], base: np.ndarray, cuts: list[np.ndarray], classes: int, centre: float, scale: float):
        self.trees, self.base, self.cuts, self.classes, self.centre, self.scale = trees, base, cuts, classes, centre, scale
        self.statistics: TargetStatistics | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Values, or the probabilities of all classes, of a matrix of features."""
        table = np.empty(x.shape, np.uint8)
        for j, points in enumerate(self.cuts):
            table[:, j] = np.searchsorted(points, x[:, j], side="left")
        margins = np.broadcast_to(self.base, (len(x), self.classes)).copy()
        for tree in self.trees:
            margins += tree.value[tree.nodes(table)]
        return margins[:, 0] * self.scale + self.centre if self.classes == 1 else softmax(margins)

    def predict(self, df: DataFrame) -> DataFrame:
        from widetab.operators.learn import score_with

        if self.statistics is not None:
            model = copy.copy(self)
            model.statistics = None
            coded = self.statistics.transform(df.withColumn("__codes", F.col("features")))
            return model.predict(coded).withColumn("features", F.col("__codes")).drop("__codes")
        if self.classes == 1:
            return score_with(df, self.scores)
        scored = score_with(df, self.scores, "probability", self.classes)
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return scored.select(*df.columns, best.alias("prediction"), "probability")

    def on_features(self, kept: np.ndarray) -> "BoostedModel":
        """The same model for tables that hold only these of its features, in this order."""
        place = {int(j): at for at, j in enumerate(kept)}
        trees = []
        for tree in self.trees:
            moved = copy.copy(tree)
            moved.feature = np.array([place[int(f)] if f >= 0 else -1 for f in tree.feature], np.int32)
            trees.append(moved)
        return BoostedModel(trees, self.base, [self.cuts[int(j)] for j in kept], self.classes, self.centre, self.scale)

    def used_features(self) -> list[int]:
        return sorted({int(f) for tree in self.trees for f in tree.feature if f >= 0})

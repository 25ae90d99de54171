"""Feature importances from extremely randomised trees (Geurts, Ernst, Wehenkel 2006).

A node looks at ``max_features`` features that vary among its rows, cuts each at random between the smallest and the
largest value it has there, and keeps the cut with the largest decrease of impurity. A node is a leaf when its labels or
all of its features are constant, or at ``max_depth``; there is no other limit.

Everything random is a hash of (seed, tree, path to the node, feature). Large nodes grow level by level: one scan finds the
ranges of all open nodes of all trees, one more the label counts on both sides of their cuts. A node whose rows fit into a
task is handed over: its rows go to one task which grows all that is below it, by the same hashes and the same sums, so
it makes no difference to the result where a node is grown. Only importances come back from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.functions.rng import mix64, stream, unit
from widetab.operators import matrix
from widetab.operators.layout import known_width
from widetab.session import task_count

LOCAL_CELLS = 1 << 22  # feature cells of a node that one task may grow to the end: 32 MB
PASS_CELLS = 1 << 23  # cells of ranges or counts that a task adds up at a time
TARGET_UNIT = 1 << 30  # a regression target is an integer in this share of its range, so that sums are exact


def root_key(seed: int, tree: int) -> int:
    return int(stream(np.uint64(seed % 2**64), tree))


def child_key(key: int, side: int) -> int:
    return int(mix64(stream(np.uint64(key), 2**40 + side)))


def candidates(key: int, low: np.ndarray, high: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``wanted`` features, in the order of the node's hashes, that vary; and where they are cut."""
    order = stream(np.uint64(key), np.arange(len(low)))
    varying = np.flatnonzero(high > low)
    chosen = varying[np.argsort(order[varying], kind="stable")[:wanted]]
    span = high[chosen] - low[chosen]
    cuts = low[chosen] + unit(mix64(order[chosen])) * span
    return chosen, np.where(cuts < high[chosen], cuts, low[chosen])


def worth(sums: np.ndarray) -> np.ndarray:
    """What label sums contribute to a decrease of impurity; the last axis holds the sums and then the rows."""
    values = sums[..., :-1].astype(np.float64)
    return (values * values).sum(axis=-1) / np.maximum(sums[..., -1], 1)


def best_cut(left: np.ndarray, whole: np.ndarray) -> tuple[int, float]:
    """The first of the best candidates and its decrease (times the rows), from the sums left of each cut.

    Decreases per row that agree in 12 decimals are ties.
    """
    gains = worth(left) + worth(whole - left) - worth(whole)
    scale = max(float(whole[-1]), 1.0) * (1.0 if len(whole) > 2 else float(TARGET_UNIT) ** 2)
    at = int(np.round(gains / scale, 12).argmax())
    return at, float(gains[at])


def label_sums(y: np.ndarray, classes: int) -> np.ndarray:
    """Rows of what is added up per row: one per class, or the target; and 1."""
    if classes:
        out = np.zeros((len(y), classes + 1), np.int64)
        out[np.arange(len(y)), y] = 1
    else:
        out = np.stack([y, y], axis=1)
    out[:, -1] = 1
    return out


def left_sums(is_left: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sums of the rows left of each cut. Products of doubles, which are exact here as all sums stay below 2^53."""
    return np.rint(is_left.T.astype(np.float64) @ sums.astype(np.float64)).astype(np.int64)


def grow(x: np.ndarray, y: np.ndarray, classes: int, key: int, wanted: int, depth_left: int | None, importance: np.ndarray) -> None:
    """Grow a node to the end, and add the decreases (times the rows) of all splits to ``importance``."""
    sums = label_sums(y, classes)
    open_ = [(np.arange(len(x)), key, depth_left)]
    while open_:
        rows, key, left_depth = open_.pop()
        if len(rows) < 2 or left_depth == 0:
            continue
        target = y[rows]
        if (target == target[0]).all():
            continue
        own = x[rows]
        features, cuts = candidates(key, own.min(axis=0), own.max(axis=0), wanted)
        if not len(features):
            continue
        is_left = own[:, features] <= cuts
        here = sums[rows]
        at, gain = best_cut(left_sums(is_left, here), here.sum(axis=0))
        importance[features[at]] += gain
        deeper = None if left_depth is None else left_depth - 1
        open_.append((rows[is_left[:, at]], child_key(key, 0), deeper))
        open_.append((rows[~is_left[:, at]], child_key(key, 1), deeper))


class Trees:
    """The upper parts of all trees, as far as they are grown by scans."""

    def __init__(self, seed: int, count: int):
        self.tree, self.key = np.arange(count), np.array([root_key(seed, t) for t in range(count)], np.uint64)
        self.feature, self.cut, self.left = np.full(count, -1), np.zeros(count), np.zeros(count, np.int64)
        self.depth, self.rows = np.zeros(count, np.int64), np.zeros(count, np.int64)

    def split(self, nodes: list[int], features: list[int], cuts: list[float], left_rows: list[int]) -> np.ndarray:
        """Give nodes two children each; the numbers of the children."""
        first, n = len(self.tree), 2 * len(nodes)
        parents = np.repeat(np.array(nodes, np.int64), 2)
        self.feature[nodes], self.cut[nodes], self.left[nodes] = features, cuts, first + 2 * np.arange(len(nodes))
        keys = [child_key(int(self.key[p]), side) for p in nodes for side in (0, 1)]
        rows = np.array([r for p, l in zip(nodes, left_rows) for r in (l, self.rows[p] - l)], np.int64)
        for name, new in (("tree", self.tree[parents]), ("key", np.array(keys, np.uint64)), ("feature", np.full(n, -1)), ("cut", np.zeros(n)), ("left", np.zeros(n, np.int64)),
                          ("depth", self.depth[parents] + 1), ("rows", rows)):
            setattr(self, name, np.append(getattr(self, name), new))
        return np.arange(first, first + n)

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Where the rows stand in a tree."""
        at = np.full(len(x), tree, np.int64)
        open_ = np.arange(len(x)) if self.feature[tree] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            here = at[open_]
            here = self.left[here] + ~(x[open_, self.feature[here]] <= self.cut[here])
            at[open_] = here
            open_ = open_[self.feature[here] >= 0]
        return at


def _segments(trees: Trees, x: np.ndarray, chosen: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(slot, rows)`` for the chosen nodes that hold rows of a batch."""
    slot_of = np.full(len(trees.tree), -1)
    slot_of[list(chosen)] = list(chosen.values())
    for tree in np.unique(trees.tree[list(chosen)]):
        slots = slot_of[trees.nodes(x, int(tree))]
        order = np.argsort(slots, kind="stable")
        found, starts = np.unique(slots[order], return_index=True)
        for slot, rows in zip(found.tolist(), np.split(order, starts[1:])):
            if slot >= 0:
                yield slot, rows


def _summed(partials: DataFrame, schema: str, fold, finish) -> DataFrame:
    """Fold the partial rows of each node, in two steps so that no task gets those of all tasks, and finish them."""

    def combine(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for slot, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                    values = cells.values.to_numpy(zero_copy_only=False)
                    held[slot] = fold(held[slot], values) if slot in held else values
            for slot, values in held.items():
                lists = finish(slot, values) if last else [values]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), *([] if last else [pa.array([0], pa.int32())]), *[pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype))) for v in lists]],
                    names=["slot", *([] if last else ["salt"]), *([f"c{i}" for i in range(len(lists))] if last else ["cells"])])
        return run

    width = max(1, math.isqrt(task_count(partials.sparkSession)))
    kind = dict(partials.dtypes)["cells"]
    first = partials.select("slot", "cells", (F.spark_partition_id() % width).alias("salt")).repartition("slot", "salt")
    halfway = first.select("slot", "cells").mapInArrow(combine(False), f"slot int, salt int, cells {kind}").select("slot", "cells")
    return halfway.repartition("slot").mapInArrow(combine(True), schema)


def grow_level(rows: DataFrame, trees: Trees, open_: list[int], classes: int, d: int, wanted: int) -> list[tuple[int, int, float, float, int]]:
    """``(node, feature, cut, decrease times rows, rows left)`` of the open nodes that can be split, by two scans."""
    found = []
    group = max(1, PASS_CELLS // max(2 * (d + 1), wanted * (max(classes, 1) + 1)))
    for at in range(0, len(open_), group):
        nodes = open_[at:at + group]
        chosen = {node: i for i, node in enumerate(nodes)}

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, seen = (np.full((len(nodes), d + 1), v) for v in (np.inf, -np.inf, 0.0))
            for batch in batches:
                x = matrix.batch_matrix(batch.column(0), d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for slot, own in _segments(trees, x, chosen):
                    part = np.column_stack([x[own], y[own]])
                    low[slot], high[slot] = np.minimum(low[slot], part.min(axis=0)), np.maximum(high[slot], part.max(axis=0))
                    seen[slot] += 1
            for slot in np.flatnonzero(seen[:, 0]):
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.concatenate([-low[slot], high[slot]])])], names=["slot", "cells"])

        def cut(slot: int, cells: np.ndarray) -> list[np.ndarray]:
            low, high = -cells[:d + 1], cells[d + 1:]
            if low[d] == high[d]:  # all labels equal
                return [np.zeros(0), np.zeros(0)]
            return [v.astype(np.float64) for v in candidates(int(trees.key[nodes[slot]]), low[:d], high[:d], wanted)]

        spread = rows.coalesce(task_count(rows.sparkSession))
        partial = spread.mapInArrow(ranges, "slot int, cells array<double>")
        cuts = {r["slot"]: (np.array(r["c0"], np.int64), np.array(r["c1"], float)) for r in _summed(partial, "slot int, c0 array<double>, c1 array<double>", np.maximum, cut).collect()}
        cuts = {slot: c for slot, c in cuts.items() if len(c[0])}
        if not cuts:
            continue
        cuttable = {node: i for node, i in chosen.items() if i in cuts}
        channels = (classes or 1) + 1

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                x = matrix.batch_matrix(batch.column(0), d)
                sums = label_sums(batch.column(1).to_numpy(zero_copy_only=False), classes)
                for slot, own in _segments(trees, x, cuttable):
                    features, where = cuts[slot]
                    left = left_sums(x[np.ix_(own, features)] <= where, sums[own])
                    part = np.vstack([left, sums[own].sum(axis=0)]).ravel()
                    held[slot] = held[slot] + part if slot in held else part
            for slot, part in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([part])], names=["slot", "cells"])

        def choose(slot: int, cells: np.ndarray) -> list[np.ndarray]:
            table = cells.reshape(-1, channels)
            best, gain = best_cut(table[:-1], table[-1])
            return [np.array([best, table[best, -1]], np.float64), np.array([gain])]

        partial = spread.mapInArrow(counts, "slot int, cells array<long>")
        for r in _summed(partial, "slot int, c0 array<double>, c1 array<double>", np.add, choose).collect():
            best, left = (int(v) for v in r["c0"])
            features, where = cuts[r["slot"]]
            found.append((nodes[r["slot"]], int(features[best]), float(where[best]), float(r["c1"][0]), left))
    return sorted(found)


def finish_locally(rows: DataFrame, trees: Trees, handed: list[int], classes: int, d: int, wanted: int, max_depth: int | None) -> DataFrame:
    """``(tree, feature_idx, decrease)``: what the splits below the handed nodes contribute, each node in one task."""
    chosen = {node: node for node in handed}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix.batch_matrix(batch.column(0), d)
            for node, own in _segments(trees, x, chosen):
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int32)), *part.columns], names=["node", "features", "y"])

    def below(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        importance = np.zeros(d)
        x = matrix.batch_matrix(table.column("features"), d)
        left_depth = None if max_depth is None else max_depth - int(trees.depth[node])
        grow(x, table.column("y").to_numpy(), classes, int(trees.key[node]), wanted, left_depth, importance)
        used = np.flatnonzero(importance)
        return pa.table({"tree": np.full(len(used), trees.tree[node], np.int32), "feature_idx": used.astype(np.int32), "decrease": importance[used]})

    routed = rows.mapInArrow(route, "node int, features array<double>, y bigint")
    return routed.groupBy("node").applyInArrow(below, "tree int, feature_idx int, decrease double")


def coded_rows(df: DataFrame, regression: bool) -> tuple[DataFrame, int]:
    """``(features, y BIGINT)`` and the number of classes (0 for regression)."""
    label = F.col("label").cast("double")
    if regression:
        r = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
        if r["low"] is None:
            raise ValueError("the table has no rows")
        span = r["high"] - r["low"] or 1.0
        y = F.rint((label - F.lit((r["high"] + r["low"]) / 2)) / F.lit(span) * F.lit(float(TARGET_UNIT))).cast("bigint")
        return df.select("features", y.alias("y")), 0
    found = sorted(r[0] for r in df.select(label.alias("y")).distinct().collect())
    if not found:
        raise ValueError("the table has no rows")
    codes = F.array(*[F.lit(float(v)) for v in found])
    return df.select("features", (F.array_position(codes, label) - 1).cast("bigint").alias("y")), len(found)


def importances(df: DataFrame, trees: int = 10, seed: int = 0, regression: bool = False, max_features: int | None = None, max_depth: int | None = None, local_rows: int | None = None) -> DataFrame:
    """``(feature_idx, score)``: mean decrease of impurity over the trees, scaled to sum to one.

    ``max_features`` defaults to the root of the width for classes and to all features for regression. ``local_rows``
    is the size of a node that a task may finish; it changes the plan, not the result.
    """
    spark, d = df.sparkSession, known_width(df)
    rows, classes = coded_rows(df, regression)
    rows = rows.persist()
    wanted = max_features or (d if regression else max(1, math.isqrt(d)))
    limit = max(2, LOCAL_CELLS // max(d, 1)) if local_rows is None else local_rows
    forest = Trees(seed, trees)
    total = rows.count()
    forest.rows[:] = total
    totals = np.zeros((trees, d))
    open_, handed = list(range(trees)), []
    try:
        while open_:
            ready = [n for n in open_ if forest.rows[n] >= 2 and (max_depth is None or forest.depth[n] < max_depth)]
            handed += [n for n in ready if forest.rows[n] <= limit]
            large = [n for n in ready if forest.rows[n] > limit]
            splits = grow_level(rows, forest, large, classes, d, wanted) if large else []
            for node, feature, _, gain, _ in splits:
                totals[forest.tree[node], feature] += gain
            open_ = forest.split([s[0] for s in splits], [s[1] for s in splits], [s[2] for s in splits], [s[4] for s in splits]).tolist() if splits else []
        if handed:
            below = finish_locally(rows, forest, handed, classes, d, wanted, max_depth)
            for r in below.groupBy("tree", "feature_idx").agg(F.sum("decrease").alias("decrease")).collect():
                totals[r["tree"], r["feature_idx"]] += r["decrease"]
    finally:
        rows.unpersist()
    shares = totals / np.where(totals.sum(axis=1, keepdims=True) > 0, totals.sum(axis=1, keepdims=True), 1.0)
    mean = shares.mean(axis=0)
    mean = mean / mean.sum() if mean.sum() > 0 else mean
    return spark.createDataFrame(list(enumerate(mean.tolist())), "feature_idx int, score double")


def root_splits(df: DataFrame, trees: int = 10, seed: int = 0, regression: bool = False, max_features: int | None = None) -> DataFrame:
    """``(tree, feature_idx, threshold, decrease, left_rows)`` of the first split of each tree, grown by scans."""
    d = known_width(df)
    rows, classes = coded_rows(df, regression)
    forest = Trees(seed, trees)
    wanted = max_features or (d if regression else max(1, math.isqrt(d)))
    found = grow_level(rows, forest, list(range(trees)), classes, d, wanted)
    return df.sparkSession.createDataFrame(found, "tree int, feature_idx int, threshold double, decrease double, left_rows bigint")

"""Reproducible hold-outs, folds and chunks of exact size.

A row's place follows from the md5 of ``seed:row_id``. Splits with few parts compare that hash with
cut-offs found by counting, so the wide rows themselves are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widetab.functions.rng import hash52
from widetab.operators import ranks
from widetab.operators.layout import checked_broadcast

MAX_CUT_FOLDS = 64


def _keyed(df: DataFrame, seed: int, label: str | None) -> DataFrame:
    group = F.col(label) if label else F.lit(0)
    return df.select(group.alias("g"), hash52(seed, F.col("row_id")).alias("key"), F.col("row_id").alias("tie"))


def class_quotas(sizes: dict, test_size: float) -> dict:
    """Test rows per class: proportional, rounded by largest remainder to ``ceil(test_size * n)``."""
    n = sum(sizes.values())
    total = math.ceil(test_size * n)
    share = {g: total * c / n for g, c in sizes.items()}
    quota = {g: math.floor(s) for g, s in share.items()}
    by_remainder = sorted(sizes, key=lambda g: (quota[g] - share[g], g))
    for g in by_remainder[: total - sum(quota.values())]:
        quota[g] += 1
    return quota


def holdout(df: DataFrame, test_size: float = 0.3, seed: int = 0, label: str | None = None) -> DataFrame:
    """Add ``part`` = ``test`` for exactly ``ceil(test_size * n)`` rows and ``train`` for the others.

    With ``label`` the split is stratified. As usual for stratified splits, a class with one row or
    more classes than rows in a part is an error.
    """
    counted = ranks.Counted(_keyed(df, seed, label))
    sizes = counted.sizes
    if not sizes:
        raise ValueError("cannot split an empty table")
    n = sum(sizes.values())
    total = math.ceil(test_size * n)
    if not 0 < total < n:
        raise ValueError(f"test_size={test_size} of {n} rows leaves an empty part")
    if label:
        if min(sizes.values()) < 2:
            raise ValueError("a stratified split needs at least two rows of every class")
        if total < len(sizes) or n - total < len(sizes):
            raise ValueError("a part of the split is smaller than the number of classes")
    quota = class_quotas(sizes, test_size)
    found = counted.cutoffs({g: [q] for g, q in quota.items() if q > 0})
    counted.release()
    cuts = {g: found[g, q] for g, q in quota.items() if q > 0}
    keyed = df.withColumn("_k", hash52(seed, F.col("row_id")))
    key, tie = F.col("_k"), F.col("row_id")
    if not label:
        cut_key, cut_tie = cuts[0]
        chosen = ranks.not_after(key, tie, F.lit(cut_key), F.lit(cut_tie))
        return keyed.withColumn("part", F.when(chosen, "test").otherwise("train")).drop("_k")
    joined = _join_cuts(keyed, label, [(g, *c) for g, c in cuts.items()], "_key bigint, _tie {tie}")
    chosen = F.coalesce(ranks.not_after(key, tie, F.col("_key"), F.col("_tie")), F.lit(False))
    return joined.withColumn("part", F.when(chosen, "test").otherwise("train")).drop("_k", "_key", "_tie")


def _join_cuts(df: DataFrame, label: str, cuts: list[tuple], fields: str) -> DataFrame:
    """Attach per-class values. Their number was limited when they were found, so they are broadcast."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = fields.format(tie=types["row_id"])
    small = df.sparkSession.createDataFrame(cuts, f"_label {types[label]}, {fields}")
    return df.join(F.broadcast(small), df[label] == small["_label"], "left").drop("_label")


def fold_layout(sizes: dict, k: int) -> dict:
    """Per class the fold of each of its ``k`` consecutive blocks and the last rank in the block.

    Larger blocks start where the class before stopped, so folds differ by at most one row both inside
    every class and over all rows.
    """
    layout, offset = {}, 0
    for g in sorted(sizes):
        small, extra = divmod(sizes[g], k)
        ends, end = [], 0
        for t in range(k):
            end += small + (1 if t < extra else 0)
            ends.append(((offset + t) % k, end))
        layout[g] = ends
        offset += sizes[g]
    return layout


def kfold(df: DataFrame, k: int = 8, seed: int = 0, label: str | None = None, out: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1, stratified when ``label`` is given; usable as a ``foldCol``."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    counted = ranks.Counted(_keyed(df, seed, label))
    sizes = counted.sizes
    if sum(sizes.values()) < k:
        raise ValueError(f"{sum(sizes.values())} rows cannot fill {k} folds")
    if k > MAX_CUT_FOLDS:
        folds = _blocks(counted, k).select("row_id", F.col("chunk").alias(out))
        return df.join(folds, "row_id")
    layout = fold_layout(sizes, k)
    wanted = {g: sorted({end for _, end in blocks[:-1] if 0 < end < sizes[g]}) for g, blocks in layout.items()}
    found = counted.cutoffs(wanted)
    counted.release()
    # The hash is a column of its own, so that it is computed once and not for every comparison.
    keyed = df.withColumn("_k", hash52(seed, F.col("row_id")))
    key, tie = F.col("_k"), F.col("row_id")
    if not label:
        return keyed.withColumn(out, _fold_of(key, tie, _steps(layout[0], sizes[0], lambda e: found[0, e]))).drop("_k")
    cuts = [
        (g, [(fold, *(cut or (None, None))) for fold, cut in _steps(blocks, sizes[g], lambda e, g=g: found[g, e])])
        for g, blocks in layout.items()
    ]
    joined = _join_cuts(keyed, label, cuts, "_cuts array<struct<fold:int,key:bigint,tie:{tie}>>")
    inside = F.filter(
        F.col("_cuts"),
        lambda c: c["key"].isNull() | ranks.not_after(key, tie, c["key"], c["tie"]),
    )
    return joined.withColumn(out, F.get(inside, F.lit(0))["fold"]).drop("_k", "_cuts")


def _steps(blocks: list, size: int, cut) -> list:
    """``(fold, cut-off or None)`` for the non-empty blocks in rank order; the last has no cut-off."""
    steps, start = [], 0
    for fold, end in blocks:
        if end > start:
            steps.append((fold, cut(end) if end < size else None))
        start = end
    return steps


def _fold_of(key: Column, tie: Column, steps: list) -> Column:
    expr = F.lit(steps[-1][0])
    for fold, cut in reversed(steps[:-1]):
        expr = F.when(ranks.not_after(key, tie, F.lit(cut[0]), F.lit(cut[1])), fold).otherwise(expr)
    return expr.cast("int")


CHUNKS_SENT = 1_000_000  # chunk numbers broadcast at most


def chunk_table(df: DataFrame, k: int, seed: int = 0, label: str | None = None) -> DataFrame:
    """``(row_id, label, chunk)`` with the block layout of :func:`kfold`, for any number of chunks.

    Ranks are exact and distributed; only keys are shuffled, the features stay where they are. Without
    ``label`` the label column is 0.
    """
    return _blocks(ranks.Counted(_keyed(df, seed, label)), k)


def _blocks(counted: ranks.Counted, k: int) -> DataFrame:
    placed = counted.ranked()
    sizes = placed.sparkSession.createDataFrame(
        _class_offsets(counted.sizes), f"g {counted.group_type}, size bigint, class_offset bigint"
    )
    joined = placed.join(F.broadcast(sizes), "g")
    small = F.floor(F.col("size") / F.lit(k))
    extra = F.col("size") - small * k
    rank0 = F.col("rank") - 1
    block = F.when(rank0 < extra * (small + 1), F.floor(rank0 / (small + 1))).otherwise(
        extra + F.floor((rank0 - extra * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    chunk = F.pmod(F.col("class_offset") + block, F.lit(k)).cast("int")
    return joined.select(F.col("tie").alias("row_id"), F.col("g").alias("label"), chunk.alias("chunk"))


def _class_offsets(sizes: dict) -> list[tuple]:
    rows, offset = [], 0
    for g in sorted(sizes):
        rows.append((g, sizes[g], offset))
        offset += sizes[g]
    return rows


def chunks(df: DataFrame, max_rows: int = 256, seed: int = 0, label: str | None = None) -> DataFrame:
    """``(row_id, label, chunk)``: the table cut into ``max(2, ceil(n / max_rows))`` even chunks."""
    counted = ranks.Counted(_keyed(df, seed, label))
    k = max(2, math.ceil(sum(counted.sizes.values()) / max(1, max_rows)))
    placed = _blocks(counted, k)
    if label:
        return placed
    return placed.drop("label").join(df.select("row_id", "label"), "row_id")


def chunk_holdout(chunked: DataFrame, test_size: float = 0.3, seed: int = 0, stratify: bool = True) -> DataFrame:
    """Add ``part`` inside every chunk: stratified where each class has two rows, plain elsewhere.

    Chunks are bounded by construction, so windows over one chunk are small whatever the class sizes
    of the table are. Columns in: ``row_id, label, chunk``.
    """
    by_chunk, by_class = Window.partitionBy("chunk"), Window.partitionBy("chunk", "label")
    sized = chunked.withColumn("_n", F.count(F.lit(1)).over(by_chunk))
    sized = sized.withColumn("_c", F.count(F.lit(1)).over(by_class))
    sized = sized.withColumn("_key", hash52(seed, F.col("row_id")))
    sized = sized.withColumn("_total", F.ceil(F.col("_n") * F.lit(test_size)))
    classes = F.size(F.collect_set("label").over(by_chunk))
    fits = (
        (F.min("_c").over(by_chunk) >= 2)
        & (F.col("_total") >= classes)
        & (F.col("_n") - F.col("_total") >= classes)
    )
    sized = sized.withColumn("_stratified", F.lit(stratify) & fits)
    share = F.col("_total") * F.col("_c") / F.col("_n")
    sized = sized.withColumn("_floor", F.floor(share)).withColumn("_rest", share - F.floor(share))
    sized = sized.withColumn("_class_row", F.row_number().over(by_class.orderBy("_key", "row_id")))
    # One row per class carries its quota, so that sums over the chunk count each class once.
    first = F.col("_class_row") == 1
    sized = sized.withColumn("_spare", F.col("_total") - F.sum(F.when(first, F.col("_floor"))).over(by_chunk))
    by_rest = by_chunk.orderBy(F.col("_rest").desc(), F.col("label").asc())
    sized = sized.withColumn("_class_rank", F.dense_rank().over(by_rest))
    quota = F.col("_floor") + F.when(F.col("_class_rank") <= F.col("_spare"), 1).otherwise(0)
    plain = F.row_number().over(by_chunk.orderBy("_key", "row_id")) <= F.col("_total")
    chosen = F.when(F.col("_stratified"), F.col("_class_row") <= quota).otherwise(plain)
    return sized.select(
        *chunked.columns, F.when(chosen, "test").otherwise("train").alias("part"), F.col("_stratified").alias("stratified")
    )


def class_coverage(parts: DataFrame) -> DataFrame:
    """Chunks with the number of classes in both parts, and whether the numbers are equal.

    Columns in: ``chunk, label, part``. Distinct (chunk, label, part) first, so that the second
    aggregate only sees as many rows as there are classes.
    """
    seen = parts.select("chunk", "label", "part").distinct()
    side = lambda name: F.count(F.when(F.col("part") == name, 1))
    return (
        seen.groupBy("chunk")
        .agg(side("train").alias("n_train"), side("test").alias("n_test"))
        .withColumn("covered", F.col("n_train") == F.col("n_test"))
    )


def ordered_split(df: DataFrame, fraction: float = 0.8, order: str = "row_id", leaf: int = 1 << 16) -> DataFrame:
    """``train`` for the first ``floor(fraction * n)`` rows by a distinct ``order`` column.

    The boundary value is found by counting in ranges, so nothing is sorted as a whole; ``order`` may have any type
    that can be sorted.
    """
    n = df.count()
    boundary = math.floor(n * fraction)
    if boundary == 0:
        return df.withColumn("part", F.lit("test"))
    last = _value_at_rank(df.select(order), order, boundary, n, leaf)
    return df.withColumn("part", F.when(F.col(order) <= F.lit(last), "train").otherwise("test"))


def _value_at_rank(df: DataFrame, order: str, rank: int, n: int, leaf: int = 1 << 16):
    """The value at an exact rank, whatever its type: pivots of that type cut the rows into ranges, the ranges are
    counted, and only the range that holds the rank goes on, until it can be sorted.
    """
    before, step = 0, 0
    while n > leaf:
        points = ranks.pivots(df, order, 256, step)
        found = ranks.range_of(F.col(order), points)
        counts = sorted((r["b"], r["n"]) for r in df.groupBy(found.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        for b, size in counts:
            if rank <= before + size:
                break
            before += size
        if b > 0:
            df = df.filter(F.col(order) >= F.lit(points[b - 1]))
        if b < len(points):
            df = df.filter(F.col(order) < F.lit(points[b]))
        if size == n:  # only when all rows have one value
            return points[b - 1]
        n, step = size, step + 1
    window = Window.orderBy(order)  # at most ``leaf`` rows
    return df.select(order, F.row_number().over(window).alias("_rn")).filter(F.col("_rn") == rank - before).first()[0]


def boundary_split(df: DataFrame, flag: str = "is_test") -> DataFrame:
    """Split at the remembered border between an appended test table and the training rows."""
    return df.withColumn("part", F.when(F.col(flag), "test").otherwise("train"))


def schedule(datasets: DataFrame, repeats: int = 10, folds: int = 3, seed: int = 0) -> DataFrame:
    """Repeats x folds for every row of ``datasets`` with ``rep_seed`` and ``fold_seed``."""
    expanded = datasets.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    )
    rep_seed = F.lit(seed) + F.lit(100) * F.col("repeat")
    return expanded.withColumn("rep_seed", rep_seed).withColumn("fold_seed", F.col("rep_seed") + F.col("fold"))


def published_part(data: DataFrame, splits: DataFrame, repeat: int, fold: int, part: str) -> DataFrame:
    """Rows of one side of a published split ``(row_id, repeat, fold, part)``.

    The split table grows with the data, so it is broadcast only when a look at it shows it is small.
    """
    chosen = splits.filter(
        (F.col("repeat") == repeat) & (F.col("fold") == fold) & (F.col("part") == part)
    ).select("row_id")
    return data.join(checked_broadcast(chosen), "row_id", "left_semi")


def published_parts(data: DataFrame, splits: DataFrame) -> DataFrame:
    """Every (repeat, fold, part) of a published split beside the rows of the data."""
    return data.join(splits, "row_id")

"""Exact ranks inside groups without putting a group into one task.

``row_number() over (partition by label)`` sends every row of a class to one task; with a class that
holds a third of a large table that task never ends. Here rows are ordered by a hashed key, which is
uniform, so its leading bits cut every group into equally large buckets. Counting buckets is a
map-side combined aggregate, and only (group, bucket) pieces are ever sorted.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widetab.functions.rng import HASH_BITS, hash52
from widetab.session import cut_lineage

FIRST_BITS = 8
MAX_BITS = 24
ROWS_PER_BUCKET = 1_000_000
LOCAL_COUNTS = 200_000
MAX_GROUPS = 100_000
MAX_CUTOFFS = 100_000
MAX_RANGES = 256


def _bucket(key: Column, bits: int) -> Column:
    return F.shiftright(key, HASH_BITS - bits).cast("int")


def bucket_counts(rows: DataFrame, bits: int) -> DataFrame:
    """``(g, bucket, n, before)`` from ``(g, key, tie)``: bucket sizes and the rows of the group ahead."""
    counts = rows.groupBy("g", _bucket(F.col("key"), bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("bigint"))


class Counted:
    """Bucket counts of ``(g, key, tie)`` rows, kept for the steps that follow, and the group sizes.

    The first count uses few buckets. Only when a group is so large that such a bucket is too much for
    one task are the rows counted again with more of them. A limited number of counts is summed up on
    the driver; more of them stay a table. Groups are classes of a target, so their number is limited.
    """

    def __init__(self, rows: DataFrame, bits: int | None = None):
        self.rows, self.bits = rows, bits or FIRST_BITS
        self.local = self._collect_counts()
        self.sizes = self._sizes()
        if None in self.sizes:
            raise ValueError(f"{self.sizes[None]} rows have no class; drop or fill missing targets first")
        needed = math.ceil(math.log2(max(1, max(self.sizes.values(), default=0) / ROWS_PER_BUCKET)))
        if bits is None and needed > self.bits:
            self.release()
            self.bits = min(MAX_BITS, needed)
            self.local = self._collect_counts()

    def _collect_counts(self) -> list[tuple] | None:
        """``(g, bucket, n, before)`` rows on the driver, or None when there are too many of them."""
        bucket = _bucket(F.col("key"), self.bits).alias("bucket")
        found = self.rows.groupBy("g", bucket).agg(F.count(F.lit(1)).alias("n")).limit(LOCAL_COUNTS + 1).collect()
        if len(found) > LOCAL_COUNTS:
            self.counts = bucket_counts(self.rows, self.bits).persist()
            return None
        rows, before = [], {}
        for r in sorted(found, key=lambda r: r["bucket"]):
            rows.append((r["g"], r["bucket"], r["n"], before.get(r["g"], 0)))
            before[r["g"]] = before.get(r["g"], 0) + r["n"]
        schema = f"g {self.group_type}, bucket int, n bigint, before bigint"
        self.counts = self.rows.sparkSession.createDataFrame(rows, schema)
        return rows

    def _sizes(self) -> dict:
        if self.local is not None:
            sizes: dict = {}
            for g, _, n, before in self.local:
                sizes[g] = max(sizes.get(g, 0), before + n)
            return sizes
        found = self.counts.groupBy("g").agg(F.sum("n").alias("n")).limit(MAX_GROUPS + 1).collect()
        if len(found) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups")
        return {r["g"]: r["n"] for r in found}

    @property
    def group_type(self) -> str:
        return self.rows.schema["g"].dataType.simpleString()

    def release(self) -> None:
        if self.local is None:
            self.counts.unpersist()

    def ranked(self) -> DataFrame:
        """Add ``rank`` (from 1) of every row in its group by ``(key, tie)``.

        The rows are sorted inside (group, bucket); adding the rows in the buckets ahead gives the rank.
        A limited number of counts is broadcast; otherwise both sides are distributed by (group, bucket)
        and share one shuffle of the key columns.
        """
        inside = Window.partitionBy("g", "bucket").orderBy("key", "tie")
        placed = self.rows.withColumn("bucket", _bucket(F.col("key"), self.bits)).withColumn("_rn", F.row_number().over(inside))
        ahead = self.counts.select("g", "bucket", "before")
        joined = placed.join(ahead if self.local is None else F.broadcast(ahead), ["g", "bucket"])
        return joined.select("g", "key", "tie", (F.col("before") + F.col("_rn")).cast("bigint").alias("rank"))

    def cutoffs(self, wanted: Mapping[object, Sequence[int]]) -> dict:
        """``{(group, rank): (key, tie)}`` of the rows at the wanted ranks.

        The kept counts name the bucket of each rank; one pass over the rows sorts only those buckets.
        """
        pairs = [(g, int(r)) for g, ranks in wanted.items() for r in ranks]
        if not pairs:
            return {}
        if len(pairs) > MAX_CUTOFFS:
            raise ValueError(f"more than {MAX_CUTOFFS} cut-offs; use ranked() instead")
        spark = self.rows.sparkSession
        plan = self._locate(pairs)
        wanted_rows = F.broadcast(spark.createDataFrame(
            plan, f"g {self.group_type}, bucket int, wanted bigint, _rn bigint"
        ))
        edges = F.broadcast(spark.createDataFrame(
            sorted({(g, b) for g, b, _, _ in plan}), f"g {self.group_type}, bucket int"
        ))
        edge_rows = self.rows.withColumn("bucket", _bucket(F.col("key"), self.bits)).join(edges, ["g", "bucket"], "left_semi")
        order = Window.partitionBy("g", "bucket").orderBy("key", "tie")
        numbered = edge_rows.withColumn("_rn", F.row_number().over(order).cast("bigint"))
        hits = numbered.join(wanted_rows, ["g", "bucket", "_rn"]).select("g", "wanted", "key", "tie")
        return {(r["g"], r["wanted"]): (r["key"], r["tie"]) for r in hits.collect()}

    def _locate(self, pairs: list[tuple]) -> list[tuple]:
        """``(g, bucket, rank, rank inside the bucket)`` of the wanted ranks."""
        if self.local is not None:
            by_group: dict = {}
            for g, bucket, _, before in self.local:
                by_group.setdefault(g, ([], []))
                by_group[g][0].append(before)
                by_group[g][1].append(bucket)
            plan = []
            for g, rank in pairs:
                befores, buckets = by_group[g]
                at = bisect.bisect_left(befores, rank) - 1
                plan.append((g, buckets[at], rank, rank - befores[at]))
            return plan
        targets = F.broadcast(self.rows.sparkSession.createDataFrame(pairs, f"g {self.group_type}, wanted bigint"))
        inside = (F.col("wanted") > F.col("before")) & (F.col("wanted") <= F.col("before") + F.col("n"))
        located = self.counts.join(targets, "g").filter(inside)
        local = (F.col("wanted") - F.col("before")).alias("_rn")
        return [tuple(r) for r in located.select("g", "bucket", "wanted", local).collect()]


def not_after(key: Column, tie: Column, cut_key: Column, cut_tie: Column) -> Column:
    """True for rows at or before a cut-off in ``(key, tie)`` order."""
    return (key < cut_key) | ((key == cut_key) & (tie <= cut_tie))


def pivots(df: DataFrame, column: str, count: int, seed: int = 0) -> list:
    """At most ``count`` values of a column, in its own type and order: those with the smallest hashes.

    They only balance the work: results computed range by range do not depend on them.
    """
    key = hash52(seed, F.col(column))
    drawn = df.filter(F.col(column).isNotNull()).orderBy(key, column).limit(count)
    return [r[0] for r in drawn.select(column).distinct().orderBy(column).collect()]


def range_of(value: Column, points: Sequence) -> Column:
    """How many of the pivots are not above ``value``; compared in the column's own type."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= value))


def range_count(rows: int, rows_per_bucket: int) -> int:
    """Partitions for ranges of about ``rows_per_bucket`` rows; more than ``MAX_RANGES`` only if ranges would exceed ``ROWS_PER_BUCKET``."""
    return max(1, min(-(-rows // rows_per_bucket), max(MAX_RANGES, -(-rows // ROWS_PER_BUCKET))))


def running_totals(df: DataFrame, order: str, values: Sequence[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``<value>_before``: the exclusive prefix sum of each value in ascending ``order``.

    ``order`` must be distinct (aggregate ties first). The rows are range-partitioned, sorted inside the partitions and
    stored; one total per partition tells what lies before it, and a second pass streams through the partitions and
    adds up. Small ranges are joined up to ``MAX_RANGES`` partitions: beyond that their number only grows with the rows that
    a task can sort, not with ``rows_per_bucket``, for every partition is a task and a stored file.
    """
    spark = df.sparkSession
    parts = range_count(df.count(), rows_per_bucket)
    placed = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    stored = cut_lineage(placed)
    totals = stored.groupBy("_p").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_p").collect()
    before, sums = {}, [0] * len(values)
    for r in totals:
        before[r["_p"]] = list(sums)
        sums = [s + (r[v] or 0) for s, v in zip(sums, values)]
    places = [stored.columns.index(v) for v in values]
    at, offsets = len(stored.columns) - 1, spark.sparkContext.broadcast(before)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{v}_before", _sum_type(df.schema[v].dataType)) for v in values]])

    def stream(batches):
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = list(offsets.value[batch.column(at)[0].as_py()]) if sums is None else sums
            added = []
            for i, place in enumerate(places):
                own = batch.column(place).fill_null(0).to_numpy(zero_copy_only=False)
                own = own.astype(np.int64 if own.dtype.kind in "iub" else np.float64)
                running = np.cumsum(own)
                added.append(pa.array(running - own + sums[i]))
                sums[i] = sums[i] + running[-1].item()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *added], names=[f.name for f in schema.fields])

    return stored.mapInArrow(stream, schema)


def _sum_type(dtype: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(dtype, (T.FloatType, T.DoubleType)) else T.LongType()

"""Bottom-k sketches of 5-word shingles, with DataFrame functions only.

A sketch is the number of distinct shingles of a text and the ``K`` smallest of their 64-bit hashes in order. The
sketch of a union is the ``K`` smallest of the hashes of its parts (``merged``), so sketches of parts can be combined
in any order. Texts with at most ``K`` shingles are compared exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE = 128, 5
LAST = (1 << 63) - 1  # stands for a null id


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column) -> Column:
    """Distinct hashes of all shingles; a text of one to four words has one, a text without words none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def combine(w: Column) -> Column:
        runs = F.transform(
            F.slice(w, F.lit(1), F.size(w) - (SHINGLE - 1)),
            lambda h, i: F.xxhash64(h, *[F.get(w, i + j) for j in range(1, SHINGLE)]),
        )
        return F.when(F.size(w) >= SHINGLE, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
            F.array().cast("array<bigint>"))

    return once(F.transform(words, lambda x: F.xxhash64(x)), combine)


def sketch(text: Column) -> Column:
    """``struct<n: int, low: array<bigint>>``."""
    return once(shingle_hashes(text), lambda s: F.struct(F.size(s).alias("n"), F.slice(F.sort_array(s), 1, K).alias("low")))


def written(s: Column) -> Column:
    """The sketch as text: the count of distinct shingles, then the hashes in hexadecimal. Equal texts, equal strings."""
    return F.concat_ws(":", s["n"].cast("string"), F.array_join(F.transform(s["low"], lambda h: F.hex(h)), ","))


def merged(a: Column, b: Column) -> Column:
    """The lowest hashes of the union of two texts' shingles, from their lowest hashes."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, K)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated intersection over union; 1 for two texts without shingles, 0 if only one has none."""
    def share(low: Column) -> Column:
        common = F.size(F.array_intersect(low, F.array_intersect(a["low"], b["low"])))
        return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(common / F.size(low))

    return F.when(a["low"] == b["low"], F.lit(1.0)).otherwise(once(merged(a["low"], b["low"]), share))


def distinct_shingles(low: Column) -> Column:
    """Estimated size of a set from its lowest hashes alone, exact below ``K``: for merged sketches without a count."""
    reached = (F.element_at(low, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(low) < K, F.size(low).cast("double")).otherwise((K - 1) / reached)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has, from the resemblance and the counts."""
    r = resemblance(a, b)
    common = r / (1 + r) * (a["n"] + b["n"])
    return F.when(a["n"] == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / a["n"]))


def id_ranges(docs: DataFrame, parts: int) -> list[int]:
    """The smallest id of each of about ``parts`` equal ranges: as many numbers as parts, whatever the rows."""
    spread = docs.select("__id").repartitionByRange(parts, "__id")
    rows = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.min("__id").alias("low")).collect()
    return sorted({r["low"] for r in rows})


def range_of(value: Column, lows: list[int]) -> Column:
    """The number of the range a value is in, looked up in two steps of about the square root of the ranges each."""
    step = max(1, math.isqrt(len(lows)))
    coarse = F.array(*[F.lit(x).cast("long") for x in lows[::step]])
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in lows[i:i + step]]) for i in range(0, len(lows), step)])
    block = F.size(F.filter(coarse, lambda x: x <= value)) - 1
    return once(block, lambda b: b * step + F.size(F.filter(F.get(fine, b), lambda x: x <= value)) - 1)


def with_next(docs: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Rows ``__id, text, ...`` with ``next_<column>`` of the row that follows by id, the first row following the last.

    Rows travel once, to ranges of ids; the first row of a range also visits the range before it.
    """
    lows = id_ranges(docs, parts)
    if not lows:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    ranged = docs.withColumn("__range", range_of(F.col("__id"), lows))
    firsts = F.array(*[F.lit(x).cast("long") for x in lows])
    before = F.when(F.col("__range") == 0, len(lows) - 1).otherwise(F.col("__range") - 1)
    own = F.struct(F.col("__range").alias("range"), F.lit(0).alias("visit"))
    visit = F.struct(before.alias("range"), F.lit(1).alias("visit"))
    begins = F.get(firsts, F.col("__range")) == F.col("__id")
    spread = ranged.withColumn("__at", F.explode(F.when(begins, F.array(own, visit)).otherwise(F.array(own)))).select(
        *docs.columns, F.col("__at.range").alias("__range"), F.col("__at.visit").alias("__visit"))
    order = Window.partitionBy("__range").orderBy("__visit", "__id", "text")
    return spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("__visit = 0").drop("__range", "__visit")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the text that follows, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and
    ``n_shingles, in_edited`` (share of the text's shingles that its edited text has).

    A null text is empty. Rows follow each other by id, then text; null ids come last. Texts are compared in lower case.
    An empty table gives no rows; the only row of a table follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("__id"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = with_next(rows.withColumn("own", sketch(F.col("text"))), ["text", "own"], parts)
    edited = near.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).withColumn("other", sketch(F.col("edited")))
    return edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"), resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
        F.col("own.n").cast("long").alias("n_shingles"), containment(F.col("own"), F.col("other")).alias("in_edited"),
    )

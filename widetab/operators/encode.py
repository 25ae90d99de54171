"""Type-driven encoding of columns and of the target.

Two-valued columns become 0/1, strings become codes in sorted order, timestamps are expanded, constant
and duplicate columns are dropped. Everything is learnt from the training rows; a value that was not
seen there gets the most frequent code, as a missing value would.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widetab.operators.layout import checked_broadcast, columns_by_type, number
from widetab.operators.stats import long_cells
from widetab.session import cut_lineage

LITERAL_CODES = 256  # categories written into the plan; longer code tables are joined
HOT_SHARE = 200  # a value with more than this part of the rows is coded by a broadcast table
SALTS = 1024
MAX_CLASSES = 100_000
DATE_PARTS = ("year", "month", "day", "dayofweek")


# --- target -------------------------------------------------------------------------------------


class LabelCoder(Estimator):
    """Class ids 0, 1, ... in the sorted order of the labels' own type (10 comes after 2)."""

    def __init__(self, label: str = "label", out: str = "label"):
        super().__init__()
        self.label, self.out = label, out

    def _fit(self, df: DataFrame) -> "LabelCoderModel":
        rows = df.select(self.label).filter(F.col(self.label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes; is this a regression target?")
        return LabelCoderModel(self.label, self.out, sorted(r[0] for r in rows), df.schema[self.label].dataType.simpleString())


class LabelCoderModel(Model):
    def __init__(self, label: str, out: str, classes: list, dtype: str | None = None):
        super().__init__()
        self.label, self.out, self.classes, self.dtype = label, out, classes, dtype

    def _transform(self, df: DataFrame) -> DataFrame:
        if len(self.classes) <= LITERAL_CODES:
            return df.withColumn(self.out, code_of(F.col(self.label), self.classes))
        dtype = df.schema[self.label].dataType.simpleString()
        rows = [(v, i) for i, v in enumerate(self.classes)]
        codes = df.sparkSession.createDataFrame(rows, f"_value {dtype}, _code int")
        joined = df.join(F.broadcast(codes), df[self.label] == codes["_value"], "left")
        return joined.withColumn(self.out, F.col("_code")).drop("_value", "_code")

    def unseen(self, df: DataFrame) -> int:
        """Rows whose label was not in the training rows."""
        marked = self.transform(df.withColumn("_had", F.col(self.label).isNotNull()))
        return marked.filter(F.col("_had") & F.col(self.out).isNull()).count()


def code_of(value: Column, ordered: Sequence) -> Column:
    """Position of ``value`` in a short list, NULL when absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in ordered]), value)
    return F.when(position > 0, (position - 1).cast("int"))


# --- features -----------------------------------------------------------------------------------


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the values present, in one pass for all columns."""
    cells = long_cells(df, columns, "string").filter(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def sorted_codes(counts: DataFrame) -> DataFrame:
    """``(column, value, n, code)``: codes in sorted order for columns of any cardinality.

    A range-partitioned sort numbers the rows of each partition; adding the sizes of the partitions
    before gives the position, so no column is ever sorted in one task. The numbered rows are
    checkpointed, because row numbers must not change if a task is retried.
    """
    numbered = cut_lineage(counts.orderBy("column", "value").withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    if not offsets:
        return counts.withColumn("code", F.lit(0))
    shared = F.broadcast(counts.sparkSession.createDataFrame(offsets, "_part int, _before bigint"))
    placed = numbered.join(shared, "_part").withColumn("_pos", F.col("_before") + F.col("_row"))
    starts = placed.groupBy("column").agg(F.min("_pos").alias("_start"))
    return placed.join(checked_broadcast(starts), "column").select(
        "column", "value", "n", (F.col("_pos") - F.col("_start")).cast("int").alias("code")
    )


def column_fingerprints(df: DataFrame, columns: Sequence[str], row_id: str, dtype: str) -> DataFrame:
    """``(column, fp1, fp2)``: order-free hashes over (row, value) that are equal for equal columns."""
    cell = lambda c: F.struct(
        F.lit(c).alias("column"), F.xxhash64(F.col(row_id), F.col(f"`{c}`").cast(dtype)).alias("h")
    )
    cells = df.select(F.inline(F.array(*[cell(c) for c in columns])))
    return cells.groupBy("column").agg(
        F.bit_xor("h").alias("fp1"), F.sum(F.pmod("h", F.lit(2**31 - 1))).alias("fp2")
    )


def duplicate_columns(df: DataFrame, columns: Sequence[str], row_id: str, summaries: dict | None = None) -> dict[str, str]:
    """``{column: earlier equal column}``.

    Columns with equal ``summaries`` (anything already known that equal columns share) get fingerprints;
    equal fingerprints are candidates, and a last scan of those pairs confirms them.
    """
    order = {c: i for i, c in enumerate(columns)}
    numeric = set(columns_by_type(df, "number")) | set(columns_by_type(df, "boolean"))
    if summaries is not None:
        shared = Counter(summaries[c] for c in columns)
        columns = [c for c in columns if shared[summaries[c]] > 1]
    pairs = []
    for dtype, group in (
        ("double", [c for c in columns if c in numeric]),
        ("string", [c for c in columns if c not in numeric]),
    ):
        if len(group) < 2:
            continue
        first: dict = {}
        prints = column_fingerprints(df, group, row_id, dtype).collect()
        for r in sorted(prints, key=lambda r: order[r["column"]]):
            keeper = first.setdefault((r["fp1"], r["fp2"]), r["column"])
            if keeper != r["column"]:
                pairs.append((r["column"], keeper, dtype))
    if not pairs:
        return {}
    differs = lambda a, b, t: ~F.col(f"`{a}`").cast(t).eqNullSafe(F.col(f"`{b}`").cast(t))
    cell = lambda i, p: F.struct(F.lit(i).alias("pair"), differs(*p).cast("int").alias("d"))
    found = df.select(F.inline(F.array(*[cell(i, p) for i, p in enumerate(pairs)]))).groupBy("pair").agg(F.max("d").alias("d"))
    return {pairs[r["pair"]][0]: pairs[r["pair"]][1] for r in found.collect() if not r["d"]}


class ColumnEncoder(Estimator):
    """Turn a mixed table into ``(row_id, label, features)``; output names are on the model."""

    def __init__(self, label: str | None = "label", row_id: str = "row_id", columns: Sequence[str] | None = None, keep: Sequence[str] = ()):
        super().__init__()
        self.label, self.row_id, self.columns, self.keep = label, row_id, columns, list(keep)

    def _fit(self, df: DataFrame) -> "ColumnEncoderModel":
        skip = {self.label, self.row_id, *self.keep}
        columns = list(self.columns) if self.columns is not None else [c for c in df.columns if c not in skip]
        dates = [c for c in columns if c in set(columns_by_type(df, "datetime"))]
        numbers = [c for c in columns if c in set(columns_by_type(df, "number") + columns_by_type(df, "boolean"))]
        strings = [c for c in columns if c in set(columns_by_type(df, "string"))]
        ranges = self._number_ranges(df, numbers + dates)
        counts = category_counts(df, strings).persist() if strings else None
        categories = {} if counts is None else {
            r["column"]: (r["k"], r["n"])
            for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
        }
        distinct = {c: k for c, (k, _) in categories.items()}
        constant = [c for c in numbers + dates if ranges[c]["lo"] == ranges[c]["hi"]]
        constant += [c for c in strings if distinct.get(c, 0) <= 1]
        live = [c for c in columns if c not in set(constant)]
        summaries = {c: ("text", *categories[c]) if c in categories else ("number", c in dates, *ranges[c].values()) for c in live}
        duplicates = duplicate_columns(df, live, self.row_id, summaries)
        live = [c for c in live if c not in duplicates]
        binary = self._two_valued(df, ranges, [c for c in numbers if c in live])
        short = [c for c in strings if c in live and distinct[c] <= LITERAL_CODES]
        long = [c for c in strings if c in live and distinct[c] > LITERAL_CODES]
        literal: dict[str, list[str]] = {c: [] for c in short}
        modes: dict[str, int] = {}
        if short:
            for r in counts.filter(F.col("column").isin(short)).collect():
                literal[r["column"]].append((r["value"], r["n"]))
            for c, found in literal.items():
                ordered = sorted(found)
                literal[c] = [v for v, _ in ordered]
                modes[c] = min(range(len(ordered)), key=lambda i: (-ordered[i][1], ordered[i][0]))
        tables: dict[str, DataFrame] = {}
        hot: list[tuple] = []
        if long:
            coded = cut_lineage(sorted_codes(counts.filter(F.col("column").isin(long))))
            top = coded.groupBy("column").agg(F.min_by("code", F.struct(-F.col("n"), "code")).alias("code"))
            modes.update({r["column"]: r["code"] for r in top.collect()})
            tables = {c: coded.filter(F.col("column") == c).select("value", "code") for c in long}
            # Of each column at most HOT_SHARE values can be hot, so the list is short.
            rows = F.create_map(*[F.lit(v) for c in long for v in (c, categories[c][1])])
            hot = [tuple(r) for r in coded.filter(F.col("n") * HOT_SHARE > F.element_at(rows, F.col("column"))).select("column", "value", "code").collect()]
        if counts is not None:
            counts.unpersist()
        return ColumnEncoderModel(
            self.label, self.row_id, self.keep, live, set(dates), binary, literal, tables, modes, constant, duplicates, hot
        )

    @staticmethod
    def _number_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
        """``{column: {n, lo, hi, mean, var}}`` of numbers and timestamps in one long-form pass."""
        if not columns:
            return {}
        dates = set(columns_by_type(df, "datetime"))
        cell = lambda c: F.struct(F.lit(c).alias("column"), _as_number(c, c in dates, df).alias("value"))
        cells = df.select(F.inline(F.array(*[cell(c) for c in columns])))
        ends = cells.groupBy("column").agg(
            F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        )
        return {r["column"]: {k: r[k] for k in ("n", "lo", "hi", "mean", "var")} for r in ends.collect()}

    @staticmethod
    def _two_valued(df: DataFrame, ranges: dict[str, dict], columns: Sequence[str]) -> dict[str, tuple]:
        """``{column: (low, high)}`` for columns with exactly two values.

        The variance is at most ``(mean - low)(high - mean)``, with equality exactly when all values are at
        the two ends. That singles out candidates without a pass; only those are looked at again.
        """
        def candidate(r: dict) -> bool:
            bound = (r["mean"] - r["lo"]) * (r["hi"] - r["mean"])
            return abs(bound - r["var"]) <= 1e-6 * (r["hi"] - r["lo"]) ** 2

        likely = [c for c in columns if candidate(ranges[c])]
        if not likely:
            return {}
        inner = lambda c: ~_as_number(c, False, df).isin(ranges[c]["lo"], ranges[c]["hi"])
        flag = lambda c: F.struct(F.lit(c).alias("column"), F.coalesce(inner(c), F.lit(False)).cast("int").alias("m"))
        marks = df.select(F.inline(F.array(*[flag(c) for c in likely]))).groupBy("column").agg(F.max("m").alias("m"))
        return {r["column"]: (ranges[r["column"]]["lo"], ranges[r["column"]]["hi"]) for r in marks.collect() if not r["m"]}


def _as_number(name: str, is_date: bool, df: DataFrame) -> Column:
    if is_date:
        stamp = F.col(f"`{name}`").cast("timestamp")
        if df.schema[name].dataType.typeName() == "timestamp_ntz":
            # Wall-clock time: count from the epoch of the same clock, whatever the session's zone is.
            stamp = F.from_utc_timestamp(stamp, F.current_timezone())
        return F.unix_micros(stamp).cast("double")
    return number(name, df.schema[name].dataType)


class ColumnEncoderModel(Model):
    def __init__(self, label, row_id, keep, columns, dates, binary, literal, tables, modes, constant, duplicates, hot=()):
        super().__init__()
        self.label, self.row_id, self.keep = label, row_id, keep
        self.columns, self.dates, self.binary = columns, dates, binary
        self.literal, self.tables, self.modes = literal, tables, modes
        self.constant, self.duplicates, self.hot = constant, duplicates, list(hot)

    @property
    def may_leave_gaps(self) -> bool:
        """Whether encoded cells can be missing although the input was imputed."""
        return bool(self.dates or self.binary)

    @property
    def names_out(self) -> list[str]:
        names = []
        for c in self.columns:
            names += [c, *[f"{c}.{p}" for p in DATE_PARTS]] if c in self.dates else [c]
        return names

    def _cells(self, name: str, df: DataFrame) -> list[Column]:
        column = F.col(f"`{name}`")
        if name in self.dates:
            stamp = column.cast("timestamp")
            return [_as_number(name, True, df), F.year(stamp), F.month(stamp), F.day(stamp), F.dayofweek(stamp)]
        if name in self.binary:
            low, high = self.binary[name]
            value = _as_number(name, False, df)
            return [F.when(value == low, 0.0).when(value == high, 1.0)]
        if name in self.literal:
            return [F.coalesce(code_of(column.cast("string"), self.literal[name]), F.lit(self.modes[name]))]
        if name in self.tables:
            return [F.coalesce(F.element_at("__codes", name), F.lit(self.modes[name]))]
        return [_as_number(name, False, df)]

    def _with_codes(self, df: DataFrame) -> DataFrame:
        """Add ``__codes``: the codes of all columns with long code tables, looked up in one long-form join.

        Frequent values get theirs from a broadcast table and are spread over the join by a salt that matches nothing;
        the cells are narrow, and the wide rows move once, to meet their codes.
        """
        spark = df.sparkSession
        cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        rows = df.select(F.col(f"`{self.row_id}`").alias("__row"), F.inline(F.array(*[cell(c) for c in self.tables])))
        frequent = F.broadcast(spark.createDataFrame(self.hot, "column string, value string, __hot int"))
        marked = rows.filter(F.col("value").isNotNull()).join(frequent, ["column", "value"], "left")
        salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("string"))
        marked = marked.withColumn("value", F.when(F.col("__hot").isNull(), F.col("value")).otherwise(salt))
        codes = None
        for c, table in self.tables.items():
            own = table.select(F.lit(c).alias("column"), "value", "code")
            codes = own if codes is None else codes.unionByName(own)
        coded = marked.join(codes, ["column", "value"], "left").withColumn("code", F.coalesce("__hot", "code"))
        known = coded.filter(F.col("code").isNotNull())
        gathered = known.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("column", "code"))).alias("__codes"))
        return df.join(gathered, df[self.row_id] == gathered["__row"], "left").drop("__row")

    def _transform(self, df: DataFrame) -> DataFrame:
        joined = self._with_codes(df) if self.tables else df
        cells = [cell.cast("double") for c in self.columns for cell in self._cells(c, df)]
        target = [F.col(f"`{self.label}`").alias("label")] if self.label else []
        gathered = F.array(*cells) if cells else F.array().cast("array<double>")
        return joined.select(
            F.col(f"`{self.row_id}`").alias("row_id"), *target, *[F.col(c) for c in self.keep], gathered.alias("features")
        )

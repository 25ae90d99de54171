"""Vectors as short codes: a codebook per part of the vector, and the number of the nearest entry for each part.

Components are integers (``floor(scale * x)``), so sums, means and distances are exact and do not depend on the order in
which tasks finish. A round assigns every part to the nearest entry of its codebook and moves the entries to the floored
means; it is one scan whose tasks send sums per entry, never vectors. The codebooks are all the driver holds.

The nearest entry is found by equal-average search: entries are sorted by the sum of their components, a part starts
beside its own sum and moves outwards, nearer sums first, and stops when the squared gap of the sums over the dimension
strictly exceeds the best distance, which no entry further out can then reach (Cauchy-Schwarz). Entries at the same
distance are never cut off, so ties go to the lower index, as in a full search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm.frames import batch, cut_lineage, schema_of

LARGEST = 1 << 27  # integers beyond are taken as this, so that no distance of 64 components leaves 64 bits
ROWS = 1 << 14  # vectors searched at once
KNOWN_LABELS = 1 << 20  # sums of so many labels are broadcast, more are joined


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry (the lowest one of several) and its squared distance, for each row of ``parts``."""
    dim = max(entries.shape[1], 1)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, total = sums[order], parts.sum(axis=1)
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), len(entries), np.int64)
    rows = np.arange(len(parts))
    right = np.searchsorted(sums, total)
    left = right - 1
    far = np.iinfo(np.int64).max
    while len(rows):
        own = total[rows]
        gap_left = np.where(left >= 0, own - sums[np.maximum(left, 0)], far)
        gap_right = np.where(right < len(sums), sums[np.minimum(right, len(sums) - 1)] - own, far)
        go_left = gap_left <= gap_right
        gap = np.where(go_left, gap_left, gap_right)
        square = gap.astype(np.float64) ** 2 / dim
        # beyond 2^53 floats round; a wrong stop is ruled out by a margin far above their error
        open_ = (gap != far) & ~(square > best[rows].astype(np.float64) * (1 + 1e-12))
        rows, left, right, go_left = rows[open_], left[open_], right[open_], go_left[open_]
        entry = order[np.where(go_left, left, right)]
        distance = ((parts[rows] - entries[entry]) ** 2).sum(axis=1)
        better = (distance < best[rows]) | (distance == best[rows]) & (entry < index[rows])
        best[rows[better]], index[rows[better]] = distance[better], entry[better]
        left, right = left - go_left, right + ~go_left
    return index, best


class Codebooks:
    """``entries[part]`` is an integer matrix, one row per entry; ``length`` is that of the vectors."""

    def __init__(self, entries: list[np.ndarray], length: int, scale: int):
        self.entries, self.length, self.scale = entries, length, scale

    def assign(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances, a column per part."""
        found = [nearest(part, own) for part, own in zip(np.split(whole, len(self.entries), axis=1), self.entries)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for own in self.entries for v in own.ravel().tolist()).encode()).hexdigest()


def components(vectors: pa.Array, scale: int):
    """Lengths, ends, fitness and the integer components of all rows; a fit row is not empty and holds finite numbers only."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(holes | ~np.isfinite(values), out=bad[1:])
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.floor(values * float(scale)), -LARGEST, LARGEST)
    return sizes, ends, (sizes > 0) & (bad[ends] == bad[ends - sizes]), whole


def integers(vectors: pa.Array, length: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the fit rows of that length, and their components as integers, padded with zeros to equal parts."""
    sizes, _, fit, whole = components(vectors, scale)
    fit &= sizes == length
    out = np.zeros((int(fit.sum()), -(-length // parts) * parts), np.int64)
    out[:, :length] = whole[np.repeat(fit, sizes)].reshape(len(out), length)
    return np.flatnonzero(fit), out


def _columns(vectors: DataFrame, label: bool) -> DataFrame:
    kind = "array<double>" if "double" in dict(vectors.dtypes)["embedding"] else "array<float>"
    own = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")]
    return vectors.select(*own, *([F.col("label").cast("long").alias("label")] if label else []))


def _first(vectors: DataFrame, count: int, scale: int) -> list[list[int]]:
    """The integer vectors of the smallest ids, equal ids by components. All have the length of the very first one."""
    schema = schema_of("vec_id long, whole array<long>")

    def smallest(batches):
        for b in batches:
            sizes, ends, fit, whole = components(b.column(1), scale)
            ids = b.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            chosen = []
            for size in np.unique(sizes[fit]):  # which length counts is not known yet
                own = np.flatnonzero(fit & (sizes == size))
                cut = np.partition(ids[own], min(count, len(own)) - 1)[min(count, len(own)) - 1]
                chosen.append(own[ids[own] <= cut])
            rows = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            yield batch(schema, b.column(0).take(pa.array(rows)), [whole[ends[i] - sizes[i]:ends[i]].astype(np.int64) for i in rows])

    found = vectors.mapInArrow(smallest, "vec_id long, whole array<long>")
    order = [F.col("vec_id").asc_nulls_last(), F.col("whole")]
    top = found.orderBy(*order).limit(1).collect()
    if not top:
        return []
    return [r["whole"] for r in found.filter(F.size("whole") == len(top[0]["whole"])).orderBy(*order).limit(count).collect()]


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of ``vectors`` (``vec_id, embedding``), started from the vectors with the smallest ids.

    Vectors that are null, empty or hold nulls, NaN or infinities do not take part, nor do those whose length differs
    from that of the first vector. Lengths that are no multiple of ``parts`` are filled up with zeros. Fewer vectors than
    ``entries`` make codebooks of that many entries, none make empty ones. Equal ids are ordered by components, null ids
    come last. Values beyond ``LARGEST / scale`` are taken as that. An entry without parts stays as it is.
    """
    rows = _columns(vectors, label=False)
    start = _first(rows, entries, scale)
    length = len(start[0]) if start else 0
    width = -(-length // parts)
    whole = np.zeros((len(start), width * parts), np.int64)
    whole[:, :length] = np.array(start, np.int64).reshape(len(start), length)
    books = Codebooks(np.split(whole, parts, axis=1), length, scale)
    schema = schema_of("part int, entry int, place int, total long, count long")
    for _ in range(rounds if start else 0):

        def sums(batches, books=books):
            total = np.zeros((parts, len(start), width), np.int64)
            count = np.zeros((parts, len(start)), np.int64)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    _, own = integers(b.column(1).slice(at, ROWS), length, parts, scale)
                    chosen, _ = books.assign(own)
                    for p, part in enumerate(np.split(own, parts, axis=1)):
                        np.add.at(total[p], chosen[:, p], part)
                        count[p] += np.bincount(chosen[:, p], minlength=len(start))
            part, entry, place = (x.ravel() for x in np.indices(total.shape))
            used = count[part, entry] > 0
            yield batch(schema, *[x[used] for x in (part, entry, place, total.ravel(), count[part, entry])])

        found = (rows.mapInArrow(sums, "part int, entry int, place int, total long, count long")
                 .groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count")).collect())
        moved = [own.copy() for own in books.entries]
        for r in found:
            moved[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["count"]
        books = Codebooks(moved, length, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, codes array<int>, error``: entry numbers by part, and the squared distance in all."""
    schema = schema_of("vec_id long, label long, codes array<int>, error long")
    parts = len(books.entries)

    def assigned(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                b_ = b.slice(at, ROWS)
                rows, own = integers(b_.column(1), books.length, parts, books.scale)
                chosen, distance = books.assign(own)
                kept = b_.take(pa.array(rows))
                flat = pa.array(chosen.astype(np.int32).ravel())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts), flat)
                yield batch(schema, kept.column(0), kept.column(2), codes, distance.sum(axis=1))

    return _columns(vectors, label=True).mapInArrow(assigned, "vec_id long, label long, codes array<int>, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, embedding array<double>``: the middle of the cells of the entries that a code names."""
    schema = schema_of("vec_id long, embedding array<double>")

    def vectors(batches):
        for b in batches:
            codes = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(books.entries))
            whole = np.concatenate([own[codes[:, p]] for p, own in enumerate(books.entries)], axis=1)[:, :books.length]
            values = pa.array(((whole + 0.5) / books.scale).ravel())
            starts = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * books.length)
            yield batch(schema, b.column(0), pa.ListArray.from_arrays(starts, values))

    return coded.select("vec_id", "codes").mapInArrow(vectors, "vec_id long, embedding array<double>")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error``: the error summed over all rows of the label, those without one together.

    The coded rows are stored first, as they are read twice. The sums of few labels are broadcast; those of more are
    joined, where adaptive execution splits a label that holds much.
    """
    coded = cut_lineage(coded)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    totals = cut_lineage(totals)
    if totals.limit(KNOWN_LABELS + 1).count() <= KNOWN_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")

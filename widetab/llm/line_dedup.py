"""Remove lines that repeat across documents, keeping each in the document with the smallest id.

Only 128-bit hashes of lines travel. They are range-partitioned by (hash, document) and sorted by (hash, document,
position), and each partition streams over its runs of equal hashes: the first document of a run keeps its lines. The
document is part of the range key, so a line that a third of all documents share is spread over many partitions; a
run that crosses a border is settled by the first document of each partition's first and last run (two rows per
partition, hence a bounded broadcast). The result is one compressed bitmap per document that loses lines.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from widetab.llm import textops
from widetab.llm.frames import batch, cut_lineage, schema_of

MIN_CHARS = 10
LAST = (1 << 63) - 1  # stands for a null id: such rows count as one document after all others

_LINES = "h1 long, h2 long, id long, text_key long, pos int, n_lines int"
_MARKS = "kind int, h1 long, h2 long, id long, text_key long, pos int, n_lines int"
_BITMAPS = "id long, text_key long, n_dropped long, keep_bitmap binary"
DROPPED, OPEN, EDGE = 0, 1, 2


def line_key(line: bytes) -> bytes | None:
    """The line without white space around it, A-Z lower-cased; None if it is too short to count."""
    key = line.strip()  # of bytes: exactly \x20 and \x09-\x0d
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return key


def _lines(batches):
    schema = schema_of(_LINES)
    for b in batches:
        data, offsets = textops.utf8(b.column("text"))
        ids, keys = b.column("id").to_numpy(zero_copy_only=False), b.column("text_key").to_numpy(zero_copy_only=False)
        for i, j in textops.groups(offsets):
            digests, at, sizes, row = [], [], [], []
            for k in range(i, j):
                lines = data[offsets[k]:offsets[k + 1]].tobytes().lower().split(b"\n")  # of bytes: only A-Z change
                for pos, line in enumerate(lines):
                    if (key := line_key(line)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        at.append(pos)
                        sizes.append(len(lines))
                        row.append(k)
            if row:
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield batch(schema, np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), ids[row], keys[row], at, sizes)


def _first_holders(batches):
    """Stream over sorted lines. Rows of the partition's first run stay open, as the run may begin in an earlier partition."""
    schema = schema_of(_MARKS)
    columns = ("h1", "h2", "id", "text_key", "pos", "n_lines")
    run = None  # hash and first document of the current run
    head = None  # the same for the partition's first run
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, ids, *rest = (b.column(c).to_numpy() for c in columns)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if run is not None and (h1[0], h2[0]) == run[:2]:
            new[0] = False
        starts = np.flatnonzero(new)
        number = np.cumsum(new)
        firsts = np.concatenate([[run[2] if run is not None else 0], ids[starts]])
        in_head = np.zeros(len(h1), bool)
        if head is None:
            head = (int(h1[0]), int(h2[0]), int(ids[0]))
            in_head = number <= 1
        elif run == head:
            in_head = number == 0
        kind = np.where(in_head, OPEN, np.where(ids != firsts[number], DROPPED, -1))
        out = kind >= 0
        if out.any():
            yield batch(schema, kind[out], h1[out], h2[out], ids[out], *(r[out] for r in rest))
        run = (int(h1[-1]), int(h2[-1]), int(firsts[-1]))
    if head is not None:
        edges = {head, run}
        yield batch(schema, [EDGE] * len(edges), *([e[i] for e in edges] for i in range(3)), *([0] * len(edges) for _ in range(3)))


def _bitmaps(batches):
    schema = schema_of(_BITMAPS)
    for b in batches:
        maps, dropped = [], []
        for n, at in zip(b.column("n_lines").to_pylist(), b.column("dropped")):
            keep = np.ones(n, bool)
            keep[at.values.to_numpy(zero_copy_only=False)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(n - int(keep.sum()))
        yield batch(schema, b.column("id"), b.column("text_key"), dropped, maps)


@F.pandas_udf(StringType())
def keep_lines(text: pd.Series, keep_bitmap: pd.Series) -> pd.Series:
    """The lines whose bit is set; a text without bitmap stays as it is."""
    out = []
    for t, m in zip(text, keep_bitmap):
        if t is not None and m is not None:
            lines = t.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), count=len(lines))
            t = "\n".join(line for line, bit in zip(lines, bits) if bit)
        out.append(t)
    return pd.Series(out, dtype=object)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, n_dropped, keep_bitmap`` of the documents that lose lines.

    ``id`` is the document id, or the largest long for a null; ``text_key`` is ``xxhash64`` of the text, so that rows
    that repeat an id with other texts keep bitmaps of their own. Rows with the same id count as one document.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("text_key"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = keyed.mapInArrow(_lines, _LINES).repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    marks = cut_lineage(lines.mapInArrow(_first_holders, _MARKS))
    first = marks.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
    settled = marks.filter(F.col("kind") == OPEN).join(F.broadcast(first), ["h1", "h2"]).filter("id > first_id")
    columns = ["id", "text_key", "pos", "n_lines"]
    dropped = marks.filter(F.col("kind") == DROPPED).select(columns).unionByName(settled.select(columns))
    grouped = dropped.groupBy("id", "text_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return grouped.mapInArrow(_bitmaps, _BITMAPS)


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text less its repeated lines, and ``__n_lines``, ``__n_dropped``, ``__keep_bitmap``.

    A text is split at \\n (null or empty: one empty line). A line counts by its key: white space at both ends
    stripped, A-Z lower-cased, at least 10 code points. A key found in two or more documents stays only in the one
    with the smallest id, with all its repeats there. A null text stays null; a text that loses all lines is empty.
    An empty table gives no rows, and texts of any length are split whole. Columns that begin with ``__`` are reserved;
    all other names may occur in ``docs``.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col).withColumnsRenamed({"id": "__id", "text_key": "__key", "n_dropped": "__n", "keep_bitmap": "__bitmap"})
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__key": F.xxhash64(text_col)})
    joined = keyed.join(bitmaps, ["__id", "__key"], "left")
    return joined.select(
        *[F.col(f"`{c}`") if c != text_col else keep_lines(F.col(text_col), F.col("__bitmap")).alias(text_col) for c in docs.columns],
        F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("__n_lines"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("__n_dropped"), F.col("__bitmap").alias("__keep_bitmap"),
    )

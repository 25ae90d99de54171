"""WARC archives of pages, written by Spark's own writer, and a reader that salvages damaged ones.

Writing: digests are computed where pages are read; the response of each group of equal payloads is the smallest page
id (aggregated before the shuffle). Only ids and digests are joined to find revisits. A bit map of fixed size tells the
tasks which pages may be revisits: these travel once, by page id, the others are written where they are read. A record is valid UTF-8, so archives are plain text files without compression, of a bounded number of records.

Reading (``salvage``): a file is a run of gzip members or of plain records. When a member does not decompress, a header
does not parse, a length does not fit or a digest differs, the reader looks for the next member or version line that
begins a record that passes all checks, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widetab.llm.frames import batch, cut_lineage, schema_of

SMALLEST = 100  # bytes of a payload that may be revisited
PER_FILE = 2000  # records
MAP_BITS = 27  # a bit map of 16 MB, whatever the input
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
LONGEST_HEADER = 1 << 16

# --- writing --------------------------------------------------------------------------------------


def _pages(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]+", " ").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))


def _record(refers_to: Column) -> Column:
    """Version line, headers, block and closing lines; the writer adds the last line feed."""
    end = "\r\n"
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("size").cast("string"), F.lit(end + end))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(refers_to))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(http, 256))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(end, *lines), F.lit(end + end), block, F.lit("\r\n\r"))


def _place(page: str, digest: str) -> Column:
    return F.pmod(F.xxhash64(page, digest), F.lit(1 << MAP_BITS))


def _may_revisit(revisits: DataFrame):
    """A function of ``_place`` that is True for all revisits and few other pages.

    It only spares pages the shuffle; the join decides. If the map fills up, more pages travel.
    """
    at = _place("__page", "__digest")
    words = revisits.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^21 words
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    chosen = revisits.sparkSession.sparkContext.broadcast(bits)

    def hit(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((chosen.value[at >> 6] >> (at & 63)) & 1 == 1)

    return F.pandas_udf(hit, "boolean")


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per row. Null html is an empty payload, a null url an empty one, a null page id is written as ``none``.

    Rows that repeat a page id keep a record each; with equal payloads all of them are responses if the id is the smallest.
    """
    rows = _pages(pages)
    narrow = rows.filter(F.col("size") >= SMALLEST).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = narrow.join(first, "digest").filter("page_id <> refers_to or (page_id is null and refers_to is not null)").distinct()
    revisits = cut_lineage(revisits.withColumnsRenamed({"page_id": "__page", "digest": "__digest"}))
    may = _may_revisit(revisits)(_place("page_id", "digest"))
    travel = rows.filter(may)
    found = travel.join(revisits, travel["page_id"].eqNullSafe(F.col("__page")) & (travel["digest"] == F.col("__digest")), "left")
    columns = ["page_id", "url", "payload", "digest", "size", "refers_to"]
    marked = rows.filter(~may).withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(found.select(columns))
    marked.select(_record(F.col("refers_to")).alias("value")).write.option("maxRecordsPerFile", PER_FILE).option("lineSep", "\n").text(path)


# --- reading --------------------------------------------------------------------------------------


class Damaged(ValueError):
    pass


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes  # what the record holds of it: empty for a revisit
    size: int  # of the full payload

    def name(self, header: str) -> str | None:
        return self.headers.get(header)


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def _digest_differs(headers: dict[str, str], name: str, content) -> bool:
    kind, _, value = headers.get(name, "").partition(":")
    return kind.lower() in ("sha1", "sha256", "md5") and len(value) == 2 * hashlib.new(kind.lower()).digest_size and (
        hashlib.new(kind.lower(), content).hexdigest() != value.lower())


def parse_record(data: bytes, start: int) -> Record:
    """The record that begins at ``start``; Damaged if any check fails. Bytes are those of ``data``."""
    if not data.startswith(VERSION, start):
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", start, start + LONGEST_HEADER)
    if head < 0:
        raise Damaged("header without end")
    try:
        lines = data[start:head].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        raise Damaged("header is not UTF-8") from None
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise Damaged("required header is missing")
    begin, end = head + 4, head + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = memoryview(data)[begin:end]
    payload, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        body = data.find(b"\r\n\r\n", begin, end)
        if body < 0:
            raise Damaged("response without header end")
        payload, size = block[body + 4 - begin:], end - body - 4
        if headers["warc-type"] == "revisit":
            fields = dict(x.lower().split(b":", 1) for x in data[begin:body].split(b"\r\n")[1:] if b":" in x)
            size = int(fields.get(b"content-length", b"0"))
    if _digest_differs(headers, "warc-block-digest", block):
        raise Damaged("block digest differs")
    if headers["warc-type"] != "revisit" and _digest_differs(headers, "warc-payload-digest", payload):
        raise Damaged("payload digest differs")
    return Record(start, end + 4, headers, bytes(payload), size)


def _member(data: bytes, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``start``, fed in blocks so that nothing behind it is copied."""
    unpack, at, out = zlib.decompressobj(31), start, []
    view = memoryview(data)
    try:
        while not unpack.eof:
            if at >= len(data):
                raise Damaged("member without end")
            out.append(unpack.decompress(view[at:at + (1 << 15)]))
            at = min(at + (1 << 15), len(data))
    except zlib.error as error:
        raise Damaged(f"member does not decompress: {error}") from None
    return b"".join(out), at - len(unpack.unused_data)


def _read_at(data: bytes, at: int) -> tuple[list[Record], int]:
    if not data.startswith(GZIP, at):
        record = parse_record(data, at)
        return [record], record.end
    content, end = _member(data, at)
    found, inner = [], 0
    while inner < len(content):
        record = parse_record(content, inner)
        inner = record.end
        record.start, record.end = at, end
        found.append(record)
    if not found:
        raise Damaged("empty member")
    return found, end


def _candidate(data: bytes, after: int) -> int:
    """The next place where a member or a version line may begin, or the end. A cut-off record has no line end before the next."""
    return min((p for p in (data.find(GZIP, after), data.find(VERSION, after)) if p >= 0), default=len(data))


def salvage(data: bytes) -> Salvage:
    """All records that pass their checks, and the byte gaps between them."""
    out, at, gap = Salvage(), 0, None
    while at < len(data):
        try:
            found, end = _read_at(data, at)
        except Damaged as error:
            if gap is None:
                gap = (at, str(error))
            at = _candidate(data, at + 1)
            continue
        if gap is not None:
            out.gaps.append(Gap(gap[0], at, gap[1]))
            gap = None
        out.records += found
        at = end
    if gap is not None:
        out.gaps.append(Gap(gap[0], len(data), gap[1]))
    return out


_READ = ("archive string, start long, end long, reason string, record_type string, record_id string, target_uri string, refers_to string, "
         "payload_bytes long, payload_digest string, payload binary")


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``. A gap has a ``reason`` and no ``record_type``.

    ``payload_digest`` is bare lower-case hex SHA-256 of the full payload: computed for records that hold it, taken from
    the header of revisits. An empty file has no rows.
    """
    def rows(batches):
        schema = schema_of(_READ)
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                found = salvage(content.as_py())
                lines = [(name, g.start, g.end, g.reason, *[None] * 7) for g in found.gaps]
                for r in found.records:
                    revisit = r.name("warc-type") == "revisit"
                    digest = (r.name("warc-payload-digest") or "").rpartition(":")[2].lower() if revisit else hashlib.sha256(r.payload).hexdigest()
                    lines.append((name, r.start, r.end, None, r.name("warc-type"), r.name("warc-record-id"), r.name("warc-target-uri"),
                                  r.name("warc-refers-to"), r.size, digest, r.payload if with_payload else None))
                if lines:
                    yield batch(schema, *map(list, zip(*lines)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, _READ)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

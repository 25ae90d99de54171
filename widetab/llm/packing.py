"""Best-fit-decreasing packing of token sequences.

Texts become pieces of at most ``capacity`` tokens in one pass that leaves only lengths behind. Pieces are spread by
hash over groups of about ``GROUP`` full sequences, sorted by falling length inside, and placed one by one: a segment
tree over remaining capacities finds the tightest open sequence in logarithmic time. A group leaves at most one
sequence that is not more than half full; these few (one per group) are packed again with each other.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm import textops
from widetab.llm.frames import batch, cut_lineage, documents, schema_of

CAPACITY = 4096
END = 1  # the id after each document
GROUP = 16384  # full sequences per group
CACHED_WORDS = 1_000_000  # the table of known words is emptied beyond
TEXT_CHUNK = 1 << 20  # bytes of text whose hashes and ids are in memory at a time
NEW_WORDS = 1 << 13  # words the tokenizer gets at a time; its answer takes about a kilobyte for each

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long, fill long"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class WordTokens:
    """Token ids of texts by way of their words.

    The tokenizer lowers case, drops white space, never joins across it, and separates ASCII letters and digits from
    marks behind them. So the ids of a text are those of its stems (words less closing marks, A-Z lower-cased) and marks
    in order. Each distinct stem of a chunk is looked up once by its 64-bit hash in a sorted table; new ones are
    encoded - letters alone by the merges only, all else by the whole tokenizer. Texts that may hold special tokens
    are encoded as they are.
    """

    MARKS = textops.separators(*((b, b) for b in b".,;:!?"))

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)  # only the merges
        self.letters = _byte_letters()
        self.reset()

    def reset(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Words of letters that need no cleaning go to the merges in the vocabulary's spelling of bytes."""
        plain = [w.isalpha() and (w.isascii() or w == w.lower() and unicodedata.is_normalized("NFC", w)) for w in words]
        spelled = [w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w, p in zip(words, plain) if p]
        short = iter(self.merges.encode_batch_fast(spelled, add_special_tokens=False))
        long = iter(self.whole.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        return [next(short if p else long).ids for p in plain]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Add the words at these places, ``NEW_WORDS`` of them at a time; ``keys`` are sorted."""
        sizes, ids = [], []
        for i in range(0, len(keys), NEW_WORDS):
            places = zip(starts[i:i + NEW_WORDS].tolist(), ends[i:i + NEW_WORDS].tolist())
            found = self._encode([data[x:y].tobytes().lower().decode() for x, y in places])
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        sizes = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.ids = np.concatenate([self.ids, *ids])
        numbers = np.concatenate([self.numbers, np.arange(len(self.sizes), len(self.sizes) + len(keys), dtype=np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs, which it merges
        self.keys, self.numbers = keys[order], numbers[order]

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """Hashes, starts and ends of stems and of the marks behind them, in order, and each text's first unit."""
        starts, ends = textops.spans(data, offsets, textops.NOT_SPACE)
        stems = ends.copy()
        move = np.arange(len(stems))
        while len(move):
            move = move[(stems[move] > starts[move] + 1) & ~self.MARKS[data[stems[move] - 1]]]
            stems[move] -= 1
        stems = np.where(textops.ALNUM[data[stems - 1]] & (data[stems - 1] < 128), stems, ends)
        tail = stems < ends
        at = np.arange(len(starts)) + np.cumsum(tail) - tail
        a, b = np.empty(len(starts) + int(tail.sum()), np.int64), np.empty(len(starts) + int(tail.sum()), np.int64)
        a[at], b[at] = starts, stems
        a[at[tail] + 1], b[at[tail] + 1] = stems[tail], ends[tail]
        return textops.span_hashes(data, a, b, textops.LOWER), a, b, np.searchsorted(a, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and where each text's ids begin."""
        if len(self.keys) > CACHED_WORDS or len(self.ids) > 8 * CACHED_WORDS:
            self.reset()
        keys, a, b, bounds = self._units(data, offsets)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[near] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], data, a[first[new]], b[first[new]])
            near = np.searchsorted(self.keys, distinct)
        number = self.numbers[near][back]
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[bounds]

    def texts(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of each text, a chunk of texts at a time."""
        for i, j in textops.groups(offsets, TEXT_CHUNK):
            part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            special = np.searchsorted(own, np.flatnonzero((part[:-1] == 0x3C) & (part[1:] == 0x7C)), side="right") - 1  # <|
            odd = set(special.tolist())
            if j - i > 1 or own[-1] <= 2 * TEXT_CHUNK:
                ids, bounds = self.encode(part, own)
            else:  # one very long text: in parts cut at white space
                ids = np.concatenate([self.encode(part[x:y], np.array([0, y - x]))[0] for x, y in textops.pieces(part, textops.NOT_SPACE)])
                bounds = np.array([0, len(ids)])
            for k in range(j - i):
                if k in odd:
                    yield np.array(self.whole.encode(part[own[k]:own[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[bounds[k]:bounds[k + 1]]


_tokens: dict[str, WordTokens] = {}


def _tokens_of(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each whole text and an end, cut only beyond ``capacity``."""
    schema = schema_of(_PIECES)

    def pieces(batches):
        tokens = _tokens_of(tokenizer)
        for b in batches:
            data, offsets = textops.utf8(b.column("text"))
            doc = b.column("doc_id")
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(tokens.texts(data, offsets)):
                own = np.append(ids, np.uint32(END)).astype("<u4")
                for p, s in enumerate(range(0, len(own), capacity)):
                    part = own[s:s + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield batch(schema, doc.take(pa.array(row, pa.int64())), piece, start, length, crc)

    return docs.mapInArrow(pieces, _PIECES)


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: dict[int, list] = {}

    def _mark(self, remaining: int, value: int):
        node = self.leaves + remaining
        self.tree[node] = value
        while node > 1:
            node >>= 1
            value = self.tree[2 * node] | self.tree[2 * node + 1]
            if self.tree[node] == value:
                return
            self.tree[node] = value

    def add(self, remaining: int, sequence: int):
        if remaining:
            stack = self.open.setdefault(remaining, [])
            stack.append(sequence)
            if len(stack) == 1:
                self._mark(remaining, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """``(remaining, sequence)`` of the fullest open sequence with room, or None. It leaves the open ones."""
        node = self.leaves + length
        while not self.tree[node]:
            while node & 1:  # a right child: nothing further right under this parent
                node >>= 1
            if node == 0:  # the root was passed on its right side
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        stack = self.open[remaining]
        sequence = stack.pop()
        if not stack:
            self._mark(remaining, 0)
        return remaining, sequence


def best_fit(lengths, capacity: int, opened: OpenSequences, number: int):
    """Places for lengths in falling order: ``(sequence, offset)`` each; ``number`` is the next new sequence."""
    for length in lengths:
        found = opened.take(length)
        if found is None:
            remaining, sequence, number = capacity, number, number + 1
        else:
            remaining, sequence = found
        opened.add(remaining - length, sequence)
        yield sequence, capacity - remaining


def _placer(capacity: int):
    schema = schema_of(_PLACED)

    def place(batches):
        opened, number = OpenSequences(capacity), TaskContext.get().partitionId() << 40
        top = number
        for b in batches:
            if not b.num_rows:
                continue
            places = list(best_fit(b.column("length").to_pylist(), capacity, opened, top))
            top = max(top, max(s for s, _ in places) + 1)
            yield batch(schema, *(b.column(c) for c in b.schema.names), [s for s, _ in places], [o for _, o in places], [None] * len(places))
        loose = [(s, capacity - r) for r, stack in opened.open.items() for s in stack if 2 * r >= capacity]
        if loose:
            n = len(loose)
            yield batch(schema, *[[None] * n] * 5, [s for s, _ in loose], [None] * n, [f for _, f in loose])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` should be stored: it is read twice."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group)))
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    spread = pieces.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(*order)
    placed = cut_lineage(spread.mapInArrow(_placer(capacity), _PLACED))
    # at most one row per group: two half-empty sequences of a group would have been one
    loose = placed.filter("fill is not null").select(F.col("fill").alias("length"), F.col("sequence_id").alias("old_id"))

    def merge(batches):
        schema = schema_of("old_id long, new_id long, shift long")
        opened, members, top = OpenSequences(capacity), [], 0
        for b in batches:
            lengths, old = b.column("length").to_pylist(), b.column("old_id").to_pylist()
            places = list(best_fit(lengths, capacity, opened, top))
            if places:
                top = max(top, max(s for s, _ in places) + 1)
                members += [(o, s, at) for o, (s, at) in zip(old, places)]
        name = {s: o for o, s, at in members if at == 0}
        if members:
            yield batch(schema, [m[0] for m in members], [name[m[1]] for m in members], [m[2] for m in members])

    moved = loose.repartition(1).sortWithinPartitions(F.desc("length"), "old_id").mapInArrow(merge, "old_id long, new_id long, shift long")
    rows = placed.filter("fill is null").drop("fill")
    out = rows.join(F.broadcast(moved), rows["sequence_id"] == moved["old_id"], "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("new_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end token alone. Repeated rows are packed as often as they come; a null id stays null.
    An empty table gives no rows.
    """
    return pack(cut_lineage(token_pieces(documents(docs, id_col, text_col), tokenizer, capacity)), capacity)

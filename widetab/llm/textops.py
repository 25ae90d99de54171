"""Words, hashes and shingles of whole texts as numpy arrays.

The functions read the UTF-8 bytes of an Arrow column in place. They work on a bounded number of bytes at a
time (``CHUNK``); a longer text is cut at separators, so memory follows the longest text, not the batch.

Hashes have 64 bits: two different words among n of them collide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes handled at once
SPACE = b" \t\n\x0b\x0c\r"

_PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, as many as asked for so far. A copy sent to a task starts empty."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n, 1 << 16).bit_length()
            self.up, self.down = (_running_product(base, size) for base in (_PRIME, _INVERSE))
        return self.up[:n], self.down


def _running_product(base: np.uint64, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_STEP_VALUES = mix(np.arange(1000, 1064, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def lowered(values: np.ndarray) -> np.ndarray:
    """The byte table with A-Z taken as a-z."""
    out = values.copy()
    out[65:91] = values[97:123]
    return out


PLAIN, LOWER = _BYTE_VALUES, lowered(_BYTE_VALUES)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for the bytes that belong to words; ``ranges`` are those that separate."""
    keep = np.ones(256, bool)
    for low, high in ranges:
        keep[low:high + 1] = False
    return keep


NOT_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # letters, digits, all beyond ASCII


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges of texts with at most ``limit`` bytes each, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; the end of a text ends its word."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = keep[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_counts(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in groups(offsets):
        a, b = offsets[i], offsets[j]
        starts, _ = spans(data[a:b], offsets[i:j + 1] - a, keep)
        out[i:j] = np.diff(np.searchsorted(starts, offsets[i:j + 1] - a))
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from one running sum over all bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers.first(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * up, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE, values: np.ndarray = LOWER):
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in groups(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        for a, b in pieces(part, keep):
            piece, inner = part[a:b], np.clip(own - a, 0, b - a)
            starts, ends = spans(piece, inner, keep)
            found.append(span_hashes(piece, starts, ends, values))
            counts[i:j] += np.diff(np.searchsorted(starts, inner))
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=bounds[1:])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), bounds


def pieces(data: np.ndarray, keep: np.ndarray):
    """The whole of ``data``, or cuts at separators when it is longer than ``CHUNK``."""
    a, n = 0, len(data)
    while n - a > CHUNK:
        near = np.flatnonzero(~keep[data[a + CHUNK // 2:a + CHUNK]])
        if len(near):
            b = a + CHUNK // 2 + int(near[-1])
        else:
            far = np.flatnonzero(~keep[data[a + CHUNK:]])
            b = a + CHUNK + int(far[0]) if len(far) else n
        yield a, b
        a = b
    if a < n:
        yield a, n


def combine(columns: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of several 64-bit columns, order included."""
    with np.errstate(over="ignore"):
        total = np.full(len(columns[0]), np.uint64(salt) * np.uint64(0x2545F4914F6CDD1D), np.uint64)
        for c, m in zip(columns, _STEP_VALUES):
            total += c * m
    return mix(total)


def ngrams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the positions (in ``words``) at which they begin."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.repeat(bounds[1:], np.diff(bounds))[:len(words) - n + 1]
    at = np.flatnonzero(np.arange(len(room)) + n <= room)
    return combine([words[j:len(words) - n + 1 + j] for j in range(n)], n)[at], at


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles with repeats, and where each text's begin. A shorter text is one shingle of all its words."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    where = np.zeros(len(bounds), np.int64)
    np.cumsum(sizes, out=where[1:])
    out = np.zeros(where[-1], np.uint64)
    out[np.repeat(counts >= k, sizes)] = ngrams(words, bounds, k)[0]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[bounds[i]:bounds[i + 1]]
        out[where[i]] = combine([own[m:m + 1] for m in range(len(own))], len(own))[0]
    return out, where


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


class Lookup:
    """Sorted hashes behind a table of their low bits, which answers nearly all absent ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(len(keys)).bit_length() + 6)
        self.low = np.zeros(1 << self.bits, bool)
        self.low[(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that occur among the keys, and which key each is."""
        at = np.flatnonzero(self.low[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[at]
        return at[hit], key[hit]

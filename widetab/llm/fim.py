"""Fill-in-the-middle examples: prefix, middle and suffix of whole texts, cut at token boundaries.

A token is a run of ASCII letters or one other character. The bytes of a text fall into four classes: the first byte of
another character, the first letter of a run, a later letter, a later byte of a character beyond ASCII. A wavelet matrix
over these classes answers how many bytes of a class lie before a position. Tokens begin with bytes of the first two
classes, so two ranks make a boundary count, and bisection on it finds where a given number of tokens ends; characters
are all bytes but those of the last class. Both cuts of all texts of a batch are searched at once.

Nothing is shuffled: a text is cut where it is read, and the output is put together by the JVM from character counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm.frames import documents
from widetab.llm.textops import groups, utf8

OTHER, FIRST_LETTER, LATER_LETTER, LATER_BYTE = range(4)
CHUNK = 1 << 22  # bytes in one wavelet matrix, or one longer text
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class BitRanks:
    """Bits packed into 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """Symbols below ``2 ** bits``: one plane per bit, each ordered stably by the bits of the planes above it."""

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.planes = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self.planes.append((bit, BitRanks(ones), len(symbols) - int(np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each position."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for bit, plane, zeros in self.planes:
            if symbol >> bit & 1:
                low, high = zeros + plane.rank(low), zeros + plane.rank(high)
            else:
                low, high = low - plane.rank(low), high - plane.rank(high)
        return high - low


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    out = np.where(letter, np.uint8(LATER_LETTER), np.uint8(OTHER))
    out[(data & 0xC0) == 0x80] = LATER_BYTE
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = letter[begins]
    out[first] = FIRST_LETTER
    return out


def find_cuts(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray):
    """Tokens of each text, and the characters before its earlier and its later cut.

    The cuts come after ``one % (n + 1)`` and ``two % (n + 1)`` of its n tokens.
    """
    matrix = WaveletMatrix(byte_classes(data, offsets))
    begin, end = offsets[:-1], offsets[1:]

    def tokens(at):
        return matrix.rank(OTHER, at) + matrix.rank(FIRST_LETTER, at)

    def characters(at):
        return at - matrix.rank(LATER_BYTE, at)

    base = tokens(begin)
    n = tokens(end) - base
    cuts = np.sort([one % (n + 1), two % (n + 1)], axis=0)
    places = []
    for wanted in cuts:
        # the last position before which at most the wanted tokens have begun
        low, high = begin.copy(), end.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            fits = tokens(middle) - base <= wanted
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        places.append(characters(low) - characters(begin))
    return n, places[0], places[1]


_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def cuts_of(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    data, offsets = utf8(text)
    one, two = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (one, two))
    found = [np.zeros(len(one), np.int64) for _ in range(3)]
    for i, j in groups(offsets, CHUNK):
        a = offsets[i]
        for column, part in zip(found, find_cuts(data[a:offsets[j]], offsets[i:j + 1] - a, one[i:j], two[i:j])):
            column[i:j] = part
    return pa.StructArray.from_arrays([pa.array(c) for c in found], fields=list(_CUTS))


def fill_in_middle(docs: DataFrame, seed: int = 1, changed: int = 90, suffix_first: int = 20) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of every row.

    ``changed`` of 100 texts get the form ``psm`` or, ``suffix_first`` of 100 of these, ``spm``; the others stay
    ``plain``. Cuts and forms are drawn from the SHA-256 of ``seed:doc_id``, so they depend on nothing else.

    A null text counts as an empty one, and empty texts are plain, as are texts that hold one of the three markers.
    Equal rows get equal results, one for each; a null id is drawn as the empty word. An empty table gives no rows. Texts
    of any length are cut whole. Other columns are not read, whatever their names.
    """
    from pyspark.sql.functions import arrow_udf

    find = arrow_udf(cuts_of, "struct<n:long, first:long, second:long>")
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.withColumn("cuts", find("text", draws[0], draws[1]))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.length("text") == 0) | marked | (draws[2] % 100 >= changed)
    rows = rows.withColumn("form", F.when(plain, "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm"))
    first, second = (F.col(f"cuts.{c}").cast("int") for c in ("first", "second"))
    text = F.col("text")
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(text))
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id", "text", F.col("cuts.n").alias("n"), "form", F.when(moved, F.col("cuts.first")).alias("prefix_chars"),
        F.when(moved, F.col("cuts.second") - F.col("cuts.first")).alias("middle_chars"), output.alias("output"))


def restored(output, form):
    """The text from an output and its form. No marker can arise where two parts meet, so splitting at them is exact."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    one, two, three = (parts.getItem(i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)

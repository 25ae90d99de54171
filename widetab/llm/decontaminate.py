"""Find passages of benchmark items in training texts, exact or edited.

1. The 3-grams of all items are looked up in one pass over the corpus, which counts how often each occurs anywhere
   (partial counts per task, summed by gram).
2. Seeds of an item are its rare 3-grams: those that occur at most ``COMMON`` times per corpus word, or at most
   ``SPREAD`` times as often as the item's median 3-gram - so an item that has leaked into a third of all documents
   keeps its seeds. Items are handled in blocks of bounded size, each broadcast on its own.
3. A second pass looks up the seeds in every whole text. Each hit says where the item would lie; hits that agree are
   one place. The words around each place are aligned with the item by Smith-Waterman (match ``MATCH``, mismatch and
   gap -1, so a word that was edited costs half of what one that was kept gives). The score is the best alignment as a
   share of that of the whole item. A place counts from ``THRESHOLD`` on, and only with an alignment worth at least
   ``LEAST_WORDS`` words or half of the item: copies with three of ten words replaced, and excerpts, are found.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased, so punctuation and case do not
matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm import textops
from widetab.llm.frames import batch, documents, schema_of

SEED = 3
COMMON, SPREAD = 1e-6, 8
MATCH = 2
THRESHOLD, LEAST_WORDS = 0.38, 8
BLOCK_WORDS = 2_000_000  # of items per pass: bounds every broadcast
CELLS = 4_000_000  # alignment cells handled at once

_FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"


def _words(column):
    data, offsets = textops.utf8(column)
    for i, j in textops.groups(offsets):
        a, b = offsets[i], offsets[j]
        yield (*textops.word_hashes(data[a:b], offsets[i:j + 1] - a, textops.ALNUM), i, j)


def medians(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each value the median of all values of its owner."""
    if not len(values):
        return np.zeros(0)
    ordered = values[np.lexsort((values, owner))].astype(float)
    _, place, count = np.unique(owner, return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    return ((ordered[first + (count - 1) // 2] + ordered[first + count // 2]) / 2)[place]


class Items:
    """A block of items: words, bounds, and the seeds that point into them."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, bounds: np.ndarray):
        self.ids, self.words, self.bounds = ids, words, bounds
        self.sizes = np.diff(bounds)
        self.grams, self.places = textops.ngrams(words, bounds, SEED)
        self.owner = np.searchsorted(bounds, self.places, side="right") - 1

    def choose_seeds(self, keys: np.ndarray, counts: np.ndarray, corpus_words: int):
        """Keep rare grams; every item keeps those up to ``SPREAD`` times its median."""
        at = np.minimum(np.searchsorted(keys, self.grams), max(len(keys) - 1, 0))
        often = np.where(keys[at] == self.grams, counts[at], 0) if len(keys) else np.zeros(len(self.grams), np.int64)
        keep = (often <= COMMON * corpus_words) | (often <= SPREAD * medians(often, self.owner))
        order = np.argsort(self.grams[keep], kind="stable")
        gram, place = self.grams[keep][order], self.places[keep][order]
        self.owner = self.owner[keep][order]
        self.seeds, self.first = np.unique(gram, return_index=True)
        self.last = np.append(self.first[1:], len(gram))
        self.where = place - self.bounds[self.owner]
        del self.grams, self.places
        self.lookup = textops.Lookup(self.seeds)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS):
    """Items with at least ``SEED`` words, a bounded block at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter(
        "item_id is not null and text is not null").dropDuplicates().orderBy("item_id", "text")
    ids, texts, held = [], [], 0
    for r in rows.toLocalIterator():  # the block, not the table, is in memory
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"]) // 4
        if held > block_words:
            yield _block(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield _block(ids, texts)


def _block(ids, texts) -> Items:
    words, bounds = textops.word_hashes(*textops.utf8(pa.array(texts, pa.large_string())), textops.ALNUM)
    return Items(np.array(ids, np.int64), words, bounds)


def gram_counts(docs: DataFrame, lookup) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each looked-up gram occurs in the corpus, and the words of the corpus."""
    def count(batches):
        schema = schema_of("key long, n long")
        totals, words = np.zeros(len(lookup.value.keys), np.int64), 0
        for b in batches:
            for hashes, bounds, _, _ in _words(b.column("text")):
                words += len(hashes)
                _, key = lookup.value.find(textops.ngrams(hashes, bounds, SEED)[0])
                totals += np.bincount(key, minlength=len(totals))
        seen = np.flatnonzero(totals)
        yield batch(schema, np.append(seen, -1), np.append(totals[seen], words))

    table = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = table["key"].to_numpy(), table["n"].to_numpy()  # no more rows than grams in the block
    counts = np.zeros(len(lookup.value.keys), np.int64)
    counts[key[key >= 0]] = n[key >= 0]
    return lookup.value.keys, counts, int(n[key < 0].sum())


def align(windows: np.ndarray, valid: np.ndarray, items: np.ndarray, sizes: np.ndarray, match: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item (row of ``items``, ``sizes`` words) with its window, and the column where it ends.

    All pairs advance together, one item word at a time; the gaps along the window come from a running maximum.
    """
    n, width = windows.shape
    ramp = np.arange(width, dtype=np.int32)
    row = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        live = i < sizes
        step = np.where((windows == items[:, i:i + 1]) & valid, match, -1).astype(np.int32)
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        new = np.maximum(np.maximum(diagonal + step, row - 1), 0)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        row = np.where(live[:, None], new, row)
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = live & (value > best)
        best[better], end[better] = value[better], top[better]
    return best, end


def _places(items: Items, hashes: np.ndarray, bounds: np.ndarray):
    """Text, item and first word of every place that a seed points to, one for all seeds that agree."""
    gram, at = textops.ngrams(hashes, bounds, SEED)
    hit, key = items.lookup.find(gram)
    if not len(hit):
        return None
    counts = items.last[key] - items.first[key]
    entry = np.repeat(items.first[key] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    at = np.repeat(at[hit], counts)
    text = np.searchsorted(bounds, at, side="right") - 1
    item = items.owner[entry]
    begin = at - items.where[entry]  # may lie before the text
    # within an item's length / 4 the window of the first place covers the others
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    slack = np.maximum(items.sizes[item] // 4, 2)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] // slack[1:] != begin[:-1] // slack[1:])
    return text[new], item[new], begin[new]


def leaks(items: Items, hashes: np.ndarray, bounds: np.ndarray):
    """Best place per (text, item): arrays of text, item, score, first and last word within the text."""
    found = _places(items, hashes, bounds)
    if found is None:
        return [np.zeros(0, np.int64)] * 5
    text, item, begin = found
    size = items.sizes[item]
    before, width = size // 2 + 2, 2 * size + 4
    score, first, last = np.zeros(len(text)), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * int(width[order[j]]) <= max(CELLS // 16, int(width[order[j]])):
            j += 1
        own = order[i:j]
        reach, longest = int(width[own].max()), int(size[own].max())
        columns = (begin[own] - before[own])[:, None] + np.arange(reach)
        valid = (columns >= bounds[text[own]][:, None]) & (columns < bounds[text[own] + 1][:, None]) & (np.arange(reach) < width[own][:, None])
        window = hashes[np.clip(columns, 0, len(hashes) - 1)]
        words = items.words[np.minimum(items.bounds[item[own]][:, None] + np.arange(longest), len(items.words) - 1)]
        best, end = align(window, valid, words, size[own], MATCH)
        score[own] = best / (MATCH * size[own])
        last[own] = columns[np.arange(len(own)), end] - bounds[text[own]]
        first[own] = np.maximum(last[own] - size[own] + 1, 0)
        i = j
    good = np.flatnonzero(score >= np.maximum(THRESHOLD, np.minimum(0.5, LEAST_WORDS / size)))
    good = good[np.lexsort((first[good], -score[good], item[good], text[good]))]
    keep = np.ones(len(good), bool)
    keep[1:] = (text[good][1:] != text[good][:-1]) | (item[good][1:] != item[good][:-1])
    good = good[keep]
    return text[good], item[good], score[good], first[good], last[good]


def prepared_items(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Broadcast blocks of items with their seeds chosen by the counts of the whole corpus."""
    sc = docs.sparkSession.sparkContext
    for block in item_blocks(items, id_col, text_col):
        lookup = sc.broadcast(textops.Lookup(np.unique(block.grams)))
        block.choose_seeds(*gram_counts(docs, lookup))
        lookup.unpersist()
        yield sc.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word``, the best place of each item in each document where it scores enough.

    Null or empty texts hold nothing; items with fewer than three words or a null id or text are not looked for.
    Repeated rows are reported as often as they come; repeated items once.
    """
    table = documents(docs, id_col, text_col)
    out = None
    for block in prepared_items(table, items):
        def rows(batches, block=block):
            schema = schema_of(_FOUND)
            for b in batches:
                ids = b.column("doc_id")
                for hashes, bounds, i, _ in _words(b.column("text")):
                    text, item, score, first, last = leaks(block.value, hashes, bounds)
                    if len(text):
                        yield batch(schema, ids.take(pa.array(text + i)), block.value.ids[item], score, first, last)

        part = table.mapInArrow(rows, _FOUND)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any leak, all columns as they are; decided where they are read."""
    table = docs.select(F.col(text_col).cast("string").alias("text"))
    for block in prepared_items(table, items):
        def rows(batches, block=block):
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for hashes, bounds, i, _ in _words(b.column(text_col)):
                    clean[leaks(block.value, hashes, bounds)[0] + i] = False
                if clean.any():
                    yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs

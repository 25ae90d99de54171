"""Scores of texts under a hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given the two tokens before it, times that of the token in its class.

* Class factor: a softmax over ``CLASSES`` with one weight row per feature - the previous token, the token before that
  (a skip), and both together, hashed into ``ROWS`` rows. A context is the pair of signs of the two tokens before, so
  the gradient over all training tokens needs no more than how often each class follows each context. These counts are
  gathered once; a round then adds up the gradients of all contexts in distributed tasks, one softmax per distinct
  context, and the driver moves the weights (Adam). The gradients of a bucket of contexts are rounded to integers before
  they are added, so the model does not depend on how the texts are partitioned or which task ends first.
* Token factor: the maximum-entropy solution for the unigram feature is the smoothed relative frequency in the class.
  Its counts cover all training tokens. It is in closed form and knows no context.

Classes: the ``SINGLES`` most frequent tokens each have one, the end of a text has one, all others share by the hash of
their last three bytes.

Counts are summed in each task and then by Spark. The 2^``HEAVY`` most frequent words are broadcast. Occurrences of rarer
words are joined by word, so no key of that join is heavy, and come back as one sum per document. Texts are scored once;
the rows of that pass are stored, as they serve both sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm import textops
from widetab.llm.frames import batch, cut_lineage, schema_of

CLASSES, SINGLES = 128, 32
TOP, BUCKETS, PAIR_ROWS = 1024, 1023, 4096
START = TOP + BUCKETS
SIGNS = START + 1
ROWS = 2 * SIGNS + PAIR_ROWS
HEAVY = 17
EXACT = 1 << 16  # words with fewer occurrences are told apart when the broadcast ones are chosen
RATES = (0.4, 0.4, 0.3, 0.2, 0.1, 0.05)  # one per round
MOMENTUM, DECAY, DAMPING = 0.6, 0.95, 100.0
UNIT = 1 << 20  # gradients are integers in this unit
BATCH = 8192
KEPT_WORDS = 2_000_000  # words gathered before a task adds up their counts
KEPT_CONTEXTS = 8_000_000
BUCKETS_OF_CONTEXTS = (8, 256)  # fewest and most; between them one for about BUCKET_TOKENS tokens
BUCKET_TOKENS = 2_000_000
GRADIENT_BLOCK = 1024  # weight rows that are added up together

END_WORD = int(textops.signed(textops.mix(np.array([0x656E64], np.uint64)))[0])  # a hash for the end of a text


def _chunks(column):
    """``(hashes, last-bytes buckets, bounds, first text, last text)`` a chunk of texts at a time."""
    data, offsets = textops.utf8(column)
    for i, j in textops.groups(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        hashes, buckets, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(j - i, np.int64)
        for a, b in textops.pieces(part, textops.NOT_SPACE):
            inner = np.clip(own - a, 0, b - a)
            starts, ends = textops.spans(part[a:b], inner, textops.NOT_SPACE)
            hashes.append(textops.span_hashes(part[a:b], starts, ends, textops.LOWER))
            last = textops.span_hashes(part[a:b], np.maximum(starts, ends - 3), ends, textops.LOWER)
            buckets.append((last % np.uint64(BUCKETS)).astype(np.int64))
            counts += np.diff(np.searchsorted(starts, inner))
        yield np.concatenate(hashes), np.concatenate(buckets), np.concatenate([[0], np.cumsum(counts)]), i, j


def word_counts(train: DataFrame) -> DataFrame:
    """``word, bucket, c`` of all training tokens, the end of a text included."""
    def count(batches):
        schema = schema_of("word long, bucket int, c long")
        held, texts = [], 0

        def added():
            word, first, c = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_counts=True)
            return batch(schema, textops.signed(word), np.concatenate([b for _, b in held])[first], c)

        for b in batches:
            texts += b.num_rows
            for hashes, buckets, *_ in _chunks(b.column("text")):
                held.append((hashes, buckets))
                if sum(len(h) for h, _ in held) > KEPT_WORDS:
                    yield added()
                    held = []
        if held:
            yield added()
        if texts:
            yield batch(schema, [END_WORD], [0], [texts])

    rows = train.select("text").mapInArrow(count, "word long, bucket int, c long")
    return cut_lineage(rows.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c")))


@dataclass
class Vocabulary:
    """What scoring knows of words: bounded by 2^HEAVY words, whatever the corpus."""

    heavy: np.ndarray      # sorted hashes
    heavy_counts: np.ndarray
    least: int             # words that occur less often are not among them
    top: np.ndarray        # sorted hashes of the most frequent words
    top_ranks: np.ndarray
    class_cost: np.ndarray  # log10 of the denominator of the token factor by class
    class_tokens: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        return _values(self.top, self.top_ranks, hashes, TOP)


def _values(keys, values, wanted, missing):
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END_WORD, F.col("c"))).alias("ends")).first()
    n, v, ends = int(total["n"] or 0), int(total["v"]), int(total["ends"] or 0)
    words = counts.filter(F.col("word") != END_WORD)
    top = words.orderBy(F.desc("c"), "word").limit(TOP).toPandas()
    least = least_count(words, n, 1 << HEAVY)
    heavy = words.filter(F.col("c") >= least).select("word", "c").toPandas()  # at most 2^HEAVY rows
    hashes = textops.unsigned(heavy["word"].to_numpy(np.int64))
    order = np.argsort(hashes)
    top_hashes = textops.unsigned(top["word"].to_numpy(np.int64))
    top_order = np.argsort(top_hashes)
    shared = CLASSES - SINGLES - 1
    singles = [int(w) for w in top["word"][:SINGLES]]
    kind = F.when(F.col("word").isin(singles), -1).otherwise(F.pmod("bucket", F.lit(shared))) if singles else F.pmod("bucket", F.lit(shared))
    size = np.zeros((CLASSES, 2))
    for r in words.groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row per class
        if r["k"] >= 0:
            size[SINGLES + r["k"]] = r["n"], r["v"]
    size[:len(singles), 0], size[:len(singles), 1] = top["c"][:SINGLES], 1
    size[CLASSES - 1] = ends, 1
    return Vocabulary(hashes[order], heavy["c"].to_numpy(np.int64)[order], least, top_hashes[top_order], top_order.astype(np.int64),
                      np.log10(size[:, 0] + 0.5 * (size[:, 1] + 1)), size[:, 0], n, v, ends)


def least_count(words: DataFrame, tokens: int, places: int) -> int:
    """The smallest count that at most ``places`` words reach; no more can each have that part of all tokens."""
    by_count = words.groupBy(F.least("c", F.lit(EXACT)).alias("c")).count().collect()  # at most EXACT rows
    seen = 0
    for r in sorted(by_count, key=lambda r: -r["c"]):
        seen += r["count"]
        if seen > places:
            return r["c"] + 1 if r["c"] < EXACT else max(EXACT, -(-tokens // places))
    return 1


def features(hashes, buckets, bounds, known: Vocabulary):
    """Per token (words, then the end of each text): its class and its three weight rows; and the bounds with ends."""
    rank = known.rank(hashes)
    sign = np.where(rank < TOP, rank, TOP + buckets)
    kind = np.where(rank < SINGLES, rank, SINGLES + buckets % (CLASSES - SINGLES - 1))
    texts = len(bounds) - 1
    wider = bounds + np.arange(texts + 1)
    word = np.ones(wider[-1], bool)
    word[wider[1:] - 1] = False
    kinds = np.full(wider[-1], CLASSES - 1)
    kinds[word] = kind
    signs = np.full(wider[-1], START)  # the end looks like a start to what follows
    signs[word] = sign
    before = np.full(wider[-1], START)
    before[1:] = signs[:-1]
    skip = np.full(wider[-1], START)
    skip[2:] = signs[:-2]
    begins = wider[:-1]
    skip[begins] = START
    second = begins + 1
    skip[second[second < wider[-1]]] = START
    pair = textops.mix((before * SIGNS + skip).astype(np.uint64)) % np.uint64(PAIR_ROWS)
    rows = np.stack([before, SIGNS + skip, 2 * SIGNS + pair.astype(np.int64)], axis=1)
    return kinds, rows, wider, word


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scores = weights[rows[:, 0]] + weights[rows[:, 1]]
    scores += weights[rows[:, 2]]
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


def context_rows(pairs: np.ndarray) -> np.ndarray:
    """The three weight rows of contexts, given as ``before * SIGNS + skip``."""
    hashed = textops.mix(pairs.astype(np.uint64)) % np.uint64(PAIR_ROWS)
    return np.stack([pairs // SIGNS, SIGNS + pairs % SIGNS, 2 * SIGNS + hashed.astype(np.int64)], axis=1)


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their sums."""
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(back, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


_CONTEXTS = "bucket int, codes binary, counts binary"


def context_counts(train: DataFrame, known, buckets: int) -> DataFrame:
    """How often each class follows each context, over all training tokens: sorted ``pair * CLASSES + class`` by bucket.

    There are at most ``SIGNS ** 2 * CLASSES`` of them. Tasks send their own distinct ones, and a bucket is merged as they
    arrive, so no task holds more than its distinct ones and what it gathers before merging.
    """
    schema = schema_of(_CONTEXTS)

    def rows(codes, counts):
        place = (textops.mix((codes // CLASSES).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[i]:cuts[i + 1]]
            yield batch(schema, [i], [codes[own].tobytes()], [counts[own].tobytes()])

    def gather(batches):
        held, size = [], 0
        for b in batches:
            for hashes, ends, bounds, _, _ in _chunks(b.column("text")):
                kinds, weight_rows, _, _ = features(hashes, ends, bounds, known.value)
                code, count = np.unique((weight_rows[:, 0] * SIGNS + weight_rows[:, 1] - SIGNS) * CLASSES + kinds, return_counts=True)
                held.append((code, count))
                size += len(code)
                if size > KEPT_CONTEXTS:
                    yield from rows(*merged(*zip(*held)))
                    held, size = [], 0
        if held:
            yield from rows(*merged(*zip(*held)))

    def merge(batches):
        held: dict[int, list] = {}
        for b in batches:
            for bucket, codes, counts in zip(*(c.to_pylist() for c in b.columns)):
                own = held.setdefault(bucket, [])
                own.append((np.frombuffer(codes, np.int64), np.frombuffer(counts, np.int64)))
                if len(own) > 1 and sum(len(c) for c, _ in own[1:]) > max(len(own[0][0]), 1 << 20):
                    held[bucket] = [merged(*zip(*own))]
        for bucket in sorted(held):
            code, count = merged(*zip(*held[bucket]))
            yield batch(schema, [bucket], [code.tobytes()], [count.tobytes()])

    return cut_lineage(train.select("text").mapInArrow(gather, _CONTEXTS).repartition("bucket").mapInArrow(merge, _CONTEXTS))


def gradient(codes: np.ndarray, counts: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Slopes of the log likelihood by weight row and class, and in the last column how often each row is used."""
    pair, first = np.unique(codes // CLASSES, return_index=True)
    kinds, ends = codes % CLASSES, np.r_[first[1:], len(codes)]
    out = np.zeros((ROWS, CLASSES + 1))
    for s in range(0, len(pair), BATCH):
        e = min(s + BATCH, len(pair))
        rows, inside = context_rows(pair[s:e]), slice(first[s], ends[e - 1])
        place = np.repeat(np.arange(e - s), ends[s:e] - first[s:e])
        uses = np.bincount(place, counts[inside], e - s)
        rest = np.empty((e - s, CLASSES + 1))
        rest[:, :CLASSES] = np.exp(log_softmax(weights, bias, rows)) * -uses[:, None]
        rest[place, kinds[inside]] += counts[inside]
        rest[:, CLASSES] = uses
        for column in range(rows.shape[1]):
            order = np.argsort(rows[:, column], kind="stable")
            own = rows[order, column]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[start]] += np.add.reduceat(rest[order], start, axis=0)
    return out


def _gradient_round(contexts: DataFrame, model) -> np.ndarray:
    """The gradients of all contexts added up; the driver gets as many numbers as there are weights."""
    sent = contexts.sparkSession.sparkContext.broadcast(model)
    schema = schema_of("block int, cells binary")

    def slopes(batches):
        total = np.zeros((ROWS, CLASSES + 1), np.int64)
        for b in batches:
            for codes, counts in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist()):
                total += np.rint(gradient(np.frombuffer(codes, np.int64), np.frombuffer(counts, np.int64), *sent.value) * UNIT).astype(np.int64)
        for at in range(0, ROWS, GRADIENT_BLOCK):
            part = total[at:at + GRADIENT_BLOCK]
            if part.any():
                yield batch(schema, [at], [part.tobytes()])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, cells in zip(b.column("block").to_pylist(), b.column("cells").to_pylist()):
                part = np.frombuffer(cells, np.int64)
                total[at] = total[at] + part if at in total else part
        for at, part in total.items():
            yield batch(schema, [at], [part.tobytes()])

    out = np.zeros((ROWS, CLASSES + 1))
    for r in contexts.mapInArrow(slopes, "block int, cells binary").repartition("block").mapInArrow(add, "block int, cells binary").collect():
        part = np.frombuffer(r["cells"], np.int64).reshape(-1, CLASSES + 1)
        out[r["block"]:r["block"] + len(part)] = part / UNIT
    sent.destroy()
    return out


def learn(train: DataFrame, known, rates=RATES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the class factor; the bias is the logarithm of the classes' shares of all tokens."""
    words = known.value
    share = words.class_tokens + 0.5
    bias = np.log(share / share.sum()).astype(np.float32)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    mean, square = np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES))
    fewest, most = BUCKETS_OF_CONTEXTS
    contexts = context_counts(train, known, min(most, max(fewest, words.tokens // BUCKET_TOKENS)))
    for number, rate in enumerate(rates, 1):
        slopes = _gradient_round(contexts, (weights, bias))
        step = slopes[:, :CLASSES] / (slopes[:, CLASSES:] + DAMPING)
        mean = MOMENTUM * mean + (1 - MOMENTUM) * step
        square = DECAY * square + (1 - DECAY) * step ** 2
        weights = (weights + rate * (mean / (1 - MOMENTUM ** number)) / (np.sqrt(square / (1 - DECAY ** number)) + 1e-3)).astype(np.float32)
    return weights, bias


_PARTS = "doc_id long, text_key long, n_tokens long, n_known long, log_counts double, log_model double, words array<long>, tfs array<long>"


def class_chances(kinds: np.ndarray, pairs: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The logarithm of each token's class probability; one softmax per distinct context."""
    context, place = np.unique(pairs, return_inverse=True)
    order = np.argsort(place, kind="stable")
    steps = np.arange(0, len(context) + BATCH, BATCH)
    cuts = np.searchsorted(place[order], steps)
    out = np.empty(len(kinds))
    for s, a, b in zip(steps, cuts[:-1], cuts[1:]):
        scores = log_softmax(weights, bias, context_rows(context[s:s + BATCH]))
        own = order[a:b]
        out[own] = scores[place[own] - s, kinds[own]]
    return out


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities).

    ``train`` holds the texts to learn from. A null text is empty: its only token is the end. Repeated rows get the same
    row each. Without training tokens every word is unknown and classes are equally likely.
    """
    sc = docs.sparkSession.sparkContext
    counts = word_counts(train)
    known_words = vocabulary(counts)
    known = sc.broadcast(known_words)
    sent = sc.broadcast(learn(train, known))

    def rows(batches):
        schema, vocab, (weights, bias) = schema_of(_PARTS), known.value, sent.value
        end = np.log10(vocab.ends + 0.5)
        for b in batches:
            for hashes, buckets, bounds, i, j in _chunks(b.column("text")):
                kinds, feature_rows, wider, word = features(hashes, buckets, bounds, vocab)
                chance = class_chances(kinds, feature_rows[:, 0] * SIGNS + feature_rows[:, 1] - SIGNS, weights, bias)
                chance = chance / np.log(10) - vocab.class_cost[kinds]
                c = _values(vocab.heavy, vocab.heavy_counts, hashes, 0)
                heavy = np.where(c > 0, np.log10(c + 0.5), 0.0)
                summed = lambda x, at: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
                n = j - i
                rare = np.flatnonzero(c == 0)
                text = np.searchsorted(bounds, rare, side="right") - 1
                order = np.lexsort((hashes[rare], text))
                t, w = text[order], hashes[rare][order]
                first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (w[1:] != w[:-1])]) if len(t) else np.zeros(0, np.int64)
                lists = np.searchsorted(t[first], np.arange(n + 1)).astype(np.int32)
                yield batch(schema, b.column("doc_id").slice(i, n), b.column("text_key").slice(i, n), np.diff(wider),
                            (summed((c > 0).astype(float), bounds) + (vocab.ends > 0)).astype(np.int64), summed(heavy, bounds) + end, summed(chance, wider),
                            pa.ListArray.from_arrays(lists, textops.signed(w[first])), pa.ListArray.from_arrays(lists, np.diff(np.r_[first, len(t)])))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    parts = cut_lineage(narrow.mapInArrow(rows, _PARTS))
    names = ("m", "n_tokens", "n_known", "log_counts", "log_model")
    local = parts.select("doc_id", "text_key", F.lit(1).cast("long").alias("m"), *names[1:])
    rare_counts = counts.filter(F.col("c") < known_words.least).select("word", "c")
    occurrences = parts.select("doc_id", "text_key", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("tfs").alias("tf")))).join(rare_counts, "word", "left")
    rare = occurrences.select(
        "doc_id", "text_key", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0).cast("long").alias("n_known"),
        (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_counts"), F.lit(0.0).alias("log_model"))
    sums = local.unionByName(rare).groupBy("doc_id", "text_key").agg(*[F.sum(c).alias(c) for c in names])
    each = sums.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("m").cast("int"))))
    share = lambda c: F.col(c) / F.col("m")
    all_tokens = float(np.log10(known_words.tokens + 0.5 * (known_words.distinct + 1)))
    return each.select(
        "doc_id", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(known_words.tokens).cast("long").alias("train_tokens"), (share("log_counts") - share("n_tokens") * all_tokens).alias("base_score"),
        (share("log_counts") + share("log_model")).alias("score"))

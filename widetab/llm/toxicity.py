"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF vectors, queries in batches.

Fitting uses a bounded sample of at most about ``EXAMPLES`` labelled rows, drawn by hash. Terms are words (runs of
letters, digits and anything beyond ASCII, A-Z lower-cased). All terms of the indexed examples are kept; their inverse
document frequencies come from all documents, and count 1 + log(1 + chi-square) times, with the chi-square of term and
label among the indexed examples. Words of no indexed example have no weight.

Three quarters of the sample are indexed. The ``FREQUENT`` most frequent terms are held as a matrix, all others as postings.
``QUERIES`` texts at a time are multiplied with the whole matrix in single precision; each adds its postings. Examples
whose sum, ``SLACK`` allowed for rounding, reaches the k-th best are scored again in double precision, so the k neighbours
are exact. Neighbours vote with weights that grow as their distance shrinks. The last quarter of the sample calibrates votes to probabilities by a monotone fit. Texts without any indexed term get the
share of toxic examples among such texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm import textops
from widetab.llm.frames import batch, documents, schema_of

EXAMPLES, K = 16_000, 15
FREQUENT, QUERIES = 256, 64
SLACK = 1e-4  # single precision is off by at most 256 * 2^-23 for vectors no longer than 1
CUT = 0.7  # predicted from this score on
EVIDENCE = 3


def _terms(column):
    """``(hashes, bounds, first text)`` of a chunk of texts at a time."""
    data, offsets = textops.utf8(column)
    for i, j in textops.groups(offsets):
        yield (*textops.word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], textops.ALNUM), i)


@dataclass
class Example:
    """The labelled sample, by id: small and bounded, so it is broadcast."""

    ids: np.ndarray
    toxic: np.ndarray
    held: np.ndarray

    def find(self, doc_ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(doc_ids), -1)
        at = np.minimum(np.searchsorted(self.ids, doc_ids), len(self.ids) - 1)
        return np.where(self.ids[at] == doc_ids, at, -1)


def sample_labels(labels: DataFrame, most: int = EXAMPLES) -> Example:
    """At most about ``most`` labelled rows by hash of the id; an id with both labels is left out."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    n = usable.count()
    share = min(1.0, most / max(n, 1))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    table = drawn.select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0).alias("held")).toPandas()
    table = table.sort_values("doc_id")
    return Example(table["doc_id"].to_numpy(np.int64), table["toxic"].to_numpy(bool), table["held"].to_numpy(bool))


def sample_terms(docs: DataFrame, chosen) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the indexed examples, and the chi-square of each term and the label there."""
    def count(batches):
        schema = schema_of("term long, toxic long, clean long")
        for b in batches:
            at = chosen.value.find(b.column("doc_id").fill_null(-1).to_numpy())
            keep = np.array([i >= 0 and not chosen.value.held[i] for i in at], bool)
            b, at = b.filter(_mask(keep)), at[keep]
            for hashes, bounds, i in _terms(b.column("text")):
                sets = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                label = np.repeat(chosen.value.toxic[at[i:i + len(sets)]], [len(s) for s in sets])
                if len(label):
                    term, back = np.unique(np.concatenate(sets), return_inverse=True)
                    toxic = np.bincount(back, weights=label)
                    yield batch(schema, textops.signed(term), toxic.astype(np.int64), (np.bincount(back) - toxic).astype(np.int64))

    example = chosen.value
    p, n = int((example.toxic & ~example.held).sum()), int((~example.toxic & ~example.held).sum())
    found = docs.mapInArrow(count, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).toArrow()
    t, c = (found[name].to_numpy().astype(float) for name in ("t", "c"))
    chi = (t * n - c * p) ** 2 * (p + n) / ((t + c) * np.maximum(p + n - t - c, 1) * max(p, 1) * max(n, 1))
    terms = textops.unsigned(found["term"].to_numpy())
    order = np.argsort(terms)
    return terms[order], chi[order]


def _mask(keep):
    import pyarrow as pa

    return pa.array(keep)


def document_frequencies(docs: DataFrame, terms) -> tuple[np.ndarray, int]:
    """In how many of all documents each indexed term occurs, and how many there are."""
    def count(batches):
        schema, lookup = schema_of("term long, n long"), textops.Lookup(terms.value)
        total, texts = np.zeros(len(terms.value), np.int64), 0
        for b in batches:
            texts += b.num_rows
            for hashes, bounds, _ in _terms(b.column("text")):
                at, key = lookup.find(hashes)
                text = np.searchsorted(bounds, at, side="right") - 1
                total += np.bincount(np.unique(text * len(total) + key) % max(len(total), 1), minlength=len(total))
        seen = np.flatnonzero(total)
        yield batch(schema, np.concatenate([[-1], seen]), np.concatenate([[texts], total[seen]]))

    table = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms.value), np.int64)
    known = table[table["term"] >= 0]
    out[known["term"]] = known["n"]
    return out, int(table.loc[table["term"] < 0, "n"].sum())


def weighted(hashes, bounds, lookup: textops.Lookup, idf: np.ndarray):
    """Per text its indexed terms and unit-length weights (1 + log tf) * idf (here times what the labels add)."""
    at, key = lookup.find(hashes)
    text = np.searchsorted(bounds, at, side="right") - 1
    pair, tf = np.unique(text * max(len(idf), 1) + key, return_counts=True)
    text, key = pair // max(len(idf), 1), pair % max(len(idf), 1)
    weight = (1 + np.log(tf)) * idf[key] if len(key) else np.zeros(0)
    cuts = np.searchsorted(text, np.arange(len(bounds)))
    return [(key[a:b], weight[a:b] / np.sqrt((weight[a:b] ** 2).sum()) if b > a else weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Index:
    """Examples: a matrix of the frequent terms and postings of the others."""

    def __init__(self, ids, toxic, vectors, n_terms: int):
        filled = [i for i, (t, _) in enumerate(vectors) if len(t)]
        self.ids, self.toxic = np.array([ids[i] for i in filled], np.int64), np.array([toxic[i] for i in filled], bool)
        empty = [toxic[i] for i, (t, _) in enumerate(vectors) if not len(t)]
        self.prior = (sum(empty) + 0.5 * (self.toxic.mean() if len(filled) else 0.5)) / (len(empty) + 0.5)
        rows = np.repeat(np.arange(len(filled)), [len(vectors[i][0]) for i in filled])
        term = np.concatenate([vectors[i][0] for i in filled]) if filled else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in filled]) if filled else np.zeros(0)
        frequent = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:FREQUENT]
        self.place = np.full(n_terms, -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        self.full = np.zeros((len(filled), len(frequent)), weight.dtype)
        own = self.place[term] >= 0
        self.full[rows[own], self.place[term[own]]] = weight[own]
        rows, term, weight = rows[~own], term[~own], weight[~own]
        order = np.lexsort((rows, term))
        self.rows, self.weights = rows[order].astype(np.min_scalar_type(len(filled))), weight[order]
        self.cuts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def nearest(self, terms, weights, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine above 0 and these, ties by id."""
        return next(self.nearest_all([(terms, weights)], k))

    def nearest_all(self, vectors, k: int = K):
        """The nearest examples of every vector, in order."""
        for start in range(0, len(vectors), QUERIES):
            group = vectors[start:start + QUERIES]
            queries = np.zeros((len(group), self.full.shape[1]))
            for query, (terms, weights) in zip(queries, group):
                place = self.place[terms]
                query[place[place >= 0]] = weights[place >= 0]
            for query, (terms, weights), frequent in zip(queries, group, queries.astype(np.float32) @ self.full.T.astype(np.float32, copy=False)):
                yield self._best(query, terms, weights, frequent, k)

    def _best(self, query, terms, weights, frequent, k):
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        other = self.place[terms] < 0
        rare, rare_weights = terms[other], weights[other]
        start, size = self.cuts[rare], self.cuts[rare + 1] - self.cuts[rare]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        total = np.bincount(self.rows[at], weights=self.weights[at] * np.repeat(rare_weights, size), minlength=len(self.ids))
        about = total + frequent
        least = np.partition(about, -k)[-k] - SLACK if len(about) > k else -1.0
        row = np.flatnonzero((about > -SLACK) & (about >= least))
        cosine = total[row] + self.full[row] @ query
        order = np.lexsort((self.ids[row], -np.round(cosine, 12)))
        order = order[cosine[order] > 0][:k]
        return row[order], cosine[order]

    def vote(self, rows, cosine) -> float:
        """Share of toxic neighbours, weighted by 1 / (distance + 0.1) with distance 1 - cosine."""
        weight = 1 / (np.maximum(1 - cosine, 0) + 0.1)
        return float((weight * self.toxic[rows]).sum() / weight.sum())


def monotone(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising steps of vote -> smoothed share of toxic ones, anchored at both ends."""
    order = np.argsort(votes, kind="stable")
    blocks = [[0.0, 0.5, 1.0]]  # vote, toxic, count: one pseudo-example of each kind at the ends
    for v, t in zip(votes[order], toxic[order]):
        blocks.append([float(v), float(t), 1.0])
    blocks.append([1.0, 0.5 if not len(votes) else 1.0, 1.0])
    pooled: list[list[float]] = []
    for v, t, n in blocks:
        pooled.append([v * n, t, n])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            b = pooled.pop()
            pooled[-1] = [x + y for x, y in zip(pooled[-1], b)]
    return np.array([p[0] / p[2] for p in pooled]), np.array([p[1] / p[2] for p in pooled])


@dataclass
class Model:
    lookup: textops.Lookup
    idf: np.ndarray
    index: Index
    steps: tuple[np.ndarray, np.ndarray]

    def __getstate__(self):
        return {**self.__dict__, "lookup": self.lookup.keys}  # its table is built where it is used

    def __setstate__(self, state):
        self.__dict__.update({**state, "lookup": textops.Lookup(state["lookup"])})

    def score(self, column):
        """Per text: score, vote (NaN without indexed terms), ids and cosines of the nearest examples."""
        out = []
        for hashes, bounds, _ in _terms(column):
            for rows, cosine in self.index.nearest_all(weighted(hashes, bounds, self.lookup, self.idf)):
                if not len(rows):
                    out.append((self.index.prior, None, [], []))
                    continue
                vote = self.index.vote(rows, cosine)
                out.append((float(np.interp(vote, *self.steps)), vote, self.index.ids[rows[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist()))
        return out


_LABELLED = "doc_id long, toxic boolean, held boolean, terms array<int>, weights array<float>"


def train(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    """The model of the labelled rows given; leave out rows of ``labels`` that must not be learned from."""
    sc = docs.sparkSession.sparkContext
    docs = documents(docs)
    chosen = sc.broadcast(sample_labels(labels, most))
    terms, chi = sample_terms(docs, chosen)
    lookup = textops.Lookup(terms)
    keys = sc.broadcast(terms)
    frequency, n = document_frequencies(docs, keys)
    idf = (np.log((1 + n) / (1 + frequency)) + 1) * (1 + np.log1p(chi))
    factors = sc.broadcast(idf)

    def rows(batches):
        schema, known = schema_of(_LABELLED), textops.Lookup(keys.value)
        for b in batches:
            at = chosen.value.find(b.column("doc_id").fill_null(-1).to_numpy())
            b, at = b.filter(_mask(at >= 0)), at[at >= 0]
            for hashes, bounds, i in _terms(b.column("text")):
                vectors = weighted(hashes, bounds, known, factors.value)
                own = at[i:i + len(vectors)]
                yield batch(schema, chosen.value.ids[own], chosen.value.toxic[own], chosen.value.held[own], [t for t, _ in vectors], [w for _, w in vectors])

    # at most about EXAMPLES rows: copies of an id are taken once
    found = docs.mapInArrow(rows, _LABELLED).dropDuplicates(["doc_id"]).toArrow().combine_chunks()
    for sent in (chosen, keys, factors):
        sent.unpersist()
    values = lambda name: found[name].to_numpy()
    ids, marks, held, terms, weights = (values(name) for name in ("doc_id", "toxic", "held", "terms", "weights"))
    unpack = lambda keep: (ids[keep], marks[keep], [(t.astype(np.int64), w) for t, w in zip(terms[keep], weights[keep])])
    held = held.astype(bool)
    index = Index(*unpack(~held), len(idf))
    votes, toxic = [], []
    _, marks, vectors = unpack(held)
    for t, (near, cosine) in zip(marks, index.nearest_all(vectors)):
        if len(near):
            votes.append(index.vote(near, cosine))
            toxic.append(t)
    return Model(lookup, idf, index, monotone(np.array(votes), np.array(toxic, bool)))


_SCORES = "doc_id long, score double, vote double, evidence array<long>, cosines array<double>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, score, vote, evidence, cosines``. Null and empty texts get the prior of texts without terms.

    The model is broadcast: it holds about ``EXAMPLES`` vectors at most, over their own terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        schema = schema_of(_SCORES)
        for b in batches:
            found = sent.value.score(b.column("text"))
            if found:
                yield batch(schema, b.column("doc_id"), *map(list, zip(*found)))

    return documents(docs).mapInArrow(rows, _SCORES)

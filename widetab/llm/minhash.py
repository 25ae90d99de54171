"""Near-duplicate documents: one-permutation sketches, banded buckets, star-shaped candidates, confirmed links.

How it works, with n documents:

1. One pass hashes every whole text into its set of 5-word shingles. Documents with equal sets share a *node* (a
   128-bit digest of the set), so a group of exact copies, however large, is one node from here on.
2. One permutation gives every node 128 bins; empty bins borrow from a random full bin of the same node (optimal
   densification), so short texts behave like long ones. 32 bands of 4 bins make 32 bucket keys per node. A pair
   with similarity 0.75 shares no bucket with a chance of about 5 in a million.
3. Buckets with one node are dropped. In each other bucket a *star* links all nodes with one centre, so a bucket of
   m nodes makes m - 1 candidates. Candidates are confirmed on the full sets: 100 * intersection >= 75 * union.
   Before that, the join itself leaves out pairs that cannot reach it: every node has an odd sketch, 512 parities of
   its shingles by hash. Two nodes differ in at most as many parities as shingles, and a link allows a seventh of
   both sizes together. No link is lost; from about 900 shingles on, the sketch says nothing and every pair passes.
4. Nodes that a centre does not confirm may still belong to another member. Further rounds draw new centres in
   every bucket whose nodes lie in several components - some uniformly, some by the links they have so far - until a
   round joins nothing. Each round makes a fixed number of candidates per bucket row.
5. Components grow by minimum labels with pointer jumping; nothing of the graph is collected.

Heavy keys: centres and minima are aggregated on the map side; joins on a bucket or node have one small unique side,
and adaptive execution may split the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm import textops
from widetab.llm.frames import batch, cut_lineage, documents, release, schema_of, scratch

SHINGLE, BINS, ROWS = 5, 128, 4
EMPTY = np.uint64(2**64 - 1)
STARS = 8  # centres per bucket in the rounds after the first
PARITIES = 512  # bits of an odd sketch
FILTER_BITS = 27  # a filter of 16 MB, whatever the input

_SKETCH = "doc_id long, n_shingles long, node binary, bands array<long>, odd array<long>"
_SETS = "node binary, shingles binary"


def sketch_bins(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts x BINS smallest hashes; the leading bits of a hash name its bin. Texts without shingles stay empty."""
    n = len(bounds) - 1
    bins = np.full(n * BINS, EMPTY, np.uint64)
    at = np.repeat(np.arange(n), np.diff(bounds)) * BINS + (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(bins, at, shingles)
    return bins.reshape(n, BINS)


def densify(bins: np.ndarray) -> np.ndarray:
    """Every empty bin takes the value of a bin drawn by hash of (bin, attempt), first full one wins."""
    full, out = bins != EMPTY, bins.copy()
    text, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(text):
        attempt += 1
        drawn = textops.combine([bin_.astype(np.uint64), np.full(len(bin_), attempt, np.uint64)], 77)
        drawn = (drawn % np.uint64(BINS)).astype(np.int64)
        hit = full[text, drawn]
        out[text[hit], bin_[hit]] = bins[text[hit], drawn[hit]]
        text, bin_ = text[~hit], bin_[~hit]
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    keys = [textops.combine([bins[:, b + j] for j in range(ROWS)], b + 1) for b in range(0, BINS, ROWS)]
    return np.stack(keys, axis=1)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of the distinct shingles falls on each position, as 64-bit words."""
    at = (textops.mix(shingles) >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sets(column) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    data, offsets = textops.utf8(column)
    shingles, bounds = textops.shingles(*textops.word_hashes(data, offsets), SHINGLE)
    return [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], shingles, bounds


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _slices(batches):
    """Batches cut so that each holds about a chunk of text, or one longer text."""
    for b in batches:
        _, offsets = textops.utf8(b.column("text"))
        for i, j in textops.groups(offsets):
            yield b.slice(i, j - i)


def _sketch(batches):
    schema = schema_of(_SKETCH)
    for b in _slices(batches):
        sets, shingles, bounds = _sets(b.column("text"))
        keys = textops.signed(band_keys(densify(sketch_bins(shingles, bounds))))
        odd = np.stack([odd_sketch(s) for s in sets])
        bands, parities = (pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (keys, odd))
        yield batch(schema, b.column("doc_id"), [len(s) for s in sets], [_digest(s) for s in sets], bands, parities)


def _filter_bits(column) -> np.ndarray:
    """The three bit positions of each node."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)
    return np.stack([(textops.mix(raw[:, 0] + np.uint64(s) * raw[:, 1]) >> np.uint64(64 - FILTER_BITS)) for s in (1, 2, 3)], axis=1).astype(np.int64)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size, made of partial words that are combined on the map side.

    It only keeps sets of nodes without candidates from being shuffled; the joins decide. If it fills up, more sets travel.
    """
    schema = schema_of("word int, bits long")

    def words(batches):
        for b in batches:
            if b.num_rows:
                at = np.unique(_filter_bits(b.column("node")))
                word, start = np.unique(at >> 6, return_index=True)
                yield batch(schema, word, np.bitwise_or.reduceat(np.left_shift(np.int64(1), at & 63), start))

    table = nodes.select("node").mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the wanted nodes, sorted 64-bit hashes as bytes, one row per node."""
    chosen = docs.sparkSession.sparkContext.broadcast(node_filter(nodes))
    schema = schema_of(_SETS)

    def rows(batches):
        bits, seen = chosen.value, set()
        for b in _slices(batches):
            sets, _, _ = _sets(b.column("text"))
            found = [(d, s.tobytes()) for s in sets if (d := _digest(s)) is not None and d not in seen]
            if not found:
                continue
            at = _filter_bits(pa.array([d for d, _ in found], pa.binary()))
            hit = ((bits[at >> 6] >> (at & 63)) & 1).all(axis=1)
            kept = [x for x, h in zip(found, hit) if h]
            seen.update(d for d, _ in kept)  # copies within a task are sent once
            if len(seen) > 200_000:
                seen.clear()
            if kept:
                yield batch(schema, [d for d, _ in kept], [s for _, s in kept])

    # equal nodes have equal sets, so any of them will do
    found = docs.select("text").mapInArrow(rows, _SETS).join(nodes.select("node"), "node", "left_semi")
    return found.dropDuplicates(["node"])


def _confirm(batches):
    schema = schema_of("a binary, b binary")
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a"), b.column("set_b")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 75 * (len(p) + len(q) - common))
        if any(keep):
            mask = pa.array(keep)
            yield batch(schema, b.column("a").filter(mask), b.column("b").filter(mask))


def confirm_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    wide = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    )
    return wide.select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a binary, b binary")


def may_link(n, other_n, odd, other_odd):
    """False only for nodes whose sizes or parities rule out a link.

    100 * intersection >= 75 * union is the same as 7 * symmetric difference <= sum of the sizes.
    """
    apart = [F.bit_count(odd[i].bitwiseXOR(other_odd[i])) for i in range(PARITIES // 64)]
    return (100 * F.least(n, other_n) >= 75 * F.greatest(n, other_n)) & (7 * sum(apart[1:], apart[0]) <= n + other_n)


def _stars(members: DataFrame, round_: int) -> DataFrame:
    """Pairs of each bucket's centres with its other nodes, where the components differ. Columns a < b."""
    uniform = [F.xxhash64("key", "node", F.lit(1000 * round_ + j)) for j in range(STARS // 2 if round_ else 1)]
    if round_:
        # exponential waiting times: a node with more links is drawn more often
        draw = lambda j: (F.pmod(F.xxhash64("key", "node", F.lit(-1000 * round_ - j)), F.lit(1 << 40)) + 1) / float(1 << 40)
        weighted = [-F.log(draw(j)) / (F.col("links") + 1) for j in range(STARS // 2)]
    else:
        weighted = []
    picks = [F.min(F.struct(p.alias("p"), F.col("node"), F.col("component"), F.col("n_shingles"), F.col("odd")))
             .alias(f"c{j}") for j, p in enumerate(uniform + weighted)]
    chosen = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *picks)
    centres = chosen.filter("low <> high").select("key", F.explode(F.array_distinct(F.array(*[
        F.struct(F.col(f"c{j}.node").alias("node"), F.col(f"c{j}.component").alias("component"), F.col(f"c{j}.n_shingles").alias("n"),
                 F.col(f"c{j}.odd").alias("odd"))
        for j in range(len(picks))]))).alias("centre"))
    near = members.join(centres, "key").filter(
        (F.col("centre.component") != F.col("component"))
        & may_link(F.col("n_shingles"), F.col("centre.n"), F.col("odd"), F.col("centre.odd"))
    )
    return near.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels ``(node, component)`` after the links ``(a, b)``; a component is named by its smallest node.

    Every step hooks each component onto its smallest neighbour and then shortens the chains by jumping, so a star is
    joined in one step and a path in a logarithmic number of steps.
    """
    spark = labels.sparkSession
    name = labels.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    edges = links.join(name.withColumnsRenamed({"x": "a", "cx": "ca"}), "a").join(name.withColumnsRenamed({"x": "b", "cx": "cb"}), "b")
    with scratch(spark) as store:
        edges = store(edges.filter("ca <> cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct())
        while not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            parents = store(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
            while True:
                up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
                jumped = store(parents.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("q"), "p"))
                done = jumped.filter("q <> p").isEmpty()
                parents = jumped.select("u", F.col("q").alias("p"))
                if done:
                    break
            labels = labels.join(parents.withColumnRenamed("u", "component"), "component", "left")
            labels = store(labels.select("node", F.coalesce("p", "component").alias("component")))  # or each step would plan all steps before it again
            edges = edges.join(parents.withColumnsRenamed({"p": "pu"}), "u").join(parents.withColumnsRenamed({"u": "v", "p": "pv"}), "v")
            edges = store(edges.filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
            del parents, jumped, up, both
            release(spark)
        return cut_lineage(labels)


def similar_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes that share a bucket with another one."""
    rows = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")).select("key", "node", "n_shingles")
    crowded = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = cut_lineage(rows.join(crowded, "key"))
    labels = cut_lineage(members.select("node").distinct().withColumn("component", F.col("node")))
    sketches = cut_lineage(nodes.select("node", "odd").join(labels.select("node"), "node", "left_semi"))
    sets = cut_lineage(full_sets(docs, labels))
    del rows, crowded
    release(docs.sparkSession)
    tested = links = None
    round_ = 0
    with scratch(docs.sparkSession) as store:
        while True:
            degree = None
            if links is not None:
                degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
            now = members.join(labels.join(sketches, "node"), "node")
            now = now.join(degree, "node", "left").fillna(0, ["links"]) if degree is not None else now.withColumn("links", F.lit(0))
            pairs = _stars(now, round_)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = store(pairs)
            del now, degree  # plans of many joins
            release(docs.sparkSession)
            found = cut_lineage(confirm_pairs(pairs, sets))
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = found if links is None else links.unionByName(found)
            if found.isEmpty():
                if round_:
                    return labels
            else:
                labels = join_components(labels, found)
            round_ += 1
            release(docs.sparkSession)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without white space, A-Z taken as a-z. A text with one to four words has one shingle, the whole of
    it; a null, empty or blank text has none and is linked with nothing. ``component_id`` is the smallest id reachable
    through links. Rows that repeat an id with the same text get the same row; with other texts, each text is linked on
    its own. A null id never names a component unless all ids in it are null; such rows are kept.
    """
    table = documents(docs, id_col, text_col)
    sketched = cut_lineage(table.mapInArrow(_sketch, _SKETCH))
    nodes = sketched.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    nodes = cut_lineage(nodes)
    labels = similar_nodes(table, nodes)
    named = nodes.select("node", "first_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id")
    out = sketched.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(
        F.col("doc_id") == component, F.col("node").isNull() | component.isNull()).alias("kept"))

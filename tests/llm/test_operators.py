"""Document operators against brute force on small tables with hard rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from widetab.llm import (
    decontaminate, fingerprint, license_scan, line_dedup, lm_score, minhash, packing, quality, textops, toxicity, warc,
)
from widetab.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n))


def hard_rows():
    """Nulls, empty, blank, very long, repeated and near-repeated texts."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [None, "", "  \n\t ", "one", "One two", "É é. x\x0by", *base]
    for b in base[:6]:
        w = b.split()
        texts += [b, b.upper(), " ".join(w[:-2] + ["new", "end"]), " ".join(w[:20] + ["changed"] + w[21:])]
    texts += ["shared line number one\n" + t for t in base[:4]] + ["  SHARED line number one\t\nshort\nshort", " ".join(base * 30)]
    rows = [(i, t, None if i % 5 == 0 else "en", "s", None) for i, t in enumerate(texts)]
    return rows + [rows[8], (None, base[0], "en", None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).withColumn("node", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles(monkeypatch):
    monkeypatch.setattr(textops, "CHUNK", 64)
    texts = [r[1] for r in hard_rows()]
    hashes, bounds = textops.word_hashes(*textops.utf8(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len(words_of(t)) for t in texts]
    seen = {}
    for word, h in zip((w for t in texts for w in words_of(t)), hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    _, cuts = textops.shingles(hashes, bounds)
    assert np.diff(cuts).tolist() == [max(len(w) - 4, min(len(w), 1)) for w in map(words_of, texts)]


def test_line_dedup(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    last = 1 << 63
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    holder = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holder[key(line)] = min(holder.get(key(line), last), last if i is None else i)
    expected = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 10 or holder[key(s)] == (last if i is None else i)]
        expected.append((i if i is not None else -1, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    found = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["__n_lines"], r["__n_dropped"]) for r in line_dedup.deduplicate_lines(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert line_dedup.deduplicate_lines(empty).count() == 0


def test_line_dedup_with_clashing_names(docs):
    clashing = docs
    for name in ("n_dropped", "keep_bitmap", "n_lines", "pos", "h1", "text_key", "dropped", "first_id"):
        clashing = clashing.withColumn(name, F.lit(name))
    out = line_dedup.deduplicate_lines(clashing)
    plain = sorted(map(repr, (tuple(r) for r in line_dedup.deduplicate_lines(docs).select("doc_id", "text", "__n_lines", "__n_dropped").collect())))
    assert sorted(map(repr, (tuple(r) for r in out.select("doc_id", "text", "__n_lines", "__n_dropped").collect()))) == plain
    assert {tuple(r) for r in out.select("n_dropped", "keep_bitmap").distinct().collect()} == {("n_dropped", "keep_bitmap")}


def test_runs_across_partitions_of_lines(spark):
    """One line in all documents, so that its run spans every range."""
    table = spark.createDataFrame([(i, f"a very common line\nown line of {i}") for i in range(200)], "doc_id long, text string")
    out = line_dedup.deduplicate_lines(table.repartition(5))
    assert {r["doc_id"]: r["__n_dropped"] for r in out.collect()} == {i: int(i > 0) for i in range(200)}


def test_open_sequences_take_the_tightest():
    for seed in range(6):
        rng = random.Random(seed)
        capacity = rng.choice([7, 100, 4096])
        lengths = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
        left = []
        for length, (s, offset) in zip(lengths, packing.best_fit(lengths, capacity, packing.OpenSequences(capacity), 0)):
            fits = [(r, i) for i, r in enumerate(left) if r >= length]
            if not fits:
                left.append(capacity)
                assert s == len(left) - 1
            else:
                assert left[s] == min(fits)[0]
            assert offset == capacity - left[s]
            left[s] -= length


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer, capacity = Tokenizer.from_file(tokenizer_path()), 256
    rows = packing.pack_documents(docs, tokenizer_path(), capacity).collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(r["doc_id"], p, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.1 * sum(r["length"] for r in rows) / capacity + 2
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    odd = ["", "a b\x1cc <|endoftext|>x <|ENDOFTEXT|> don't I'll 12 ½ ́e é, ΣΑΣ İ Èch. naïve?! ét", "😀 a\x85b\xa0r ſ. Ⅷ ẞ ﬁ", "x" * 3000]
    whole = Tokenizer.from_file(tokenizer_path())
    for text, ids in zip(odd, packing.WordTokens(tokenizer_path()).texts(*textops.utf8(pa.array(odd)))):
        assert whole.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_near_duplicates(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = [(lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(words_of(t)) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    expected = sorted((repr(rows[i][0]), len(sets[i]), smallest[group[i]]) for i in range(len(rows)) if sets[i])
    found = minhash.near_duplicates(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in found if r["n_shingles"]) == expected
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in found if not r["n_shingles"])
    assert len(found) == len(rows) and minhash.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    name = lambda i: bytes([i])
    edges = [(i, i + 1) for i in range(20)] + [(30, j) for j in range(31, 40)]
    labels = spark.createDataFrame([(name(i), name(i)) for i in range(50)], "node binary, component binary")
    links = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    found = {r["node"][0]: r["component"][0] for r in minhash.join_components(labels, links).collect()}
    assert found == {i: 0 if i <= 20 else 30 if 30 <= i < 40 else i for i in range(50)}


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_edited_copies_and_excerpts_are_found(spark):
    """Recall by share of replaced words and by length of the excerpt, and no alarm on texts without them."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("bcdfglmnprstv", k=rng.randint(1, 5))) for _ in range(400)]
    weights = [1 / (i + 2) for i in range(400)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [draw(rng.randint(15, 50)) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    wanted = {"edits 0": 1.0, "edits 0.1": 1.0, "edits 0.2": 0.95, "edits 0.3": 0.9, "excerpt 0.6": 1.0, "excerpt 0.5": 0.95}
    rows, planted = [], {}
    for kind in wanted:
        name, share = kind.split()
        for i, words in enumerate(items):
            n = len(words) if name == "edits" else round(len(words) * float(share))
            start = rng.randint(0, len(words) - n)
            passage = [draw(1)[0] if name == "edits" and rng.random() < float(share) else w for w in words[start:start + n]]
            planted[len(rows)] = (kind, i)
            rows.append((len(rows), " ".join([*draw(40), *passage, *draw(40)])))
    clean = range(len(rows), len(rows) + 600)
    docs = spark.createDataFrame(rows + [(i, " ".join(draw(150))) for i in clean], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    for kind, least in wanted.items():
        own = [(d, i) for d, (k, i) in planted.items() if k == kind]
        assert sum(p in found for p in own) / len(own) >= least, kind
    assert not {d for d, _ in found} & set(clean)


def test_medians_by_owner():
    rng = np.random.default_rng(3)
    owner, values = rng.integers(0, 30, 400), rng.integers(0, 50, 400)
    assert np.allclose(decontaminate.medians(values, owner), [np.median(values[owner == o]) for o in owner])
    assert len(decontaminate.medians(np.zeros(0), np.zeros(0, int))) == 0


def test_alignment_and_leaks(spark):
    rng = random.Random(2)
    for _ in range(30):
        item, window = [rng.randrange(6) for _ in range(12)], [rng.randrange(6) for _ in range(30)]
        best, _ = decontaminate.align(np.array([window]), np.ones((1, 30), bool), np.array([item]), np.array([12]))
        assert best[0] == smith_waterman(item, window)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, None), (None, "a b c d"), (7, "too short")]
    edited = items[2][1].split()
    edited[5], edited[15] = "other", "words"
    texts = [prose(rng, 50) + " " + items[0][1].upper() + ". " + prose(rng, 50), " ".join(edited), items[1][1][:40], prose(rng, 200), None, "", items[3][1]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(6, texts[6])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == [(0, 0), (1, 2), (6, 3), (6, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_quality_model_sums_to_one_and_rejects_noise(spark, empty):
    rng = random.Random(3)
    good = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60))) for _ in range(400)]
    bad = ["beta " * 50, " ".join(rng.choice(WORDS) + "%%%" for _ in range(40))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad + ["", None])], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    size = len(model.model.unigram)
    for u, v in ((quality.START, quality.FIRST_WORD), (quality.FIRST_WORD, quality.FIRST_WORD + 3)):
        token = np.concatenate([[[quality.START, u, v, w] for w in range(size)]]).ravel()
        two, _ = quality.surprise(model.model, token, np.arange(0, 4 * size + 1, 4))
        one, _ = quality.surprise(model.model, np.array([quality.START, u, v]), np.array([0, 3]))
        assert abs((10 ** -(two - one[0])).sum() - 1) < 1e-3
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, model).collect()}
    assert sum(kept[i] for i in range(400)) >= 398 and not kept[400] and not kept[401] and kept[402] and kept[403]
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, model).select("doc_id").collect()) == sorted(i for i, k in kept.items() if k)
    nothing = quality.train(empty, labels)
    assert quality.classify(docs, nothing).filter("not kept").count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, " ".join([prose(rng, 20)] + ["nasty", "vile"] * toxic)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(600, None), (601, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter("doc_id < 400"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert all((scores[i] >= 0.7) == (i % 6 == 0) for i in range(400, 600)) and scores[600] == scores[601] < 0.7
    query = (np.array([0, 1]), np.array([0.8, 0.6]))
    vectors = [(np.array([0, 1, 2]), np.array(v) / np.linalg.norm(v)) for v in np.random.default_rng(0).random((500, 3))]
    index = toxicity.Index(list(range(500)), [True] * 500, vectors, 3)
    near, cosine = index.nearest(*query)
    exact = sorted(((round(float((v[1][:2] * query[1]).sum()), 9), -i) for i, v in enumerate(vectors)), reverse=True)[:toxicity.K]
    assert [round(float(c), 9) for c in cosine] == [c for c, _ in exact]
    blank = toxicity.train(empty, labels.limit(0))
    assert toxicity.score_documents(docs, blank).filter("score between 0 and 1").count() == 602


def test_toxicity_knows_copies_of_small_samples(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}x{rng.randrange(10 ** 6)}" for _ in range(12))) for i in range(40)]  # no word in two examples
    train = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(train, spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int"))
    indexed = model.index.ids.tolist()
    assert indexed and all(i < 24 for i in indexed)
    close = spark.createDataFrame([(i, " ".join(rows[i][1].split()[:9] + ["other", "words"])) for i in indexed], "doc_id long, text string")
    for r in toxicity.score_documents(close, model).collect():
        assert r["evidence"] == [r["doc_id"]] and r["vote"] == r["doc_id"] % 2 and 0.8 < r["cosines"][0] < 0.9


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(9)
    terms = 1500
    vectors = []
    for _ in range(900):
        t = np.unique(rng.zipf(1.2, 80) % terms)
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.Index(list(range(800)), [i % 3 == 0 for i in range(800)], vectors[:800], terms)
    full = np.zeros((800, terms))
    for i, (t, w) in enumerate(vectors[:800]):
        full[i, t] = w
    for t, w in vectors[800:]:
        near, cosine = index.nearest(t, w)
        exact = full[:, t] @ w
        wanted = sorted(range(800), key=lambda i: (-round(exact[i], 12), i))[:toxicity.K]
        assert index.ids[near].tolist() == wanted and np.allclose(cosine, exact[wanted])


def test_language_model(docs, empty):
    train = docs.filter("doc_id % 5 <> 1")
    texts = [r["text"] for r in train.select("text").collect()]
    counts = {}
    for t in texts:
        for w in words_of(t) + [None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        tokens = words_of(r["text"]) + [None]
        wanted.append((repr(r["doc_id"]), len(tokens), sum(t in counts for t in tokens), n,
                       round(sum(np.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), 6)))
    found = lm_score.score_texts(docs, train).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == sorted(wanted)
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    rows = np.random.default_rng(1).integers(0, lm_score.ROWS, (50, 3))
    weights = np.random.default_rng(2).normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(lm_score.log_softmax(weights, weights[0], rows)).sum(axis=1), 1, atol=1e-4)
    assert lm_score.score_texts(empty, empty).count() == 0 and lm_score.score_texts(docs, empty).count() == len(found)


def test_every_position_is_learned_from(spark):
    train = spark.createDataFrame([(i, "a b c") for i in range(400)], "doc_id long, text string").coalesce(1)
    known = lm_score.vocabulary(lm_score.word_counts(train))
    model = lm_score.learn(train, spark.sparkContext.broadcast(known))
    hashes, buckets, bounds, _, _ = next(lm_score._chunks(pa.array(["a b c"])))
    kinds, rows, _, _ = lm_score.features(hashes, buckets, bounds, known)
    assert (np.exp(lm_score.log_softmax(*model, rows))[np.arange(4), kinds] > 0.1).all()  # those of "c" and the end were never seen


def test_gradient_of_contexts_equals_that_of_tokens():
    rng = np.random.default_rng(6)
    pairs, kinds = rng.integers(0, 40, 3000) ** 3, rng.integers(0, lm_score.CLASSES, 3000)
    weights = rng.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    bias = rng.normal(size=lm_score.CLASSES).astype(np.float32)
    rows = lm_score.context_rows(pairs)
    logs = lm_score.log_softmax(weights, bias, rows)
    assert np.allclose(lm_score.class_chances(kinds, pairs, weights, bias), logs[np.arange(3000), kinds], atol=1e-5)
    rest = -np.exp(logs)
    rest[np.arange(3000), kinds] += 1
    expected = np.zeros((lm_score.ROWS, lm_score.CLASSES + 1))
    for column in range(3):
        np.add.at(expected, rows[:, column], np.column_stack([rest, np.ones(3000)]))
    found = lm_score.gradient(*np.unique(pairs * lm_score.CLASSES + kinds, return_counts=True), weights, bias)
    assert np.allclose(found, expected, atol=1e-3)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join([prose(rng, rng.randrange(40)), "alpha beta gamma delta " * 12])) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts, kept in ((1, 1 << 30), (4, 500), (32, 1 << 30)):  # kept: tasks also send what they have gathered in several pieces
        monkeypatch.setattr(lm_score, "KEPT_CONTEXTS", kept)
        own = table.repartition(parts)
        found.append({r["doc_id"]: tuple(r) for r in lm_score.score_texts(own, own.filter("doc_id % 5 <> 1")).collect()})
    assert all(np.allclose(found[0][i], other[i], rtol=1e-9) for other in found[1:] for i in range(300))
    held = [r for i, r in found[0].items() if i % 5 == 1]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)  # a better model of held-out texts than the unigrams


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAVY", 1)
    table = spark.createDataFrame([(0, "a b c a"), (1, "a d"), (1, "a d"), (2, "c z z")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"]) for r in lm_score.score_texts(table, table.filter("doc_id < 2")).collect()}
    c = {"a": 4, "b": 1, "c": 1, "d": 2, None: 3}
    base = lambda ts: sum(np.log10((c.get(t, 0) + 0.5) / (11 + 3.0)) for t in ts)
    assert found[2][:2] == (4, 2) and np.isclose(found[2][2], base(["c", "z", "z", None])) and np.isclose(found[1][2], base(["a", "d", None]))


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", "x" * 100_000)]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    found = warc.read_archives(spark, path).select(warc.page_of(F.col("record_id")).alias("id"), "record_type", "payload_bytes", "payload_digest", "payload",
                                                   warc.page_of(F.col("refers_to")).alias("to"), "reason").collect()
    assert all(r["reason"] is None for r in found)
    by = {r["id"]: r for r in found}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = i in (2, None)
        assert (by[i]["record_type"], by[i]["to"]) == (("revisit", 1) if revisit else ("response", None))
        assert revisit or bytes(by[i]["payload"]) == raw
    data = b"".join(sorted(p.read_bytes() for p in (tmp_path / "archives").glob("part-*")))
    whole = warc.salvage(data)
    assert len(whole.records) == len(pages) and not whole.gaps
    records = [data[r.start:r.end] for r in whole.records]
    for pack in (lambda r: r, lambda r: __import__("gzip").compress(r)):
        members = [pack(r) for r in records]
        broken = bytearray(members[2])
        broken[len(broken) // 2] ^= 0xFF
        spoiled = b"junk" + b"".join(members[:2]) + bytes(broken) + b"".join(members[3:]) + members[0][:50]
        result = warc.salvage(spoiled)
        assert [r.headers["warc-record-id"] for r in result.records] == [r.headers["warc-record-id"] for i, r in enumerate(whole.records) if i != 2]
        assert sum(g.end - g.start for g in result.gaps) == 4 + len(broken) + 50 and len(result.gaps) == 3
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path + "-none")
    assert warc.read_archives(spark, path + "-none").count() == 0


def test_fingerprints(docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = lambda t: (lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(words_of(t.lower()))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    wanted = []
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        wanted.append((repr(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), like(sets(t), sets(edited)), like(sets(t), sets(following))))
    found = [(repr(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fingerprint.fingerprints(docs).collect()]
    for a, b in zip(sorted(found), sorted(wanted), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.2 and abs(a[4] - b[4]) < 0.2
    assert fingerprint.fingerprints(empty).count() == 0


def test_sketches_merge(spark):
    table = spark.createDataFrame([("a b c d e f g", "f g h i j k l m")], "x string, y string").select(
        fingerprint.sketch(F.col("x")).alias("x"), fingerprint.sketch(F.col("y")).alias("y"))
    row = table.select(fingerprint.distinct_shingles(fingerprint.merged(F.col("x.low"), F.col("y.low"))).alias("n"),
                       fingerprint.containment(F.col("x"), F.col("x")).alias("c")).first()
    assert row["n"] == 7.0 and row["c"] == 1.0


def test_licenses(docs, empty, spark):
    texts = ["Released under the MIT License. MIT license!", "gnu lesser general public license version 2.1", "nothing", "Licensed under CC BY-NC 4.0.", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(table).collect()}
    assert (found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["base_labels"]) == (2, 3, 5, "mit")
    assert found[1]["labels"] == "gpl,lgpl-2.1" and found[2]["labels"] == "" and found[2]["score"] == 0 and found[3]["labels"] == "cc-by-nc-4.0"
    assert found[4]["n_words"] == 0 and len(license_scan.RULES) > 300
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(empty).count() == 0


def matches(parsed, alternatives=60):
    """Some texts that a parsed pattern matches: every branch, repeats at their least and one more."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            parts = [chr(arg)]
        elif kind == "IN":
            parts = [{"CATEGORY_DIGIT": "7", "CATEGORY_NOT_SPACE": "x"}.get(str(v), chr(v) if isinstance(v, int) else None) for _, v in arg]
        elif kind == "BRANCH":
            parts = [t for branch in arg[1] for t in matches(branch)]
        elif kind == "SUBPATTERN":
            parts = matches(arg[3])
        elif kind == "MAX_REPEAT":
            least, most, inner = arg
            parts = [t * n for n in (least, min(least + 1, most)) for t in matches(inner)]
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
            parts = [""]
        out = [a + b for a in out for b in dict.fromkeys(parts)]
        if len(out) > alternatives:
            out = [out[0], out[-1], *random.Random(len(out)).sample(out, alternatives - 2)]
    return out


def test_every_license_rule_passes_its_own_gate(spark):
    for rule in license_scan.RULES:
        tried = 0
        for text in matches(re._parser.parse(rule.pattern.pattern)):
            padded = f" {' '.join(text.split())} "
            if rule.pattern.search(padded):
                tried += 1
                assert set(rule.keywords) <= set(padded.split()) and rule.keywords[0] in license_scan.KEYWORDS, (rule, padded)
        assert tried, rule
    fused = {"GPLv3": "gpl-3.0", "GPLv2": "gpl-2.0", "LGPLv2.1": "lgpl-2.1", "LGPLv3": "lgpl-3.0", "AGPLv3": "agpl-3.0", "MPLv2": "mpl-2.0", "GPL3": "gpl-3.0",
             "MPLv2.0": "mpl-2.0", "GNU GPLv3+": "gpl-3.0", "Apache2": "apache-2.0", "GPL v3": "gpl-3.0", "GPL-3.0": "gpl-3.0"}
    table = spark.createDataFrame([(n, f"Licensed under {n}") for n in fused], "doc_id string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    found = [(r["labels"], r["score"]) for r in license_scan.scan_licenses(table.coalesce(1)).orderBy("doc_id").collect()]
    assert found == [(label, 0.85) for label in fused.values()]
    assert license_scan.detections("a gplv4 and gplv3 1".split()) == []


def test_pipeline_stages_keep_columns(spark):
    from tests.conftest import DATA

    read = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = read
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, DATA).toPandas(), read.schema)
        assert docs.columns == read.columns and 0 < docs.count() <= before.count(), name
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_odd_sketches_rule_out_no_link():
    rng = np.random.default_rng(3)
    for size in (1, 7, 40, 300, 3000):
        for changed in (0, 1, size // 8, size // 3, size):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**63, changed, dtype=np.uint64)]))
            apart = int(np.bitwise_count((minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64)).sum())
            common = len(np.intersect1d(a, b))
            assert apart <= len(a) + len(b) - 2 * common
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert 7 * apart <= len(a) + len(b)


def test_license_intervals_and_very_long_texts():
    rng = random.Random(23)
    for _ in range(200):
        taken, plain = license_scan.Taken(), []
        for _ in range(30):
            a = rng.randrange(40)
            b = a + rng.randrange(1, 12)
            covered = any(x <= a and b <= y for x, y in plain)
            assert taken.add(a, b) == (not covered)
            if not covered:
                plain.append((a, b))
    notice = "licensed under the mit license or the apache license version 2 0 and the gnu general public license "
    started = time.perf_counter()
    n_base, first, last, base, *_ = license_scan.scan((notice * 4000).encode())
    assert time.perf_counter() - started < 5  # 72,000 words; pairs of detections would take minutes
    words = notice.split()
    assert (n_base, first, base) == (12000, words.index("mit"), "apache,gpl,mit")
    assert last == 3999 * len(words) + words.index("general")

"""Findings of round 3 on operators on documents: what the quality model and its thresholds learn from."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from widetab.llm import minhash, packing, quality, textops, toxicity
from widetab.llm.queries import tokenizer_path
from widetab.session import scratch


@pytest.fixture(scope="module")
def trusted(spark):
    """1,900 short texts in one language and one of 30,000 characters, all labelled good: rows, documents, labels."""
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(5, 15))) for _ in range(1900)]
    texts.append(" ".join(f"long{i % 1000}" for i in range(4500)))
    data = [(i, t, "en") for i, t in enumerate(texts)]
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    ids = [r["doc_id"] for r in spark.range(20 * len(data)).select(F.col("id").alias("doc_id")).filter(~held).orderBy("doc_id").collect()]
    data[-1] = (next(i for i in ids if i >= len(texts)), *data[-1][1:])  # the long one is trained on
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    return data, set(ids), docs, spark.createDataFrame([(r[0], 1) for r in data], "doc_id long, quality int")


def hashed(words):
    return textops.word_hashes(*textops.utf8(pa.array([" ".join(words)])))[0]


def chosen(texts):
    rows = texts.map(lambda batches: (b.select(["lang", "text"]) for b in batches), "lang string, text string")
    return sorted(map(tuple, rows.collect()))


def test_all_trusted_texts_are_learned_from(trusted):
    data, training, docs, labels = trusted
    model = quality.train(docs, labels).model
    texts = [t.split() for i, t, _ in data if i in training]
    counts = Counter(w for t in texts for w in t)
    words = sorted(w for w, c in counts.items() if c >= quality.MIN_COUNT)
    assert sorted(model.vocabulary.tolist()) == sorted(hashed(words).tolist())
    place = {w: quality.FIRST_WORD + int(np.searchsorted(model.vocabulary, h)) for w, h in zip(words, hashed(words))}
    pairs = {(place[a], place[b]) for t in texts for z, a, b in zip([None, *t], t, t[1:]) if a in place and b in place and z != a != b}
    found = {(int(k) >> quality.BITS, int(k) & quality.ANY) for shard in model.bigrams for k in shard.value[0]}
    assert pairs <= found


def test_thresholds_are_quantiles_of_all_held_texts(trusted):
    data, training, docs, labels = trusted
    classifier = quality.train(docs, labels)
    own = [t for i, t, _ in data if i not in training]
    assert chosen(quality.trusted(docs, labels)[1]) == sorted(("en", t) for t in own)
    bits, n = quality._scores(classifier.model, pa.array(own))
    mean = np.round(bits / n, 4)
    median = np.median(mean)
    far = np.quantile(np.round((mean - median) * quality.spread(n), 4), quality.UPPER)
    assert np.allclose(classifier.cuts["en"], (median, quality.SLACK * far), atol=1e-3)


def test_a_model_with_few_places_sums_to_one(trusted, monkeypatch):
    data, training, docs, labels = trusted
    monkeypatch.setattr(quality, "MOST_WORDS", 300)
    monkeypatch.setattr(quality, "MOST_PAIRS", 400)
    monkeypatch.setattr(quality, "MOST_TRIPLES", 50)
    model = quality.train(docs, labels).model
    size = len(model.unigram)
    assert 0 < size - quality.FIRST_WORD <= 300 and abs(model.unigram.sum() - 1) < 1e-9
    assert 0 < sum(len(s.value[0]) for s in model.bigrams) <= 400
    for u in (quality.START, quality.FIRST_WORD, quality.FIRST_WORD + 5):
        token = np.concatenate([[[quality.START, u, w]] for w in range(size)], axis=0).ravel()
        two, _ = quality.surprise(model, token, np.arange(0, 3 * size + 1, 3))
        one, _ = quality.surprise(model, np.array([quality.START, u]), np.array([0, 2]))
        assert abs((10 ** -(two - one[0])).sum() - 1) < 1e-3


def test_many_trusted_ids_are_joined(trusted, monkeypatch):
    data, training, docs, labels = trusted
    some = labels.filter("doc_id % 2 = 0")
    broadcast = [chosen(part) for part in quality.trusted(docs, some)]
    monkeypatch.setattr(quality, "MOST_IDS", 10)
    assert [chosen(part) for part in quality.trusted(docs, some)] == broadcast
    assert [len(part) for part in broadcast] == [sum(i % 2 == 0 and (i in training) == t for i, _, _ in data) for t in (True, False)]


def test_neighbours_of_many_texts_at_once_equal_single_ones_and_brute_force():
    rng = np.random.default_rng(32)
    vectors = []
    for i in range(400):
        t = np.unique(rng.zipf(1.3, 60) % 900)
        w = rng.random(len(t)) if i % 10 else np.ones(len(t))
        vectors.append((t, (w / np.linalg.norm(w)).astype(np.float32)))
    vectors[7] = (np.zeros(0, np.int64), np.zeros(0, np.float32))
    vectors[30:60] = [vectors[30]] * 30  # more copies than neighbours
    index = toxicity.Index(list(range(1000, 1300)), [False] * 300, vectors[:300], 900)
    full = np.zeros((300, 900))
    for i, (t, w) in enumerate(vectors[:300]):
        full[i, t] = w
    found = list(index.nearest_all(vectors))
    assert len(found) == len(vectors) and not len(found[7][0])
    for (t, w), (rows, cosine) in zip(vectors, found):
        exact = full[:, t] @ w.astype(float)
        wanted = [i for i in sorted(range(300), key=lambda i: (-round(exact[i], 12), i)) if exact[i] > 0][:toxicity.K]
        assert (index.ids[rows] - 1000).tolist() == wanted and np.allclose(cosine, exact[wanted], atol=1e-6)
        again, same = index.nearest(t, w)
        assert again.tolist() == rows.tolist() and np.allclose(cosine, same, atol=1e-12)


def test_components_of_paths_and_stars_do_not_plan_earlier_steps_again(spark, monkeypatch):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(200, 201)]
    nodes = sorted({x for link in links for x in link} | {300})
    freed = []
    monkeypatch.setattr(minhash, "release", lambda s: freed.append(s))
    labels = spark.createDataFrame([(i, i) for i in nodes], "node long, component long")
    found = minhash.join_components(labels, spark.createDataFrame(links, "a long, b long"))
    assert freed and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    first = lambda i: 0 if i <= 40 else i // 100 * 100
    assert {r["node"]: r["component"] for r in found.collect()} == {i: first(i) for i in nodes}


def test_size_estimates_do_not_grow_with_the_steps_of_near_dedup(spark, monkeypatch):
    """Check of the pipeline: each step multiplied the estimates of its inputs, whose digits doubled until they filled the driver's heap."""
    rng, texts = random.Random(34), []
    for _ in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(25):  # a chain: neighbours are linked, its ends have nothing in common
            words = words[2:] + [f"w{rng.randrange(5000)}" for _ in range(2)]
            texts.append(" ".join(words))
    kept, store = [], minhash.cut_lineage
    monkeypatch.setattr(minhash, "cut_lineage", lambda df: kept.append(store(df)) or kept[-1])
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i // 25 * 25 for i in range(100)}
    bits = [df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for df in kept]
    assert len(kept) > 6 and max(bits) < 400


def test_scratch_tables_go_with_the_block(spark):
    with scratch(spark) as store:
        tables = [store(spark.range(n).withColumn("b", F.lit("x").cast("binary"))) for n in (3, 0)]
        assert [t.count() for t in tables] == [3, 0] and tables[1].isEmpty()
        files = tables[0].inputFiles()
        assert spark.read.parquet(*files).count() == 3
    with pytest.raises(Exception, match="(?i)path.not.(found|exist)|does not exist"):
        spark.read.parquet(*files)


def test_pipeline_frees_what_a_finished_stage_held(spark, monkeypatch, tmp_path):
    spark.range(3).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    freed = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: freed.append(s), raising=False)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", lambda s, docs, folder: docs) for i in range(3)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3 and len(freed) == 2


def test_the_tokenizer_gets_new_words_in_small_lots(monkeypatch):
    """Check of the pipeline: 30,000 new words in one chunk were encoded at once, a kilobyte of answer for each."""
    lots, encode = [], packing.WordTokens._encode
    monkeypatch.setattr(packing.WordTokens, "_encode", lambda self, words: lots.append(len(words)) or encode(self, words))
    rng = random.Random(33)
    texts = [" ".join(f"{rng.choice('aBcé')}{rng.randrange(10**9)}z{rng.choice(['', '.', '!'])}" for _ in range(300)) for _ in range(100)]
    texts += ["", "one two", texts[0]]
    tokens = packing.WordTokens(tokenizer_path())
    for _ in range(2):  # the second time all words are known
        found = list(tokens.texts(*textops.utf8(pa.array(texts))))
        assert [f.tolist() for f in found] == [tokens.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert 29_000 < sum(lots) < 31_000 and max(lots) <= 10_000


def test_hashing_texts_for_packing_takes_bounded_memory():
    """Check of the pipeline: workers held 64 MB of hash powers and several arrays of that kind for 4 MB of text."""
    texts = ["word " * 10_000] * 160  # 8 MB
    tokens, column = packing.WordTokens(tokenizer_path()), textops.utf8(pa.array(texts))
    textops._powers.__init__()
    tracemalloc.start()
    sizes = [len(ids) for ids in tokens.texts(*column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(sizes)) == 1 and peak < 130e6

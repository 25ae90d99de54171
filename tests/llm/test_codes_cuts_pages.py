"""Vector codes, fill-in-the-middle and main text of pages against brute force, on small tables with hard rows."""

import hashlib
import html
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from widetab.llm import fim, html_text, queries, vector_codes

INF, NAN = float("inf"), float("nan")


# vector codes

def vectors_of(rng, count, length=16):
    return [[rng.choice([-2.0, -0.5, 0.0, 0.25, 1.0, 3.0]) + (rng.random() if rng.random() < 0.7 else 0) for _ in range(length)] for _ in range(count)]


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    usable = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    cells = [(i, [max(-vector_codes.LARGEST, min(vector_codes.LARGEST, math.floor(scale * x))) for x in v], lab) for i, v, lab in usable]
    cells.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cells = [r for r in cells if len(r[1]) == len(cells[0][1])]
    if not cells:
        return [], hashlib.sha256(b"").hexdigest()
    width = -(-len(cells[0][1]) // parts)
    split = [[(v + [0] * width * parts)[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in cells]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for s in split:
                held[near(s[p], books[p])[1]].append(s[p])
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out = []
    for (i, _, lab), s in zip(cells, split):
        found = [near(s[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return out, digest


def codes_of(df):
    books = vector_codes.train(df)
    rows = vector_codes.with_label_errors(vector_codes.encode(df, books)).collect()
    return sorted(((r["vec_id"], r["label"], "".join(f"{c:02x}" for c in r["codes"]), r["error"]) for r in rows), key=str), rows, books


def check_codes(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("codes", F.lit("x")).withColumn("error", F.lit(1))
    expected, digest = brute_codes(rows)
    found, full, books = codes_of(df.repartition(3))
    assert found == sorted(expected, key=str)
    assert books.sha256() == digest
    totals = {}
    for _, lab, _, error in expected:
        totals[lab] = totals.get(lab, 0) + error
    assert all(r["label_error"] == totals[r["label"]] for r in full)
    return df, books


def test_equal_average_search_is_a_full_search():
    rng = np.random.default_rng(0)
    for dim, entries, spread in itertools.product((1, 2, 8), (1, 2, 16, 40), (2, 50, 1 << 27)):
        book = rng.integers(-spread, spread, (entries, dim))
        parts = np.concatenate([rng.integers(-spread, spread, (300, dim)), book])
        index, distance = vector_codes.nearest(parts, book)
        full = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (distance == full.min(axis=1)).all() and (index == full.argmin(axis=1)).all()


def test_vector_codes_hard_rows(spark):
    rng = random.Random(2)
    own = vectors_of(rng, 70)
    rows = [(100 - i, v, i % 3 if i % 7 else None) for i, v in enumerate(own)]
    rows += [(500, None, 1), (501, [], 1), (502, [1.0] * 15 + [None], 1), (503, [NAN] * 16, 2), (504, [INF] + [0.0] * 15, None), (505, [1.0] * 9, 1)]
    rows += [rows[3], (rows[4][0], own[9], 2), (None, own[5], None), (None, None, None), (506, [1e30, -1e30] * 8, 4)]
    df, books = check_codes(spark, rows)
    again, _, same = codes_of(df.repartition(11))
    assert same.sha256() == books.sha256()
    back = {r["vec_id"]: r["embedding"] for r in vector_codes.decode(vector_codes.encode(df, books), books).collect()}
    near = np.array([np.abs(np.array(back[100 - i]) - v).mean() for i, v in enumerate(own)])
    assert near.mean() < 1.0 and all(len(v) == 16 for v in back.values())


def test_vector_codes_few_rows_and_odd_lengths(spark):
    check_codes(spark, [(3, [1.0, 2.0, 3.5], 1), (1, [0.0, -1.0, 4.0], None), (2, [1.0, 2.0, 3.5], 1)], "float")
    check_codes(spark, [(i, [1.0] * 8, 0) for i in range(40)], "float")
    check_codes(spark, [])
    check_codes(spark, [(1, None, 1), (2, [NAN], 2)])


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "KNOWN_LABELS", 2)
    rng = random.Random(4)
    check_codes(spark, [(i, v, rng.choice([None, 1, 2, 3, 4])) for i, v in enumerate(vectors_of(rng, 30))])


# fill in the middle

def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text, text)
    if h[3] % 100 < 20:
        return (doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text)
    return (doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text)


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for s in range(4):
            assert matrix.rank(s, at).tolist() == np.concatenate([[0], np.cumsum(symbols == s)]).tolist()


@pytest.mark.parametrize("chunk", [32, 1 << 22])
def test_fill_in_middle(spark, monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = random.Random(7)
    alphabet = list("abcXYZ  \n\t.,<>PSM09") + ["é", "ß", "中", "🙂", "́", "\r", "\x0b", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 10, 60, 300]))) for _ in range(300)]
    texts += [None, "", "a", "<P>", "x<M>", "<S", "P>", "<<<", "abc" * 30000, "é " * 20000, "one two three"]
    rows = [(i * 7 - 50, t, 5, "z") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[4][0], "other text", 1, "y"), (None, "text without id", 2, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, cuts string").withColumn("form", F.lit(1)).repartition(4)
    out = fim.fill_in_middle(df).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    found = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in out.collect()]
    assert sorted(found, key=str) == sorted((brute_fim(i, t) for i, t, _, _ in rows), key=str)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


# main text of pages

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    sources = ["<div class=ad>x<p>one two</p></div><p>three.</p>", "<nav><a href=x>y</a></nav>text", ""]
    pages = [html_text.parse(s) for s in sources]
    forest = html_text.Forest(pages)
    weights, edges = rng.normal(size=(len(forest.names), 3)), rng.normal(size=(len(html_text.KIND_NAMES), 3, 3))
    belief, joint = html_text.sum_product(forest, weights, edges)
    own = forest.scores(weights)
    first = 0
    for p in pages:
        nodes = range(first, first + len(p.parent))
        first += len(p.parent)
        total, single, pair = 0.0, np.zeros((len(nodes), 3)), np.zeros((len(nodes), 3, 3))
        for states in itertools.product(range(3), repeat=len(nodes)):
            of = dict(zip(nodes, states))
            score = math.exp(sum(own[n, of[n]] + (edges[forest.kind[n], of[forest.parent[n]], of[n]] if forest.parent[n] >= 0 else 0) for n in nodes))
            total += score
            for i, n in enumerate(nodes):
                single[i, of[n]] += score
                if forest.parent[n] >= 0:
                    pair[i, of[forest.parent[n]], of[n]] += score
        assert np.allclose(np.exp(belief[list(nodes)]), single / total)
        assert np.allclose(np.exp(joint[list(nodes)]), pair / total)


def test_parser_mends_broken_pages():
    texts = lambda s: [t for t in html_text.parse(s).text if t]
    assert texts("<p>a<p>b<br>c<div>d</p>e</div>f") == ["a", "b c", "d", "e", "f"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<p>a &amp; b&nbsp; &eacute; &#233 &am &quo</p>") == ["a & b é é &am &quo"]
    assert texts("<script>var a = '</p>';</script><p>x<!-- <p>no --> y</p><style>p</style><title>t</title>") == ["x y"]
    assert texts("<p title='a > b' class=x data-y=\"</p>\">in</p>") == ["in"]
    assert texts("fo<b>ob</b>ar <1 < 2 </ x>z") == ["foobar <1 < 2 z"]
    assert texts("<p>cut off <a href='x") == ["cut off"]
    assert texts("<!-- never closed <p>x") == [] and texts("") == [] and texts("<") == ["<"]
    assert len(texts("<div>" * 3000 + "deep")) == 1
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(html_text.labelled_pages(spark))


def test_held_out_labelled_pages(model):
    pages = [html_text._Writer(77_000_000 + i).page() for i in range(200)]
    right = 0
    for source in pages:
        tree = html_text.parse(source)
        expected = "\n".join(t for t, s in zip(tree.text, html_text.gold_states(tree)) if t and s == html_text.MAIN)
        right += model.texts([re.sub(r" data-(main|rest)", "", source)]) == [expected]
    assert right >= 185


def article_of(source):
    """The blocks of the article of a page of the test tables, whose layout is known."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", inner.group(1)) if inner else []
    cleaned = [" ".join("".join(html.unescape(x) for x in re.split(r"<[^>]*>", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in cleaned if b)


def test_query_equals_known_layout(spark):
    rows = queries.QUERIES["op13_html_extraction"](spark, DATA).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        expected = article_of(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], expected, len(expected))


def test_pages_of_other_layouts(model):
    parts = ["<header><a href='/'>Site</a></header>", "<div class='cookie-banner'>We use cookies. <button>Fine</button></div>",
             "<div id=content><h1>Title</h1><p>One sentence here.</p><div class=advert>Buy this now!</div><p>Another sentence, with <a href=x>a link</a>.</p></div>",
             "<aside class=sidebar><h3>More</h3><ul><li><a href=1>Story</a></ul></aside>", "<form><label>Mail</label><input><button>Go</button></form>",
             "<section id=comments><h2>Comments</h2><div class=comment><p>A reader says something rather long about the text above.</p></div></section>", "<footer>&copy; 2020</footer>"]
    assert model.texts(["".join(parts)]) == ["Title\nOne sentence here.\nAnother sentence, with a link."]


def test_main_text_hard_rows(spark, model, monkeypatch):
    page = "<nav><a href=x>m</a></nav><article><h1>T</h1><p>One.</p><p>Two &amp; three.</p></article>"
    long = "<article><h1>T</h1>" + "<p>Some words that stand in a row.</p>" * 20000 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, page), (None, "v", None), (3, "w", ""), (4, "x", long), (5, "y", "<"), (6, "z", "<nav></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("no")).withColumn("n_chars", F.lit("no")).repartition(2)
    monkeypatch.setattr(html_text, "BATCH", 50)
    found = {(r["page_id"], r["url"]): r for r in html_text.main_text(df, model).collect()}
    assert len(found) == 7 and html_text.main_text(df, model).count() == 8
    assert found[1, "u"]["text"] == found[2, None]["text"] == "T\nOne.\nTwo & three."
    assert found[4, "x"]["n_chars"] == 1 + 20000 * (1 + len("Some words that stand in a row.")) and found[4, "x"]["text"].count("\n") == 20000
    assert all(found[k]["text"] == "" and found[k]["n_chars"] == 0 for k in ((None, "v"), (3, "w"), (6, "z")))
    assert html_text.main_text(df.limit(0), model).count() == 0


def test_train_on_few_pages(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    none = html_text.train(empty)
    assert none.texts(["<p>x</p>"]) == [""]
    some = spark.createDataFrame([(None, None), (1, "<p>x</p>"), (1, "<p data-main>y</p>")], "page_id long, html string")
    assert len(html_text.train(some, steps=5).texts(["<p>x</p>"])) == 1

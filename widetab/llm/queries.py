"""The operators as queries over whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.llm import (
    decontaminate, fim, fingerprint, html_text, license_scan, line_dedup, lm_score, minhash, packing, quality, toxicity, vector_codes, warc,
)
from widetab.llm.frames import read
from widetab.session import ensure_checkpoint_dir

QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_line_dedup(spark, folder: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(read(spark, folder, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op1_line_dedup"] = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
held AS (SELECT line_key, min(doc_id) AS first_id FROM keyed WHERE length(line_key) >= 10 GROUP BY line_key),
marked AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > h.first_id, false) AS dropped FROM keyed k LEFT JOIN held h ON k.line_key = h.line_key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_best_fit_packing(spark, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), tokenizer_path())


@query
def op3_quality_classifier(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality.classify(docs, quality.train(docs, read(spark, folder, "labels")))


@query
def op7_minhash(spark, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"))


@query
def op8_decontamination(spark, folder: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op9_fingerprints(spark, folder: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, folder, "documents"))


@query
def op10_license_scan(spark, folder: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, folder, "documents"))


def crc_is_one(doc_id, modulus: int):
    """Whether crc32 of the id as text leaves 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus == 1, F.lit(False))


@query
def op4_toxicity(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = toxicity.train(docs, read(spark, folder, "labels").filter(~crc_is_one(F.col("doc_id"), 3)))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", crc_is_one(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
                      "vote", "evidence", "cosines")


@query
def op6_warc(spark, folder: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read(spark, folder, "pages"), path)
    found = warc.read_archives(spark, path, with_payload=False).filter("record_type is not null")
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        warc.page_of(F.col("refers_to")).alias("refers_to"))


SQL["op6_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


@query
def op5_lm_scoring(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    out = lm_score.score_texts(docs, docs.filter(~crc_is_one(F.col("doc_id"), 5)))
    return out.withColumn("held_out", crc_is_one(F.col("doc_id"), 5))


@query
def op11_vector_codes(spark, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    books = vector_codes.train(vectors)
    out = vector_codes.with_label_errors(vector_codes.encode(vectors, books))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Full search instead of equal-average search, one pair of materialised tables per round."""
    steps = [f"""
WITH cells AS MATERIALIZED (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x, len(embedding) // {parts} AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
points AS MATERIALIZED (SELECT vec_id, label, pos // width AS part, pos % width AS place, x FROM cells),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM cells) ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT part, entry, place, x AS c FROM points JOIN firsts USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, part, entry, error FROM (
    SELECT vec_id, label, part, entry, error, row_number() OVER (PARTITION BY vec_id, part ORDER BY error, entry) AS rank FROM (
      SELECT p.vec_id, any_value(p.label) AS label, part, b.entry, sum((p.x - b.c) * (p.x - b.c)) AS error FROM points p JOIN book{r} b USING (part, place) GROUP BY p.vec_id, part, b.entry))
  WHERE rank = 1)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT n.part, n.entry, p.place, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS c FROM near{r} n JOIN points p USING (vec_id, part) GROUP BY n.part, n.entry, p.place) m
  USING (part, entry, place))""")
    return ",".join(steps) + f"""
, codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM codes
"""


SQL["op11_vector_codes"] = _vector_codes_sql()


@query
def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    out = fim.fill_in_middle(read(spark, folder, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL["op12_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@query
def op13_html_extraction(spark, folder: str) -> DataFrame:
    return html_text.main_text(read(spark, folder, "pages"), html_text.train(html_text.labelled_pages(spark)))


@query
def license_base_places(spark, folder: str) -> DataFrame:
    """What op 10 says of its base phrases, which SQL can say too."""
    return license_scan.scan_licenses(read(spark, folder, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


SQL["license_base_places"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, len(w) AS n_words, list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
    list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
    list_filter(range(0, len(w) - 2), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl FROM d),
a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM a
"""


@query
def fingerprint_edits(spark, folder: str) -> DataFrame:
    """The texts that op 9 compares: lengths, and each text with its last half replaced from the next document."""
    return fingerprint.fingerprints(read(spark, folder, "documents")).select("doc_id", "n_chars", "edited_sha256")


SQL["fingerprint_edits"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
f AS (SELECT text FROM d ORDER BY doc_id LIMIT 1),
e AS (SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY doc_id), (SELECT text FROM f)) AS next FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(next, 1, n // 2)) AS edited_sha256 FROM e
"""

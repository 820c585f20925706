"""The registered opN_ queries and, where SQL can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import common


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_sentencepiece(spark, sf_dir):
    from .sentencepiece_codec import round_trip

    common.small_batches(spark)
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality(spark, sf_dir):
    from . import quality
    from .toxicity import labelled

    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled(common.table(spark, sf_dir, "labels"), "quality", ~common.in_fold("doc_id", 4, 2), quality.TRAIN_DOCS)
    vectors = quality.word_vectors(docs)
    scored = quality.score(docs, quality.fit(docs, sample, vectors), vectors, keep=["doc_id"])
    return scored.select("doc_id", common.in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_nearest_neighbours(spark, sf_dir):
    from .ann import search

    common.small_batches(spark, 5000)
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_toxicity(spark, sf_dir):
    from . import toxicity

    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = toxicity.labelled(common.table(spark, sf_dir, "labels"), "toxic", ~common.in_fold("doc_id", 5, 0), toxicity.TRAIN_DOCS)
    model = toxicity.fit(docs, sample)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", common.in_fold("doc_id", 5, 0).alias("held_out"), "score", toxicity.is_toxic(F.col("score"), model).cast("int").alias("predicted"))


def op6_best_fit_packing(spark, sf_dir):
    from .packing import pack, pieces

    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 2))


def op7_language_id(spark, sf_dir):
    from . import language_id

    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~common.in_fold("doc_id", 4, 2)))
    predicted = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return predicted.select("doc_id", common.in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark, sf_dir):
    from .url_filter import joined_outcomes, judge

    outcomes = joined_outcomes(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels"))
    return judge(outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_token_store(spark, sf_dir):
    from .token_store import read_tokens, write_tokens

    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    folder = common.scratch(spark, "tokens")
    manifest = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), False, 1)
    return read_tokens(manifest, folder)


def op10_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_join

    common.small_batches(spark)
    return ngram_join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_exact_dedup, op4_nearest_neighbours, op5_toxicity, op6_best_fit_packing, op7_language_id, op8_url_filter, op9_token_store, op10_ngram_join)}

OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), labelled AS (
  SELECT p.*, q.good FROM parts p LEFT JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q
    ON q.doc_id = try_cast(regexp_extract(path, '(\d+)(?:\.html)?/?$', 1) AS bigint)
), hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, string_split(host, '.') AS l FROM labelled GROUP BY host
), named AS (
  SELECT host, n, good, l[-1] AS last1, CASE WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS last2,
         CASE WHEN len(l) > 2 THEN l[-3] || '.' || l[-2] || '.' || l[-1] WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS last3 FROM hosts
), h AS (
  SELECT host, n, good, CASE WHEN last2 IN (TWO) THEN last2 ELSE last1 END AS suffix, CASE WHEN last2 IN (TWO) THEN last3 ELSE last2 END AS domain FROM named
), t AS (
  SELECT coalesce(sum(n), 0)::double AS tn, coalesce(sum(good), 0)::double AS tg, CASE WHEN tn > 0 THEN tg / tn ELSE 0.5 END AS m FROM h
), d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY suffix),
moments AS (
  SELECT 'h' AS level, count(*)::double AS g, sum(good * good / n::double) AS s, sum(n * n)::double AS nn FROM h WHERE n > 0
  UNION ALL SELECT 'd', count(*), sum(good * good / n::double), sum(n * n) FROM d WHERE n > 0
  UNION ALL SELECT 's', count(*), sum(good * good / n::double), sum(n * n) FROM s WHERE n > 0
), rhos AS (
  SELECT level, tn, CASE WHEN m * (1 - m) * (tn - nn / tn - (g - 1)) <> 0
         THEN (s - tg * tg / tn - m * (1 - m) * (g - 1)) / (m * (1 - m) * (tn - nn / tn - (g - 1))) END AS rho FROM moments, t
), ks AS (SELECT level, CASE WHEN tn > 0 THEN CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END ELSE 1.0 END AS k FROM rhos),
sm AS (SELECT suffix, (good + k * m) / (n + k) AS mean FROM s, t, ks WHERE level = 's'),
dm AS (SELECT domain, (d.good + k * sm.mean) / (d.n + k) AS mean FROM d JOIN sm USING (suffix), ks WHERE level = 'd'),
hm AS (SELECT host, (h.good + k * dm.mean) / (h.n + k) AS mean, h.n + k AS size FROM h JOIN dm USING (domain), ks WHERE level = 'h'),
judged AS (
  SELECT page_id, host, path, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) >= 0.5 THEN 'allow' ELSE 'block' END AS method,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM labelled JOIN hm USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE method END AS verdict FROM judged
""".replace("TWO", "'co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in'").replace("\\\\", "\\")

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words
), sized AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS id FROM sets),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT i, j, a.id <> b.id AS other, b.id FROM pairs JOIN sized a ON a.doc_id = i JOIN sized b ON b.doc_id = j WHERE 100 * o >= 75 * (a.n + b.n - o)),
reach(i, j) AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.first, doc_id)) AS component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM sized LEFT JOIN (SELECT i, min(j) AS first FROM reach GROUP BY i) m ON m.i = doc_id
LEFT JOIN (SELECT i, count(DISTINCT id) AS n_links FROM links WHERE other GROUP BY i) k ON k.i = doc_id
"""

ORACLES = {"op8_url_filter": OP8_SQL, "op3_exact_dedup": OP3_SQL, "op10_ngram_join": OP10_SQL}

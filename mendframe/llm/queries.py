"""The registered queries of the operators and of the pipeline, with checking SQL where it can be said.

Each applies its operator, with the parameters of production, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from mendframe.llm import hard_negatives, host_rules, html_text, line_dedup, log_bilinear, mixing, packing, sharding, simhash, spelling, tokens, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(spark, _table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, vector=F.when(finite, whole), all_rows=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_verdicts(_table(spark, sf_dir, "documents"))


def host_rules_of_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host rules over classes of length, a hundred characters each: some of them fail as a whole."""
    docs = _table(spark, sf_dir, "documents")
    return host_rules.host_verdicts(docs.withColumn("hundreds", F.floor(F.col("n_chars") / 100)), host_col="hundreds")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select(F.col("whole.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("clean").alias("text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label, F.when(finite, whole))


def op12_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_sharding, op3_html, op4_topk, op5_simhash, op6_tokens, op7_host_rules, op8_mixing, op9_packing, op10_line_spread, op11_hard_negatives, op12_log_bilinear, op13_spelling, host_rules_of_lengths, pipeline)
}

WORDS_SQL = r"'[^\x20\x09-\x0D]+'"

OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid, q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.uid <> x.uid
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

HOST = "source"
HUNDREDS = "(n_chars // 100)::VARCHAR"


def host_sql(host: str) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || {host}, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {WORDS_SQL}) AS w
  FROM documents
), pos AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM pos
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, {WORDS_SQL}) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, d.host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY host
), m AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(failed)::DOUBLE AS f, sum(n::DOUBLE * n) AS nn,
         sum(failed::DOUBLE * failed / n) AS ffn, sum(failed)::DOUBLE / sum(n) AS mean FROM h
), v AS (
  SELECT *, mean * (1 - mean) AS noise,
         CASE WHEN n - nn / n > 0 THEN (ffn - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - nn / n) ELSE 0 END AS between_hosts FROM m
), p AS (
  SELECT mean, CASE WHEN mean IN (0, 1) THEN 1.0 WHEN between_hosts <= noise / (n + 1) THEN n
                    ELSE greatest(noise / between_hosts - 1, 1e-6) END AS strength FROM v
), r AS (
  SELECT host, n + strength AS weight, (failed + mean * strength) / (n + strength) AS rate,
         {host_rules.MULTIPLE} * mean / (1 - mean + {host_rules.MULTIPLE} * mean) AS most FROM h, p
), bad AS (
  SELECT host FROM r WHERE rate - {host_rules.DEVIATIONS} * sqrt(rate * (1 - rate) / (weight + 1)) > most
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept
FROM b
"""


OP10 = f"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), k AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l
), spread AS (
  SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), marked AS (
  SELECT k.*, spread.bare IS NOT NULL AND row_number() OVER (PARTITION BY k.bare ORDER BY doc_id, pos) > 1 AS gone
  FROM k LEFT JOIN spread ON k.bare = spread.bare
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, kept.text
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), bits AS (
  SELECT *, unhex(sha1(html)) AS digest FROM p
), letters AS (
  SELECT *, lower(sha1(html)) AS hex FROM p
)
SELECT page_id, size::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (list_sum(list_transform(range(0, 5), lambda j:
           (((instr('0123456789abcdef', hex[((5 * i + j) // 4 + 1)::INTEGER]) - 1) // (1 << (3 - (5 * i + j) % 4)::INTEGER)) % 2) * (1 << (4 - j)::INTEGER)))
         )::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM letters
"""

OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_dot_product(a.e, x.e)::BIGINT AS score
  FROM v a JOIN v x ON a.uid <> x.uid
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.uid, p.place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.uid = s.uid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

CHECKS = {"op1_warc": OP1, "op4_topk": OP4, "op7_host_rules": host_sql(HOST), "host_rules_of_lengths": host_sql(HUNDREDS), "op10_line_spread": OP10, "op11_hard_negatives": OP11}
if corpus_pipeline.ORACLE_SQL is not None:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL

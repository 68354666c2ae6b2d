"""One query per operator, with production parameters, over its whole table; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from quadrat.llm import html, lines, mixing, pieces, quality, recurrent, simhash, urls, vectors, warc
from quadrat.llm.shared import table


def op1_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op3_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"))


def op4_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes_report(table(spark, sf_dir, "documents"))


def op5_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op6_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), ids=False, digests=True)


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.annotate(table(spark, sf_dir, "documents"), report).drop("failed_rule")


def op10_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_differencing, op2_url_ratio, op3_balanced_lists, op4_ball_simhash, op5_segment_join, op6_recurrent_lm, op7_soft_mixing, op8_piece_table, op9_rule_cascade, op10_dictionary_warc)
}

ORACLE_SQL: dict[str, str] = {
    # exact where the index reads every list, as on small tables
    "op3_balanced_lists": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_rule_cascade": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D ]')) AS l
  FROM documents),
f AS (
  SELECT doc_id, t, w, l, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(t) - length(regexp_replace(t, '[^\\x09-\\x0D ]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         list_sum(list_transform(l, lambda x: length(x))) - list_sum(list_transform(list_distinct(l), lambda x: length(x))) AS dup_chars,
         len(list_filter(w, lambda x: regexp_matches(x, '(!!|\\?\\?|!\\?|\\?!)$'))) AS loud,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS lettered
  FROM d),
g AS (
  SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w FROM f WHERE n_words >= 3),
h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM g),
p AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM h WHERE c > 1) GROUP BY doc_id),
r AS (
  SELECT f.*, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM f LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * loud > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * coalesce(dup_chars, 0) > 3 * length(t) OR 10 * lettered < 8 * n_words) AS kept
FROM r""",
    "op10_dictionary_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
m AS (
  SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000""",
}

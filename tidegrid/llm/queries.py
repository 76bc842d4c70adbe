"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import byte_bpe, decontaminate, exact_dedup, html_extract, line_dedup, ngram_join, quality, secrets, source_audit, source_mixing, token_alignment, token_files, toxicity
from tidegrid.llm.storage import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_tokens=False)


@register
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER (PARTITION BY bare ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(bare) AS text_sha256
FROM d
"""


@register
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@register
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_on_file(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels"), "quality"))


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels"), "toxic"))


@register
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(read_table(spark, sf_dir, "documents")).drop("row_hash", "leads")


@register
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@register
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


@register
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = source_mixing.label_weights(docs, read_table(spark, sf_dir, "labels"))
    return source_mixing.mix(docs, weights, unknown_weight=source_mixing.UNLABELLED_WEIGHT)


ORACLE_SQL["op13_source_mixing"] = r"""
WITH known AS (
  SELECT doc_id, CASE WHEN max(quality) = 1 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(k.weight, 2.0::DOUBLE) AS weight,
         (('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN known k USING (doc_id)
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS most,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS words, sum(w) OVER () AS ws,
         coalesce(sum(most) OVER e, 0) AS most_before, coalesce(sum(w) OVER e, 0) AS w_before
  FROM w WINDOW e AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, most * (ws - w_before) <= (words - most_before) * w AS capped FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN most::DOUBLE
              ELSE ((words - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) * w)::DOUBLE
                   / (ws - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::DOUBLE END AS target
  FROM c
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size::DOUBLE)::BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT d.*, p.source_size, p.target, p.epochs,
         CASE WHEN p.epochs >= 3 THEN 0 ELSE floor(p.target + 0.5)::BIGINT - p.epochs * p.source_size END AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size::BIGINT AS size, source_size::BIGINT AS source_size, target, weight, epochs::BIGINT AS epochs,
       (epochs * size + least(greatest(rest - before, 0), size))::BIGINT AS taken
FROM o
"""


@register
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), ng AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), share AS (
  SELECT ng.lang, ng.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (ng.total + 5 * v.v) AS p
  FROM ng JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = ng.lang AND c.source = ng.source AND c.term = kept.term
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM share GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), term AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - w.q)::BIGINT AS value
  FROM share s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment(read_table(spark, sf_dir, "documents"), *paths)

"""Queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import (
    decontaminate, hamming, html_main, jaccard, language, licenses, mixing, negatives, secrets, substrings, tokens, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "shares")


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a 49k word vocabulary."""
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_hamming_top_k")
def hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes to every hundredth embedding, among all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.search(rows, rows.where("id % 100 = 0"))


@query("op4_decontaminate")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(scanned)


@query("op5_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


SIZES_SQL = r"""sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS rank
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w
  FROM sizes GROUP BY source),
-- In the order of 3 s / w, a source is full if its part of what is left would exceed it.
filled AS (
  SELECT source, s, w,
    (SELECT sum(s) FROM sources) - coalesce(sum(3 * s) OVER before, 0) AS rest,
    (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER before, 0) AS weight
  FROM sources
  WINDOW before AS (ORDER BY 3 * s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, weight FROM filled WHERE NOT (3 * s * weight < w * rest)
  ORDER BY 3 * s / w, source IS NULL, source LIMIT 1),
targets AS (
  SELECT f.source, f.s, CASE WHEN 3 * f.s * f.weight < f.w * f.rest THEN CAST(3 * f.s AS DOUBLE)
      ELSE CAST(f.w * l.rest AS DOUBLE) / CAST(l.weight AS DOUBLE) END AS target
  FROM filled f, level l),
quotas AS (
  SELECT source, s, target, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM targets)"""


@query(
    "op6_mix_sources",
    "WITH "
    + SIZES_SQL
    + """
SELECT doc_id, d.size, q.s AS source_size, q.target,
  CAST(CASE WHEN q.s = 0 THEN 0 ELSE d.size * (q.quota // q.s) + greatest(0, least(d.size, q.quota % q.s
    - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, doc_id, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS BIGINT) AS taken
FROM sizes d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source""",
)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of its sources at weights 1, 2, 3."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("sources")


@query("op7_secret_spans")
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by pattern and by character models."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(secrets.labelled_sample(docs))))


@query("op8_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


@query("op9_license_notices")
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.TEMPLATES | licenses.SHORT)


@query("op10_jaccard_classes")
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under shared 5-word shingles."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the sixteen greatest principal components, at unit variance."""
    return whitening.whiten_table(table(spark, sf_dir, "embeddings"))


@query(
    "op12_warc",
    """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS code,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(code, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM payloads""",
)
def web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a web archive, from the merged index of the archives."""
    merged = warc.archive_table(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op13_hard_negatives",
    """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""",
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows of other labels per anchor and positive, the closest ones that stay clear of the positive."""
    return negatives.mine(table(spark, sf_dir, "embeddings"), label="if(vec_id % 7 = 0, (label + 1) % 10, label)")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix of the documents that all stages keep."""
    return corpus_pipeline.run(spark, sf_dir)

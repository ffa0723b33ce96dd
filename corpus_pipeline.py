"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, jaccard, language, mixing, secrets
from clickloom.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that get a language, mixtures as well; those without a letter go, and all if no language is learned.

    A document without ``lang`` gets the one that holds most of it.
    """
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs, model).where(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates."""
    return jaccard.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any secret."""
    return secrets.clean(docs, secrets.fit(secrets.labelled_sample(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that give words to it, with how many."""
    return mixing.mix(docs).where("taken > 0").select("doc_id", F.element_at("sources", 1).alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("language", known_language),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("mix", mixed),
]

# Expectation-maximisation and the character models are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

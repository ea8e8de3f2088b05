"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

quality   texts that the discriminant scores below the threshold go
exact     of texts equal without white space one stays
near      of each component of near-duplicates (five-word shingles, Jaccard 0.8) one document stays
private   personal data, and terms that disclose it, are replaced in the texts
pack      the documents are packed into sequences; this stage returns pieces
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import exact_dedup, ngram_join, packing, pii, quality
from strandmill.llm.common import shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("exact", drop_copies), ("near", drop_near_copies), ("private", hide_private), ("pack", pack)]

#: The discriminant can't be said in SQL; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Structured Streaming forms: per-region transforms, stream-static overlaps, running window counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.interval_join import interval_join


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def transform(stream: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any per-region transform; these are projections, so they hold on streams."""
    return op(stream)


def overlaps(stream: DataFrame, ref: DataFrame, *, bits: int, stranded: bool = True) -> DataFrame:
    """Streamed regions with the static reference regions that they meet; the bin width has to be given."""
    return interval_join(stream, ref, stranded=stranded, bits=bits).selectExpr("t.region_id", "t.label", "r.region_id AS ref_id")


def ref_counts(stream: DataFrame, ref: DataFrame, *, bits: int, stranded: bool = True) -> DataFrame:
    """Running counts per reference region, for the update and complete modes."""
    return overlaps(stream, ref, bits=bits, stranded=stranded).groupBy("ref_id").agg(F.count("*").alias("hits"))

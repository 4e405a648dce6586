"""Registered queries of the library, one module for each family of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans import aggregates, arrays, jobs, manifests, relational, sequences, text, training
from lexiloom.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary lookup of every document's characters."""
    return relational.vocab_lookup(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

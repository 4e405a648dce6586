"""Writers: manifests, sharded stores, error details, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines with gzip; nothing happens where the manifest exists."""
    df.write.mode("ignore").option("compression", "gzip").json(path)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """One folder for each shard, numbered with eight digits."""
    number = F.lpad(F.pmod(F.xxhash64(key), F.lit(shards)).cast("string"), 8, "0")
    df.withColumn("shard", number).repartition(shards, "shard").write.partitionBy("shard").mode("ignore").parquet(path)


def write_error_details(df: DataFrame, path: str, totals_path: str) -> None:
    """Tab-separated rows Name, WER, Truth, Hypothesis, Insertions, Deletions, Substitutions, and the totals beside them."""
    names = ["Name", "WER", "Truth", "Hypothesis", "Insertions", "Deletions", "Substitutions"]
    df.select(*names).write.option("sep", "\t").option("header", "true").csv(path)
    df.agg(*[F.sum(n).alias(n) for n in names[4:]], F.count("*").alias("Utterances")).write.json(totals_path)


def save_dictionary(df: DataFrame, path: str) -> None:
    """(key, value) rewritten whole, in the order of the keys."""
    df.orderBy("key").write.mode("overwrite").json(path)

"""The corpus pipeline: ``documents`` -> texts worth training on, as token ids.

Each stage works on what the one before kept; its result is written as Parquet and read
again as the next one's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import simhash_similar, toxicity
from lexiloom.llm.common import new_folder, remove_folder, scoped, table
from lexiloom.llm.decontaminate import drop_contaminated
from lexiloom.llm.exact_dedup import drop_exact_duplicates
from lexiloom.llm.sentencepiece_dropout import Pieces, encode_texts
from lexiloom.llm.vocabulary import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts. It learns from the labelled rows of ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that share 0.8 of their five-word shingles."""
    return simhash_similar.drop_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (the token ids of the text), lossless (they decode to it): what training reads."""
    return encode_texts(docs, Pieces(vocabulary_path("piece_bpe_32k.model")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("encode", encode),
]

#: The toxicity model and the hash-keyed segmentation cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next.

    A stage's folder goes when the next one is written, what it keeps meanwhile when its own is. Rows with null or repeated ids pass as
    rows of their own, and further columns pass through to the last stage; an empty table
    gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        with scoped(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return docs

"""Exact duplicates: one row of each group of equal texts stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.common import free_names, kept, without

#: White space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null is empty; every run of white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of a text's content."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts group by their 128-bit hash together with their bytes: the aggregation compares
    the bytes of rows whose hashes are equal, so texts that collide part. Copies fold
    inside each map task before the shuffle; a group that holds a third of all rows
    sends one row from each task. The rows then find their class by hash and SHA-256
    in a join whose right side has one row for each class (adaptive execution splits the
    hot key's left side).

    Defined cases: null text is empty, and all empty texts are one group; a null id never
    stays while its group has another id (a group of null ids only keeps none: ``kept`` is
    false, ``keep_id`` null); where a row is repeated with the same id, each copy is
    returned with ``kept`` true. Empty tables give no rows. Other columns are ignored.
    """
    return _classes(docs, id_col, text_col, hash_of).drop("t", "h")


def _classes(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``exact_duplicates``, with the hash t of the text as it stands and the content hash h."""
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), normalised(F.col(text_col)).alias("norm"))
    norm = norm.select("doc_id", "t", "norm", hash_of(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    classes = (
        norm.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = norm.select("doc_id", "t", "h", "text_sha256")
    return rows.join(classes, ["h", "text_sha256"]).select(
        "doc_id",
        "t",
        "h",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, one with the smallest id; rows with a null id stay.

    Rows are decided by id and text, so rows that share an id and differ in their text are
    apart. Where several rows of a group have its smallest id, one of them stays. Columns keep
    their names, whatever they are; an empty table stays empty.
    """
    found = kept(_classes(docs, id_col, text_col, content_hash).select("doc_id", "t", "h", "kept").where("doc_id is not null"), "classes")
    left = without(docs, found.where(~F.col("kept")).select("doc_id", "t"), id_col, text_col)
    if found.where("kept").groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return left
    # rows that repeat an id and a text: one of each is enough
    a, b = free_names(docs, "own_id", "own_hash")
    marked = left.withColumns({a: F.col(f"`{id_col}`").cast("long"), b: content_hash(normalised(F.col(f"`{text_col}`")))})
    one = marked.where(F.col(a).isNotNull()).dropDuplicates([a, b])
    return one.unionByName(marked.where(F.col(a).isNull())).drop(a, b)

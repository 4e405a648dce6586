"""Asking a model for what is not known yet: cache, numbered batches, guards."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Tokens of one request, tries after a failure, and how much longer than its token, or its text, a reply may be.
BATCH, RETRIES, LONGER, TEXT_LONGER = 30, 2, 10, 3

#: Kept answers up to this number go to all executors; more of them are dealt by token.
BROADCAST_ROWS = 1_000_000

Provider = Callable[[str], str]

#: What a model finds in a text.
EXTRACTION = "acronyms array<string>, foreign_vietnamese_pairs array<struct<foreign_word:string,vietnamese_spelling:string>>"


def numbered(tokens: list[str]) -> str:
    return "\n".join(f"[{k}] {t}" for k, t in enumerate(tokens))


def replies(tokens: list[str], reply: str) -> list[str]:
    """A reply's numbered lines, token by token; a missing, blank or far too long one leaves the token as it is."""
    found = {}
    for line in reply.strip().split("\n"):
        if m := re.match(r"\s*\[\s*(\d+)\s*\](.*)$", line):
            found[int(m[1])] = m[2].strip()
    said = [found.get(k, t) for k, t in enumerate(tokens)]
    return [t if not s.strip() or len(s) > LONGER * len(t) else s for t, s in zip(tokens, said)]


def asked(tokens: DataFrame, provider: Provider, batch: int = BATCH, retries: int = RETRIES, wait: float = 0.5) -> DataFrame:
    """(token, said, answered) of the distinct, non-null ``tokens`` (token), in requests of at most ``batch`` of them.

    Requests run where the tokens lie. One that fails is tried again after a growing pause; if
    it fails for good, its tokens stay as they are and are not ``answered``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, told, fine = frame["token"].tolist(), [], []
            for at in range(0, len(own), batch):
                part = own[at : at + batch]
                said, good = part, False
                for attempt in range(retries + 1):
                    try:
                        said, good = replies(part, provider(numbered(part))), True
                        break
                    except Exception:  # any provider, any failure
                        if attempt < retries:
                            time.sleep(wait * 2**attempt)
                told += said
                fine += [good] * len(part)
            yield pd.DataFrame({"token": own, "said": told, "answered": fine})

    return tokens.where("token is not null").select("token").distinct().mapInPandas(run, "token string, said string, answered boolean")


def known_answers(requests: DataFrame, folder: str, number: int | None = None) -> DataFrame:
    """(token, said) that ``folder`` holds, without what batch ``number`` wrote; nothing where there is no folder yet."""
    spark = requests.sparkSession
    try:
        rows = spark.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.range(0).select(F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("said"))
    rows = rows.where("answered")
    rows = rows if number is None else rows.where(F.col("batch") != number)
    return rows.groupBy("token").agg(F.max_by("said", "batch").alias("said"))


def answered(requests: DataFrame, folder: str, number: int, provider: Provider, tokens: DataFrame | None = None, **options) -> DataFrame:
    """``requests`` (token, ...) with ``said``: known answers by a join, the others asked for once and kept in ``folder``.

    The misses of this batch are written below their number before they are read, so a batch that
    runs again asks for its own again and nothing twice within. Null tokens say null. ``tokens``
    (token) may hold the requests' tokens where they are had for less than the requests themselves.
    """
    known = known_answers(requests, folder, number)
    # Spark would push an anti join below the distinct
    each = (requests if tokens is None else tokens).select("token").distinct()
    misses = each.join(known.select("token", F.lit(True).alias("_known")), "token", "left").where("_known is null")
    here = f"{folder}/batch={number:08d}"
    asked(misses, provider, **options).write.mode("overwrite").parquet(here)
    # a miss is not known, so each token has one answer
    spark = requests.sparkSession
    answers = known.unionByName(spark.read.parquet(here).select("token", "said"))
    few = spark.read.parquet(folder).count() <= BROADCAST_ROWS
    return requests.join(answers.hint("broadcast" if few else "shuffle_hash"), "token", "left").withColumn("said", F.coalesce("said", "token"))


def stream_answers(requests: DataFrame, folder: str, out: str, checkpoint: str, provider: Provider, **options) -> None:
    """The same for each micro-batch of a stream; results go below ``out``, a batch that runs again replaces its own."""

    def store(batch: DataFrame, number: int) -> None:
        answered(batch, folder, number, provider, **options).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start().awaitTermination()


def guarded_text(text: Column, reply: Column) -> Column:
    """A whole text's reply without the blanks around it; a missing, blank or far too long one leaves the text."""
    bare = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    good = (bare != "") & (F.char_length(reply) <= TEXT_LONGER * F.char_length(text))
    return F.when(F.coalesce(good, F.lit(False)), bare).otherwise(text)


def merged_extractions(chunks: DataFrame, key: str, place: str, reply: str) -> DataFrame:
    """(key, acronyms, pairs) of the replies (JSON) to a text's chunks.

    Acronyms are distinct and sorted; of pairs of one word the last chunk's last counts, words
    in order. Replies that are no JSON object of that shape, and blank or missing parts, count as nothing.
    """
    parsed = chunks.select(F.col(key).alias("_key"), F.col(place).alias("_place"), F.from_json(reply, EXTRACTION).alias("e"))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    names = F.filter(F.transform(F.coalesce("e.acronyms", F.array().cast("array<string>")), bare), lambda a: a != "")
    pairs = F.filter(F.coalesce("e.foreign_vietnamese_pairs", F.array().cast("array<struct<foreign_word:string,vietnamese_spelling:string>>")), lambda p: (p["foreign_word"] != "") & (p["vietnamese_spelling"] != ""))
    rows = parsed.select("_key", "_place", names.alias("names"), pairs.alias("pairs"))
    each = rows.select("_key", "_place", F.posexplode("pairs").alias("_at", "p"))
    said = each.select("_key", "_place", "_at", bare(F.col("p.foreign_word")).alias("word"), bare(F.col("p.vietnamese_spelling")).alias("said"))
    last = said.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "word").orderBy(F.desc("_place"), F.desc("_at")))).where("_n = 1")
    of_words = last.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("word", "said"))).alias("pairs"))
    of_names = rows.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("acronyms"))
    out = of_names.join(of_words, "_key", "left")
    return out.select(F.col("_key").alias(key), "acronyms", F.coalesce("pairs", F.array().cast("array<struct<word:string,said:string>>")).alias("pairs"))


def scored(rows: DataFrame, column: str, scorer: Callable[[list[str]], list[float]], batch: int = BATCH, out: str = "score") -> DataFrame:
    """``rows`` with what a scorer says of ``column``, asked for ``batch`` values at a time, in their order.

    Null values have no score and are not asked for. A reply of another length is an error.
    """

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        own = values.dropna()
        said = pd.Series(index=values.index, dtype="float64")
        for at in range(0, len(own), batch):
            part = own.iloc[at : at + batch]
            scores = scorer(part.tolist())
            if len(scores) != len(part):
                raise ValueError(f"{len(scores)} scores for {len(part)} values")
            said.loc[part.index] = scores
        return said

    return rows.withColumn(out, run(F.col(column)))


def transformed(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``df`` through a user's steps, one after another."""
    for step in steps:
        df = df.transform(step)
    return df

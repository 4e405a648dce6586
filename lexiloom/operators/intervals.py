"""Joins of intervals by shared buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _spread(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket of ``width`` that the half-open interval meets."""
    return df.where(f"{end} > {start}").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of rows of ``a`` (key, a_start, a_end, ...) and ``b`` (key, b_start, b_end, ...) that overlap, with start and end.

    Intervals are half-open and whole numbers. Rows meet only in buckets that both touch, and
    a pair counts in the bucket where its overlap begins, so it comes once. Empty intervals
    and null bounds meet nothing. ``width`` should be near the usual length.
    """
    met = _spread(a, "a_start", "a_end", width).join(_spread(b, "b_start", "b_end", width), [key, "_bucket"])
    cut = met.withColumns({"start": F.greatest("a_start", "b_start"), "end": F.least("a_end", "b_end")})
    return cut.where((F.col("start") < F.col("end")) & (F.floor(F.col("start") / width) == F.col("_bucket"))).drop("_bucket")


def speaker_slices(turns: DataFrame, chunks: DataFrame, audio: str = "audio", rate: Column | int = 1, width: int = 1 << 20) -> DataFrame:
    """(audio, speaker, place, chunk, first, last): what of which chunk belongs to each of two speakers, in order.

    ``turns`` are (audio, speaker, start, end) in seconds, speakers 0 and 1; a bound falls on
    the sample below it. ``chunks`` are (audio, chunk, offset, samples). ``first`` and ``last`` are samples of the
    chunk, half-open. Turns are put one after another by their start, and a turn over several
    chunks by its samples. Where one of the speakers has no turn, both have the whole audio.
    Turns of other speakers, and null rows, count for nobody; audio without turns is whole
    for both; turns without chunks give no rows.
    """
    at = lambda c: F.floor(F.col(c) * rate).cast("long")
    ours = turns.where(F.col("speaker").isin(0, 1) & F.col("start").isNotNull() & F.col("end").isNotNull())
    spans = ours.select(audio, F.col("speaker").cast("int").alias("speaker"), at("start").alias("a_start"), at("end").alias("a_end"))
    pieces = chunks.select(audio, "chunk", F.col("offset").cast("long").alias("b_start"), (F.col("offset") + F.col("samples")).cast("long").alias("b_end"))
    both = spans.groupBy(audio).agg(F.count_distinct("speaker").alias("_n")).where("_n = 2").select(audio)
    cut = overlaps(spans.join(both, audio), pieces, audio, width)
    whole = pieces.join(both, audio, "left_anti").where("b_end > b_start").withColumn("speaker", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"a_start": F.lit(0).cast("long"), "a_end": F.col("b_end"), "start": F.col("b_start"), "end": F.col("b_end")})
    rows = cut.unionByName(whole)
    order = Window.partitionBy(audio, "speaker").orderBy("a_start", "a_end", "start", "chunk")
    return rows.select(audio, "speaker", F.row_number().over(order).alias("place"), "chunk", (F.col("start") - F.col("b_start")).alias("first"), (F.col("end") - F.col("b_start")).alias("last"))

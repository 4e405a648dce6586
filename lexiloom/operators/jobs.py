"""Job states and voices: batch twins of the stateful stream, and the rules of the service's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Later states of a job win over earlier ones; terminal ones over all.
TERMINAL = ("done", "error", "cancelled")


def voice_gender(voice_id: Column) -> Column:
    """By substring, female first."""
    low = F.lower(voice_id)
    return F.when(low.contains("nu") | low.contains("female"), "female").when(low.contains("nam") | low.contains("male"), "male")


def voice_region(voice_id: Column) -> Column:
    low = F.lower(voice_id)
    return F.when(low.contains("bac"), "North").when(low.contains("trung"), "Central").when(low.contains("nam"), "South")


def job_states(events: DataFrame, job: str, ts: str, status: str) -> DataFrame:
    """(job, status, created_at, finished_at): the first terminal state absorbs what comes later."""
    ended = F.col(status).isin(*TERMINAL)
    out = events.groupBy(job).agg(
        F.min_by(F.when(ended, F.col(status)), F.when(ended, F.struct(ts, status))).alias("__end"),
        F.max_by(status, F.struct(ts, status)).alias("__last"),
        F.min(ts).alias("created_at"),
        F.min(F.when(ended, F.col(ts))).alias("finished_at"),
    )
    return out.select(job, F.coalesce("__end", "__last").alias("status"), "created_at", "finished_at")


def conversion_seconds(jobs: DataFrame) -> Column:
    """Finish less creation, so it includes waiting; null while a job runs."""
    return (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6


def expired(finished: Column, now: Column, keep_seconds: int = 86_400) -> Column:
    """Strictly older than the time to keep."""
    return F.unix_micros(now) - F.unix_micros(finished) > keep_seconds * 1_000_000


def http_code(status: Column) -> Column:
    """Of a request for a job's result: missing, failed, not ready, ready."""
    return F.when(status.isNull(), 404).when(status == "error", 400).when(status != "done", 409).otherwise(200)


def segment_settings(is_bracket: Column, text: Column) -> Column:
    """Slow settings for bracketed or very short segments."""
    short = is_bracket | (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 2)
    return F.struct(F.when(short, 0.4).otherwise(1.0).alias("speed"), F.when(short, 32).otherwise(16).alias("steps"))


def deletion_plan(files: DataFrame, now: Column, days: int) -> DataFrame:
    """(path, job, modified, deleted) of results; ``deleted`` where strictly older than ``days``, nothing is removed here.

    ``files`` are (path, modified). Only wav and mp3 count, by the name's last part; fewer
    than 3 days raise. A null time is never old; an empty listing gives no rows.
    """
    if days < 3:
        raise ValueError("results are kept for 3 days at least")
    ours = _results(files)
    return ours.select("path", "job", "modified", F.coalesce(expired(F.col("modified").cast("timestamp"), now, days * 86_400), F.lit(False)).alias("deleted"))


def _results(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ours = files.withColumn("_name", name).where(F.col("_name").rlike(r"^.+\.(wav|mp3)$"))
    return ours.select("path", "modified", F.regexp_extract("_name", r"^(.+)\.(wav|mp3)$", 1).alias("job"), F.regexp_extract("_name", r"\.(wav|mp3)$", 1).alias("kind"))


def restored(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(job, status, created_at, finished_at, path): the known jobs, and those of which only a result is left.

    Of a lost job the wav counts before the mp3; it is done, its creation is not known, and it
    finished when the file was written. A known job is never overwritten by a file. Several
    files of one name and kind count by the latest.
    """
    best = F.max_by(F.struct("path", "modified"), F.struct((F.col("kind") == "wav").cast("int").alias("w"), "modified", "path"))
    found = _results(files).groupBy("job").agg(best.alias("f"))
    lost = found.join(jobs.select(F.col("job").cast("string").alias("job")), "job", "left_anti")
    back = lost.select("job", F.lit("done").alias("status"), F.lit(None).cast("timestamp").alias("created_at"), F.col("f.modified").cast("timestamp").alias("finished_at"), F.col("f.path").alias("path"))
    known = jobs.select(F.col("job").cast("string").alias("job"), "status", F.col("created_at").cast("timestamp").alias("created_at"), F.col("finished_at").cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("path"))
    return known.unionByName(back)

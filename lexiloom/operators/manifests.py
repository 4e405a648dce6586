"""Manifests, listings and job views: matching, checks, defaults, warnings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiloom.operators.aggregates import finite

# Words that stand for true and false, seconds from which a prompt is long and too long, and a
# sampler's defaults by model.
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")
LONG_PROMPT = {"single": (10.0, 20.0), "dialog": (20.0, 40.0)}
SAMPLER = {"zipvoice": (16, 1.0), "zipvoice_distill": (8, 3.0)}
SILENCE_DB, STEP_MS = -50.0, 10
# End of the fixed values.


def validation(recordings: DataFrame, supervisions: DataFrame) -> DataFrame:
    """(side, id, reason) of all rows of both manifests; a null reason is a row that stays.

    ``recordings`` are (recording_id, duration), ``supervisions`` (id, recording_id, start, duration).
    A recording stays if a supervision names it, a supervision if its recording is there, holds
    it, and its times are not negative. Null ids match nothing. Ids that repeat are rows of their own.
    Rows of both sides stream past the other side's distinct ids: tasks hold ids, and sort no rows.
    """
    known = recordings.where("recording_id is not null").groupBy("recording_id").agg(F.max("duration").alias("_whole")).hint("shuffle_hash")
    spoken = supervisions.where("recording_id is not null").select("recording_id").distinct().withColumn("_spoken", F.lit(True)).hint("shuffle_hash")
    r = recordings.join(spoken, "recording_id", "left").select(F.lit("recording").alias("side"), F.col("recording_id").cast("string").alias("id"), F.when(F.col("_spoken").isNull(), "no supervision").alias("reason"))
    whole, start, length = F.col("_whole"), F.col("start"), F.col("duration")
    reason = F.when(whole.isNull(), "no recording").when(F.coalesce((start < 0) | (length <= 0), F.lit(True)), "bad times").when(start + length > whole + 1e-6, "beyond its recording")
    s = supervisions.join(known, "recording_id", "left").select(F.lit("supervision").alias("side"), F.col("id").cast("string").alias("id"), reason.alias("reason"))
    return r.unionByName(s)


def with_files(rows: DataFrame, files: DataFrame, name: str, suffix: str) -> DataFrame:
    """``rows`` with ``path``, the listed file of that name and suffix (in any case); null where there is none.

    ``files`` are (path). Of files of one name the first path counts.
    """
    file = F.element_at(F.split("path", "/"), -1)
    ours = files.where(F.lower("path").endswith(suffix.lower())).select(F.substring(file, 1, F.char_length(file) - len(suffix)).alias("_name"), "path")
    first = ours.groupBy("_name").agg(F.min("path").alias("path"))
    return rows.join(first, rows[name].cast("string") == first["_name"], "left").drop("_name")


def all_found(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as they are; a row without a path fails with its name when it is read."""
    found = F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no file for "), F.col(name).cast("string")))).otherwise(F.col("path"))
    return rows.withColumn("path", found)


def audio_files(spark: SparkSession, folder: str, suffix: str = ".wav") -> DataFrame:
    """(path) of the files below ``folder`` with that suffix, in any case, contents unread; none is an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    out = listed.where(F.lower("path").endswith(suffix.lower()))
    if out.isEmpty():
        raise ValueError(f"no {suffix} below {folder}")
    return out


def either(spark: SparkSession, first: str, schema: str, otherwise) -> DataFrame:
    """The manifest at ``first`` where there is one, else what ``otherwise()`` gives (for one, two manifests joined)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(first)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).json(first)
    return otherwise()


def prompt_warning(seconds: Column, kind: str = "single") -> Column:
    """``too long``, ``long`` or null, by a prompt's length; bounds are strict."""
    long, too_long = LONG_PROMPT[kind]
    return F.when(seconds > too_long, "too long").when(seconds > long, "long")


def not_finite(df: DataFrame, group: str, array: str) -> DataFrame:
    """(group, n, bad): how many of a group's arrays have a sum that is no finite number; nulls among elements count as such."""
    total = F.aggregate(F.col(array).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    bad = F.when(F.col(array).isNotNull(), finite(total).isNull()).otherwise(False)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad"))


def merged_metrics(trackers: DataFrame, scale: float = 1.0) -> DataFrame:
    """(key, total): finite values of several trackers (key, value) added up, times ``scale``."""
    return trackers.groupBy("key").agg((F.coalesce(F.sum(finite(F.col("value"))), F.lit(0.0)) * scale).alias("total"))


def normed_metrics(merged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``merged`` (key, total) with ``mean``: by the total of ``utterances`` for keys that hold ``utt_``, else of ``frames``.

    A weight that is missing is 1; the weights' own rows go.
    """
    by = Window.partitionBy(*(group or [F.lit(0)]))
    of = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("total"))).over(by), F.lit(1.0))
    seen = merged.withColumns({"_f": of("frames"), "_u": of("utterances")})
    return seen.where(~F.col("key").isin("frames", "utterances")).withColumn("mean", F.col("total") / F.when(F.col("key").contains("utt_"), F.col("_u")).otherwise(F.col("_f"))).drop("_f", "_u")


def with_sampler(df: DataFrame, model: str, steps: str, guidance: str) -> DataFrame:
    """Null ``steps`` and ``guidance`` filled by the model's defaults; of an unknown model they stay null."""
    table = F.create_map(*(F.lit(x) for k, (n, _) in SAMPLER.items() for x in (k, n))), F.create_map(*(F.lit(x) for k, (_, g) in SAMPLER.items() for x in (k, g)))
    return df.withColumns({c: F.coalesce(F.col(c), F.try_element_at(t, F.col(model))) for c, t in zip((steps, guidance), table)})


def shape_batches(params: DataFrame, name: str, kind: str, shape: str) -> DataFrame:
    """(name, batch, place, size): parameters of one kind and shape are a batch; batches by key, places by name.

    Batches are numbered over their keys, which are few; a batch's places by a window of its own.
    """
    key = F.concat_ws("_", F.col(kind).cast("string"), F.col(shape).cast("string"))
    rows = params.select(F.col(name).alias("name"), key.alias("_key"))
    sizes = rows.groupBy("_key").agg(F.count("*").alias("size")).withColumn("batch", F.row_number().over(Window.orderBy("_key")) - 1)
    place = F.row_number().over(Window.partitionBy("_key").orderBy("name")) - 1
    return rows.withColumn("place", place).join(sizes, "_key").select("name", "batch", "place", "size")


def largest_index(values: Column) -> Column:
    """Place (from 0) of the largest magnitude; of equal ones the first; null and empty arrays give null."""
    sizes = F.transform(values, F.abs)
    return F.when(F.size(values) > 0, (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int"))


def parsed_bool(word: Column) -> Column:
    """True and false by their words, in any case; other words are null."""
    low = F.lower(word)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def int_tuple(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda p: F.btrim(p).try_cast("int"))


def even_durations(frames: Column, tokens: Column) -> Column:
    """Each token's share of the frames, rounded down."""
    return F.when(tokens > 0, F.array_repeat(F.floor(frames / tokens).cast("int"), tokens.cast("int"))).otherwise(F.array().cast("array<int>"))


def status_view(jobs: DataFrame) -> DataFrame:
    """What a client is told of a job (job, status, path, error, created_at, finished_at): fields by status.

    Done jobs have a file and an address with the path's own suffix and the time they took;
    failed ones their error; others neither.
    """
    done = F.col("status") == "done"
    suffix = F.when(F.lower("path").endswith(".mp3"), "mp3").otherwise("wav")
    job = F.col("job").cast("string")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jobs.select(
        "job",
        "status",
        F.when(done, F.concat(F.lit("/files/"), job, F.lit("."), suffix)).alias("file"),
        F.when(done, F.concat(F.lit("/v1/jobs/"), job, F.lit("/audio"))).alias("audio"),
        F.when(F.col("status") == "error", F.col("error")).alias("error"),
        F.when(done, (micros("finished_at") - micros("created_at")) / 1e6).alias("seconds"),
    )


def cancel_all(jobs: DataFrame, at: Column) -> DataFrame:
    """``jobs`` with what waits or runs cancelled at that time; ``stopped`` tells which, so their sum is the count."""
    open_ = F.coalesce(F.col("status").isin("queued", "running"), F.lit(False))
    return jobs.withColumn("stopped", open_).withColumns({"status": F.when(open_, "cancelled").otherwise(F.col("status")), "finished_at": F.when(open_, at).otherwise(F.col("finished_at"))})


def _loud(wave: np.ndarray, rate: int, step_ms: int, db: float) -> np.ndarray:
    """Of each step, whether its root mean square is above the level (of full scale 1)."""
    step = max(1, rate * step_ms // 1000)
    n = -(-len(wave) // step)
    power = np.add.reduceat(wave * wave, np.arange(0, len(wave), step)) if n else np.empty(0)
    sizes = np.minimum(step, len(wave) - step * np.arange(n))
    return power / np.maximum(sizes, 1) > 10 ** (db / 10)


def kept_samples(wave: np.ndarray, rate: int, longest_ms: int = 1000, keep_ms: int = 1000, edge_ms: int = 100, db: float = SILENCE_DB, step_ms: int = STEP_MS) -> np.ndarray:
    """Mask of the samples that stay: silences of ``longest_ms`` or more are cut down to ``keep_ms`` on each side, edges to ``edge_ms``.

    Loudness is taken in steps. A wave that is silent throughout keeps nothing; where both
    sides of a silence are kept whole it stays as it is.
    """
    loud = np.flatnonzero(_loud(wave, rate, step_ms, db))
    keep = np.zeros(len(wave), bool)
    if not len(loud):
        return keep
    step = max(1, rate * step_ms // 1000)
    gaps = np.flatnonzero(np.diff(loud) > 1)
    cuts = [g for g in gaps if (loud[g + 1] - loud[g] - 1) * step >= rate * longest_ms // 1000]
    starts = [loud[0], *(loud[g + 1] for g in cuts)]
    stops = [*(loud[g] + 1 for g in cuts), loud[-1] + 1]
    side = rate * keep_ms // 1000
    for k, (a, b) in enumerate(zip(starts, stops)):
        left = rate * edge_ms // 1000 if k == 0 else side
        right = rate * edge_ms // 1000 if k == len(starts) - 1 else side
        keep[max(0, a * step - left) : b * step + right] = True
    return keep


def without_silence(wave: Column, rate: int, trail_ms: int = 0, **how) -> Column:
    """An array of samples in [-1, 1] without long silences and silent edges, and ``trail_ms`` of silence behind.

    Null stays null; nulls among samples are silence.
    """

    @F.pandas_udf("array<double>")
    def run(waves: pd.Series) -> pd.Series:
        def cut(w):
            x = np.nan_to_num(np.array(w, dtype=np.float64))
            return np.concatenate([x[kept_samples(x, rate, **how)], np.zeros(rate * trail_ms // 1000)])

        return waves.map(lambda w: None if w is None else cut(w))

    return run(wave)

"""Text lists, vocabularies, dictionaries, manifests and directory scans as tables.

Every reader splits lines itself, since the number of fields may differ from line to line.
``strict`` readers raise at the first malformed line; the others hand malformed lines on in a
column of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.operators.relational import last_wins


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select("value", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t").alias("f"))


def _arity(df: DataFrame, *sizes: int) -> DataFrame:
    """Raises on lines of another number of fields."""
    good = F.size("f").isin(*sizes)
    why = F.concat(F.lit(f"expected {' or '.join(map(str, sizes))} fields: "), "value")
    return df.withColumn("f", F.when(good, F.col("f")).otherwise(F.raise_error(why)))


def dataset_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(uniq_id, text, wav_path, start, end[, malformed]); three fields mean the whole file."""
    rows = _fields(spark, path)
    if strict:
        rows = _arity(rows, 3, 5)
    good = F.size("f").isin(3, 5)
    at = lambda k: F.when(good, F.get("f", F.lit(k)))
    out = rows.select(
        at(0).alias("uniq_id"), at(1).alias("text"), at(2).alias("wav_path"), F.when(good, F.coalesce(at(3).cast("double"), F.lit(0.0))).alias("start"), at(4).cast("double").alias("end"), F.when(~good, F.col("value")).alias("malformed")
    )
    return out.drop("malformed") if strict else out


def transcript_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): the first and the last field of each line."""
    return _fields(spark, path).select(F.element_at("f", 1).alias("name"), F.element_at("f", -1).alias("text"))


def _lenient(rows: DataFrame, good: Column, columns: dict[str, Column]) -> DataFrame:
    """The columns of good lines, and the text of the others in ``malformed``."""
    return rows.select(*(F.when(good, c).alias(n) for n, c in columns.items()), F.when(~good, F.col("value")).alias("malformed"))


def synthesis_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(wav_name, prompt_text, prompt_wav, text[, malformed])."""
    columns = {n: F.get("f", F.lit(k)) for k, n in enumerate(("wav_name", "prompt_text", "prompt_wav", "text"))}
    rows = _fields(spark, path)
    if not strict:
        return _lenient(rows, F.size("f") == 4, columns)
    return _arity(rows, 4).select(*(c.alias(n) for n, c in columns.items()))


def dialog_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(wav_name, prompt_text, prompt_wavs, text[, malformed]); two speakers' prompts are put together with their tags."""
    at = lambda k: F.get("f", F.lit(k))
    split = F.size("f") == 6
    text = F.when(split, at(5)).otherwise(at(3))
    prompt = F.when(split, F.concat(F.lit("[S1]"), at(1), F.lit("[S2]"), at(2))).otherwise(at(1))
    columns = {"wav_name": at(0), "prompt_text": prompt, "prompt_wavs": F.when(split, F.array(at(3), at(4))).otherwise(F.array(at(2))), "text": text}
    rows = _fields(spark, path)
    if not strict:
        return _lenient(rows, F.size("f").isin(4, 6) & F.coalesce(text.startswith("[S1]"), F.lit(False)), columns)
    told = F.when(text.startswith("[S1]"), text).otherwise(F.raise_error(F.concat(F.lit("a dialog begins with [S1]: "), text)))
    return _arity(rows, 4, 6).select(*(c.alias(n) for n, c in (columns | {"text": told}).items()))


def vocabulary(spark: SparkSession, path: str, pad: str = "_") -> DataFrame:
    """(token, id); a token that stands twice, or a missing pad, raises when the table is read."""
    rows = spark.read.text(path).where("value <> ''").select(F.split(F.regexp_replace("value", r"[\s]+$", ""), "\t").alias("f"))
    pairs = rows.select(F.get("f", F.lit(0)).alias("token"), F.get("f", F.lit(1)).cast("int").alias("id"))
    checked = pairs.groupBy("token").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    checked = checked.withColumn("id", F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("token stands twice: "), "token")))).drop("n")
    has_pad = pairs.agg(F.assert_true(F.coalesce(F.bool_or(F.col("token") == pad), F.lit(False)), F.lit("the vocabulary has no pad")).alias("ok"))
    return checked.join(F.broadcast(has_pad)).where("ok is null").drop("ok")


def pipe_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key|value`` lines, keys in lower case; of equal keys the last line counts.

    The first malformed line ends the load; what follows it in its file is not read.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.split("value", r"\|").alias("f"))
    bad = lines.where(F.size("f") != 2).groupBy("file").agg(F.min("at").alias("stop"))
    kept = lines.join(F.broadcast(bad), "file", "left").where("stop is null or at < stop")
    return last_wins(kept, F.lower(F.btrim(F.get("f", F.lit(0)))), F.btrim(F.get("f", F.lit(1))), F.struct("file", "at"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) in upper case, without blanks and ``#`` comments, each once; no words where there is no such file."""
    word = F.upper(F.btrim("value"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(word.alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def json_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object in one file; what does not parse gives no rows."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or plain, under an explicit schema."""
    return spark.read.schema(schema).json(path)


def checkpoints(spark: SparkSession, folder: str, iteration: int = 0) -> DataFrame:
    """(path, number), highest first: numbers from ``iteration`` on, or up to -``iteration`` where it is negative."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "checkpoint-*.pt").load(folder).select("path")
    number = F.try_to_number(F.regexp_extract("path", r"checkpoint-(\d+)\.pt$", 1), F.lit("999999999999")).cast("long")
    rows = files.select("path", number.alias("number")).where("number is not null")
    kept = rows.where(F.col("number") >= iteration) if iteration >= 0 else rows.where(F.col("number") <= -iteration)
    return kept.orderBy(F.desc("number"))


def for_averaging(found: DataFrame, average: int) -> DataFrame:
    """The highest ``average`` + 1 of ``checkpoints``, whose ends are averaged between; fewer raise."""
    rows = found.orderBy(F.desc("number")).limit(average + 1)
    if rows.count() < average + 1:
        raise ValueError(f"fewer than {average + 1} checkpoints")
    return rows


def voices(spark: SparkSession, folder: str) -> DataFrame:
    """(voice_id, prompt_text, prompt_wav) of the sub-folders that hold both prompt files."""
    of = lambda name: F.regexp_extract(F.col("path"), rf"([^/]+)/{name}$", 1)
    scan = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    texts = scan("prompt.txt").select(of(r"prompt\.txt").alias("voice_id"), F.decode("content", "utf-8").alias("prompt_text"))
    waves = scan("prompt.wav").select(of(r"prompt\.wav").alias("voice_id"), F.col("path").alias("prompt_wav"))
    return texts.join(waves, "voice_id")


def cuts(recordings: DataFrame, supervisions: DataFrame) -> DataFrame:
    """A cut for each supervision whose recording is known and holds it; times are relative to the recording."""
    joined = supervisions.join(recordings.select("recording_id", F.col("duration").alias("recording_duration"), "path"), "recording_id")
    return joined.where(F.col("start") + F.col("duration") <= F.col("recording_duration") + 1e-6)


def recording_id(path: Column) -> Column:
    """The id that a path gives; different paths may give the same."""
    return F.translate(path, "/.", "__")

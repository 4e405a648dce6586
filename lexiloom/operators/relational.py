"""Filters, validation, joins and set operations over corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Unicode white space, as a class that Java and RE2 read alike.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Fixed value: what holds nothing to speak, besides white space.
UNSPOKEN = r""".,;:!?…—–\-'"()\[\]{}"""


def duration_range(df: DataFrame, duration: str, low: float = 1.0, high: float = 30.0) -> DataFrame:
    """Rows whose duration is within both bounds, bounds included."""
    return df.where(F.col(duration).between(low, high))


def clean_text(text: Column) -> Column:
    """Underscores and runs of white space become one space; the ends are stripped."""
    spaced = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), BLANK + "+", " ")
    return F.btrim(spaced)


def matched_and_rejected(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner join on ``key``, and the left rows that found no partner (for a log)."""
    return left.join(right, key), left.join(right.select(key), key, "left_anti")


def segment_duration(start: Column, end: Column, whole: Column) -> Column:
    """An open end means up to the end of the recording."""
    return F.when(end.isNotNull(), end - start).otherwise(whole)


def flag_too_long(df: DataFrame, duration: str, limit: str) -> DataFrame:
    """Adds ``quarantined``: the segment is longer than its recording."""
    return df.withColumn("quarantined", F.col(duration) > F.col(limit))


def lookup_ids(df: DataFrame, tokens: str, vocab: DataFrame) -> DataFrame:
    """Replaces ``tokens`` (array) by ``ids``: unknown tokens are dropped, the order stays.

    ``vocab`` (token, id) is small by construction (a character or sub-word inventory). The
    tokens meet it one by one and the sequence is put together again by position.
    """
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    each = rows.select("__row", F.posexplode(tokens).alias("pos", "token")).join(F.broadcast(vocab), "token")
    ids = each.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return rows.join(ids, "__row", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).drop("__row", tokens)


def insert_if_absent(known: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``known`` and the rows of ``new`` whose normalised key it lacks; of equal new keys the first in ``order``."""
    norm = new.withColumn(key, F.lower(F.btrim(key)))
    first = norm.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return known.unionByName(first.join(known.select(key), key, "left_anti").select(*known.columns))


def last_wins(df: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """One value for each key: that of the highest order."""
    return df.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))


def positional_zip(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
    """Rows of ``a`` and ``b`` with the same place; other columns must differ in name.

    A place that only one side has raises when it is reached.
    """
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), at, "full")
    whole = F.assert_true(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.lit("the two lists differ in length"))
    return both.withColumn("__ok", whole).where(F.col("__ok").isNull()).drop("__a", "__b", "__ok")


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear function of ``x``, constant beyond its first and last point."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(points[-1][1]))


def json_or_default(json: Column, field: str, default: str) -> Column:
    """The field where the object has it, even if it is null there; else the default."""
    has = F.array_contains(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), field)
    return F.when(has, F.get_json_object(json, f"$.{field}")).otherwise(F.lit(default))


def weighted_mix(parts: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Union of ``parts`` with ``mix_key``: in its order, parts come as often as their weights.

    The key is -ln(u) / weight with u a uniform hash of ``key``: the exponential-races draw.
    """
    u = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    out = None
    for df, weight in parts:
        one = df.withColumn("mix_key", -F.log(u) / F.lit(float(weight)))
        out = one if out is None else out.unionByName(one)
    return out


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, numbered in ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def seeded_order(key: Column, seed: int, epoch: int) -> Column:
    """A shuffle key that only depends on the row's key, the seed and the epoch."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(epoch))))


def speakable_segment(text: Column) -> Column:
    """Whether a segment holds more than white space and punctuation; null holds nothing."""
    return F.coalesce(F.regexp_replace(text, f"[{BLANK[1:-1]}{UNSPOKEN}]", "") != "", F.lit(False))


def single_supervision(df: DataFrame, supervisions: str) -> DataFrame:
    """``df``; the job fails at a row whose array does not hold exactly one supervision."""
    single = F.assert_true(F.coalesce(F.size(supervisions), F.lit(-1)) == 1, F.lit("only cuts with a single supervision are supported"))
    return df.where(single.isNull())


def fixed_batches(items: Column, size: int = 30) -> Column:
    """Array of arrays of ``size`` items in their order, the last with what is left; no items, no batches."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(items, at, size))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session has cores, where it has fewer.

    A small file is one partition and would keep one core busy; large inputs, which have more
    partitions than cores, are left as they are and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column's value computed where it stands.

    Steps that name their input several times would otherwise be merged into one expression
    that repeats all earlier steps; a generator of one row is not merged.
    """
    return df.withColumn(column, F.explode(F.array(F.col(column))))

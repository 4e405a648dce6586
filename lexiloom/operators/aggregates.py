"""Corpus metrics and tensor diagnostics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexiloom.operators.training import moment_matrix


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def micro_rate(errors: Column, words: Column) -> Column:
    """Errors per hundred words over the whole corpus."""
    return F.round(F.sum(errors) / F.sum(words) * 100, 2)


def macro_rate(errors: Column, words: Column) -> Column:
    """Mean of the rows' own rates, per hundred."""
    return F.round(F.avg(errors / words) * 100, 2)


def ratio_of_sums(time: Column, length: Column) -> Column:
    """The real-time factor of a list is a ratio of sums, not a mean of ratios."""
    return F.try_divide(F.sum(time), F.sum(length))


def merged_metrics(df: DataFrame, metric: str, value: str, frames: str) -> DataFrame:
    """(metric, total, frames, per_frame) of a long table; values that are not finite are left out."""
    x = finite(F.col(value))
    out = df.groupBy(metric).agg(F.sum(x).alias("total"), F.sum(F.when(x.isNotNull(), F.col(frames))).alias("frames"))
    return out.withColumn("per_frame", F.col("total") / F.coalesce("frames", F.lit(1)))


def elements(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """Long form (keep..., dim, x) of an array column, in double precision."""
    return df.select(*keep, F.posexplode(F.col(array).cast("array<double>")).alias("dim", "x"))


def tensor_stats(cells: DataFrame) -> DataFrame:
    """Per dim: sums of absolute, positive, squared and plain values, extremes, count, deviation, norm, rms."""
    out = cells.groupBy("dim").agg(
        F.sum(F.abs("x")).alias("sum_abs"),
        F.sum((F.col("x") > 0).cast("long")).alias("n_positive"),
        F.sum(F.col("x") * F.col("x")).alias("sum_sq"),
        F.sum("x").alias("sum_x"),
        F.max("x").alias("max_x"),
        F.min("x").alias("min_x"),
        F.count("*").alias("n"),
    )
    variance = (F.col("sum_sq") - F.col("sum_x") * F.col("sum_x") / F.col("n")) / F.col("n")
    return out.withColumns({"stddev": F.sqrt(F.greatest(variance, F.lit(0.0))), "norm": F.sqrt("sum_sq"), "rms": F.sqrt(F.col("sum_sq") / F.col("n"))})


def second_moments(df: DataFrame, array: str) -> DataFrame:
    """(i, j, total): sums over rows of x_i * x_j, for i <= j.

    Each task multiplies its rows as one matrix; what is added up has the size of one matrix.
    """
    _, total = moment_matrix(df, array)
    cells = [(i, j, float(total[i, j])) for i in range(len(total)) for j in range(i, len(total))]
    return df.sparkSession.createDataFrame(cells, "i int, j int, total double")


def whitening(moments: DataFrame) -> DataFrame:
    """How far the second moments are from a multiple of the identity: d * sum(c^2) / trace^2, at least 1."""
    off = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    out = moments.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("total"))).alias("trace"), F.sum(off * F.col("total") * F.col("total")).alias("squares"), F.max("j").alias("last"))
    return out.select((F.col("squares") * (F.col("last") + 1) / (F.col("trace") * F.col("trace"))).alias("metric"))


def tenths(df: DataFrame, group: str, x: str) -> DataFrame:
    """(group, tenth, by_floor, by_rank): eleven of a group's sorted values, by two rules of place.

    ``by_floor`` is at i * n // 10, the last one clamped, ``by_rank`` at i * (n - 1) // 10. Values
    are numbered by a sort that can spill; a group is never one array.
    """
    over = Window.partitionBy(group)
    rows = df.select(group, x, (F.row_number().over(over.orderBy(x)) - 1).alias("_k"), F.count("*").over(over).alias("_n"))
    every = F.sequence(F.lit(0), F.lit(10))
    by_floor = F.filter(every, lambda i: F.least(F.floor(i * F.col("_n") / 10), F.col("_n") - 1) == F.col("_k"))
    by_rank = F.filter(every, lambda i: F.floor(i * (F.col("_n") - 1) / 10) == F.col("_k"))
    met = rows.select(group, x, by_floor.alias("f"), by_rank.alias("r")).where("size(f) > 0 or size(r) > 0")
    each = met.select(group, x, F.explode(F.array_union("f", "r")).alias("tenth"), "f", "r")
    of = lambda c: F.max(F.when(F.array_contains(c, F.col("tenth")), F.col(x)))
    return each.groupBy(group, "tenth").agg(of("f").alias("by_floor"), of("r").alias("by_rank"))


#: Buckets of a pass, and values that are few enough to be sorted on the driver.
BUCKETS, FEW = 4096, 10_000


def values_at(df: DataFrame, x: str, ranks: list[int]) -> list[float]:
    """The values of ``x`` at places (from 0) of its sorted, non-null values; exact, in bounded memory.

    Each pass counts the values of an interval in buckets and goes on with the bucket that
    holds the place, until its values are equal or few.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"))
    first = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    # for each place: the least and largest value of its interval, how many come before it, how many are in it
    spans = {r: (first[0], first[1], 0, first[2]) for r in ranks}
    while wide := sorted({s for s in spans.values() if s[3] > FEW and s[0] < s[1]}):
        case = F.lit(None).cast("struct<i:int,b:int>")
        for i, (lo, hi, _, _) in enumerate(wide):
            bucket = F.least(F.floor((F.col("x") / (hi - lo) - lo / (hi - lo)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
            case = F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("i"), bucket.alias("b"))).otherwise(case)
        counted = rows.select("x", case.alias("s")).where("s is not null").groupBy("s.i", "s.b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()
        for rank, span in list(spans.items()):
            if span not in wide:
                continue
            before = span[2]
            for c in sorted((c for c in counted if c.i == wide.index(span)), key=lambda c: c.lo):
                if rank < before + c.n:
                    spans[rank] = (c.lo, c.hi, before, c.n)
                    break
                before += c.n
    out = {}
    for lo, hi, before, _ in set(spans.values()):
        own = [lo] if lo == hi else [r.x for r in rows.where(F.col("x").between(lo, hi)).orderBy("x").collect()]
        out |= {rank: own[0] if lo == hi else own[rank - before] for rank, s in spans.items() if s[:3] == (lo, hi, before)}
    return [out[r] for r in ranks]


def quantiles(df: DataFrame, x: str, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbours; none where there are no values."""
    n = df.where(F.col(x).isNotNull()).count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    ranks = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
    value = dict(zip(ranks, values_at(df, x, ranks)))
    ends = [(a, math.floor(a), math.ceil(a)) for a in at]
    return [value[lo] if lo == hi else (hi - a) * value[lo] + (a - lo) * value[hi] for a, lo, hi in ends]


def clipped_histogram(df: DataFrame, x: str, grad: str, quantile: float = 0.98, half: int = 256) -> DataFrame:
    """(bucket, n, sum_g, sum_g2, sum_abs_g): ``2 * half`` buckets of a ``half``-th of the quantile of |x|.

    Values go to their bucket toward zero; those beyond the range go to the outermost ones. The
    quantile is one number, computed first.
    """
    tick = (quantiles(df.select(F.abs(x).alias("x")), "x", [quantile]) or [1.0])[0] / half
    bucket = F.least(F.greatest((F.col(x) / F.lit(tick)).cast("long"), F.lit(-half)), F.lit(half - 1))
    g = F.col(grad)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(g).alias("sum_g"), F.sum(g * g).alias("sum_g2"), F.sum(F.abs(g)).alias("sum_abs_g"))


def equal_count_bins(histogram: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, first_bucket, last_bucket, n) of a histogram of at most a few hundred buckets."""
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cells = histogram.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    number = F.floor((F.col("upto") - 1) / (F.floor(F.col("total") / bins) + 1))
    return cells.groupBy(number.alias("bin")).agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.sum("n").alias("n"))


def dominant(df: DataFrame, group: str, key: str, x: str) -> DataFrame:
    """Per group the key with the largest sum of squares, and its share."""
    parts = df.groupBy(group, key).agg(F.sum(F.col(x) * F.col(x)).alias("s"))
    out = parts.groupBy(group).agg(F.max_by(key, F.struct("s", key)).alias("key"), F.max("s").alias("top"), F.sum("s").alias("total"))
    return out.select(group, "key", (F.col("top") / F.col("total")).alias("share"))


def softmax(x: Column) -> Column:
    """Of an array, shifted by its maximum."""
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def entropy(p: Column) -> Column:
    return -F.aggregate(F.transform(p, lambda v: v * F.log(v + 1e-20)), F.lit(0.0), lambda a, v: a + v)


def weighted_mean_std(w: Column, x: Column) -> tuple[Column, Column]:
    """Attentive pooling inside a group: weights are normalised, the variance is floored."""
    total = F.sum(w)
    mean = F.sum(w * x) / total
    return mean, F.sqrt(F.greatest(F.sum(w * x * x) / total - mean * mean, F.lit(1e-9)))

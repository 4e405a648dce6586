"""What training keeps count of: clipping thresholds, condition masks, running averages, principal moments."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# The early steps at which a threshold is estimated, and how much larger it is there.
EARLY, LARGER = (10, 20, 40), 2.0
# End of the fixed values.


def clip_thresholds(norms: DataFrame, key: str, step: str, norm: str, period: int = 100, scale: float = 2.0) -> DataFrame:
    """(key, step, q0..q4, threshold, percent_clipped, n) at each step that estimates a threshold.

    Norms are numbered from step 0, which has none to count. At each multiple of ``period``
    the last ``period`` norms are sorted, at steps 10, 20 and 40 (if below the period) all so far;
    the threshold is ``scale`` times the middle quartile, twice that at the early steps, and holds from
    that step on. ``percent_clipped`` counts the norms above the threshold since the estimate before, relative to
    the norms sorted now. Norms that are not finite sort last and are clipped.

    A key's norms are grouped by estimate, at most ``period`` in a group, so no key is one
    group. Repeated steps count each; null keys, steps and norms are left out; an empty
    table gives no rows; further columns are ignored.
    """
    rows = norms.where(f"`{key}` is not null and `{step}` > 0 and `{norm}` is not null").select(F.col(key).alias("key"), F.col(step).cast("long").alias("s"), F.col(norm).cast("double").alias("v"))
    early = [e for e in EARLY if e < period]
    shares = F.concat(F.array((F.ceil(F.col("s") / period) * period).cast("long")), *(F.when(F.col("s") <= e, F.array(F.lit(e).cast("long"))).otherwise(F.array().cast("array<long>")) for e in early))
    found = rows.select("key", "s", "v", F.explode(shares).alias("report")).groupBy("key", "report").agg(F.array_sort(F.collect_list("v")).alias("v"), F.max("s").alias("last"))
    at = lambda n: F.element_at("v", F.least(F.size("v"), F.floor(F.size("v") / 4).cast("int") * n + 1))
    larger = F.when(F.col("report").isin(early), LARGER).otherwise(1.0)
    marks = found.where("report = last").select("key", "report", F.size("v").alias("n"), *(at(k).alias(f"q{k}") for k in range(5)), (scale * at(2) * larger).alias("threshold"))
    # each step is held against the estimate that is valid then, counted at the next one
    valid = F.when(F.col("s") >= period, F.floor(F.col("s") / period) * period)
    following = F.when(F.col("s") >= period, (F.floor(F.col("s") / period) + 1) * period)
    for e, nxt in list(zip(early, [*early[1:], period]))[::-1]:
        valid = valid.when(F.col("s") >= e, F.lit(e))
        following = following.when(F.col("s") >= e, F.lit(nxt))
    held = rows.select("key", "v", valid.cast("long").alias("report"), following.cast("long").alias("following")).where("report is not null")
    over = held.join(marks.select("key", "report", "threshold"), ["key", "report"])
    clipped = F.isnan("v") | (F.col("threshold") < F.col("v") + 1e-20)
    counts = over.groupBy("key", F.col("following").alias("report")).agg(F.sum(clipped.cast("long")).alias("clipped"))
    out = marks.join(counts, ["key", "report"], "left")
    return out.select(F.col("key").alias(key), F.col("report").alias("step"), *(f"q{k}" for k in range(5)), "threshold", (F.coalesce("clipped", F.lit(0)) * 100.0 / F.col("n")).alias("percent_clipped"), "n")


def clip_scale(norm: Column, threshold: Column) -> Column:
    """What a gradient is multiplied with: at most 1, zero for norms that are not finite, 1 without a threshold."""
    ratio = F.least(F.lit(1.0), threshold / (norm + 1e-20))
    return F.when(threshold.isNull(), 1.0).when(F.isnan(norm), 0.0).otherwise(ratio)


def drawn(seed: int, row: Column, place: int) -> Column:
    """A number in [0, 1) that hangs on the seed, the row and the place only: equal under retries and repartitioning."""
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(str(place))))
    return F.conv(F.substring(code, 1, 8), 16, 10).cast("double") / float(1 << 32)


def condition_span(length: Column, row: Column, low: float, high: float, seed: int = 0, suffix: bool = False) -> Column:
    """(start, end) of the masked part of a sequence: a share between ``low`` and ``high``, anywhere or at the end.

    Null lengths give null; a length of zero an empty part.
    """
    size = F.floor((F.lit(low) + drawn(seed, row, 0) * (high - low)) * length).cast("long")
    start = (length - size if suffix else F.floor(drawn(seed, row, 1) * (length - size))).cast("long")
    return F.when(length.isNotNull(), F.struct(start.alias("start"), (start + size).alias("end")))


def span_mask(span: Column, places: Column) -> Column:
    """Array of ``places`` booleans, true inside the span."""
    every = F.when(places > 0, F.sequence(F.lit(0).cast("long"), places.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return F.transform(every, lambda k: (k >= span["start"]) & (k < span["end"]))


def running_average(values: DataFrame, key: str, step: str, value: str, width: int = 1024) -> DataFrame:
    """``values`` with ``average``: the mean of the key's values up to and with the row's step.

    A prefix scan in two passes: sums of stretches of ``width`` steps, their prefix, and a window
    within a stretch; no window holds a key's rows, only its stretches. Rows of one step are
    averaged together with each other. Null values count in no mean, a mean of none is null;
    null keys are one key; steps that are null come first.
    """
    part = F.coalesce(F.floor(F.col(step) / width), F.lit(-(1 << 40)))
    rows = values.withColumn("_part", part)
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_key", "_of", F.sum("_s").over(earlier).alias("_s"), F.sum("_n").over(earlier).alias("_n"))
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    within = Window.partitionBy(key, "_part").orderBy(F.col(step).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.sum(value).over(within), F.lit(0)) + F.coalesce("_s", F.lit(0))
    count = F.count(value).over(within) + F.coalesce("_n", F.lit(0))
    return joined.withColumn("average", F.try_divide(total, count)).drop("_part", "_key", "_of", "_s", "_n")


def moment_matrix(df: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """(rows, sum of x x^T) of the vectors: a matrix product in each task, added in groups, then by the driver.

    Null vectors and those with null or non-finite components are left out; all must have one length.
    """
    rows = df.select(F.col(vector).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    schema = "n bigint, width int, m binary"

    def packed(n: int, total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(total)], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["n", "width", "m"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                n, total = n + len(x), x.T @ x + (0 if total is None else total)
        yield from packed(n, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for own, width, m in zip(*(batch[c].to_pylist() for c in ("n", "width", "m"))):
                x = np.frombuffer(m).reshape(width, width)
                n, total = n + own, x if total is None else total + x
        yield from packed(n, total)

    groups = isqrt(max(1, rows.rdd.getNumPartitions()))
    parts = rows.mapInArrow(product, schema).repartition(groups).mapInArrow(add, schema).collect()
    if not parts:
        return 0, np.zeros((0, 0))
    return sum(p.n for p in parts), sum(np.frombuffer(p.m).reshape(p.width, p.width) for p in parts)


def jacobi_eigenvalues(matrix: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Eigenvalues of a symmetric matrix, the largest first, by cyclic rotations."""
    a = np.array(matrix, np.float64)
    n = len(a)
    small = 1e-18 * np.abs(a).max(initial=0)
    for _ in range(sweeps):
        if np.abs(np.tril(a, -1)).max(initial=0) <= small:
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= small:
                    continue
                turn = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if turn >= 0 else -1) / (abs(turn) + np.hypot(1, turn))
                c = 1 / np.hypot(1, t)
                s = t * c
                rows = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = rows
                columns = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                a[:, p], a[:, q] = columns
    return np.sort(np.diag(a))[::-1]

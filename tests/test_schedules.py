"""Piecewise functions, clipping thresholds, masks, averages, moments, interval joins: against plain loops and on odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import aggregates as A, intervals as I, piecewise as P, sequences as S, training as T


def value(points, x):
    """A plain reading of a function: constant beyond its ends, linear between."""
    if x <= points[0][0]:
        return points[0][1]
    for (a, u), (b, v) in zip(points, points[1:]):
        if a <= x <= b:
            return u + (v - u) * (x - a) / (b - a)
    return points[-1][1]


def loop(f, g, how):
    xs = sorted({x for x, _ in f} | {x for x, _ in g})
    if how in ("max", "min"):
        more = []
        for a, b in zip(xs, xs[1:]):
            d, e = value(f, a) - value(g, a), value(f, b) - value(g, b)
            if (d > 0) != (e > 0):
                more.append(a + abs(d) / (abs(d) + abs(e)) * (b - a))
        xs = sorted(set(xs) | set(more))
    of = {"sum": lambda u, v: u + v, "product": lambda u, v: u * v, "max": max, "min": min}[how]
    return [(x, of(value(f, x), value(g, x))) for x in xs]


@pytest.mark.parametrize("how", ["sum", "product", "max", "min"])
def test_piecewise_equals_a_loop(spark, how):
    rng = random.Random(how)
    some = lambda: sorted({rng.randint(0, 40) * 0.5: rng.randint(-9, 9) * 1.0 for _ in range(rng.randint(1, 9))}.items())
    fs, gs = {k: some() for k in range(30)}, {k: some() for k in range(5, 35)}
    frame = lambda of: spark.createDataFrame([(k, x, y, "clash") for k, ps in of.items() for x, y in ps], "key int, x double, y double, f string")
    got = {}
    for r in P.combined(frame(fs), frame(gs), how).orderBy("key", "x").collect():
        got.setdefault(r.key, []).append((r.x, r.y))
    assert set(got) == set(range(5, 30))
    for k, points in got.items():
        want = loop(fs[k], gs[k], how)
        assert [x for x, _ in points] == pytest.approx([x for x, _ in want]) and [y for _, y in points] == pytest.approx([y for _, y in want])


def test_piecewise_values(spark):
    f = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 0.0), (2, 3.0, 5.0)], "key int, x double, y double")
    at = spark.createDataFrame([(1, -100.0), (1, 0.5), (1, 2.0), (1, None), (2, 9.0), (3, 1.0)], "key int, x double")
    got = {(r.key, r.x): r.y for r in P.evaluated(f, at, default=7.0).select(at["key"], "x", "y").collect()}
    assert got == {(1, -100.0): 10.0, (1, 0.5): 5.0, (1, 2.0): 0.0, (1, None): 7.0, (2, 9.0): 5.0, (3, 1.0): 7.0}
    assert sorted(r.y for r in P.scaled(f, 2.0, 1.0).collect()) == [1.0, 11.0, 21.0]
    assert P.combined(f.limit(0), f, "max").count() == 0
    odd = spark.createDataFrame([(None, 0.0, 1.0), (2, None, 1.0), (2, 3.0, None)], "key int, x double, y double")
    assert [tuple(r) for r in P.combined(f.unionByName(odd), f, "sum").where("key = 2").collect()] == [(2, 3.0, 10.0)]


def clip_loop(norms, period, scale):
    """A key's norms, one after another, in a ring."""
    ring, out, threshold, clipped = [0.0] * period, [], None, None
    early = [e for e in (10, 20, 40) if e < period]
    for step, norm in enumerate(norms):
        if step == 0:
            continue
        ring[step % period] = norm
        if step % period == 0 or step in early:
            kept = sorted(ring)[-step:] if step in early else sorted(ring)
            q = [kept[min(len(kept) - 1, len(kept) // 4 * n)] for n in range(5)]
            threshold = scale * q[2] * (2 if step in early else 1)
            out.append((step, *q, threshold, (clipped or 0) * 100.0 / len(kept), len(kept)))
            clipped = 0
        if threshold is not None and min(1.0, threshold / (norm + 1e-20)) < 1.0:
            clipped += 1
    return out


@pytest.mark.parametrize("period", [8, 25, 100])
def test_clip_thresholds_equal_a_loop(spark, period):
    rng = random.Random(period)
    norms = {k: [rng.lognormvariate(0, 1.5) for _ in range(rng.randint(0, 260))] for k in range(8)}
    rows = [(k, s, v) for k, vs in norms.items() for s, v in enumerate(vs)] + [(None, 3, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, s int, v double").repartition(5)
    got = sorted(map(tuple, T.clip_thresholds(df, "k", "s", "v", period, 2.0).collect()))
    want = sorted((k, *r) for k, vs in norms.items() for r in clip_loop(vs, period, 2.0))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want])


def test_clip_scale(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 2.0), (math.inf, 2.0), (math.nan, 2.0), (5.0, None)], "n double, t double")
    assert [r[0] for r in df.select(T.clip_scale(F.col("n"), F.col("t"))).collect()] == pytest.approx([1.0, 0.5, 0.0, 0.0, 1.0])


def test_condition_masks_hang_on_row_and_seed_only(spark):
    df = spark.createDataFrame([(k, (k * 37) % 200) for k in range(300)] + [(900, None), (901, 0)], "k long, n long")
    made = lambda d, seed: {r.k: r.s for r in d.select("k", T.condition_span(F.col("n"), F.col("k"), 0.7, 1.0, seed).alias("s")).collect()}
    one = made(df, 3)
    assert one == made(df.repartition(7), 3) != made(df, 4)
    assert one[900] is None and tuple(one[901]) == (0, 0)
    for k, n in ((k, (k * 37) % 200) for k in range(300)):
        assert 0 <= one[k].start <= one[k].end <= n and int(0.7 * n) <= one[k].end - one[k].start <= n
    tail = df.where("n > 0").select("n", T.condition_span(F.col("n"), F.col("k"), 0.2, 0.4, 1, suffix=True).alias("s")).collect()
    assert all(r.s.end == r.n for r in tail)
    mask = spark.range(1).select(T.span_mask(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.lit(5)).alias("m")).first().m
    assert mask == [False, True, True, False, False]


def test_running_average(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(100)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s int, v long")
    for width in (1, 7, 1000):
        made = T.running_average(df, "k", "s", "v", width)
        for r in made.collect():
            own = [v for k, s, v in rows if k == r.k and v is not None and (s is None or r.s is not None and s <= r.s)]
            assert r.average == (pytest.approx(sum(own) / len(own)) if own else None)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_moments_and_rotations(spark):
    x = np.random.default_rng(3).normal(size=(500, 12)) @ np.diag(range(12))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([math.nan] + [0.0] * 11,)], "v array<double>").repartition(6)
    n, total = T.moment_matrix(df, "v")
    assert n == 500 and np.allclose(total, x.T @ x)
    values = T.jacobi_eigenvalues(total / n)
    assert np.allclose(values, np.linalg.eigvalsh(total / n)[::-1], atol=1e-9)
    assert values.sum() == pytest.approx(np.trace(total / n), abs=1e-6) and (values**2).sum() == pytest.approx(((total / n) ** 2).sum(), rel=1e-9)
    assert T.moment_matrix(df.limit(0), "v")[0] == 0


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(9)
    some = lambda n: [(rng.randint(0, 2), a := rng.randint(0, 300), a + rng.choice([0, 1, 5, 90]), k) for k in range(n)]
    a, b = some(60), some(60)
    left, right = spark.createDataFrame(a, "g int, a_start long, a_end long, i int"), spark.createDataFrame(b, "g int, b_start long, b_end long, j int")
    want = sorted((i, j, max(s, u), min(e, v)) for g, s, e, i in a for h, u, v, j in b if g == h and max(s, u) < min(e, v))
    for width in (1, 16, 1000):
        assert sorted((r.i, r.j, r.start, r.end) for r in I.overlaps(left, right, "g", width).collect()) == want


def test_speaker_slices(spark):
    turns = spark.createDataFrame(
        [("a", 0, 0.0, 1.5), ("a", 1, 1.5, 2.0), ("a", 0, 2.0, 3.25), ("a", 5, 0.0, 9.0), ("b", 0, 0.0, 1.0), ("c", None, 0.0, 1.0), ("z", 0, 0.0, 1.0), ("z", 1, 0.0, 1.0)],
        "audio string, speaker int, start double, end double",
    )
    chunks = spark.createDataFrame([("a", 0, 0, 20), ("a", 1, 20, 20), ("b", 0, 0, 7), ("c", 0, 0, 5), ("d", 0, 0, 0)], "audio string, chunk int, offset int, samples int")
    got = sorted(map(tuple, I.speaker_slices(turns, chunks, rate=10).collect()))
    assert got == [
        ("a", 0, 1, 0, 0, 15), ("a", 0, 2, 1, 0, 12), ("a", 1, 1, 0, 15, 20),
        ("b", 0, 1, 0, 0, 7), ("b", 1, 1, 0, 0, 7), ("c", 0, 1, 0, 0, 5), ("c", 1, 1, 0, 0, 5),
    ]


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_equal_sorting(spark, few, monkeypatch):
    monkeypatch.setattr(A, "FEW", few)
    monkeypatch.setattr(A, "BUCKETS", 8)
    rng = random.Random(few)
    values = [rng.choice([0.0, 7.0, -1e300, 1e300, 1e-300, rng.gauss(0, 1), rng.expovariate(1e-6)]) for _ in range(700)] + [7.0] * 300 + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    own = sorted(v for v in values if v is not None)
    places = [0, 1, 17, 500, 501, 998, 999]
    assert A.values_at(df, "x", places) == [own[k] for k in places]
    assert A.quantiles(df, "x", [0.0, 0.5, 1.0]) == [own[0], (own[499] + own[500]) / 2, own[-1]]
    assert A.quantiles(df.limit(0), "x", [0.5]) == []


def test_tenths(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), float(rng.randint(0, 20))) for _ in range(60)] + [("z", 4.0)]
    got = {(r.g, r.tenth): (r.by_floor, r.by_rank) for r in A.tenths(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    for g in "abcz":
        own = sorted(x for h, x in rows if h == g)
        for i in range(11):
            assert got[g, i] == (own[min(i * len(own) // 10, len(own) - 1)], own[i * (len(own) - 1) // 10])


def test_moving_average(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + 0.1 * v
    df = spark.createDataFrame([(k + 1, len(values), v) for k, v in enumerate(values)], "k int, n int, v double")
    assert df.agg(S.moving_average(F.col("v"), F.col("k"), F.col("n"), 0.9)).first()[0] == pytest.approx(want)
    assert spark.createDataFrame([(values,)], "v array<double>").select(S.moving_average_end(F.col("v"), 0.9)).first()[0] == pytest.approx(want)

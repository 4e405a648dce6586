"""Operators on small tables: goldens and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import arrays as X, metrics as M
from lexiloom.operators import aggregates as A, jobs as J, relational as R, sequences as S


def value(spark, made, **cols):
    return spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items())).select(made.alias("o")).first()[0]


def test_next_fit(spark):
    df = spark.createDataFrame([([3, 4, 5, 6, 2],), ([],), (None,), ([99, 1],)], "s array<int>")
    assert [r[0] for r in df.select(S.next_fit(F.col("s"), 9)).collect()] == [[0, 0, 1, 2, 2], [], None, [0, 1]]


def test_text_chunks_match_a_plain_loop(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["word ", "a. ", "longerword ", "b!\n\n", "x"]) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.chunk_pieces(F.col("t"), 30).alias("p"))
    for r in df.withColumn("c", S.next_fit(F.transform("p", F.char_length), 30)).collect():
        assert "".join(r.p) == r.t
        chunks = {}
        for p, c in zip(r.p, r.c):
            chunks[c] = chunks.get(c, "") + p
        assert all(len(v) <= 30 or len([p for p, c in zip(r.p, r.c) if c == k]) == 1 for k, v in chunks.items())


def test_merge_spans(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 6, 8), (2, 0, 9), (2, 1, 2)], "g int, a int, b int")
    assert sorted(map(tuple, S.merge_spans(spans, "g", "a", "b").collect())) == [(1, 0, 4, 2), (1, 6, 8, 1), (2, 0, 9, 2)]


def test_arrays(spark):
    x = [0.05, 0.05]
    assert value(spark, X.raise_level(F.col("x"), 0.1), x=(x, "array<double>")) == pytest.approx([0.1, 0.1])
    assert value(spark, X.rms(F.col("x")), x=(x, "array<double>")) == pytest.approx(0.05)
    at = lambda f, t: value(spark, X.token_positions(F.col("f"), F.col("t")), f=(f, "int"), t=(t, "int"))
    assert at(5, 2) == [0, 0, 1, 1, 2] and at(1, 2) == [2] and at(0, 2) == []
    assert value(spark, X.pad_mask(F.col("n"), F.lit(5)), n=(3, "int")) == [False, False, False, True, True]
    assert value(spark, X.time_steps(2, 0.5), n=(3, "int")) == pytest.approx([0, 1 / 3, 1])
    assert value(spark, S.cross_fade(F.col("a"), F.col("b"), 2), a=([1.0, 1.0], "array<double>"), b=([0.0, 0.0], "array<double>")) == [1.0, 0.0]
    assert value(spark, X.up_sample(F.col("a"), 2), a=([1.0, 2.0], "array<double>")) == [1.0, 1.0, 2.0, 2.0]
    assert value(spark, X.padded(F.col("a"), F.lit(3), F.lit(0)), a=([7], "array<int>")) == [7, 0, 0, 0]
    assert value(spark, X.eden_rate(1.0, F.col("b"), F.col("b"), 100.0, 10.0, 500.0), b=(0.0, "double")) == 0.5
    assert value(spark, X.from_int16(X.to_int16(F.col("a"))), a=([0.5, 2.0, -2.0], "array<double>")) == [0.5, 32767 / 32768, -1.0]
    pwl = lambda v: value(spark, R.interpolate(F.col("v"), [(0.0, 10.0), (1.0, 0.0)]), v=(v, "double"))
    assert [pwl(-100.0), pwl(0.5), pwl(2.0)] == [10.0, 5.0, 0.0]


def test_edit_counts_match_brute_force():
    from functools import lru_cache

    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 7))] for _ in range(2))

        @lru_cache(None)
        def cost(i, j):
            if not i or not j:
                return i + j
            return min(cost(i - 1, j) + 1, cost(i, j - 1) + 1, cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]))  # noqa: B023

        s, d, n = M.edit_counts(a, b)
        assert s + d + n == cost(len(a), len(b)) and len(a) - d + n == len(b)


def test_permutation_scores(spark):
    cos = lambda a, b: X.cosine(F.col(a), F.col(b))
    vec = "array<double>"
    score = M.best_permutation(cos("p1", "e1") + cos("p2", "e2"), cos("p1", "e2") + cos("p2", "e1"))
    assert value(spark, score, p1=([1.0, 0.0], vec), p2=([0.0, 1.0], vec), e1=([0.0, 1.0], vec), e2=([1.0, 0.0], vec)) == pytest.approx(1.0)
    assert value(spark, M.chosen_order(F.col("a"), F.col("a")), a=(0.5, "double")) == "crossed"


def test_finite_merge(spark):
    rows = spark.createDataFrame([("m", 1.0, 1), ("m", float("nan"), 1), ("m", 2.0, 1), ("m", float("inf"), 1)], "metric string, v double, n int")
    assert A.merged_metrics(rows, "metric", "v", "n").first()[1:3] == (3.0, 2)


def test_lookup_and_zip(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    docs = spark.createDataFrame([(1, ["b", "x", "a"]), (2, []), (3, ["x"])], "k int, toks array<string>")
    assert sorted(map(tuple, R.lookup_ids(docs, "toks", vocab).collect())) == [(1, [2, 1]), (2, []), (3, [])]
    a, b = spark.createDataFrame([(1, "x")], "at int, a string"), spark.createDataFrame([(1, "y"), (2, "z")], "at int, b string")
    with pytest.raises(Exception, match="differ in length"):
        R.positional_zip(a, b, "at").collect()
    assert R.positional_zip(a, b.limit(1), "at").count() == 1


def test_json_null_overrides_the_default(spark):
    df = spark.createDataFrame([('{"g": null}',), ('{"g": "x"}',), ("{}",), (None,)], "j string")
    assert [r[0] for r in df.select(R.json_or_default(F.col("j"), "g", "d")).collect()] == [None, "x", "d", "d"]


def test_voices_and_jobs(spark):
    df = spark.createDataFrame([("nu_bac_1",), ("nam_nam_2",), ("manual_trung",), ("x",)], "v string")
    assert [tuple(r) for r in df.select(J.voice_gender(F.col("v")), J.voice_region(F.col("v"))).collect()] == [("female", "North"), ("male", "South"), ("female", "Central"), (None, None)]
    events = spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (1, 3, "running"), (2, 1, "queued"), (2, 5, "running")], "job int, ts int, status string")
    assert sorted(map(tuple, J.job_states(events, "job", "ts", "status").collect())) == [(1, "done", 1, 2), (2, "running", 1, None)]


def test_insert_if_absent_keeps_the_first(spark):
    known = spark.createDataFrame([("a", 0)], "k string, v int")
    new = spark.createDataFrame([("B ", 2), ("b", 1), ("A", 9)], "k string, v int")
    assert sorted(map(tuple, R.insert_if_absent(known, new, "k", "v").collect())) == [("a", 0), ("b", 1)]


def test_fixed_batches(spark):
    df = spark.createDataFrame([(list(range(7)),), ([],), (None,), ([1, 2, 3],)], "s array<int>")
    got = [r[0] for r in df.select(R.fixed_batches(F.col("s"), 3)).collect()]
    assert got == [[[0, 1, 2], [3, 4, 5], [6]], [], [], [[1, 2, 3]]]


def test_speakable_segment(spark):
    texts = ["", None, " .,;:!?…—–-'\"()[]{}\u3000\n", "a.", "(5)", "【", "%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(R.speakable_segment(F.col("t"))).collect()] == [False, False, False, True, True, True, True]


def test_single_supervision(spark):
    good = spark.createDataFrame([(1, ["a"]), (2, [None])], "id int, s array<string>")
    assert R.single_supervision(good, "s").count() == 2
    for bad in ([], None, ["a", "b"]):
        with pytest.raises(Exception, match="single supervision"):
            R.single_supervision(spark.createDataFrame([(1, bad)], "id int, s array<string>"), "s").collect()

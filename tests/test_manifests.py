"""Manifests, listings, defaults, views and silence."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import manifests as M
from tests import twins


def test_validation(spark):
    r = spark.createDataFrame([("a", 10.0), ("b", 5.0), (None, 1.0), ("a", 8.0)], "recording_id string, duration double")
    s = spark.createDataFrame(
        [(1, "a", 0.0, 10.0), (2, "a", 9.5, 1.0), (3, "x", 0.0, 1.0), (4, "a", -1.0, 1.0), (5, "a", 0.0, None), (6, None, 0.0, 1.0), (7, "a", 0.0, 0.0)], "id int, recording_id string, start double, duration double"
    )
    got = sorted(map(str, ((x.side, x.id, x.reason) for x in M.validation(r, s).collect())))
    assert got == sorted(
        map(
            str,
            [("recording", "a", None), ("recording", "a", None), ("recording", "b", "no supervision"), ("recording", None, "no supervision"), ("supervision", "1", None), ("supervision", "2", "beyond its recording"),
             ("supervision", "3", "no recording"), ("supervision", "4", "bad times"), ("supervision", "5", "bad times"), ("supervision", "6", "no recording"), ("supervision", "7", "bad times")],
        )
    )


def test_validation_sorts_no_rows(spark, capsys):
    r = spark.createDataFrame([(k, 5.0) for k in range(100)], "recording_id int, duration double")
    s = spark.createDataFrame([(k, k % 150, 0.0, 1.0) for k in range(600)], "id int, recording_id int, start double, duration double")
    out = M.validation(r, s)
    out.explain()
    assert "Sort" not in capsys.readouterr().out
    assert {(x.side, x.reason): x["count"] for x in out.groupBy("side", "reason").count().collect()} == {("recording", None): 100, ("supervision", None): 400, ("supervision", "no recording"): 200}


def test_files(spark, tmp_path):
    for name in ("a.WAV", "b.wav", "sub/c.wav", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"RIFF")
    files = M.audio_files(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a",), ("c",), (None,)], "name string")
    found = {r.name: r.path for r in M.with_files(rows, files, "name", ".wav").collect()}
    assert found["a"].endswith("/a.WAV") and found["c"].endswith("/sub/c.wav") and found[None] is None
    assert M.all_found(M.with_files(rows.where("name = 'a'"), files, "name", ".wav"), "name").count() == 1
    with pytest.raises(Exception, match="no file for d"):
        M.all_found(M.with_files(spark.createDataFrame([("d",)], "name string"), files, "name", ".wav"), "name").collect()
    with pytest.raises(ValueError, match="no .flac"):
        M.audio_files(spark, f"file://{tmp_path}", ".flac")


def test_either_manifest(spark, tmp_path):
    (tmp_path / "cuts.jsonl").write_text('{"id": 1}\n')
    other = lambda: spark.createDataFrame([(2,)], "id int")
    assert M.either(spark, f"file://{tmp_path}/cuts.jsonl", "id int", other).first().id == 1
    assert M.either(spark, f"file://{tmp_path}/none.jsonl", "id int", other).first().id == 2


def test_columns(spark):
    df = spark.createDataFrame([(1, "Yes", "1, 2,x", [1.0, -3.0, 3.0], 7, 3), (2, "n", "", [], 5, 0), (3, "maybe", None, None, 2, None)], "k int, w string, t string, v array<double>, f int, n int")
    got = df.select("k", M.parsed_bool(F.col("w")), M.int_tuple(F.col("t")), M.largest_index(F.col("v")), M.even_durations(F.col("f"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(1, True, [1, 2, None], 1, [2, 2, 2]), (2, False, [None], None, []), (3, None, None, None, [])]


def test_sampler_defaults(spark):
    df = spark.createDataFrame([("zipvoice", None, None), ("zipvoice_distill", 4, None), ("other", None, 2.0)], "model string, steps int, guidance double")
    assert [tuple(r) for r in M.with_sampler(df, "model", "steps", "guidance").collect()] == [("zipvoice", 16, 1.0), ("zipvoice_distill", 4, 3.0), ("other", None, 2.0)]


def test_metrics(spark):
    rows = [("loss", 4.0), ("loss", math.nan), ("loss", math.inf), ("loss", 2.0), ("utt_x", 6.0), ("frames", 3.0), ("utterances", 2.0)]
    merged = M.merged_metrics(spark.createDataFrame(rows, "key string, value double"))
    assert sorted((r.key, r.total, r.mean) for r in M.normed_metrics(merged).collect()) == [("loss", 6.0, 2.0), ("utt_x", 6.0, 3.0)]
    assert [r.mean for r in M.normed_metrics(merged.where("key = 'loss'")).collect()] == [6.0]


def test_silence_equals_a_plain_reading(spark):
    rng = random.Random(6)
    for _ in range(120):
        wave = [x for _ in range(rng.randint(0, 6)) for x in [rng.choice([0.0, 0.5, 1e-5])] * rng.randint(1, 60)]
        how = {"longest_ms": rng.choice([100, 300]), "keep_ms": rng.choice([0, 50, 400]), "edge_ms": rng.choice([0, 30]), "db": -50.0, "step_ms": 10}
        got = np.array(wave)[M.kept_samples(np.array(wave), 100, **how)].tolist()
        assert got == twins.cut_silence(wave, 100, 0, how["longest_ms"], how["keep_ms"], how["edge_ms"], how["db"], how["step_ms"])
    df = spark.createDataFrame([(1, [0.0] * 300 + [0.5] * 100 + [0.0] * 4000 + [0.5] * 10 + [None] * 200), (2, None), (3, []), (4, [0.0] * 10)], "k int, w array<double>")
    sizes = {r.k: None if r.o is None else len(r.o) for r in df.select("k", M.without_silence(F.col("w"), 1000, 5).alias("o")).collect()}
    assert sizes == {1: 100 + 100 + 2000 + 10 + 100 + 5, 2: None, 3: 5, 4: 5}

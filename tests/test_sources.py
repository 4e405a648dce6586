"""Readers and writers over small files."""

import pytest

from lexiloom.sources import lists, sinks
from lexiloom.streaming import jobs


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_lists(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "u1\thello\ta.wav\nu2\tyo\tb.wav\t0.5\t2\n")
    assert sorted(map(tuple, lists.dataset_list(spark, path).collect())) == [("u1", "hello", "a.wav", 0.0, None), ("u2", "yo", "b.wav", 0.5, 2.0)]
    bad = put(tmp_path, "bad.tsv", "u1\thello\ta.wav\nu2\tx\ty\tz\n")
    with pytest.raises(Exception, match="expected 3 or 5 fields"):
        lists.dataset_list(spark, bad).collect()
    assert lists.dataset_list(spark, bad, strict=False).where("malformed is not null").count() == 1
    assert [tuple(r) for r in lists.transcript_list(spark, put(tmp_path, "t", "n\tx\ty\n")).collect()] == [("n", "y")]
    rows = lists.dialog_list(spark, put(tmp_path, "d", "w\tp1\tp2\ta\tb\t[S1] hi\n")).collect()
    assert rows[0].prompt_text == "[S1]p1[S2]p2" and rows[0].prompt_wavs == ["a", "b"]
    with pytest.raises(Exception, match="begins with"):
        lists.dialog_list(spark, put(tmp_path, "d2", "w\tp\ta\thi\n")).collect()


def test_vocabulary(spark, tmp_path):
    assert lists.vocabulary(spark, put(tmp_path, "v", "_\t0\na\t1\n \t2\n")).count() == 3
    for name, text, why in (("v2", "_\t0\na\t1\na\t2\n", "stands twice"), ("v3", "a\t1\n", "no pad")):
        with pytest.raises(Exception, match=why):
            lists.vocabulary(spark, put(tmp_path, name, text)).collect()


def test_dictionaries(spark, tmp_path):
    path = put(tmp_path, "pipe", "A|x\nb|y\na|z\nbroken\nc|w\n")
    assert sorted(map(tuple, lists.pipe_dictionary(spark, path).collect())) == [("a", "z"), ("b", "y")]
    assert sorted(r[0] for r in lists.word_list(spark, put(tmp_path, "w", "abc\n# no\n\nABC\nd\n")).collect()) == ["ABC", "D"]
    assert sorted(map(tuple, lists.json_dictionary(spark, put(tmp_path, "j", '{"a": "b",\n "c": "d"}')).collect())) == [("a", "b"), ("c", "d")]
    assert lists.json_dictionary(spark, put(tmp_path, "j2", "oops")).count() == 0


def test_checkpoints_and_voices(spark, tmp_path):
    for n in (1, 20, 300, 4000):
        put(tmp_path, f"ck/checkpoint-{n}.pt", "x")
    put(tmp_path, "ck/epoch-3.pt", "x")
    folder = f"file://{tmp_path}/ck"
    assert [r.number for r in lists.checkpoints(spark, folder, 20).collect()] == [4000, 300, 20]
    assert [r.number for r in lists.checkpoints(spark, folder, -20).collect()] == [20, 1]
    put(tmp_path, "v/one/prompt.txt", "xin chào")
    put(tmp_path, "v/one/prompt.wav", "RIFF")
    put(tmp_path, "v/two/prompt.txt", "no wave")
    assert [(r.voice_id, r.prompt_text) for r in lists.voices(spark, f"file://{tmp_path}/v").collect()] == [("one", "xin chào")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    sinks.write_manifest(df, f"file://{tmp_path}/m")
    sinks.write_manifest(df.limit(0), f"file://{tmp_path}/m")
    assert lists.manifest(spark, f"file://{tmp_path}/m", "key string, value string").count() == 2
    sinks.write_shards(df, f"file://{tmp_path}/s", "key", 4)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 2 and all(len(p.name) == len("shard=00000000") for p in (tmp_path / "s").glob("shard=*"))
    sinks.save_dictionary(df, f"file://{tmp_path}/d")
    assert [r.key for r in spark.read.json(f"file://{tmp_path}/d").collect()] == ["a", "b"]
    errors = spark.createDataFrame([("n", 0.5, "a b", "a c", 0, 0, 1)], "Name string, WER double, Truth string, Hypothesis string, Insertions int, Deletions int, Substitutions int")
    sinks.write_error_details(errors, f"file://{tmp_path}/e", f"file://{tmp_path}/t")
    assert spark.read.json(f"file://{tmp_path}/t").first().Substitutions == 1


def test_dictionary_stream_keeps_first_values(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("A", "1", 1), ("a", "2", 2)], [("a", "3", 3), ("b", "4", 4)])):
        spark.createDataFrame(rows, "key string, value string, at long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("key string, value string, at long").parquet(f"file://{tmp_path}/in")
        jobs.grow_dictionary(stream, f"file://{tmp_path}/known", f"file://{tmp_path}/ck")
    assert sorted((r.key, r.value) for r in spark.read.parquet(f"file://{tmp_path}/known").collect()) == [("a", "1"), ("b", "4")]


def test_cut_off_stream(spark, tmp_path):
    spark.createDataFrame([(1, float(k % 100)) for k in range(2000)], "g long, v double").coalesce(1).write.parquet(f"file://{tmp_path}/v")
    stream = spark.readStream.schema("g long, v double").parquet(f"file://{tmp_path}/v")
    query = jobs.cut_off(stream, "g", "v", 0.3).writeStream.outputMode("update").format("memory").queryName("cut").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("cut").first()
    assert row.n == 2000 and 0.2 < row.passed / row.n < 0.4


def test_lenient_lists_and_missing_words(spark, tmp_path):
    rows = lists.synthesis_list(spark, put(tmp_path, "s", "w\tp\tv\thi\nbad\tline\n"), strict=False).collect()
    assert sorted((r.wav_name or "", r.malformed or "") for r in rows) == [("", "bad\tline"), ("w", "")]
    rows = lists.dialog_list(spark, put(tmp_path, "d", "w\tp\tv\t[S1] hi\nw\tp\tv\thi\nx\n"), strict=False).collect()
    assert sorted(r.malformed or "" for r in rows) == ["", "w\tp\tv\thi", "x"]
    assert lists.word_list(spark, f"file://{tmp_path}/none").count() == 0


def test_checkpoints_for_averaging(spark, tmp_path):
    for n in (1, 20, 300):
        put(tmp_path, f"ck/checkpoint-{n}.pt", "x")
    found = lists.checkpoints(spark, f"file://{tmp_path}/ck")
    assert [r.number for r in lists.for_averaging(found, 1).collect()] == [300, 20]
    with pytest.raises(ValueError, match="fewer than 4"):
        lists.for_averaging(found, 3)

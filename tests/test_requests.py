"""Requests to a model: cache, batches, guards, replies."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom import plans
from lexiloom.operators import requests as R
from lexiloom.operators import sequences as S


def provider(log):
    """Writes down what it is asked, a file for each request."""

    def ask(prompt):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        if "broken" in prompt:
            raise TimeoutError
        return "\n".join(f"[{k}] {line.split('] ', 1)[1]}!" for k, line in enumerate(prompt.split("\n")))

    return ask


def asked_for(log):
    return sorted(line.split("] ", 1)[1] for f in log.iterdir() for line in f.read_text().split("\n"))


def test_replies():
    tokens = ["AI", "KPI", "x", "y", "z"]
    assert R.replies(tokens, "[0] ây ai\nnoise\n [ 1 ]  kây pi ai \n[3]\n[9] far\n[4] " + "o" * 99) == ["ây ai", "kây pi ai", "x", "y", "z"]
    assert R.replies(tokens, "") == tokens


def test_each_token_is_asked_for_once(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/cache"
    log.mkdir()
    rows = lambda *ts: spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ts)], "k int, token string, answered string")
    first = R.answered(rows("a", "b", "a", None), folder, 0, provider(str(log)), batch=2)
    assert sorted((r.k, r.token, r.said) for r in first.collect()) == [(0, "a", "a!"), (1, "b", "b!"), (2, "a", "a!"), (3, None, None)]
    second = R.answered(rows("b", "c", "broken", "c"), folder, 1, provider(str(log)), batch=1, retries=1, wait=0.0)
    assert sorted((r.token, r.said) for r in second.collect()) == [("b", "b!"), ("broken", "broken"), ("c", "c!"), ("c", "c!")]
    assert asked_for(log) == ["a", "b", "broken", "broken", "c"]
    # what failed is asked for again, and a batch that runs again changes nothing
    third = R.answered(rows("broken", "a"), folder, 2, lambda prompt: "[0] ok", retries=0)
    assert sorted((r.token, r.said) for r in third.collect()) == [("a", "a!"), ("broken", "ok")]
    again = R.answered(rows("broken", "a"), folder, 2, lambda prompt: "[0] ok", retries=0)
    assert sorted((r.token, r.said) for r in again.collect()) == [("a", "a!"), ("broken", "ok")]
    assert R.answered(rows("a").limit(0), folder, 3, provider(str(log))).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_tokens_may_come_apart_from_requests(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_ROWS", most)
    log, folder = tmp_path / "log", f"file://{tmp_path}/cache"
    log.mkdir()
    rows = lambda *ts: spark.createDataFrame([(k, t) for k, t in enumerate(ts)], "k int, token string")
    for number, ts in enumerate((["a", "b", "a", None], ["b", "c", "c"])):
        out = R.answered(rows(*ts), folder, number, provider(str(log)), tokens=rows(*ts, *ts).select("token"))
        assert sorted((r.k, r.token, r.said) for r in out.collect()) == [(k, t, t and f"{t}!") for k, t in enumerate(ts)]
    assert asked_for(log) == ["a", "b", "c"]


@pytest.mark.parametrize(
    "rows, size",
    [
        ([(None, "a b a"), (None, "b"), (-3, "a c"), (-2, "c"), (1, "a"), (1, "a d"), (2, None), (4, "")], 7),
        ([(None, "a b a"), (-3, "a c"), (-2, "c Été aÀb"), (2, None), (4, "")], 8),
    ],
)
def test_cache_of_documents_with_odd_ids(spark, tmp_path, rows, size):
    """Ids that are null, negative or repeated keep their words, as in the SQL."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = plans.queries()["request_cache"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, token, n, said from ({plans.oracle_sql()['request_cache']})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(got) == size


def test_stream_writes_answers_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for part in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in part], "token string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("token string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    R.stream_answers(stream, f"file://{tmp_path}/cache", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", provider(str(log)))
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.token, r.said) for r in out.collect()) == [("a", "a!"), ("a", "a!"), ("b", "b!"), ("b", "b!"), ("c", "c!")]
    assert asked_for(log) == ["a", "b", "c"]


@pytest.mark.parametrize("text, reply, want", [("ab", " xyz ", "xyz"), ("ab", "1234567", "ab"), ("ab", " ", "ab"), ("ab", None, "ab"), ("", "x", ""), (None, "x", None)])
def test_guarded_text(spark, text, reply, want):
    df = spark.createDataFrame([(text, reply)], "t string, r string")
    assert df.select(R.guarded_text(F.col("t"), F.col("r"))).first()[0] == want


def test_merged_extractions(spark):
    pair = lambda w, s: f'{{"foreign_word": "{w}", "vietnamese_spelling": "{s}"}}'
    rows = [
        (1, 0, f'{{"acronyms": ["KPI", " AI ", ""], "foreign_vietnamese_pairs": [{pair("server", "sơ")}, {pair("web", "")}]}}'),
        (1, 1, f'{{"acronyms": ["AI"], "foreign_vietnamese_pairs": [{pair("server ", "sơ vơ")}, {pair("app", "áp")}]}}'),
        (2, 0, "oops"),
        (3, 0, None),
        (4, 0, "{}"),
    ]
    got = {r.d: (r.acronyms, [tuple(p) for p in r.pairs]) for r in R.merged_extractions(spark.createDataFrame(rows, "d int, k int, reply string"), "d", "k", "reply").collect()}
    assert got == {1: (["AI", "KPI"], [("app", "áp"), ("server", "sơ vơ")]), 2: ([], []), 3: ([], []), 4: ([], [])}


def test_batches_that_pay_for_rows(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([9, 1],), ([],), (None,)], "n array<int>")
    assert [r[0] for r in df.select(S.batchify(F.col("n"), 5.0, 1.0, 1.0)).collect()] == [[0, 0, 1], [0, 1], [], None]


def test_merged_rows(spark):
    rows = [(1, 0, "x", False), (1, 1, "A", True), (1, 2, "và", False), (1, 3, "B", True), (1, 4, "một hai ba", False), (1, 5, "bốn", False), (2, 0, "C", True), (2, 1, "D", True)]
    got = S.merged_rows(spark.createDataFrame(rows, "g int, k int, t string, r boolean"), "g", "k", "t", "r", 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "x", False), (1, 1, "A và B", True), (1, 2, "một hai ba bốn", False), (2, 0, "C", True), (2, 1, "D", True)]


def test_scores_keep_their_order(spark):
    df = spark.createDataFrame([(k, None if k == 5 else "x" * k) for k in range(100)], "k int, v string").coalesce(1)
    asked = lambda values: [float(len(v)) for v in values]
    steps = [lambda d: R.scored(d, "v", asked, batch=7), lambda d: d.where("score is null or score > 2")]
    assert {r.k: r.score for r in R.transformed(df, steps).collect()} == {k: None if k == 5 else float(k) for k in range(100) if k == 5 or k > 2}
    with pytest.raises(Exception, match="scores for"):
        R.scored(df, "v", lambda values: [1.0]).collect()

"""Special tokens, the dictionary automaton and what is built on them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import lexicon, text as X
from lexiloom.functions.special_tokens import special_spans
from lexiloom.operators import vietnamese
from tests import twins


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("không có gì", []),
        ("AI và KPI", [("AI", "abbreviation", 0, 2), ("KPI", "abbreviation", 6, 9)]),
        ("ở TP.HCM, U.S.A", [("TP.HCM", "abbreviation", 2, 8), ("U.S.A", "abbreviation", 10, 15)]),
        ("ax² + bx = 0 nhé", [("ax² + bx = 0", "expression+symbol", 0, 12)]),
        ("1 + 2 là", []),
        ("mạng 802.11ax, H.264", [("802.11ax", "code", 5, 13), ("H.264", "code", 15, 20)]),
        ("a#b", [("#", "sign", 1, 2)]),
        ("x@@y ²", [("@@", "sign", 1, 3), ("²", "symbol", 5, 6)]),
        ("GPU4²", [("²", "symbol", 4, 5)]),
    ],
)
def test_special_tokens(text, want):
    assert special_spans(text) == want


def test_special_tokens_equal_covered_runs():
    rng = random.Random(2)
    parts = ["ax²", " + ", "=", " ", "AI", "RoHS", "TP.", "HCM", "5G", "802.11ax", "#", "@", "é", "Δ", "(b", ")", "-", "x", "12", "\n", "😀"]
    rows = [{"doc_id": k, "text": "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))} for k in range(300)]
    want = sorted(twins.special_tokens(rows)["rows"])
    assert sorted((r["doc_id"], b, kind, a, t) for r in rows for t, kind, a, b in special_spans(r["text"])) == want


def test_long_run_without_operator_is_linear():
    began = time.process_time()
    assert special_spans("x" * 300_000 + " ²")
    assert time.process_time() - began < 2


ENTRIES = [("new", "mới", False), ("new york", "NY", False), ("york city", "?", False), ("AI", "ây ai", True), ("ai", "ai đó", False), ("c++", "xê", False), ("", "x", False), (None, "x", False), ("gone", None, False)]


@pytest.mark.parametrize("block_chars", [1 << 20, 8])
def test_replacement_is_leftmost_and_longest(spark, block_chars):
    entries = spark.createDataFrame(ENTRIES, "key string, said string, cased boolean")
    texts = ["NEW York city", "newer new, York", "AI ai Ai aI", "c++x c++ c++", "", None, "gone with", "İ new", "new " * 5000, "anew new1 _new new"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "k int, text string, `start` string")
    got = {r.k: r.said for r in lexicon.replaced(df, entries, block_chars=block_chars).collect()}
    plain = [(k, s or "", c) for k, s, c in ENTRIES if k]
    assert [got[k] for k in range(len(texts))] == [None if t is None else twins.longest(t, plain) for t in texts]
    assert got[0] == "NY city" and got[2] == "ây ai ai đó ai đó ai đó"
    assert lexicon.replaced(df, entries.limit(0)).where("text = said or text is null").count() == len(texts)


def test_time_hardly_depends_on_the_number_of_entries():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    many = [(word(), "x", False) for _ in range(100_000)]
    text = " ".join(rng.choice(many[:500])[0] if k % 5 == 0 else word() for k in range(20_000))

    def seconds(entries):
        built, best = lexicon.Lexicon(entries), 9.0
        for _ in range(3):
            began = time.process_time()
            built.matches(text)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(many) < 2 * seconds(many[:1000]) + 0.05


def test_spelling_markers(spark):
    texts = ["Hệ thống {{SPELL}}TTS{{/SPELL}} rất tốt", "{{SPELL}}VS1{{/SPELL}}{{SPELL}}cron job{{/SPELL}}", "{{SPELL}}12{{/SPELL}}.", "{{SPELL}}é{{/SPELL}}", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.spelled_markers(F.col("t")).alias("o")).orderBy("k").collect()
    assert [r.o for r in rows] == ["Hệ thống 【ti ti ét】 rất tốt", "【vi ét】 một【xi ah âu en jây âu bi】", "một hai.", "{{SPELL}}é{{/SPELL}}", ""]


def test_spoken_vietnamese(spark):
    df = spark.createDataFrame(
        [(1, "Ngày 5/6/2020 dùng AI và server mới, CPU tốt", [("server", "sơ vơ")], ["AI"]), (2, None, None, None), (3, "", [], []), (4, "hello. thế", [(None, "x"), ("thế", None)], [None])],
        "k int, text string, pairs array<struct<word:string,said:string>>, names array<string>",
    )
    words = spark.createDataFrame([("hello", "hê lô")], "key string, said string")
    spelled = spark.createDataFrame([("cpu",)], "key string")
    got = {r.k: r.said for r in vietnamese.spoken(df, words, words.limit(0), spelled, pairs_col="pairs", acronyms_col="names").collect()}
    assert got == {1: "Ngày ngày năm tháng sáu năm hai nghìn không trăm hai mươi dùng 【ây ai】, và sơ vơ mới, 【xi pi iu】 tốt", 2: None, 3: "", 4: "Hê lô. Thế"}

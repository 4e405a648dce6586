"""Typed segments and their tokenizers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import tokenize as T
from tests import twins


def test_segments_equal_a_plain_reading(spark):
    rng = random.Random(1)
    bits = ["我", "们", "a", "Bc", " ", "1", ",", "<", ">", "[", "]", "<wo3>", "[S1]", "<a]", "[b>", "é", "\n", "😀"]
    texts = ["我们是小米人,是吗? Yes I think so!霍...啦啦啦", "", "12 3", "<", "a<b", "x <y> [z"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    texts = [t for t in texts if "\n" not in t or not set(t) & set("<[")]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.typed_segments(F.col("t")).alias("s")).orderBy("k").collect()
    for r, text in zip(got, texts):
        assert [tuple(s) for s in r.s] == twins.segments(text), text


def test_long_segments(spark):
    text = "word, " * 60_000 + "我" * 50_000 + "[a]" * 2000
    n = spark.createDataFrame([(text,), (None,)], "t string").select(T.typed_segments(F.col("t")).alias("s")).select(F.size("s")).collect()
    assert n[0][0] == 2002 and n[1][0] in (-1, None)


@pytest.mark.parametrize("part, want", [("<zhong1>", ["zh0", "ong1"]), ("<ai4>", ["ai4"]), ("<yu3>", ["y0", "u3"]), ("<m2>", ["m0", "2"]), ("<xx>", []), ("<>", []), ("<lü4>", ["l0", "ü4"]), ("<3>", [])])
def test_syllables(spark, part, want):
    assert spark.createDataFrame([(part,)], "t string").select(T.syllable_parts(F.col("t"))).first()[0] == want


def test_tokenizers_by_name(spark):
    df = spark.createDataFrame([(1, "你好，a [S1] b<wo3>[x]"), (2, None), (3, "")], "k int, text string").withColumn("lang", F.lit("clash"))
    made = lambda name, **o: {r.k: r.tokens for r in T.add_tokens(df, name, **o).collect()}
    assert made("simple")[1][:4] == ["你", "好", "，", "a"]
    assert made("emilia") == {1: ["你", "好", ",", "a", " ", "[S1]", " ", "b", "w0", "o3", "[x]"], 2: None, 3: []}
    assert made("dialog")[1] == ["你", "好", ",", "a", "[S1]", "b", "w0", "o3", "[x]"]
    assert made("dialog", by_type={"en": lambda t: F.array(F.upper(t))})[1] == ["你", "好", ",", "A", "[S1]", "B", "w0", "o3", "[x]"]
    with pytest.raises(ValueError, match="no such tokenizer"):
        T.add_tokens(df, "bpe")


def test_dialogue_ids(spark):
    vocab = spark.createDataFrame([("_", 0), ("a", 1), ("[S1]", 2), ("[S2]", 3)], "token string, id int")
    df = T.add_tokens(spark.createDataFrame([(1, "[S1] ab [S2] a")], "k int, text string"), "dialog")
    assert T.token_ids(df, "tokens", vocab, dialog=True).first().ids == [2, 1, 3, 1]
    with pytest.raises(ValueError, match="lacks"):
        T.token_ids(df, "tokens", vocab.where("id < 3"), dialog=True)


def test_character_counts(spark):
    rows = spark.createDataFrame([("aßa😀\n",), ("",), (None,)], "t string").select(T.character_counts(F.col("t")).alias("c")).collect()
    assert [r.c and {tuple(x) for x in r.c} for r in rows] == [{("a", 2), ("ß", 1), ("😀", 1), ("\n", 1)}, [], None]


def test_characters_and_many_parts_of_a_run(spark):
    rows = spark.createDataFrame([("aß😀 b\n",), ("",), (None,)], "t string").select(T.characters(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [["a", "ß", "😀", " ", "b", "\n"], [], None]
    # one run of 20,000 words and 20,000 tags: its language was looked for again for each part
    text = F.expr("concat('x', repeat(' de la casa [S1] y', 20000))")
    begin = time.perf_counter()
    row = spark.range(1).select(T.typed_segments(text).alias("s")).select(F.size("s").alias("n"), F.array_sort(F.array_distinct(F.transform("s", lambda x: x["lang"]))).alias("langs")).first()
    assert tuple(row) == (40001, ["en", "tag"])
    assert time.perf_counter() - begin < 20

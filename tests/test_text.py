"""Goldens of the text functions, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import spell, text as X
from lexiloom.operators import sequences as S


def run(spark, made, value):
    return spark.createDataFrame([(value,)], "text string").select(made(F.col("text")).alias("o")).first()[0]


@pytest.mark.parametrize(
    "made, value, want",
    [
        (X.punctuation_spacing, "a , b", "a, b"),
        (X.punctuation_spacing, "x ,. y", "x. y"),
        (X.sentence_case, "xin chào. bạn", "Xin chào. Bạn"),
        (X.sentence_case, "a. đi", "A. đi"),
        (X.sentence_case, "", ""),
        (X.double_marks, "a, b.", "a,, b.."),
        (X.double_marks, "a.. b", "a.. b"),
        (X.clean_for_dialog, "[S1] Hello,  World's (laugh) end", "hello world's end"),
        (X.clean_for_letters, "It’s 5%!", "it's 5"),
        (X.split_dialogue, "[S1] a [S2] b [S1] c", [" a  c", " b "]),
        (X.spell_letters, "TTS", "ti ti ét"),
        (X.spell_letters, "KPI", "kây pi ai"),
        (X.spell_letters, "VVS1", "vi vi ét một"),
        (X.spell_letters, "S2", "ét hai"),
        (X.dash_ranges, "1-2-3", "1 đến 2-3"),
        (X.verbatim_symbols, "80%", "80%"),
        (X.verbatim_symbols, "80 %", "80  phần trăm"),
        (X.percent_per_unit, "8,5%/năm.", "8,5 phần trăm trên năm."),
        (X.end_marks, "tỉ lệ 80%,90 xong.\nmới", "tỉ lệ 80%,90 xong. mới"),
        (X.pause_signs, "75 — 88 (ba) … “x”", "75-88 , ba,  .  x"),
        (X.remove_emoji, "a\U0001f600中b", "ab"),
        (X.map_wide_marks, "你，好…...", "你,好……"),
        (X.final_point, " xin chào ", "xin chào."),
        (X.final_point, "ok!", "ok!"),
        (X.final_point, "", ""),
        (X.pause_after, "một, ", 300),
        (X.trim_speaker_tags, "a [S1] b", "a[S1]b"),
        (X.expand_abbreviations, "Dr Smith etc", "doctor Smith et cetera"),
        (X.expand_abbreviations, "schöst stü béco ſt ſGT coſ xſt", "schösaint saintü bécompany ſt ſGT companyſ xsaint"),
        (X.spoken_points, "3.14", "3 point 14"),
        (X.numbered_lines, "[1] a\nbad\n[2] b\n[1] c", {1: "c", 2: "b"}),
        (X.strip_html, "<p>a<b>c</b>\n<i\nx>", "ac\n<i\nx>"),
        (S.language_runs, "我们是小米人,是吗? Yes I think so!霍...啦啦啦", ["我们是小米人,是吗? ", "Yes I think so!", "霍...啦啦啦"]),
        (S.split_tags, "a<le5>b[S1]c", ["a", "<le5>", "b", "[S1]", "c"]),
        (lambda c: S.drop_second(S.words(c), "ngày", "ngày"), "ngày ngày 5", ["ngày", "5"]),
        (lambda c: S.drop_second(S.words(c), "mùng", "ngày"), "mùng ngày 5", ["mùng", "5"]),
    ],
)
def test_goldens(spark, made, value, want):
    assert run(spark, made, value) == want


def test_spell_split(spark):
    got = [tuple(run(spark, X.spell_split, w)) for w in ("VS1", "G")]
    assert got == [("vi ét", "một"), ("ji", "")]


@pytest.mark.parametrize(
    "number, want",
    [
        ("0", "không"), ("5", "năm"), ("10", "mười"), ("15", "mười lăm"), ("21", "hai mươi mốt"), ("105", "một trăm lẻ năm"), ("110", "một trăm mười"), ("1000", "một nghìn"),
        ("1005", "một nghìn không trăm lẻ năm"), ("1000000", "một triệu"), ("2000000001", "hai tỷ không trăm lẻ một"), ("1234567890123", "một hai ba bốn năm sáu bảy tám chín không một hai ba"),
    ],
)
def test_vietnamese_numbers(number, want):
    assert spell.number_vi(number) == want


def test_speakers(spark):
    assert spell.speak_vi("ngày 21/11/2024 lúc 08:05, 1.000.000 và 3,5 ở a.b1@x.com") == (
        "ngày ngày hai mươi mốt tháng mười một năm hai nghìn không trăm hai mươi bốn lúc tám giờ năm phút , một triệu và ba phảy năm ở a chấm b một a còng x chấm com"
    )
    assert spell.dollars_en("5.5") == " 5 dollars, 5 cents " and spell.dollars_en("1") == " 1 dollar "
    assert [spell.year_en(n) for n in (2000, 2005, 1900, 1905, 1987)] == ["two thousand", "two thousand five", "nineteen hundred", "nineteen oh five", "nineteen eighty-seven"]
    assert spell.ordinal_en(115) == "one hundred and fifteenth" and spell.fraction_en(115, 7) == "one hundred and fifteen seventh"
    assert spell.number_en(1_002_115) == "one million two thousand one hundred fifteen"
    frame = spark.createDataFrame([("7",), (None,)], "text string")
    assert [r[0] for r in frame.select(spell.speak(F.col("text"), "vi")).collect()] == ["bảy", None]
    assert [r[0] for r in spark.createDataFrame([("New York is new.",)], "text string").select(spell.replace_words(F.col("text"), [("new", "mới"), ("new york", "NY")])).collect()] == ["NY is mới."]


def test_ordinals_fractions_and_numerals():
    assert [spell.ordinal_en(n) for n in (1, 2, 3, 5, 12, 20, 21, 100)] == ["first", "second", "third", "fifth", "twelfth", "twentieth", "twenty-first", "one hundredth"]
    assert [spell.fraction_en(*x) for x in ((1, 2), (3, 2), (1, 4), (3, 4), (2, 3))] == ["one half", "three halves", "one quarter", "three quarters", "two third"]
    assert spell.speak_en("the 21st of 3/4 and 1987") == "the twenty-first of three quarters and nineteen eighty-seven"
    assert [spell.roman(x) for x in ("I", "iv", "IX", "XIV", "XXXIX", "IIII", "VX")] == [1, 4, 9, 14, 39, 0, 0]
    assert spell.speak_vi("thế kỷ XXI, 2 x 3 và 2020-2024, U23.") == "thế kỷ hai mươi mốt, hai nhân ba và hai nghìn không trăm hai mươi đến hai nghìn không trăm hai mươi bốn , U hai mươi ba ."


def test_steps_take_time_by_their_matches(spark):
    """What is rare is looked for first: signs, line ends and dashes cost little where there are none."""
    import time

    texts = spark.range(40).select(F.expr("repeat('mot hai ba, bon nam. ', 20000)").alias("t")).cache()
    texts.count()

    def plain(t):
        for sign, _ in X.VERBATIM:
            t = X.sub(t, rf"\{sign}", " ")
        return X.strip(t)

    took = []
    for step in (plain, X.verbatim_symbols):
        runs = []
        for _ in range(3):
            begin = time.perf_counter()
            texts.select(F.sum(F.char_length(step(F.col("t"))))).first()
            runs.append(time.perf_counter() - begin)
        took.append(min(runs))
    texts.unpersist()
    assert took[1] < 2.5 * took[0], took

"""Word errors of two speakers, and marked words in texts."""

import random

from pyspark.sql import functions as F

from lexiloom.functions import metrics as M, text as X


def test_word_distance_is_the_number_of_edits(spark):
    rnd = random.Random(3)
    some = lambda: " ".join(rnd.choices("a b c dd é 你".split(), k=rnd.randint(0, 12)))
    rows = [(some(), some()) for _ in range(150)] + [(None, "a b"), (None, None), ("", " "), (" a  b ", "a\nb")]
    many = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(1500)) for _ in range(2)]
    df = spark.createDataFrame([*rows, ("x " + many[0], many[0])], "r string, h string")
    for r in df.select("r", "h", M.word_distance(F.col("r"), F.col("h")).alias("d")).collect()[:-1]:
        assert r.d == sum(M.edit_counts((r.r or "").split(), (r.h or "").split())), r
    assert df.select(M.word_distance(F.col("r"), F.col("h")).alias("d")).collect()[-1].d == 1


def test_speakers_in_the_better_order(spark):
    rows = [
        ("[S1] a b [S2] c d", "[S1] c d [S2] a b"),
        ("[S1] a b [S2] c d", "[S1] a b [S2] c"),
        ("[S1] a [S2] a", "[S1] a [S2] a"),
        ("[S1] a [S2] b [S1] c", "[S1] a [S2] x [S1] c"),
        ("no marks", None),
    ]
    df = spark.createDataFrame(rows, "r string, h string").select(M.cp_word_errors(F.col("r"), F.col("h")).alias("e")).select("e.*")
    got = [(r.errors, r.words, r.swapped) for r in df.collect()]
    # straight and crossed tie where both speakers say the same: swapped
    assert got == [(0, 4, True), (1, 4, False), (0, 2, True), (1, 3, False), (2, 3, True)]
    counts = df.select(M.word_errors(F.col("reference"), F.col("hypothesis")).alias("c"), "errors").select("c.*", "errors").collect()
    assert all(r.substitutions + r.deletions + r.insertions == r.errors for r in counts)


def test_marked_words(spark):
    cases = {
        "Kiểm tra 【A】 【I】, Hà Nội.": ([("Kiểm tra", False), ("A I", True), (", Hà Nội.", False)],) * 2,
        "【A】, 【B】. 【kây pi ai】 và 【C】": ([("A B kây pi ai.", True), ("và", False), ("C", True)], [("A B kây pi ai. và C", True)]),
        "một hai ba 【A】 bốn năm sáu 【B】": ([("một hai ba", False), ("A", True), ("bốn năm sáu", False), ("B", True)],) * 2,
        "【A】 x 【B】 y 【C】 z": ([("A", True), ("x", False), ("B", True), ("y", False), ("C", True), ("z", False)], [("A x B y C", True), ("z", False)]),
        "【1】 a 】 b": ([("1 a  b", False)],) * 2,
        "【A】【】【B】": ([("A", True), ("B", True)],) * 2,
        "  ": ([], []),
        "": ([], []),
        None: ([], []),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.marked_segments(F.col("t")).alias("s"))
    for r in df.select("t", "s", X.merged_segments(F.col("s")).alias("m")).collect():
        assert ([tuple(x) for x in r.s], [tuple(x) for x in r.m]) == tuple(cases[r.t]), r.t
    texts = spark.sql("select array(named_struct('text', 'a', 'is_bracket', false), named_struct('text', 'b c', 'is_bracket', false)) as s")
    assert [tuple(x) for x in texts.select(X.merged_segments(F.col("s"))).first()[0]] == [("a b c", False)]


def test_long_runs_of_marked_words(spark):
    text = F.expr("repeat('【một】, ', 100000)")
    row = spark.range(1).select(X.marked_segments(text).alias("s")).select(F.size("s").alias("n"), F.char_length(F.col("s")[0]["text"]).alias("chars"), F.col("s")[0]["is_bracket"].alias("run")).first()
    # the last mark follows the run's last word and stays in the text behind it
    assert tuple(row) == (2, 100000 * 4, True)

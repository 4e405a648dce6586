"""Metrics, array and number functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lexiloom.functions import arrays as X, metrics as M, text as T
from lexiloom.operators import aggregates as A
from lexiloom.plans.registry import query, table

_PAIRS = "p as (select a.vec_id, a.label, list_transform(a.embedding, lambda x: x::double) as x, list_transform(b.embedding, lambda x: x::double) as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)"
_VECS = "v as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    odd = vecs.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return vecs.where("vec_id % 2 = 0").join(odd, "vec_id")


def _vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(f"with {_PAIRS} select vec_id, round(list_cosine_similarity(x, y), 6) as score from p")
def sim_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(X.cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"with {_PAIRS} select label, count(*) as n, round(avg(list_cosine_similarity(x, y)), 6) as mean from p group by 1")
def sim_o_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(X.cosine(F.col("x"), F.col("y"))), 6).alias("mean"))


@query(
    """
    with v as (select vec_id // 4 as q, vec_id % 4 as k, list_transform(embedding, lambda x: x::double) as x from embeddings),
    c as (select q, max(x) filter (k = 0) as a, max(x) filter (k = 1) as b, max(x) filter (k = 2) as c, max(x) filter (k = 3) as d from v group by 1 having count(*) = 4)
    select q, round(greatest(list_cosine_similarity(a, c) + list_cosine_similarity(b, d), list_cosine_similarity(a, d) + list_cosine_similarity(b, c)) / 2, 6) as score,
           case when list_cosine_similarity(a, c) + list_cosine_similarity(b, d) < list_cosine_similarity(a, d) + list_cosine_similarity(b, c) then 'crossed' else 'straight' end as pairing from c
    """
)
def cp_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts (places 0, 1) and outputs (2, 3) of each four vectors, under the better of two pairings."""
    four = _vecs(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("q")).agg(*[F.max_by("x", F.col("vec_id") % 4 == k).alias(c) for k, c in enumerate("abcd")], F.count("*").alias("n")).where("n = 4")
    cos = lambda x, y: X.cosine(F.col(x), F.col(y))
    both = four.select("q", (cos("a", "c") + cos("b", "d")).alias("s"), (cos("a", "d") + cos("b", "c")).alias("t"))
    return both.select("q", F.round(M.best_permutation(F.col("s"), F.col("t")), 6).alias("score"), F.when(F.col("s") < F.col("t"), "crossed").otherwise("straight").alias("pairing"))


_TURNS = "t as (select a.conv_id, a.turn, regexp_replace(lower(a.text), '[^a-z ]', '', 'g') as r, regexp_replace(lower(b.text), '[^a-z ]', '', 'g') as h from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as reference, the next as hypothesis."""
    clean = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", clean.alias("c"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("h"))
    return turns.select("conv_id", "turn", F.col("c").alias("r")).join(after, ["conv_id", "turn"])


@query(f"with {_TURNS} select conv_id, turn, levenshtein(r, h) as distance, round(levenshtein(r, h) / length(r), 6) as rate from t where length(r) > 0")
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).where(F.char_length("r") > 0)
    return turns.select("conv_id", "turn", F.levenshtein("r", "h").cast("long").alias("distance"), F.round(M.char_error_rate(F.col("r"), F.col("h")), 6).alias("rate"))


@query()
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions and insertions of each turn; checked against brute force in the tests."""
    turns = _turns(spark, sf_dir).withColumn("e", M.word_errors(F.col("r"), F.col("h"))).withColumn("words", M.word_count(F.col("r")))
    return turns.select("conv_id", "turn", "e.*", "words", F.round((F.col("e.substitutions") + F.col("e.deletions") + F.col("e.insertions")) / F.col("words"), 6).alias("rate"))


_DIALOGUES = f"{_TURNS}, d as (select conv_id, turn, len(list_filter(string_split(r || ' ' || h, ' '), lambda w: w in ('and', 'the'))) as errors, len(string_split(regexp_replace('[S1] ' || trim(h) || ' [S2] ' || trim(r), ' +', ' ', 'g'), ' ')) - 2 as words from t where turn % 2 = 0)"


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns as a dialogue; its hypothesis lacks two words throughout, and every other one has the speakers swapped."""
    turns = _turns(spark, sf_dir).where(F.col("turn") % 2 == 0)
    less = lambda c: F.regexp_replace(c, r"\b(and|the)\b", "")
    marked = lambda a, b: F.concat(F.lit("[S1] "), a, F.lit(" [S2] "), b)
    said = F.when(F.col("conv_id") % 2 == 0, marked(less("r"), less("h"))).otherwise(marked(less("h"), less("r")))
    return turns.select("conv_id", "turn", M.cp_word_errors(marked(F.col("r"), F.col("h")), said).alias("e"))


@query(f"with {_DIALOGUES} select conv_id, turn, errors::bigint as errors, words::bigint as words, round(errors / words, 6) as rate from d")
def cp_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed words are the errors under the right order of speakers, and no order has fewer."""
    out = _dialogues(spark, sf_dir).select("conv_id", "turn", F.col("e.errors").cast("long").alias("errors"), F.col("e.words").cast("long").alias("words"))
    return out.withColumn("rate", F.round(F.col("errors") / F.col("words"), 6))


@query(f"with {_DIALOGUES} select round(sum(errors) / sum(words) * 100, 2) as rate, sum(errors)::bigint as errors, sum(words)::bigint as words from d")
def cp_corpus_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, words = F.sum("e.errors"), F.sum("e.words")
    return _dialogues(spark, sf_dir).agg(F.round(errors / words * 100, 2).alias("rate"), errors.alias("errors"), words.alias("words"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns as a dialogue of at most 1,500 characters, with asides and marks; its hypothesis lacks some words, has others changed, and every other one has the speakers swapped."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("r"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("h"))
    pairs = turns.join(after, ["conv_id", "turn"]).where("turn % 2 = 0 and char_length(r) + char_length(h) <= 1500")
    heard = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\b[a-z]{4}\b", ""), r"(?U)\b([a-z])([a-z]{6})\b", "$2$1 $1")
    marked = lambda a, b: F.concat(F.lit("[S1] (laughs) "), a, F.lit(" [S2] <noise> "), b)
    said = F.when(F.col("conv_id") % 2 == 0, marked(heard("r"), heard("h"))).otherwise(marked(heard("h"), heard("r")))
    rows = pairs.select("conv_id", "turn", M.cp_word_errors(marked(F.col("r"), F.col("h")), said, T.clean_for_dialog).alias("e"))
    return rows.withColumn("k", M.word_errors(F.col("e.reference"), F.col("e.hypothesis")))


@query()
def cp_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of errors under the better order of speakers, after each speaker's words are cleaned. A plain twin is in the tests."""
    rows = _kinds(spark, sf_dir)
    return rows.select("conv_id", "turn", F.col("e.swapped").alias("swapped"), F.col("e.words").alias("words"), "k.substitutions", "k.deletions", "k.insertions")


@query()
def cp_error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' rate and its kinds of errors. A plain twin is in the tests."""
    kinds = ("substitutions", "deletions", "insertions")
    totals = _kinds(spark, sf_dir).agg(*(F.sum(f"k.{k}").alias(k) for k in kinds), F.sum("e.words").cast("long").alias("words"))
    return totals.withColumn("rate", F.round(sum(F.col(k) for k in kinds) / F.col("words") * 100, 2))


@query(
    f"""with {_VECS}, r as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) as l from v),
    u as (select vec_id, l, list_transform(x, lambda v: greatest(least(v * 16 * case when l * 16 < 2.5 then 2.5 / (l * 16) else 1 end, 1.0), -1.0)) as y, l * 16 as m from r)
    select vec_id, round(list_sum(list_transform(y, lambda v: abs(v * case when m < 2.5 then m / 2.5 else 1 end))), 6) as total, round(list_max(y), 6) as peak from u"""
)
def volume_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves raised to a level, clamped, and scaled back to their own."""
    waves = _vecs(spark, sf_dir).select("vec_id", F.transform("x", lambda v: v * 16).alias("w"))
    rows = waves.select("vec_id", X.rms(F.col("w")).alias("level"), X.raise_level(F.col("w"), 2.5).alias("raised"))
    back = rows.select("vec_id", X.restore_level(F.col("raised"), F.col("level"), 2.5).alias("back"), F.array_max(F.transform("raised", lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)))).alias("peak"))
    return back.select("vec_id", F.round(F.aggregate("back", F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("total"), F.round("peak", 6).alias("peak"))


@query(
    f"with {_VECS} select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] + b.x[k]) / 2)), 6) as mixed, round(a.x[1], 6) as first_left, round(b.x[64], 6) as last_right, 0.0::double as bed, round(list_sum(a.x[1:32]), 6) as first_half, round(list_sum(a.x[33:64]), 6) as second_half from v a join v b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0"
)
def prompt_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prompts mixed, put one after another in channels of their own, and cut by channels."""
    waves = _vecs(spark, sf_dir)
    pairs = waves.where("vec_id % 2 = 0").join(waves.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    made = pairs.select("vec_id", "x", X.mix_channels(F.col("x"), F.col("y")).alias("m"), X.one_after_another(F.col("x"), F.col("y")).alias("c"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 6)
    bed = F.aggregate(F.concat(F.slice(F.col("c")[0], 65, 64), F.slice(F.col("c")[1], 1, 64)), F.lit(0.0), lambda s, v: s + F.abs(v))
    return made.select("vec_id", total(F.col("m")).alias("mixed"), F.round(F.col("c")[0][0], 6).alias("first_left"), F.round(F.col("c")[1][127], 6).alias("last_right"), bed.alias("bed"), total(X.channel(F.col("x"), 32)).alias("first_half"), total(X.channel(F.col("x"), 32, True)).alias("second_half"))


@query(f"with {_VECS}, r as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) as l from v) select vec_id, round(l, 6) as level, round(sqrt(list_sum(list_transform(x, lambda v: pow(v * case when l < 0.125 then 0.125 / l else 1 end, 2))) / 64), 6) as raised, round(list_max(list_transform(x, lambda v: v * case when l < 0.125 then 0.125 / l else 1 end)), 6) as peak from r")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _vecs(spark, sf_dir).select("vec_id", X.rms(F.col("x")).alias("level"), X.raise_level(F.col("x"), 0.125).alias("y"))
    return out.select("vec_id", F.round("level", 6).alias("level"), F.round(X.rms(F.col("y")), 6).alias("raised"), F.round(F.array_max("y"), 6).alias("peak"))


@query(f"with {_VECS} select vec_id, list_sum(list_transform(x, lambda v: greatest(least(round(v * 32768), 32767), -32768)::int))::bigint as total, list_max(list_transform(x, lambda v: greatest(least(round(v * 32768), 32767), -32768)::int)) as peak from v")
def int16_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _vecs(spark, sf_dir).select("vec_id", X.to_int16(F.col("x")).alias("y"))
    return out.select("vec_id", F.aggregate("y", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("y").alias("peak"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform(range(0, l_quantity::int), lambda f: case when l_quantity::int // l_linenumber > 0 then least(f // greatest(l_quantity::int // l_linenumber, 1), l_linenumber) else l_linenumber end), ',') as positions from lineitem")
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity as frames, line number as tokens."""
    at = X.token_positions(F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(at.cast("array<string>"), ",").alias("positions"))


@query("with w as (select o_orderkey, o_orderkey % 9 as n, max(o_orderkey % 9) over (partition by o_custkey) as width from orders) select o_orderkey, array_to_string(list_transform(range(0, width), lambda p: case when p >= n then '1' else '0' end), '') as mask from w")
def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders are a batch, as wide as its longest."""
    mask = X.pad_mask(F.col("n"), F.col("width"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 9).alias("n"))
    orders = orders.withColumn("width", F.max("n").over(Window.partitionBy("o_custkey")))
    return orders.select("o_orderkey", F.array_join(F.transform(mask, lambda b: F.when(b, "1").otherwise("0")), "").alias("mask"))


@query("select o_orderkey, round(list_sum(list_transform(range(0, 9), lambda k: (k + 1) * 0.5 * (k / 8.0) / (1 - 0.5 * (k / 8.0)))) * o_totalprice, 3) as weighted from orders")
def time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(X.time_steps(8, 0.5), lambda t, k: t * (k + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X.total(steps) * F.col("o_totalprice"), 3).alias("weighted"))


@query("select event_id, round(0.02 * pow((event_id * event_id + 7500.0 * 7500.0) / (7500.0 * 7500.0), -0.25) * pow((user_id * user_id + 10.0 * 10.0) / (10.0 * 10.0), -0.25) * case when event_id >= 500 then 1 else 0.5 + 0.5 * event_id / 500.0 end, 8) as rate, round(event_id * (200.0 * 4) / 600.0, 6) as adjusted from events")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = X.eden_rate(0.02, F.col("event_id").cast("double"), F.col("user_id").cast("double"), 7500.0, 10.0, 500.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(rate, 8).alias("rate"), F.round(X.adjusted_batches(F.col("event_id"), 200.0, 4, 600.0), 6).alias("adjusted"))


@query("select event_id, round(greatest(value / 10, 3) + ln(1 + exp(-abs(value / 10 - 3))), 6) as logadd, round(greatest(0, value / 10 - 4) + ln(1 + exp(-abs(value / 10 - 4))) - 0.08 * value / 10 - 0.035, 6) as swoosh_l, round(greatest(0, value / 10 - 1) + ln(1 + exp(-abs(value / 10 - 1))) - 0.08 * value / 10 - 0.313261687, 6) as swoosh_r from events")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 10
    return table(spark, sf_dir, "events").select("event_id", F.round(X.log_add_exp(x, F.lit(3.0)), 6).alias("logadd"), F.round(X.swoosh_l(x), 6).alias("swoosh_l"), F.round(X.swoosh_r(x), 6).alias("swoosh_r"))


@query(f"with {_VECS}, e as (select vec_id, list_transform(x, lambda v: exp(v - list_max(x))) as w from v) select vec_id, round(list_max(w) / list_sum(w), 8) as top, round(list_min(w) / list_sum(w), 8) as low from e")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _vecs(spark, sf_dir).select("vec_id", A.softmax(F.col("x")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 8).alias("top"), F.round(F.array_min("p"), 8).alias("low"))


@query("select event_id, round(list_sum(list_transform(range(0, 8), lambda k: (k + 1) * cos(value * exp(-ln(10000.0) * k / 8)) + (k + 9) * sin(value * exp(-ln(10000.0) * k / 8)))), 5) as code from events")
def timestep_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.transform(X.timestep_embedding(F.col("value"), 16), lambda v, k: v * (k + 1))
    return table(spark, sf_dir, "events").select("event_id", F.round(X.total(code), 5).alias("code"))


@query(f"with {_VECS} select vec_id, 22 as n, round(list_sum(list_transform(range(0, 22), lambda g: (g + 1) * (0.5 * x[g * 3 + 1] + 0.3 * x[least(g * 3 + 2, 64)] + 0.2 * x[least(g * 3 + 3, 64)]))), 6) as weighted from v")
def down_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = _vecs(spark, sf_dir).select("vec_id", X.down_sample(F.col("x"), [0.5, 0.3, 0.2]).alias("y"))
    return y.select("vec_id", F.size("y").alias("n"), F.round(X.total(F.transform("y", lambda v, k: v * (k + 1))), 6).alias("weighted"))


@query(f"with {_PAIRS} select vec_id, round(list_sum(list_transform(range(1, 65), lambda k: k * (x[k] * 0.25 + y[k] * 0.75))), 6) as mixed, round(list_sum(list_transform(range(1, 65), lambda k: k * (x[k] - y[k]))), 6) as flow from p")
def flow_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    xt, ut = X.flow_targets(F.col("x"), F.col("y"), F.lit(0.25))
    weigh = lambda c: F.round(X.total(F.transform(c, lambda v, k: v * (k + 1))), 6)
    return _pairs(spark, sf_dir).select("vec_id", weigh(xt).alias("mixed"), weigh(ut).alias("flow"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity + ceil(l_quantity * l_linenumber / (8 * 1.25)))::bigint as frames, trunc((60 - l_quantity) / (l_quantity / (8 * 1.25)))::int as max_tokens from lineitem")
def duration_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.duration_by_ratio(q, F.lit(8), k, 1.25).cast("long").alias("frames"), X.max_tokens(q, F.lit(8), 1.25, 60.0).alias("max_tokens")
    )


@query("select user_id, count(*) as n, round(avg(value / 100) * 2 + 3, 6) as mos from events group by 1")
def mos_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(M.mos(F.avg(F.col("value") / 100)), 6).alias("mos"))

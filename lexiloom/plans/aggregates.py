"""Metrics and diagnostics over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.operators import aggregates as A
from lexiloom.plans.registry import query, table


@query("select l_returnflag, round(sum(l_discount * 100) / sum(l_quantity) * 100, 2) as micro, round(avg(l_discount * 100 / l_quantity) * 100, 2) as macro, count(*) as n from lineitem group by 1")
def macro_micro_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, words = F.col("l_discount") * 100, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.micro_rate(errors, words).alias("micro"), A.macro_rate(errors, words).alias("macro"), F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, sum(case when l_linenumber <= 2 then 1 else 0 end)::bigint as substitutions, sum(case when l_linenumber between 3 and 4 then 1 else 0 end)::bigint as deletions, sum(case when l_linenumber > 4 then 1 else 0 end)::bigint as insertions, sum(l_linenumber)::bigint as words from lineitem group by 1, 2")
def error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    count = lambda c: F.sum(c.cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        count(k <= 2).alias("substitutions"), count(k.between(3, 4)).alias("deletions"), count(k > 4).alias("insertions"), F.sum(k).alias("words")
    )


@query("select event_type, round(sum(value) / sum(user_id + 1), 6) as rtf from events group by 1")
def rtf_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(A.ratio_of_sums(F.col("value"), F.col("user_id") + 1), 6).alias("rtf"))


@query("select event_type, round(sum(value) filter (user_id % 7 <> 0), 4) as total, (sum(user_id) filter (user_id % 7 <> 0))::bigint as frames, round(sum(value) filter (user_id % 7 <> 0) / sum(user_id) filter (user_id % 7 <> 0), 6) as per_frame from events group by 1")
def frame_weighted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users divisible by seven report no number at all."""
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("user_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    out = A.merged_metrics(rows, "event_type", "value", "user_id")
    return out.select("event_type", F.round("total", 4).alias("total"), "frames", F.round("per_frame", 6).alias("per_frame"))


@query("select c_mktsegment, arg_min(c_custkey, (c_acctbal, c_custkey)) as best, round(min(c_acctbal), 2) as loss from customer group by 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best"), F.round(F.min("c_acctbal"), 2).alias("loss"))


@query("select lang, array_to_string(list_sort(list(distinct source)), ',') as sources, arg_max(source, doc_id) as last_source from documents group by 1")
def distinct_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max_by("source", "doc_id").alias("last_source"))


@query(
    """
    with c as (select d - 1 as dim, embedding[d]::double as x from embeddings, range(1, 65) t(d)),
    s as (select dim, sum(abs(x)) as sum_abs, count(*) filter (x > 0) as n_positive, sum(x * x) as sum_sq, sum(x) as sum_x, max(x) as max_x, min(x) as min_x, count(*) as n from c group by 1)
    select dim::int as dim, round(sum_abs, 6) as sum_abs, n_positive, round(sum_sq, 6) as sum_sq, round(sum_x, 6) as sum_x, round(max_x, 6) as max_x, round(min_x, 6) as min_x, n,
           round(sqrt((sum_sq - sum_x * sum_x / n) / n), 6) as stddev, round(sqrt(sum_sq), 6) as norm, round(sqrt(sum_sq / n), 6) as rms from s
    """
)
def tensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.tensor_stats(A.elements(table(spark, sf_dir, "embeddings"), "embedding"))
    return out.withColumns({c: F.round(c, 6) for c in ("sum_abs", "sum_sq", "sum_x", "max_x", "min_x", "stddev", "norm", "rms")})


@query(
    """
    select (i - 1)::int as i, (j - 1)::int as j, round(sum(embedding[i]::double * embedding[j]::double), 6) as total
    from embeddings, range(1, 65) a(i), range(1, 65) b(j) where i <= j group by 1, 2
    """
)
def second_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.second_moments(table(spark, sf_dir, "embeddings"), "embedding").withColumn("total", F.round("total", 6))


@query(
    """
    with m as (select i, j, sum(embedding[i]::double * embedding[j]::double) as t from embeddings, range(1, 65) a(i), range(1, 65) b(j) group by 1, 2)
    select round(sum(t * t) * 64 / pow(sum(t) filter (i = j), 2), 4) as metric from m
    """
)
def whitening_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.whitening(A.second_moments(table(spark, sf_dir, "embeddings"), "embedding")).select(F.round("metric", 4).alias("metric"))


@query(
    """
    with s as (select user_id, list_sort(list(value)) as v, count(*) as n from events group by 1)
    select user_id, i::int as tenth, v[least(i * n // 10, n - 1) + 1] as by_floor, v[i * (n - 1) // 10 + 1] as by_rank from s, range(0, 11) t(i)
    """
)
def percentile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tenths(table(spark, sf_dir, "events"), "user_id", "value")


_HISTOGRAM = """
    t as (select quantile_cont(abs(value - 50), 0.98) / 256 as tick from events),
    h as (select least(greatest(trunc((value - 50) / tick)::bigint, -256), 255) as bucket, count(*) as n, sum(user_id) as sum_g, sum(user_id * user_id) as sum_g2, sum(abs(user_id)) as sum_abs_g from events, t group by 1)
"""


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("value") - 50).alias("x"), F.col("user_id").alias("g"))
    return A.clipped_histogram(rows, "x", "g")


@query(f"with {_HISTOGRAM} select bucket, n, sum_g::bigint as sum_g, sum_g2::bigint as sum_g2, sum_abs_g::bigint as sum_abs_g from h")
def histogram_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


@query(f"with {_HISTOGRAM}, c as (select *, sum(n) over (order by bucket) as upto, sum(n) over () as total from h) select ((upto - 1) // (total // 20 + 1))::bigint as bin, min(bucket) as first_bucket, max(bucket) as last_bucket, sum(n)::bigint as n from c group by 1")
def rebin_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.equal_count_bins(_histogram(spark, sf_dir))


@query("select vec_id, round(list_avg(list_transform(embedding, lambda x: abs(x::double))), 6) as energy, round(quantile_cont(x, 0.5), 6) as median from (select vec_id, embedding, unnest(embedding)::double as x from embeddings) group by vec_id, embedding")
def median_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute value and median of each vector, from the vector itself."""
    x = F.array_sort(F.col("embedding").cast("array<double>"))
    n = F.size(x)
    at = lambda k: F.element_at(x, k.cast("int"))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2
    energy = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)) / n
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(energy, 6).alias("energy"), F.round(median, 6).alias("median"))


@query("select a.user_id, round(sum(case when a.v > 40 and b.v > 40 then (a.v - 40) * (b.v - 40) else 0 end), 7) as penalty from (select user_id, date_trunc('day', ts) as d, avg(value) as v from events where event_type = 'click' group by 1, 2) a join (select user_id, date_trunc('day', ts) as d, avg(value) as v from events where event_type = 'view' group by 1, 2) b using (user_id, d) group by 1")
def overlap_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")
    )
    both = days.where("a is not null and b is not null")
    over = F.when((F.col("a") > 40) & (F.col("b") > 40), (F.col("a") - 40) * (F.col("b") - 40)).otherwise(0.0)
    return both.groupBy("user_id").agg(F.round(F.sum(over), 7).alias("penalty"))


@query("with p as (select user_id, event_type, sum(value * value) as s from events group by 1, 2) select user_id, arg_max(event_type, (s, event_type)) as key, round(max(s) / sum(s), 6) as share from p group by 1")
def dominant_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dominant(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumn("share", F.round("share", 6))


@query("select l_returnflag, round(avg(pow(l_quantity - l_linenumber, 2)) filter (l_linestatus = 'F'), 6) as mse from lineitem group by 1")
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("l_quantity") - F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("l_linestatus") == "F", gap * gap)), 6).alias("mse"))


@query(
    """
    with e as (select vec_id, exp(embedding[d]::double - list_max(embedding)::double) as w from embeddings, range(1, 65) t(d)),
    p as (select vec_id, w / sum(w) over (partition by vec_id) as p from e)
    select vec_id, round(-sum(p * ln(p + 1e-20)), 6) as entropy from p group by 1
    """
)
def attention_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.softmax(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.entropy(p), 6).alias("entropy"))


@query("select user_id, round(sum(exp(-value / 100) * value) / sum(exp(-value / 100)), 5) as mean, round(sqrt(greatest(sum(exp(-value / 100) * value * value) / sum(exp(-value / 100)) - pow(sum(exp(-value / 100) * value) / sum(exp(-value / 100)), 2), 1e-9)), 5) as std from events group by 1")
def attentive_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, std = A.weighted_mean_std(F.exp(-F.col("value") / 100), F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(mean, 5).alias("mean"), F.round(std, 5).alias("std"))


@query("select source, count(*) as n, sum(n_chars)::bigint as total, arg_max(doc_id, (n_chars, doc_id)) as longest, arg_max(doc_id, (length(text) - length(replace(text, ' ', '')), doc_id)) as most_words from documents group by 1")
def pessimistic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each source that are largest by one criterion each."""
    spaces = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest"), F.max_by("doc_id", F.struct(spaces, "doc_id")).alias("most_words")
    )

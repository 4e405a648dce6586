"""Piecewise functions, clipping, masks, running averages and principal moments over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.operators import piecewise as P, training as T
from lexiloom.plans.registry import query, table

_FUNCTIONS = """
f as (select o_custkey as key, (o_orderkey % 97)::double as x, max(o_totalprice) as y from orders where o_orderkey % 2 = 0 group by 1, 2),
g as (select o_custkey as key, (o_orderkey % 89)::double as x, max(o_totalprice) as y from orders where o_orderkey % 2 = 1 group by 1, 2),
b as (select key, x from f union select key, x from g),
k as (select key from f intersect select key from g),
v as (
  select key, b.x,
    (select max_by(p.y, p.x) from f p where p.key = b.key and p.x <= b.x) as fy0, (select max(p.x) from f p where p.key = b.key and p.x <= b.x) as fx0,
    (select min_by(p.y, p.x) from f p where p.key = b.key and p.x >= b.x) as fy1, (select min(p.x) from f p where p.key = b.key and p.x >= b.x) as fx1,
    (select max_by(p.y, p.x) from g p where p.key = b.key and p.x <= b.x) as gy0, (select max(p.x) from g p where p.key = b.key and p.x <= b.x) as gx0,
    (select min_by(p.y, p.x) from g p where p.key = b.key and p.x >= b.x) as gy1, (select min(p.x) from g p where p.key = b.key and p.x >= b.x) as gx1
  from b join k using (key)
),
w as (
  select key, x,
    case when fx0 is null then fy1 when fx1 is null or fx0 = fx1 then fy0 else fy0 + (fy1 - fy0) * (x - fx0) / (fx1 - fx0) end as f,
    case when gx0 is null then gy1 when gx1 is null or gx0 = gx1 then gy0 else gy0 + (gy1 - gy0) * (x - gx0) / (gx1 - gx0) end as g
  from v
),
l as (select *, lead(x) over o as nx, lead(f) over o as nf, lead(g) over o as ng from w window o as (partition by key order by x)),
c as (select key, x + abs(f - g) / (abs(f - g) + abs(nf - ng)) * (nx - x) as cx, x, f, g, nx, nf, ng from l where nx is not null and (f > g) <> (nf > ng)),
z as (select key, x, f, g from w union all select key, cx, f + (nf - f) * (cx - x) / (nx - x), g + (ng - g) * (cx - x) / (nx - x) from c where cx > x and cx < nx)
"""


@query(
    f"""with {_FUNCTIONS} select key, how, round(x, 5) as x, round(y + 0.0001, 2) as y from (
    select key, 'sum' as how, x, f + g as y from w union all select key, 'product', x, f / 1000 * g / 1000 from w
    union all select key, 'max', x, greatest(f, g) from z union all select key, 'min', x, least(f, g) from z)"""
)
def piecewise_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, product, maximum and minimum of two functions of each customer: the prices of even and of odd orders."""
    orders = table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    side = lambda odd, n: orders.where(F.col("o_orderkey") % 2 == odd).select("key", (F.col("o_orderkey") % n).cast("double").alias("x"), F.col("o_totalprice").alias("y")).groupBy("key", "x").agg(F.max("y").alias("y"))
    f, g = side(0, 97), side(1, 89)
    thousands = lambda h: P.scaled(h, 1 / 1000)
    made = [P.combined(thousands(f), thousands(g), how) if how == "product" else P.combined(f, g, how) for how in ("sum", "product", "max", "min")]
    all_ = reduce(DataFrame.unionByName, [m.withColumn("how", F.lit(how)) for m, how in zip(made, ("sum", "product", "max", "min"))])
    # prices have two digits, so values halfway between two of them are common; the shift keeps rounding apart from that
    return all_.select("key", "how", F.round("x", 5).alias("x"), F.round(F.col("y") + 0.0001, 2).alias("y"))


@query(
    """
    with e as (select user_id, value as v, row_number() over (partition by user_id order by ts, event_id) - 1 as s from events),
    h as (select *, list(v) over (partition by user_id order by s rows between 49 preceding and current row) as last from e),
    m as (
      select user_id, s as step, list_sort(case when s % 50 = 0 then last else list_slice(last, -s, -1) end) as v, case when s % 50 = 0 then 1.0 else 2.0 end as larger
      from h where s > 0 and (s % 50 = 0 or s in (10, 20, 40))
    ),
    q as (select user_id, step, len(v) as n, 2.0 * v[least(len(v), len(v) // 4 * 2 + 1)] * larger as threshold, v from m),
    r as (select *, lag(step) over o as since, lag(threshold) over o as held from q window o as (partition by user_id order by step))
    select user_id, step, v[1] as q0, v[least(n, n // 4 + 1)] as q1, v[least(n, n // 4 * 2 + 1)] as q2, v[least(n, n // 4 * 3 + 1)] as q3, v[least(n, n // 4 * 4 + 1)] as q4,
           threshold, coalesce((select count(*) from e where e.user_id = r.user_id and e.s >= since and e.s < step and e.v > held), 0) * 100.0 / n as percent_clipped, n::int as n
    from r
    """
)
def clip_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from each user's event values, numbered by time."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    norms = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(by) - 1).alias("step"), "value")
    return T.clip_thresholds(norms, "user_id", "step", "value", period=50)


_DRAWN = "list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(md5('7:' || doc_id || ':{0}'), i, 1)) - 1) * power(16, 8 - i))) / 4294967296.0"


@query(
    f"""
    with l as (select doc_id, n_chars % 500 as n from documents),
    s as (select *, floor((0.7 + {_DRAWN.format(0)} * (1.0 - 0.7)) * n)::bigint as size from l),
    p as (select *, floor({_DRAWN.format(1)} * (n - size))::bigint as start from s)
    select doc_id, start, start + size as stop, n - size as suffix_start, size as n_masked, (n > 0 and start = 0 and size > 0) as first_masked from p
    """
)
def condition_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between 70 and 100 % of each document's places, anywhere and at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 500).alias("n"))
    span = lambda suffix: T.condition_span(F.col("n"), F.col("doc_id"), 0.7, 1.0, 7, suffix)
    made = docs.withColumns({"span": span(False), "tail": span(True)}).withColumn("mask", T.span_mask(F.col("span"), F.col("n")))
    masked = F.size(F.filter("mask", lambda m: m)).cast("long")
    return made.select("doc_id", F.col("span.start").alias("start"), F.col("span.end").alias("stop"), F.col("tail.start").alias("suffix_start"), masked.alias("n_masked"), F.coalesce(F.try_element_at("mask", F.lit(1)), F.lit(False)).alias("first_masked"))


@query("select l_suppkey, l_orderkey, l_linenumber, sum((l_extendedprice * 100)::bigint) over w / count(*) over w as average from lineitem window w as (partition by l_suppkey order by l_orderkey range unbounded preceding)")
def running_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean price in cents of each supplier's lines up to each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return T.running_average(lines, "l_suppkey", "l_orderkey", "cents", width=512).select("l_suppkey", "l_orderkey", "l_linenumber", "average")


@query()
def moment_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of the embeddings' second moments, the largest first. A plain twin is in the tests."""
    n, total = T.moment_matrix(table(spark, sf_dir, "embeddings"), "embedding")
    values = T.jacobi_eigenvalues(total / max(n, 1))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").select("k", F.round("v", 6).alias("value"))

"""Manifests, listings and job views over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.operators import manifests as M
from lexiloom.plans.jobs import _FILES, _JOBS, _files, _states
from lexiloom.plans.registry import query, table


@query(
    """
    with r as (select o_orderkey as id, o_totalprice / 10000 as d from orders where o_orderkey % 5 <> 0),
    s as (select l_orderkey as rid, l_orderkey || '-' || l_linenumber || '-' || l_partkey as id, l_linenumber - 2 as a, l_quantity / 2 as n from lineitem where l_orderkey % 3 <> 1)
    select 'recording' as side, id::varchar as id, case when id not in (select rid from s) then 'no supervision' end as reason from r
    union all
    select 'supervision', s.id, case when r.id is null then 'no recording' when a < 0 or n <= 0 then 'bad times' when a + n > d + 1e-6 then 'beyond its recording' end
    from s left join r on r.id = rid
    """
)
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings, their lines as supervisions; some of each are missing."""
    recordings = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("recording_id"), (F.col("o_totalprice") / 10000).alias("duration"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 1")
    supervisions = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("recording_id"), (F.col("l_linenumber") - 2).alias("start"), (F.col("l_quantity") / 2).alias("duration"))
    return M.validation(recordings, supervisions)


@query(
    f"""
    with {_FILES}, n as (select regexp_extract(path, '/([^/]+)\\.mp3$', 1) as name, min(path) as path from f where path like '%.mp3' group by 1)
    select o_orderkey, path from orders left join n on name = o_orderkey::varchar
    """
)
def list_file_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of names beside a listing of files; names without a file keep a null path."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return M.with_files(rows, _files(spark, sf_dir), "o_orderkey", ".mp3")


@query("select doc_id, case when n_chars / 150.0 > 20 then 'too long' when n_chars / 150.0 > 10 then 'long' end as single, case when n_chars / 150.0 > 40 then 'too long' when n_chars / 150.0 > 20 then 'long' end as dialog, n_chars / 150.0 <= 30 as short_enough from documents")
def prompt_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's characters, 150 a second, as a prompt's length."""
    seconds = F.col("n_chars") / 150.0
    return table(spark, sf_dir, "documents").select("doc_id", M.prompt_warning(seconds).alias("single"), M.prompt_warning(seconds, "dialog").alias("dialog"), (seconds <= 30).alias("short_enough"))


@query("select label, count(*) as n, count(*) filter (vec_id % 7 = 3 or vec_id % 11 = 5) as bad from embeddings group by 1")
def not_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some embeddings get an element that is infinite or no number; the sum shows it."""
    odd = F.when(F.col("vec_id") % 7 == 3, F.lit(float("inf"))).when(F.col("vec_id") % 11 == 5, F.lit(float("nan"))).otherwise(F.lit(0.0))
    rows = table(spark, sf_dir, "embeddings").select("label", F.concat(F.col("embedding").cast("array<double>"), F.array(odd)).alias("x"))
    return M.not_finite(rows, "label", "x")


@query(
    """
    with t as (
      select l_returnflag as g, case l_linenumber % 3 when 0 then 'loss' when 1 then 'utt_loss' else 'other' end as key, l_quantity as value from lineitem
      union all select l_returnflag, 'frames', l_suppkey + 1 from lineitem union all select l_returnflag, 'utterances', 1 from lineitem where l_returnflag <> 'R'
    ), s as (select g, key, sum(value) * 0.5 as total from t group by 1, 2)
    select g, key, total, total / coalesce(case when key like '%utt!_%' escape '!' then (select total from s u where u.g = s.g and u.key = 'utterances') else (select total from s u where u.g = s.g and u.key = 'frames') end, 1) as mean
    from s where key not in ('frames', 'utterances')
    """
)
def metric_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trackers, merged, halved and normed; one has counted no utterances."""
    lines = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_returnflag"))
    kind = F.element_at(F.array(F.lit("loss"), F.lit("utt_loss"), F.lit("other")), F.col("l_linenumber") % 3 + 1)
    rows = lines.select("g", kind.alias("key"), F.col("l_quantity").cast("double").alias("value"))
    frames = lines.select("g", F.lit("frames").alias("key"), (F.col("l_suppkey") + 1).cast("double").alias("value"))
    spoken = lines.where("g <> 'R'").select("g", F.lit("utterances").alias("key"), F.lit(1.0).alias("value"))
    every = rows.unionByName(frames).unionByName(spoken)
    merged = M.merged_metrics(every.select(F.concat_ws("/", "g", "key").alias("key"), "value"), 0.5)
    parts = merged.select(F.substring_index("key", "/", 1).alias("g"), F.substring_index("key", "/", -1).alias("key"), "total")
    return M.normed_metrics(parts, ["g"])


@query("select p_partkey as name, (dense_rank() over (order by p_brand || '_' || p_size) - 1)::int as batch, (row_number() over (partition by p_brand || '_' || p_size order by p_partkey) - 1)::int as place, count(*) over (partition by p_brand || '_' || p_size) as size from part")
def shape_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and size are a batch."""
    return M.shape_batches(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_size")


@query(
    f"""
    with {_JOBS}, s as (select job, coalesce(arg_min(status, (ts, status)) filter (status in ('done', 'error')), arg_max(status, (ts, status))) as status, min(ts) as a, min(ts) filter (status in ('done', 'error')) as b from e group by 1)
    select job, case when status in ('queued', 'running') then 'cancelled' else status end as status, status in ('queued', 'running') as stopped,
           case when status = 'done' then '/files/' || job || case when job % 2 = 0 then '.mp3' else '.wav' end end as file, case when status = 'done' then '/v1/jobs/' || job || '/audio' end as audio,
           case when status = 'error' then 'job ' || job || ' failed' end as error, case when status = 'done' then (epoch_us(b) - epoch_us(a)) / 1e6 end as seconds
    from s
    """
)
def job_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients are told of each job after everything that waits or runs was cancelled."""
    job = F.col("job").cast("string")
    path = F.concat(F.lit("results/"), job, F.when(F.col("job") % 2 == 0, ".MP3").otherwise(".wav"))
    jobs = _states(spark, sf_dir).withColumns({"path": path, "error": F.concat(F.lit("job "), job, F.lit(" failed"))})
    stopped = M.cancel_all(jobs, F.lit(None).cast("timestamp"))
    return M.status_view(stopped).join(stopped.select("job", "stopped"), "job")


@query()
def silence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waves of 64 samples a second with quiet stretches, their silences cut. A plain twin is in the tests."""
    quiet = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(F.pmod(F.floor(i / (F.col("vec_id") % 9 + 2)), F.lit(2)) == 0, x).otherwise(x / 1000))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", M.without_silence(quiet, 64, 62, longest_ms=125, keep_ms=31, edge_ms=16, db=-40.0, step_ms=16).alias("w"))
    return rows.select("vec_id", F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))

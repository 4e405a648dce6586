"""Job states over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.operators import jobs as J
from lexiloom.plans.registry import query, table
from lexiloom.streaming.jobs import latest_states, stream_job_states, stream_table, work_folder
from lexiloom.streaming.queue import current_jobs, run_queue, write_progress

_STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'done' else 'error' end"
_JOBS = f"e as (select event_id // 4 as job, ts, {_STATUS} as status from events)"


def _status() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "done").otherwise("error")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each four events are one job's."""
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("job"), "ts", _status().alias("status"))
    return J.job_states(events, "job", "ts", "status")


@query(
    f"""
    with {_JOBS}, s as (select job, coalesce(arg_min(status, (ts, status)) filter (status in ('done', 'error')), arg_max(status, (ts, status))) as status, min(ts) as a, min(ts) filter (status in ('done', 'error')) as b from e group by 1)
    select job, status, epoch_us(a) as created_us, epoch_us(b) as finished_us, (epoch_us(b) - epoch_us(a)) / 1e6 as seconds, case status when 'error' then 400 when 'done' then 200 else 409 end as code from s
    """
)
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _states(spark, sf_dir)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jobs.select("job", "status", micros("created_at").alias("created_us"), micros("finished_at").alias("finished_us"), J.conversion_seconds(jobs).alias("seconds"), J.http_code(F.col("status")).alias("code"))


@query(
    f"""
    with {_JOBS}, s as (select job, arg_min(status, (ts, status)) filter (status in ('done', 'error')) as status, min(ts) filter (status in ('done', 'error')) as b from e group by 1), m as (select max(ts) as now from events)
    select status, count(*) as n from s, m where b is not null and epoch_us(now) - epoch_us(b) > 86400000000 group by 1
    """
)
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs that a clean-up at the time of the last event would drop."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("now"))
    jobs = _states(spark, sf_dir).where("finished_at is not null").join(F.broadcast(now))
    return jobs.where(J.expired(F.col("finished_at").cast("timestamp"), F.col("now"))).groupBy("status").agg(F.count("*").alias("n"))


@query("select conv_id, turn, case when turn = 1 or len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 2 then 0.4::double else 1.0::double end as speed, case when turn = 1 or len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 2 then 32 else 16 end as steps from conversations")
def segment_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", J.segment_settings(F.col("turn") == 1, F.col("text")).alias("s"))
    return turns.select("conv_id", "turn", "s.speed", "s.steps")


@query(
    f"""
    with {_JOBS}, s as (select job, coalesce(arg_min(status, (ts, status)) filter (status in ('done', 'error')), arg_max(status, (ts, status))) as status, min(ts) as a, min(ts) filter (status in ('done', 'error')) as b from e group by 1)
    select job, status, epoch_us(a) as created_us, epoch_us(b) as finished_us from s
    """
)
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from Structured Streaming over the event files."""
    events = stream_table(spark, sf_dir, "events")
    jobs = events.select(F.floor(F.col("event_id") / 4).alias("job"), "ts", _status().alias("status"))
    out = work_folder(spark, "job-states")
    stream_job_states(jobs, out, work_folder(spark, "stream"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return latest_states(spark, out).select("job", "status", micros("created_at").alias("created_us"), micros("finished_at").alias("finished_us"))


_QUEUE = """
with recursive e as (
  select event_id, epoch_ms(ts) as t0, event_type, value from events
), c as (
  select event_id - 2 as job, min(t0) as stop from e where event_type = 'error' group by 1
), j as (
  select (event_id // 64) % 4 as pool, event_id as job, t0, floor(value * 48000)::bigint as takes, coalesce(stop, 1::bigint << 61) as stop,
         row_number() over (partition by (event_id // 64) % 4 order by t0, event_id) as k
  from e left join c on c.job = e.event_id where event_type in ('signup', 'view')
), r as (
  select distinct pool, 0::bigint as k, 0::bigint as job, 0::bigint as t0, 0::bigint as stop, 0::bigint as start, 0::bigint as finish, 0::bigint as a, 0::bigint as b from j
  union all
  select pool, k, job, t0, stop, start, start + takes,
         case when stop <= start or a > b then a else least(start + takes, stop) end,
         case when stop <= start or a <= b then b else least(start + takes, stop) end
  from (select j.*, r.a, r.b, greatest(j.t0, least(r.a, r.b)) as start from r join j on j.pool = r.pool and j.k = r.k + 1)
), u as (
  select max(epoch_ms(ts)) - 1 as until from events where event_type in ('signup', 'view', 'error')
)
select pool, job,
       case when stop <= start and greatest(t0, stop) <= until then 'cancelled' when start > until then 'queued' when stop <= start then 'queued'
            when finish <= stop and finish <= until then 'done' when stop < finish and stop <= until then 'cancelled' else 'running' end as status
from r, u where k > 0
"""


@query(_QUEUE)
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's state after all events, from two streams in one stateful operator: four pools of two slots each."""
    events = lambda: stream_table(spark, sf_dir, "events")
    pool = lambda job: F.floor(job / 64) % 4
    job = F.col("event_id")
    submitted = events().where(F.col("event_type").isin("signup", "view")).select(pool(job).alias("pool"), job.alias("job"), "ts", F.floor(F.col("value") * 48000).alias("takes_ms"))
    stopped = events().where("event_type = 'error'").select(pool(job - 2).alias("pool"), (job - 2).alias("job"), "ts")
    out = work_folder(spark, "job-queue")
    write_progress(run_queue(submitted, stopped), out, work_folder(spark, "queue"))
    return current_jobs(spark, out).select("pool", "job", "status")


_FILES = "f as (select 'results/' || (event_id // 3) || case event_id % 5 when 0 then '.wav' when 1 then '.mp3' when 2 then '.txt' when 3 then '.mp3' else '.wav.part' end as path, ts as modified from events)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: each event is a file of a job's result, written at its time."""
    suffix = F.element_at(F.array(*map(F.lit, (".wav", ".mp3", ".txt", ".mp3", ".wav.part"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("results/"), F.floor(F.col("event_id") / 3).cast("string"), suffix).alias("path"), F.col("ts").alias("modified"))


@query(
    f"""
    with {_FILES}, m as (select max(ts) as now from events)
    select path, regexp_extract(path, '/(.+)\\.(wav|mp3)$', 1) as job, epoch_us(modified) as modified_us, epoch_us(now) - epoch_us(modified) > 7::bigint * 86400000000 as deleted
    from f, m where regexp_matches(path, '\\.(wav|mp3)$')
    """
)
def disk_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results a clean-up at the last event's time would delete, after seven days."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("now")).first().now
    plan = J.deletion_plan(_files(spark, sf_dir), F.lit(now), 7)
    return plan.select("path", "job", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified_us"), "deleted")


@query(
    f"""
    with {_FILES}, {_JOBS}, s as (select job, coalesce(arg_min(status, (ts, status)) filter (status in ('done', 'error')), arg_max(status, (ts, status))) as status, min(ts) as a, min(ts) filter (status in ('done', 'error')) as b from e group by 1),
    r as (select regexp_extract(path, '/(.+)\\.(wav|mp3)$', 1) as job, path, modified, path like '%.wav' as w from f where regexp_matches(path, '\\.(wav|mp3)$')),
    l as (select job, arg_max(path, (w, modified, path)) as path, arg_max(modified, (w, modified, path)) as modified from r group by 1)
    select job::varchar as job, status, epoch_us(a) as created_us, epoch_us(b) as finished_us, null::varchar as path from s where job % 2 = 0
    union all select job, 'done', null, epoch_us(modified), path from l where job not in (select job::varchar from s where job % 2 = 0)
    """
)
def restored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other job is lost and comes back from its file, if it has one."""
    jobs = _states(spark, sf_dir).where("job % 2 = 0")
    micros = lambda c: F.unix_micros(F.col(c)).alias(c.replace("_at", "_us"))
    return J.restored(jobs, _files(spark, sf_dir)).select("job", "status", micros("created_at"), micros("finished_at"), "path")

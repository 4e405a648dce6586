"""The job queue: a plain simulation, replays in other batches, retention and restore."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import jobs as J
from lexiloom.streaming import queue as Q


def simulate(jobs, cancels, slots, until):
    """Every millisecond in turn: what ends, what is cancelled, what starts. jobs: (at, job, takes)."""
    state, running, waiting = {}, {}, []
    for now in range(until + 1):
        for job in [j for j, finish in running.items() if finish <= now]:
            state[job] = "done"
            del running[job]
        for at, job in cancels:
            if at <= now and job in running:
                state[job] = "cancelled"
                del running[job]
        waiting += sorted((a, j, t) for a, j, t in jobs if a == now)
        for at, job in cancels:
            if at <= now and any(j == job for _, j, _ in waiting):
                waiting = [w for w in waiting if w[1] != job]
                state[job] = "cancelled"
        state |= {j: "queued" for _, j, _ in waiting}
        while waiting and len(running) < slots:
            _, job, takes = waiting.pop(0)
            if takes == 0:
                state[job] = "done"
                continue
            running[job], state[job] = now + takes, "running"
    return state


@pytest.mark.parametrize("seed", range(12))
def test_pool_equals_a_simulation_however_events_are_dealt(seed):
    rng = random.Random(seed)
    jobs = [(rng.randint(0, 80), k, rng.randint(1, 15)) for k in range(25)]
    cancels = [(rng.randint(0, 110), rng.randint(0, 30)) for _ in range(12)]
    want = simulate(jobs, cancels, 2, 100)
    events = sorted([(a, 0, j, t) for a, j, t in jobs] + [(a, 1, j, -1) for a, j in cancels])
    for parts in (1, 4, 30):
        saved, told = None, []
        bounds = [len(events) * k // parts for k in range(parts + 1)]
        for a, b in zip(bounds, bounds[1:]):
            pool = Q.Pool(2, saved)
            batch = events[a:b]
            rng.shuffle(batch)
            for at, _, job, takes in batch:
                pool.cancel(at, job) if takes < 0 else pool.submit(at, job, takes)
            pool.settle(min(100, events[b][0] - 1) if b < len(events) else 100)
            told += pool.changed
            saved = pool.saved()
        last = {}
        for job, status, _ in told:
            if status in ("done", "cancelled"):
                assert last.get(job) not in ("done", "cancelled")
            last[job] = status
        assert last == want


def events(spark, folder, files):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rng = random.Random(1)
    rows = sorted([(rng.randint(0, 300), k % 3, k, rng.randint(1, 20_000)) for k in range(60)] + [(rng.randint(0, 300), k % 3, k, -1) for k in rng.sample(range(60), 15)])
    for n in range(files):
        part = rows[len(rows) * n // files : len(rows) * (n + 1) // files]
        spark.createDataFrame([(at(s), p, j, t) for s, p, j, t in part], "ts timestamp, pool long, job long, takes_ms long").coalesce(1).write.mode("append").parquet(folder)


def test_replay_in_other_batches_gives_the_same_states(spark, tmp_path):
    found = []
    for files in (1, 5):
        folder = f"file://{tmp_path}/in{files}"
        events(spark, folder, files)
        stream = lambda: spark.readStream.schema("ts timestamp, pool long, job long, takes_ms long").option("maxFilesPerTrigger", 1).parquet(folder)  # noqa: E731, B023
        out = f"file://{tmp_path}/out{files}"
        Q.write_progress(Q.run_queue(stream().where("takes_ms >= 0"), stream().where("takes_ms < 0").select("pool", "job", "ts")), out, f"file://{tmp_path}/ck{files}")
        found.append(sorted(map(tuple, Q.current_jobs(spark, out).collect())))
        feed = Q.progress_feed(spark, out)
        ended = feed.groupBy("job").agg(F.sum(F.col("last").cast("int")).alias("n"), F.max_by("last", "place").alias("l"))
        assert ended.where("n > 1 or (n = 1 and not l)").count() == 0
    assert found[0] == found[1] and {"done", "cancelled"} <= {s for _, _, s, _ in found[0]}


def test_retention_and_restore(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    files = spark.createDataFrame(
        [("r/a.wav", day(2)), ("r/a.mp3", day(9)), ("r/b.mp3", day(3)), ("r/b.mp3.tmp", day(1)), ("r/.wav", day(1)), ("r/c.txt", day(1)), ("r/d.x.wav", None), ("q/b.mp3", day(5))], "path string, modified timestamp"
    )
    with pytest.raises(ValueError, match="3 days"):
        J.deletion_plan(files, F.lit(day(10)), 2)
    plan = {r.path: (r.job, r.deleted) for r in J.deletion_plan(files, F.lit(day(10)), 7).collect()}
    assert plan == {"r/a.wav": ("a", True), "r/a.mp3": ("a", False), "r/b.mp3": ("b", False), "r/d.x.wav": ("d.x", False), "q/b.mp3": ("b", False)}
    jobs = spark.createDataFrame([("a", "error", day(1), day(1))], "job string, status string, created_at timestamp, finished_at timestamp")
    back = {r.job: (r.status, r.created_at, r.finished_at, r.path) for r in J.restored(jobs, files).collect()}
    assert back == {"a": ("error", day(1), day(1), None), "b": ("done", None, day(5), "q/b.mp3"), "d.x": ("done", None, None, "r/d.x.wav")}
    assert J.restored(jobs.limit(0), files).where("job = 'a'").first().path == "r/a.wav"

"""A job queue as a stateful stream: submissions, cancellations, a bounded number of running jobs, timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Order of a job's states; the last one stands.
ORDER = ("queued", "running", "done", "cancelled")
_PROGRESS = "pool long, job long, status string, at_ms long"
_NEVER = 1 << 62


class Pool:
    """One pool's queue: first come, first served, at most ``slots`` running; times are milliseconds.

    What happens is settled only up to a time that no later event can precede, so it does
    not depend on how events were dealt into batches. Each job ends once: as done, or as
    cancelled where a cancellation comes before its end (before its start, it never runs).
    """

    def __init__(self, slots: int, saved: str | None = None) -> None:
        was = json.loads(saved) if saved else {}
        self.free: list[int] = was.get("free", [0] * slots)
        self.running: list[list[int]] = was.get("running", [])
        self.queue: list[list[int]] = was.get("queue", [])
        self.cancels: dict[int, int] = {int(k): v for k, v in was.get("cancels", {}).items()}
        self.changed: list[tuple[int, str, int]] = []

    def saved(self) -> str:
        return json.dumps({"free": self.free, "running": self.running, "queue": self.queue, "cancels": self.cancels})

    def submit(self, at: int, job: int, takes: int) -> None:
        self.queue.append([at, job, takes])
        self.changed.append((job, "queued", at))

    def cancel(self, at: int, job: int) -> None:
        self.cancels[job] = min(at, self.cancels.get(job, _NEVER))

    def _end(self, job: int, finish: int, until: int) -> bool:
        """Ends a running job if its end is settled."""
        stop = self.cancels.get(job, _NEVER)
        if min(stop, finish) > until:
            return False
        self.changed.append((job, "done", finish) if finish <= stop else (job, "cancelled", stop))
        self.free.append(min(stop, finish))
        self.cancels.pop(job, None)
        return True

    def settle(self, until: int) -> None:
        """All that happens up to ``until``."""
        self.running = [r for r in self.running if not self._end(r[1], r[0], until)]
        self.queue.sort()
        left = 0
        for at, job, takes in self.queue:
            if not self.free:
                break
            slot = min(self.free)
            start, stop = max(at, slot), self.cancels.get(job, _NEVER)
            if start > until:
                break
            left += 1
            if stop <= start:
                self.changed.append((job, "cancelled", max(at, stop)))
                self.cancels.pop(job)
                continue
            self.free.remove(slot)
            self.changed.append((job, "running", start))
            if not self._end(job, start + takes, until):
                self.running.append([start + takes, job])
        waiting = []
        for q in self.queue[left:]:
            stop = max(q[0], self.cancels.get(q[1], _NEVER))
            if stop <= until:
                self.changed.append((q[1], "cancelled", stop))
                self.cancels.pop(q[1])
            else:
                waiting.append(q)
        self.queue = waiting

    def next_time(self, until: int) -> int | None:
        """When something can happen next without further events."""
        times = [f for f, _ in self.running] + [c for c in self.cancels.values()]
        if self.queue and self.free:
            times.append(max(min(self.queue)[0], min(self.free)))
        return min((t for t in times if t > until), default=None)


def run_queue(submissions: DataFrame, cancellations: DataFrame, slots: int = 2, delay: str = "0 seconds") -> DataFrame:
    """Progress (pool, job, status, at_ms) of two streams: (pool, job, ts, takes_ms) and (pool, job, ts).

    A job's rows are queued, then running, then one of done and cancelled; a pool's state
    holds its waiting and running jobs only, and cancellations of jobs not seen yet. Events
    later than ``delay`` are dropped, as in any watermarked stream. Null jobs, pools and
    times are left out; a null time to take is none.
    """
    named = lambda df, takes: df.where("pool is not null and job is not null and ts is not null").select(F.col("pool").cast("long").alias("pool"), F.col("job").cast("long").alias("job"), F.col("ts").cast("timestamp").alias("ts"), takes.alias("takes"))
    both = named(submissions, F.coalesce(F.col("takes_ms").cast("long"), F.lit(0))).unionByName(named(cancellations, F.lit(-1).cast("long")))
    events = both.withColumn("at", F.unix_millis("ts")).withWatermark("ts", delay)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = Pool(slots, state.get[0] if state.exists else None)
        for frame in frames:
            for job, at, takes in zip(frame["job"], frame["at"], frame["takes"]):
                if takes < 0:
                    pool.cancel(int(at), int(job))
                else:
                    pool.submit(int(at), int(job), int(takes))
        # events of the watermark's own millisecond may still come
        until = state.getCurrentWatermarkMs() - 1
        pool.settle(until)
        state.update((pool.saved(),))
        due = pool.next_time(until)
        if due is not None:
            state.setTimeoutTimestamp(max(due, until + 1) + 1)
        if pool.changed:
            yield pd.DataFrame([(key[0], *c) for c in pool.changed], columns=["pool", "job", "status", "at_ms"])

    return events.groupBy("pool").applyInPandasWithState(update, _PROGRESS, "saved string", "append", GroupStateTimeout.EventTimeTimeout)


def write_progress(progress: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs the stream over what is there; a batch that runs again replaces its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    progress.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start().awaitTermination()


def current_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """(pool, job, status, at_ms): the last state of each job that ``write_progress`` stored."""
    rows = spark.read.parquet(folder)
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    last = F.max_by(F.struct("status", "at_ms"), place)
    return rows.groupBy("pool", "job").agg(last.alias("s")).select("pool", "job", "s.*")


def progress_feed(spark: SparkSession, folder: str) -> DataFrame:
    """(pool, job, place, status, at_ms, last): what a listener to one job is told, in order; it ends at ``last``."""
    rows = spark.read.parquet(folder).select("pool", "job", "status", "at_ms")
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    by = Window.partitionBy("pool", "job").orderBy("at_ms", place)
    return rows.select("pool", "job", F.row_number().over(by).alias("place"), "status", "at_ms", F.col("status").isin("done", "cancelled").alias("last"))

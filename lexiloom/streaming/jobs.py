"""Streams over job events and learned pairs."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiloom.operators.jobs import job_states
from lexiloom.operators.relational import insert_if_absent


def stream_job_states(events: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs the stream over what is there; each batch writes the jobs it changed below ``folder``.

    The state is that of ``job_states``; a batch that runs again replaces its own folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    states = job_states(events, "job", "ts", "status")
    states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start().awaitTermination()


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state that the stream wrote of each job."""
    rows = spark.read.parquet(folder)
    last = F.max_by(F.struct("status", "created_at", "finished_at"), "batch")
    return rows.groupBy("job").agg(last.alias("s")).select("job", "s.*")


def grow_dictionary(pairs: DataFrame, known_path: str, checkpoint: str) -> None:
    """Appends the pairs (key, value, at) whose key is new; of a batch's equal keys the first counts."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(known_path)
        except Exception as e:  # the first batch finds no dictionary yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.limit(0)
        grown = insert_if_absent(known.select("key", "value", "at"), batch.select("key", "value", "at"), "key", "at")
        new = grown.join(known.select("key"), "key", "left_anti")
        new.write.mode("append").parquet(known_path)

    pairs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start().awaitTermination()


def cut_off(values: DataFrame, group: str, value: str, share: float, rate: float = 0.05) -> DataFrame:
    """Online threshold of each group that lets about ``share`` of its values pass.

    After each value the threshold moves up where it passed and down where not, in the
    proportion that balances at ``share``. Emits (group, n, passed, threshold) after each batch.
    """

    def update(key: tuple, frames, state: GroupState):
        n, passed, at = state.get if state.exists else (0, 0, 0.0)
        for frame in frames:
            for v in frame[value]:
                ok = v > at
                n, passed = n + 1, passed + int(ok)
                at += rate * ((1 - share) if ok else -share) * max(1.0, abs(at))
        state.update((n, passed, at))
        yield pd.DataFrame({group: [key[0]], "n": [n], "passed": [passed], "threshold": [at]})

    return values.groupBy(group).applyInPandasWithState(update, f"{group} long, n long, passed long, threshold double", "n long, passed long, threshold double", "update", GroupStateTimeout.NoTimeout)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. A stream reads folders, so a table of one file is picked by its name."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"

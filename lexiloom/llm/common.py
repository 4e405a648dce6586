"""What several operators need: the shared folder, cut lineage, and distributed components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (a test) a temporary folder takes its place; on a
    cluster that would be a folder of one machine, so there its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_SCOPES = threading.local()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, as a URI; it goes with the innermost ``scoped`` block of this thread."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if open_ := getattr(_SCOPES, "open", None):
        open_[-1].append(folder)
    return folder


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the folders that are named inside it; what is read from them must be written by then."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield
    finally:
        for folder in _SCOPES.open.pop():
            remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``new_folder`` named, through its own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Lets Spark drop the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, kind: str, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or to ``folder``), as columns, and read again; its shuffle files go with the write."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, kind)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until no column of ``df`` has one."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text (its xxhash64) are in ``gone`` (doc_id, t).

    Rows are decided one by one: another row with the same id and another text stays. Rows
    with a null id stay. Columns keep their names, whatever they are.
    """
    a, b = free_names(docs, "gone_id", "gone_text")
    marked = docs.withColumns({a: F.col(f"`{id_col}`").cast("long"), b: F.xxhash64(f"`{text_col}`")})
    return marked.join(gone.distinct().toDF(a, b), [a, b], "left_anti").drop(a, b)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), component the smallest node.

    Alternates large-star and small-star steps (Kiverstein and others, 2014): every step is
    a grouped minimum and a join, so no component meets in one task and the number of steps
    grows with the logarithm of the longest path; it goes on until nothing changes. Null ends and loops are left out. An empty
    input gives no rows. Nodes without an edge do not appear.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    if now.isEmpty():
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    state_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = state_of(now)
    while True:
        # large star: each node hands its larger neighbours to the smallest of its neighbourhood
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("n")).agg(F.least(F.min("lo"), F.col("n")).alias("m"))
        # neighbours larger than the node: stored edges where the node is the lower end
        large = now.join(least, now.lo == least.n).select("hi", F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        # small star: each node hands its smaller neighbours and itself to the smallest of them
        low = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        small = large.join(low, large.hi == low.n).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.where("hi <> lo").union(low.select("n", "m")).distinct()
        now = cut(small)
        state = state_of(now)
        if state == before:
            break
        before = state
    # a settled graph is a star around each component's smallest node
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())

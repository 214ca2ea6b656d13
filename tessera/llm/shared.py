"""Shared folder, written tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textarrays import release


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without one gets its own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir()
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
            at = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: The list that the paths of written tables are noted in, where one is being kept.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting(paths: list[str]):
    """Within the block, paths of written tables are appended to ``paths``; ``remove`` deletes them."""
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables at ``paths`` and empty the list; every result that reads them must have been written itself."""
    while paths:
        _delete(spark, paths.pop())


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the application ends at the latest."""
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return path


#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 5.0
_collected = [0.0]


def collect_garbage(spark: SparkSession, now: bool = False) -> None:
    """Let Spark's cleaner see, now and then or at once, what no plan refers to any more.

    Shuffle files and broadcasts of a finished step stay until the driver collects its garbage, which a driver with
    room to spare puts off; steps that follow one another would pile them up.
    """
    at = time.monotonic()
    if now or at - _collected[0] >= COLLECT_EVERY:
        _collected[0] = at
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def erase(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._tessera_path)
        if (paths := _noted.get()) and t._tessera_path in paths:
            paths.remove(t._tessera_path)


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches hold at most so many rows and bytes, unless the session says otherwise: long texts must not pile up."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release_driver() -> None:
    """Give memory that a finished step freed in the driver back to the system."""
    gc.collect()
    release()


#: Links in one file of a round's checkpoint.
LINKS_A_FILE = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable over undirected ``edges``; nodes without edges are absent.

    Alternates large-star and small-star steps on an edge table that never grows: each round keeps one row per
    remaining link, so a hub of any size costs its own rows only. Joins against the hub's minimum are plain shuffle
    joins, which adaptive execution splits where a hub is hot. Every round is written to the shared folder, and the one
    before it deleted.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(links, "links")
    seen, parts = None, None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("p"))
            .select(F.col("p.x").alias("u"), F.col("p.y").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Counted links go to as few files as they need.
        before, e = e, written(small if parts is None else small.coalesce(parts), "links")
        erase(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen, parts = tuple(now), max(1, now[0] // LINKS_A_FILE)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


def _shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only for a local session that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{_shared(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, which stays when the application ends."""
    return f"{_shared(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to a path of its own below the shared folder and read back; lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """(name, bytes, modification time) of every file below ``path``, as the file system lists them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    each = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    while each.hasNext():
        f = each.next()
        yield f.getPath().toString(), f.getLen(), f.getModificationTime()


def fingerprint_of(spark: SparkSession, *sources: str) -> str:
    """Digest of names, sizes and times of all files of the sources: it changes where a file comes, goes or is rewritten."""
    rows = sorted(row for source in sources for row in _files(spark, source))
    return hashlib.sha256(repr(rows).encode()).hexdigest()[:24]


#: The setting that names a folder where built tables outlive the session.
STORE = "spark.tessera.store"
#: Where the last version of a table was stored, by session, store, sources and name.
_built: dict[tuple[str, ...], str] = {}


def built(spark: SparkSession, sources: str | list[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made from the files of ``sources`` once and read by every later plan, such as an index.

    It is stored under the fingerprint of the sources' files. Where a file changed, the table is made anew and the
    session's last version of it deleted. In the folder that ``spark.tessera.store`` names, tables stay for other
    sessions; without it, they go with the application.
    """
    sources = [sources] if isinstance(sources, str) else sources
    named = spark.conf.get(STORE, None)
    store = named.rstrip("/") if named else f"{_shared(spark)}/tessera-store-{spark.sparkContext.applicationId}"
    path = f"{store}/{name}-{fingerprint_of(spark, *sources)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
        if not named:
            fs.deleteOnExit(at)
    key = (spark.sparkContext.applicationId, store, *sources, name)
    before = _built.get(key)
    if before not in (None, path):
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before), True)
    _built[key] = path
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer parts than there are cores, as one small file does.

    Large inputs come in many parts and stay as they are: nothing is shuffled for them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

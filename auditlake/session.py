"""Session preparation shared by every query."""

from __future__ import annotations

import atexit
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound the Arrow batches they receive."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in partitions for all cores where it is read in fewer, as small tables with much work on each row are; plans with exchanges are left to Spark."""
    q, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if q.executedPlan().nodeName() == "AdaptiveSparkPlan" or q.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(3 * cores)


def by_size(df: DataFrame, *keys: str, megabytes: int = 4) -> DataFrame:
    """``df`` by these columns, in as many partitions as the tables and files it is made of have pieces of ``megabytes``: a task's share doesn't grow with them. Left as it is where their size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size > 1 << 50:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // (megabytes << 20))), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where set, else (tests, one machine) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditlake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_TEMPORARY: list[str] = []


def temporary(path: str) -> str:
    """Notes a folder in the shared one that later results read; it is deleted when this process ends."""
    if not _TEMPORARY:
        atexit.register(_clear)
    _TEMPORARY.append(path)
    return path


def _clear() -> None:
    import pyarrow.fs as pafs

    for path in _TEMPORARY:
        try:
            fs, at = pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)
            fs.delete_dir(at)
        except (OSError, ValueError):  # gone already, or a file system that can't be reached any more
            continue


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written in the shared folder for one use."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

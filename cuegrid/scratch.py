"""Shared scratch tables: the one place where lineage is cut.

Intermediate results are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``, which every executor and the driver can reach, so a lost
executor costs a re-read and not a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query when the query ends, and not when the driver's
#: garbage collector happens to find them unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is configured a single machine (a local master, as
    in tests) takes a folder of its own; a cluster has no folder that all executors share, which is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="cuegrid-"))
        root = _own[0]
    if spark.conf.get(CLEANUP) != "true":
        spark.conf.set(CLEANUP, "true")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends normally."""
    path = f"{scratch_root(spark)}/cuegrid/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that no later plan reads; nothing else."""
    ours = {path.rpartition("/")[2]: path for _, path in _made}
    for name in {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}:
        if name in ours:
            drop_path(df.sparkSession, ours[name])


def tidy(spark: SparkSession) -> None:
    """After many plans in a row: the driver unloads the classes that were generated for those that are gone
    and gives memory back. They are otherwise kept until its heap is full, which a small heap never gets."""
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder's own retention applies
            return

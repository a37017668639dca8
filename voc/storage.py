"""Where intermediate tables go: the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# tables and files written for a session's plans, for ``drop_scratch``
_WRITTEN: list[str] = []
# deletes the shuffle files of a query when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder.

    Without that setting a temporary folder is used on a local master only; elsewhere it is an error, since a
    machine-local folder is not visible to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="voc-")
        spark.sparkContext.setCheckpointDir(root)
    _WRITTEN.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this process wrote below the checkpoint folder. For the end of a job, when its outputs are written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Spreads rows over the cores if the input has fewer splits than that, as one JSON array or one row group has.

    Meant for the start of work that is bound by the processor. Inputs with enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table once for ``drop`` and read it back: the table and its path. Its shuffle files are deleted at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of ``scratch_path`` that nothing reads any more."""
    _WRITTEN.remove(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts the lineage, and later passes read only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Lineage cuts that survive executor loss."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors reach.

    Where it is unset, a folder in the warehouse, which they share as well; it then
    becomes the session's checkpoint folder.
    """
    context = spark.sparkContext
    named = (
        context.getCheckpointDir()
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
    )
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return context.getCheckpointDir() or named
    context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/foldyard-checkpoints")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new folder next to the checkpoints; the session deletes it when it ends."""
    path = f"{shared_folder(spark)}/foldyard-{uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it.

    Later scans read only the columns they need and do not depend on any executor.
    ``folder``: a new one of ``scratch_path``, for a caller who discards it early.
    ``codec``: of the Parquet files.
    """
    path = f"{folder or scratch_path(df.sparkSession)}/table"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``scratch_path`` whose table nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

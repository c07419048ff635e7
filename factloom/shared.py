"""Session settings and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without: driver and executors are one process, and a temporary folder will do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return str(base).rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="factloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def by_unit(spark: SparkSession, within: bool = True) -> None:
    """Let joins on unit and more columns keep a partitioning by unit alone, or not."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false" if within else "true")

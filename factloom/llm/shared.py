"""What the operators share: reading tables and writing intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by path; only Spark's readers touch it, so any Hadoop file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without: driver and executors are one process, and a temporary folder will do (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return str(base).rstrip("/")


#: Bytes of a batch between Spark and Python where the session has Spark's default, so that long texts don't add up.
BATCH_BYTES = "8m"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of bounded bytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64m", "64MB"):
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/factloom-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 bits in the filter of only_wanted, as a power of two.
_FILTER = 18


def _perhaps(rows: DataFrame, wanted: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows with _found: whether the key is among the keys of `wanted`; true for a few others too.

    A Bloom filter of one hash: what is broadcast is a table of 2**18 words at most, whatever the input.  With far more
    wanted keys than its 2**24 bits it finds everything, and the exact join that follows does all the work.
    """
    place, bit = F.shiftrightunsigned(F.xxhash64(*key), 64 - _FILTER), F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(key)}) & 63 as int))")
    words = wanted.select(place.alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.withColumns({"_place": place, "_mine": bit}).join(F.broadcast(words), "_place", "left")
    return held.withColumn("_found", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mine")) != 0, F.lit(False))).drop("_place", "_mine", "_bits")


def only_wanted(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is among the keys of `wanted`, and a few more, so that a join after it moves less."""
    return _perhaps(rows, wanted, key).where("_found").drop("_found")


def unwanted(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows that only_wanted leaves out: all surely without a key among those of `wanted`."""
    return _perhaps(rows, wanted, key).where("not _found").drop("_found")

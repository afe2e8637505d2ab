"""Stored intermediate tables and row numbers, for jobs that read a result more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, one of our own on a local master, else an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="sessionloom-")
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target, files = _path(spark, path)
        files.delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, and no executor's loss computes it again.

    It is deleted when the driver program ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/sessionloom/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with `name`, its rows' places from 0 in the given order, without one task that sees all rows."""
    parted = df.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in order)).sortWithinPartitions(*order)
    # the low 33 bits count a partition's rows in their order, the others are the partition, in the order of the ranges
    rows = stored(parted.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    # a row for each partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")

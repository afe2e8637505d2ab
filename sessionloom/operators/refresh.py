"""Stored analyses that follow the store: only sessions whose events have changed are analysed again.

A folder holds the tables of analysis.analyse(), in buckets of the sessions' hash, and `state`: the event count with which
each session was analysed. A session is analysed again if its index says another count. Its events are read from its days
alone; of the result tables only its buckets are written again, with the rows of their other sessions as they were. `state`
is written last, so a run that ends early is made up for by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema, tables
from . import analysis, indexes

KEYS = ["repo_id", "session_id"]
BUCKETS = 32


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def changed_sessions(spark: SparkSession, root: str, results: str) -> DataFrame:
    """(repo_id, session_id, event_count) of the sessions whose count isn't the one that they were analysed with."""
    now = indexes.read(spark, root, "sessions").select(*KEYS, "event_count")
    if not tables.exists(spark, f"{results}/state"):
        return now
    return now.join(spark.read.parquet(f"{results}/state").select(*KEYS, "event_count"), [*KEYS, "event_count"], "left_anti")


def _events_of(spark: SparkSession, root: str, sessions: DataFrame) -> DataFrame:
    """The events of sessions, read from the days that their index names."""
    days = indexes.sums(spark, root, "sessions").join(sessions.select(*KEYS), KEYS, "left_semi")
    days = tables.stored(days.select("repo_id", F.to_date("segment", "yyyyMMdd").alias("event_date")).distinct(), "refresh-days")
    dates = [r.event_date for r in days.where("event_date is not null").select("event_date").distinct().collect()]  # days of the calendar
    stored = indexes.events(spark, root).where(F.col("event_date").isNull() | F.col("event_date").isin(dates))
    return indexes.at_days(stored, days).join(sessions.select(*KEYS), KEYS, "left_semi").drop("event_date")


def _replace(fresh: DataFrame, path: str, sessions: DataFrame, touched: list[int], buckets: int) -> None:
    """Rows of sessions in place of what a table has of them: their buckets are written again."""
    spark = fresh.sparkSession
    rows = fresh.withColumn("bucket", _bucket(buckets))
    if tables.exists(spark, path):
        kept = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched)).join(sessions.select(*KEYS), KEYS, "left_anti")
        rows = tables.stored(kept.select(*rows.columns).unionByName(rows), "refresh-bucket")
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def refresh(spark: SparkSession, root: str, results: str, namespace: str = "sessionloom", buckets: int = BUCKETS) -> DataFrame:
    """Bring the analyses below `results` up to the indexed store at `root`; the sessions that were analysed again."""
    sessions = tables.stored(changed_sessions(spark, root, results), "refresh-sessions")
    touched = [r.b for r in sessions.select(_bucket(buckets).alias("b")).distinct().collect()]  # `buckets` at most
    if touched:
        found = analysis.analyse(_events_of(spark, root, sessions), namespace)
        for name, table in found.items():
            _replace(table, f"{results}/{name}", sessions, touched, buckets)
        _replace(sessions, f"{results}/state", sessions, touched, buckets)
    return sessions


_SHAPES: dict[str, T.StructType] = {}


def read(spark: SparkSession, results: str, name: str) -> DataFrame:
    """A stored table: sessions, prompts, thoughts, answers or contributors. One without rows may have no files, so its columns are those of an analysis of nothing."""
    if not _SHAPES:
        _SHAPES.update({n: t.schema for n, t in analysis.analyse(spark.createDataFrame([], schema.ENVELOPE)).items()})
    return spark.read.schema(_SHAPES[name]).parquet(f"{results}/{name}").drop("bucket")

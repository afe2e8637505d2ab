"""Incremental ingest by Structured Streaming, and writing a store's events to a sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema, tables
from ..operators import indexes, store
from .delivery import Delivery


class Sink(Protocol):
    def write(self, rows: Sequence[dict]) -> None: ...


def _written(sink: Sink, rows: Sequence[dict]) -> int:
    """How many of the rows a sink takes; a batch that fails is halved until single rows fail."""
    try:
        sink.write(rows)
        return len(rows)
    except Exception:
        half = len(rows) // 2
        return _written(sink, rows[:half]) + _written(sink, rows[half:]) if half else 0


def backfill(events: DataFrame, make_sink: Callable[[], Sink], batch: int = 32, give_up_after: int = 3) -> DataFrame:
    """(attempted, accepted, deduplicated, failed, sessions): write first arrivals to a sink, each partition from where it lies.

    Batches are halved on failure; after give_up_after batches in a row of which nothing was taken, a partition writes no more.
    """
    kept = store.first_arrivals(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, lost, attempted, accepted = make_sink(), 0, 0, 0
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                some = rows.slice(i, batch).to_pylist()
                attempted += len(some)
                taken = _written(sink, some) if lost < give_up_after else 0
                accepted, lost = accepted + taken, 0 if taken else lost + 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in (attempted, accepted)], names=["attempted", "accepted"])

    done = kept.mapInArrow(run, "attempted long, accepted long").agg(F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"))
    size = events.agg(F.count("*").alias("n"), F.count_distinct("repo_id", "session_id").alias("sessions"))
    return done.crossJoin(size).select("attempted", "accepted", (F.col("n") - F.col("attempted")).alias("deduplicated"), (F.col("attempted") - F.col("accepted")).alias("failed"), "sessions")  # one row each


#: Names that a landed line may give each field of an envelope.
_NAMES = {"event_id": ("event_id", "eventId"), "source": ("source",), "repo_id": ("repo_id", "repoId"), "actor_id": ("actor_id", "actorId"), "session_id": ("session_id", "sessionId"), "thread_id": ("thread_id", "threadId"), "ts": ("ts",), "event_type": ("event_type", "eventType"), "reasoning_availability": ("reasoning_availability", "reasoningAvailability")}


#: Where a line of a landed file stands, beside its envelope.
_PLACE = ["landed_at", "landed_file", "landed_split"]


def _placed(batch: DataFrame, number: int) -> DataFrame:
    """A batch's envelopes with their order of arrival, and with numbers in the ids of equal bad lines.

    Batches arrive in their order; within one files by their time and name, and lines as they stand, in whatever splits a
    file is read. arrival_seq is the batch's number (times 2^40) and the place in it.
    """
    place = [c for c in _PLACE if c in batch.columns]
    kept = tables.stored(batch.withColumn("__line", F.monotonically_increasing_id()), "ingest-batch")
    rows = tables.numbered(kept, [*place, "__line"], "__place").withColumn("arrival_seq", F.lit(number << 40) + F.col("__place"))
    rows = tables.stored(rows.select(*schema.ENVELOPE.names), "ingest-placed")
    bad = F.coalesce((F.col("event_type") == "error") & (F.col("repo_id") == "unknown"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("arrival_seq"))
    again = F.substring(F.sha2(F.concat_ws("|", "event_id", nth.cast("string")), 256), 1, 24)
    return rows.where(~bad).unionByName(rows.where(bad).withColumn("event_id", F.when(nth > 1, again).otherwise(F.col("event_id"))))


def read_landed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of envelopes from JSON-lines files that land in a folder, with the names of segments or of columns.

    A line that doesn't parse, or has no event id, is an error event: its id follows from its file and text, its ts is the
    file's. The file's time and name and the line's split come beside the envelope: run_ingest() takes the order of arrival
    from them, and tells a file's equal bad lines apart.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    kinds = ", ".join(f"{name} string" for names in _NAMES.values() for name in names)
    landed = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"), F.col("_metadata.file_block_start").alias("split"))
    parsed = landed.where(F.trim("value") != "").withColumn("e", F.from_json("value", kinds))
    values = {field: F.coalesce(*(F.col(f"e.{n}") for n in names)) for field, names in _NAMES.items()}
    good = values["event_id"].isNotNull()
    values |= {"payload_json": F.get_json_object("value", "$.payload"), "arrival_seq": F.unix_millis("landed")}
    error = {"event_id": F.substring(F.sha2(F.concat_ws("|", "file", "value"), 256), 1, 24), "source": F.lit("codex_exec"), "repo_id": F.lit("unknown"), "session_id": F.lit("unknown"), "event_type": F.lit("error"), "ts": F.date_format("landed", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "payload_json": F.to_json(F.struct(F.col("value").alias("raw"))), "reasoning_availability": F.lit("unavailable"), "arrival_seq": F.unix_millis("landed")}
    place = [F.col("landed").alias("landed_at"), F.col("file").alias("landed_file"), F.col("split").alias("landed_split")]
    return parsed.select(*(F.when(good, values[f.name]).otherwise(error[f.name] if f.name in error else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.ENVELOPE.fields), *place)


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event id of a repository once, exactly and for ever: state grows with the ids, so use the RocksDB state store.

    Which of several lines of one micro-batch stays is open; run_ingest() alone keeps the first.
    """
    return events.dropDuplicates(store.KEY)


def run_ingest(events: DataFrame, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, available_now: bool = True, indexed: bool = False, delivery: Delivery | None = None, deliver_known: bool = False) -> StreamingQuery:
    """Append new events to the store; a batch that is run again adds nothing, as it is held against the store.

    Of the store only the repositories of the batch are read: they are its first partition. With `indexed`, table is an
    indexed store (see indexes.add), of which only the touched buckets of the ids are read.

    New events also go to `delivery`, where one is given: before a plain store takes them, so that a batch that is run
    again after a loss delivers them again; an indexed store knows a batch's own. With deliver_known the events go out
    that the store has already, too: the first arrivals of the batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = tables.stored(_placed(batch, number), "ingest-events")
        if indexed:
            new = indexes.add(batch, table, number)
        else:
            new = store.first_arrivals(batch)
            if store.exists(spark, table):
                known = store.read(spark, table)
                repos = [r.repo_id for r in batch.select("repo_id").distinct().limit(1001).collect()]
                if len(repos) <= 1000:  # otherwise the whole store
                    known = known.where(F.col("repo_id").isin(repos))
                new = store.new_events(batch, known)
            if delivery and not deliver_known:
                new = tables.stored(new, "ingest-new")
        if delivery:
            delivery.write(store.first_arrivals(batch) if deliver_known else new, number)
        if not indexed:
            store.append(new, table)
        if on_batch:
            on_batch(batch, number)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

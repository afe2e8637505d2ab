"""The event store: envelopes, first-wins deduplication, partitioned append, and the indexes as aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema, tables
from ..functions import ids, payload, redact, text

KEY = ["repo_id", "event_id"]


def envelopes(staged: DataFrame, redacted: bool = True) -> DataFrame:
    """Envelopes from staged events (source, repo_id, actor_id, session_id, thread_id, sequence, ts, event_type,
    payload_json, arrival_seq, and optionally event_id and reasoning_availability)."""
    given = F.col("event_id") if "event_id" in staged.columns else F.lit(None).cast("string")
    made = ids.event_id(F.col("source"), F.col("thread_id"), F.col("sequence"), F.col("event_type"), F.col("ts"))
    clean = redact.redact_payload("payload_json") if redacted else F.col("payload_json")
    rows = staged.withColumn("payload_json", clean)
    known = F.col("reasoning_availability") if "reasoning_availability" in staged.columns else F.lit(None).cast("string")
    seen = payload.reasoning_availability(payload.parsed(F.col("payload_json")))
    return rows.select(
        F.coalesce(text.text_or_null(given), made).alias("event_id"), "source", "repo_id", text.text_or_null(F.col("actor_id")).alias("actor_id"), "session_id", "thread_id", "ts", "event_type", "payload_json",
        F.coalesce(known, seen).alias("reasoning_availability"), "arrival_seq",
    )


def first_arrivals(events: DataFrame) -> DataFrame:
    """Of events with one id in a repository the first to arrive; the rest are dropped, whatever they say."""
    # min_by aggregates map-side, so repeats of one hot id never meet in one task
    others = [c for c in events.columns if c not in KEY]
    kept = events.groupBy(*KEY).agg(F.min_by(F.struct(*others), F.struct("arrival_seq")).alias("e"))
    return kept.select(*KEY, "e.*").select(*events.columns)


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """First arrivals that the store doesn't have yet."""
    return first_arrivals(events).join(stored.select(*KEY), KEY, "left_anti")


def dated(events: DataFrame) -> DataFrame:
    """With event_date, the UTC day that an event is stored under."""
    return events.withColumn("event_date", F.to_date(F.try_to_timestamp("ts")))


def item_typed(events: DataFrame) -> DataFrame:
    """With item_type, the type of the payload's item: beside the envelope in stored files, so that their statistics and dictionaries can leave row groups out."""
    return events.withColumn("item_type", F.get_json_object("payload_json", "$.item.type"))


def append(events: DataFrame, path: str) -> None:
    """Add to the store: Parquet by repository and day. Late events go to the day of their own ts."""
    item_typed(dated(events)).write.mode("append").partitionBy("repo_id", "event_date").parquet(path)


def append_raw(lines: DataFrame, path: str) -> None:
    """Keep captured lines (provider, session_id, line) as they came but for secrets: text files by provider and session."""
    kept = lines.select("provider", "session_id", redact.redact_payload("line").alias("value"))
    kept.write.mode("append").partitionBy("provider", "session_id").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store was begun at path."""
    return tables.exists(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_typed(spark, path).drop("item_type")


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """The stored events with item_type. A store has it in all of its files or in none; then it is read from the payloads."""
    rows = spark.read.parquet(path)
    return rows if "item_type" in rows.columns else item_typed(rows)


def read_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON-lines segments as envelopes, without lines that don't parse; a missing actorId is null.

    Events arrive in the order of the paths as given, and within a file in that of its lines: arrival_seq is the path's
    place and the line's offset, summed within each split of a file, so that files are read in parallel.
    """
    names = {"eventId": "event_id", "source": "source", "repoId": "repo_id", "actorId": "actor_id", "sessionId": "session_id", "threadId": "thread_id", "ts": "ts", "eventType": "event_type", "reasoningAvailability": "reasoning_availability"}
    lines = spark.read.option("ignoreMissingFiles", "true").option("lineSep", "\n").text(paths)
    split = F.col("_metadata.file_block_start")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), split.alias("split"), F.monotonically_increasing_id().alias("pos"))
    # Spark names files by URI, with blanks encoded: each path as its file system writes it
    places = spark.createDataFrame([(uri, n) for n, path in enumerate(paths) for uri in _uris(spark, path)], "file string, place long").groupBy("file").agg(F.min("place").alias("place"))
    before = F.coalesce(F.sum(F.octet_length("value") + 1).over(Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a line that begins at a split's start belongs to the split before it
    offset = F.col("split") + before + F.when(F.col("split") > 0, 1).otherwise(0)
    lines = lines.withColumn("offset", offset).join(places, "file", "left")
    lines = lines.withColumn("arrival_seq", F.shiftleft(F.coalesce("place", F.lit(len(paths))), 44) + F.col("offset"))
    parsed = lines.withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
    fields = [F.try_variant_get("v", f"$.{old}", "string").alias(new) for old, new in names.items()]
    return parsed.select(*fields, F.get_json_object("value", "$.payload").alias("payload_json"), "arrival_seq").select(*schema.ENVELOPE.names)


def _uris(spark: SparkSession, path: str) -> set[str]:
    """How Spark may write a file's path: qualified by its file system, with one slash after the scheme or three."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()
    return {uri, re.sub(r"^(\w+):/(?!/)", r"\1:///", uri), re.sub(r"^(\w+):///", r"\1:/", uri)}


#: What an index is keyed by and which values it lists.
SEGMENTS = (["repo_id", "segment"], {})
SESSIONS = (["repo_id", "session_id"], {"segments": "segment", "threads": "thread_id", "actors": "actor_id"})
THREADS = (["repo_id", "thread_id"], {"segments": "segment", "sessions": "session_id"})
ACTORS = (["repo_id", "actor_id"], {"segments": "segment", "sessions": "session_id"})


def partial(events: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """Sums that can be merged: for each combination of keys and listed values its first (a) and last ts (b), count (n) and first arrival (o)."""
    rows = dated(events).withColumn("segment", F.date_format("event_date", "yyyyMMdd")).where(F.col(keys[1]).isNotNull() if keys[1] in ("thread_id", "actor_id") else F.lit(True))
    return rows.groupBy(*keys, *(v for v in lists.values() if v not in keys)).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.min("arrival_seq").alias("o"))


def partial_again(rows: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """partial() sums of several batches as those of all of them."""
    return rows.groupBy(*keys, *(v for v in lists.values() if v not in keys)).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.min("o").alias("o"))


def merged(rows: DataFrame, name: str) -> DataFrame:
    """The index `name` from partial() sums."""
    if name == "segments":
        out = _listed(rows, *SEGMENTS)
        return out.select("repo_id", F.to_date("segment", "yyyyMMdd").alias("event_date"), "from_ts", "to_ts", "event_count")
    if name == "sessions":
        return _listed(rows, *SESSIONS)
    if name == "threads":
        return _listed(rows, *THREADS).withColumn("session_id", F.get("sessions", F.lit(0))).drop("sessions")
    return _listed(rows, *ACTORS).withColumn("session_count", F.size("sessions").cast("long"))


def _listed(per: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """(keys, from_ts, to_ts, event_count, a list for each of `lists`): distinct non-null values in order of arrival."""
    seen = [F.array_sort(F.collect_list(F.struct("o", *lists.values()))).alias("__seen")] if lists else []
    out = per.groupBy(*keys).agg(F.min("a").alias("from_ts"), F.max("b").alias("to_ts"), F.sum("n").alias("event_count"), *seen)

    def distinct(column: str) -> Column:
        return F.array_distinct(F.filter(F.transform("__seen", lambda x: x[column]), lambda v: v.isNotNull()))

    return out.withColumns({name: distinct(column) for name, column in lists.items()}).drop("__seen") if lists else out


def segment_manifest(events: DataFrame) -> DataFrame:
    """(repo_id, event_date, from_ts, to_ts, event_count)."""
    return dated(events).groupBy("repo_id", "event_date").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("event_count"))


def session_index(events: DataFrame) -> DataFrame:
    """(repo_id, session_id, from_ts, to_ts, event_count, segments, threads, actors); lists in order of arrival.

    Here and below events are first reduced to the combinations of the listed values, so that a hot key collects those alone.
    """
    return merged(partial(events, *SESSIONS), "sessions")


def days_of(index: DataFrame, **ids_: str) -> list[str]:
    """The days under which a session's (or a thread's, an actor's) events are stored, from its index: the partitions to read."""
    found = index
    for column, value in ids_.items():
        found = found.where(F.col(column) == value)
    days = found.select(F.explode("segments").alias("d")).distinct().collect()  # the days of one session
    return sorted(f"{r.d[:4]}-{r.d[4:6]}-{r.d[6:]}" for r in days)


def thread_index(events: DataFrame) -> DataFrame:
    """(repo_id, thread_id, from_ts, to_ts, event_count, segments, session_id): the session is the thread's first."""
    return merged(partial(events, *THREADS), "threads")


def actor_index(events: DataFrame) -> DataFrame:
    """(repo_id, actor_id, from_ts, to_ts, event_count, segments, sessions, session_count)."""
    return merged(partial(events, *ACTORS), "actors")


def event_id_index(events: DataFrame) -> DataFrame:
    return dated(first_arrivals(events)).select(*KEY, F.date_format("event_date", "yyyyMMdd").alias("segment"), "ts", "session_id", "actor_id")

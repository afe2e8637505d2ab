"""Replay of remote activity snapshots: unwrapping, ordered union, fingerprints, counters, the suspicion of a server cap."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text
from ..functions.payload import load, strip
from . import store

#: Order in which the streams of a snapshot are replayed.
STREAMS = ("summaries", "diffs", "prompts", "main")
SAME_SNAPSHOTS = 3


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """(stream_rank, pos, id, created_at, payload, activity): all records, streams in their order."""
    parts = [streams[name].withColumn("stream_rank", F.lit(rank)) for rank, name in enumerate(STREAMS) if name in streams]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


_FIELDS = ("event_type", "session_id", "thread_id", "event_id", "actor_id", "source", "reasoning", "ts", "payload_json")


def unwrap(payload: str | None, activity: str | None, namespace: str) -> tuple | None:
    """The _FIELDS that a record holds, as far as it says them; null if it holds no event of ours.

    A record wraps an activity, an activity an envelope, an envelope an event; each may be an object or its JSON text.
    """

    def held(value):
        value = load(value) if isinstance(value, str) else value
        return value if isinstance(value, dict) else None

    def said(holder: dict | None, key: str) -> str | None:
        value = (holder or {}).get(key)
        return (strip(value) or None) if isinstance(value, str) else None

    def is_event(value: dict | None) -> bool:
        return any(said(value, k) for k in ("eventType", "sessionId", "eventId", "threadId", "prompt"))

    outer = held(payload)
    act = held(activity) or held((outer or {}).get("activity")) or outer
    if act is None:
        return None
    envelope = held(act.get("payload")) or (act if isinstance(act.get("event"), dict) else None)
    if envelope is None:
        return None
    kinds = {f"{namespace}_event", f"{namespace}_prompt"}
    if not ({said(act, "type"), said(envelope, "type")} & kinds or (said(envelope, "schema") or "").startswith(tuple(kinds))):
        return None
    deeper = held(envelope.get("payload"))
    event = envelope["event"] if isinstance(envelope.get("event"), dict) else deeper if not is_event(envelope) and is_event(deeper) else envelope
    body = event.get("payload") if isinstance(event.get("payload"), dict) else {}
    return (
        said(event, "eventType") or said(event, "type"), said(event, "sessionId") or said(act, "input_ref"), said(event, "threadId"), said(event, "eventId") or said(act, "output_ref"), said(event, "actorId"), said(event, "source"),
        said(event, "reasoningAvailability"), said(event, "ts") or said(act, "ts"), json.dumps(body, ensure_ascii=False, separators=(",", ":")),
    )


def parse_records(records: DataFrame, repo_id: str, now: Column, namespace: str = "sessionloom", fallback_actor: str | None = None) -> DataFrame:
    """records (id, created_at, payload, activity as text) with the event that each holds, or event_id null."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in _FIELDS]))
    def unwrapped(payload: pd.Series, activity: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unwrap(p, a, namespace) or (None,) * len(_FIELDS) for p, a in zip(payload, activity, strict=True)], columns=list(_FIELDS), dtype=object)

    activity = F.col("activity") if "activity" in records.columns else F.lit(None).cast("string")
    rows = records.withColumn("__e", unwrapped("payload", activity))
    rows = rows.withColumns({
        "event_type": F.coalesce("__e.event_type", F.lit("remote.activity")),
        "session_id": F.coalesce("__e.session_id", text.text_or_null(F.col("id")), F.lit("remote-session")),
        "ts": text.iso_millis(F.coalesce("__e.ts", text.text_or_null(F.col("created_at"))), now),
    })
    seed = F.concat_ws("|", F.coalesce(text.text_or_null(F.col("id")), F.lit("timeline")), "ts", "event_type", "session_id")
    return rows.withColumns({
        "thread_id": F.coalesce("__e.thread_id", "session_id"),
        "event_id": F.when(F.col("__e.payload_json").isNotNull(), F.coalesce("__e.event_id", ids.short_hash(seed, 24))),
        "actor_id": F.coalesce("__e.actor_id", F.lit(fallback_actor)),
        "source": text.known_source(F.col("__e.source")),
        "reasoning_availability": text.known_reasoning(F.col("__e.reasoning")),
        "payload_json": F.coalesce("__e.payload_json", F.lit("{}")),
        "repo_id": F.lit(repo_id),
    }).drop("__e")


def import_new(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """parsed with `outcome`: imported, deduplicated or skipped. The first record of an event id that the store lacks is imported."""
    ranked = parsed.withColumn("arrival_seq", F.struct("stream_rank", "pos"))
    firsts = ranked.where("event_id is not null").groupBy(*store.KEY).agg(F.min("arrival_seq").alias("first"))
    known = stored.select(*store.KEY).distinct().withColumn("known", F.lit(True))
    rows = ranked.join(firsts, store.KEY, "left").join(known, store.KEY, "left")
    outcome = F.when(F.col("event_id").isNull(), "skipped").when(F.coalesce("known", F.lit(False)) | (F.col("arrival_seq") != F.col("first")), "deduplicated").otherwise("imported")
    return rows.withColumn("outcome", outcome).drop("first", "known", "arrival_seq")


def replay_counters(outcomes: DataFrame, now: Column) -> DataFrame:
    """One row: imported, deduplicated, skipped, sessions and contributors of imported events, the last ts of both."""
    new = F.col("outcome") == "imported"
    per = outcomes.groupBy("session_id", "actor_id").agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("imported", "deduplicated", "skipped")), F.max(F.when(new, F.col("ts"))).alias("last_ts"),
        F.max(F.greatest(text.iso_millis(F.when(F.try_to_timestamp("created_at").isNotNull(), F.col("created_at")), F.lit(None).cast("timestamp")), F.when(F.col("outcome") != "skipped", F.col("ts")))).alias("timeline_max_ts"))
    some = F.col("imported") > 0
    return per.agg(*(F.sum(o).alias(o) for o in ("imported", "deduplicated", "skipped")), F.count_distinct(F.when(some, F.col("session_id"))).alias("sessions"), F.count_distinct(F.when(some, F.col("actor_id"))).alias("contributors"), F.max("last_ts").alias("last_ts"), F.max("timeline_max_ts").alias("timeline_max_ts"))


def fingerprint(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint, n): a hash over the records (id, created_at, payload text) of each snapshot, in their order.

    A snapshot's lines are sorted in one partition and hashed as they stream by, so no row holds them all.
    """
    line = F.concat_ws("|", F.coalesce(text.text_or_null(F.col("id")), F.concat(F.lit("idx:"), F.col("pos").cast("string"))), F.coalesce(text.text_or_null(F.col("created_at")), F.lit("")), ids.short_hash(F.coalesce("payload", F.lit(""))))
    rows = records.select(*keys, "pos", F.concat(line, F.lit("\n")).alias("line")).repartition(*keys).sortWithinPartitions(*keys, "pos")
    fields = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, out = None, None, 0, []

        def done() -> pa.RecordBatch:
            columns = [pa.array([r[0][k] for r in out], kind) for k, kind in enumerate(kinds)]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=[*keys, "fingerprint", "n"])
            out.clear()
            return batch

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for own, text_ in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("line").to_pylist(), strict=True):
                if own != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()[:24], n))
                    key, digest, n = own, hashlib.sha256(), 0
                digest.update(text_.encode())
                n += 1
            if len(out) > 10_000:
                yield done()
        if digest is not None:
            out.append((key, digest.hexdigest()[:24], n))
            yield done()

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.StringType()), T.StructField("n", T.LongType())]))


def combined_fingerprint(main: Column, prompts: Column, sessions: Column, diffs: Column) -> Column:
    """Of all streams together, where a side stream has records; else the main stream's."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), F.coalesce(c, F.lit("none")))
    return F.when(F.coalesce(prompts, sessions, diffs).isNotNull(), ids.short_hash(F.concat_ws("|", part("main", main), part("prompt", prompts), part("session", sessions), part("diff", diffs)), 24)).otherwise(main)


def same_snapshot_runs(pulls: DataFrame, keys: list[str], order: str, requested: Column | None = None, received: Column | None = None) -> DataFrame:
    """pulls with same_count, how many pulls in a row before this one gave the same fingerprint, and suspected_cap."""
    w = Window.partitionBy(*keys).orderBy(order)
    previous = F.lag("fingerprint").over(w)
    changed = F.when(previous.isNotNull() & F.col("fingerprint").isNotNull() & (previous == F.col("fingerprint")), 0).otherwise(1)
    rows = pulls.withColumn("__i", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("same_count", (F.row_number().over(Window.partitionBy(*keys, "__i").orderBy(order)) - 1).cast("long")).drop("__i")
    if requested is None or received is None:
        return rows
    return rows.withColumn("suspected_cap", (F.col("same_count") >= SAME_SNAPSHOTS) & (received > 0) & (requested > received))

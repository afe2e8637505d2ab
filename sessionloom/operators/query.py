"""Sessions, contributors, timelines and file changes."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload


def timeline_filter(session_id: str | None = None, thread_id: str | None = None, actor_id: str | None = None, from_ts: str | None = None, to_ts: str | None = None, item_type: str | None = None, item: Column | None = None, days: list[str] | None = None, by_day: bool = False) -> Column:
    """The conjunction of what is given; an empty text filters nothing. Bounds are inclusive and compare as text.

    With by_day (events that have event_date) the bounds also leave out partitions: where they start with a date, days
    before the one before and after the one after it, as a ts may be in any time zone. days (see store.days_of) are the
    only ones that may hold events, beside the partition of events whose ts has no day. item is the column of item types,
    where events have one; else they are read from the payloads.
    """
    tests = []
    day = F.col("event_date")
    for value, beyond in ((from_ts, -1), (to_ts, 1)):
        if by_day and value and re.match(r"\d{4}-\d{2}-\d{2}", value):
            try:
                edge = F.lit(date.fromisoformat(value[:10]) + timedelta(days=beyond))
            except (ValueError, OverflowError):
                continue
            tests.append(day.isNull() | (day >= edge if beyond < 0 else day <= edge))
    if days is not None and by_day:
        tests.append(day.isNull() | day.isin([date.fromisoformat(d) for d in days]))
    for name, value in (("session_id", session_id), ("thread_id", thread_id), ("actor_id", actor_id)):
        if value:
            tests.append(F.col(name) == value)
    if from_ts:
        tests.append(F.col("ts") >= from_ts)
    if to_ts:
        tests.append(F.col("ts") <= to_ts)
    if item_type:
        tests.append((item if item is not None else F.get_json_object("payload_json", "$.item.type")) == item_type)
    return reduce(and_, tests, F.lit(True))


def timeline(events: DataFrame, **filters) -> DataFrame:
    """Events that meet the filters, by ts and then by arrival."""
    return filtered(events, **filters).orderBy("ts", "arrival_seq")


def filtered(events: DataFrame, **filters) -> DataFrame:
    """Events that meet the filters; what events are stored by (event_date, item_type) is used to read less."""
    stored = {"item": F.col("item_type")} if "item_type" in events.columns else {}
    return events.where(timeline_filter(**stored | filters, by_day="event_date" in events.columns))


def page(ordered: DataFrame, offset: int = 0, limit: int = 200, most: int = 1000) -> DataFrame:
    """Rows offset+1 to offset+limit; the limit is kept within 1 and `most`."""
    return ordered.offset(max(0, offset)).limit(min(max(1, limit), most))


def page_with_total(events: DataFrame, offset: int = 0, limit: int = 200, most: int = 1000, **filters) -> tuple[DataFrame, int, bool]:
    """(a timeline's page, how many events meet the filters, whether some come after the page)."""
    found = timeline(events, **filters)
    total = found.count()
    return page(found, offset, limit, most), total, max(0, offset) + min(max(1, limit), most) < total


def sessions(events: DataFrame) -> DataFrame:
    """(repo_id, session_id, from_ts, to_ts, event_count, thread_count), the latest activity first."""
    per = events.groupBy("repo_id", "session_id", "thread_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return per.groupBy("repo_id", "session_id").agg(F.min("a").alias("from_ts"), F.max("b").alias("to_ts"), F.sum("n").alias("event_count"), F.count("thread_id").alias("thread_count")).orderBy(F.desc("to_ts"), "session_id")


def contributors(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """(repo_id, actor_id, from_ts, to_ts, event_count, session_count), most events first.

    With a session only its contributors are listed; their counts stay those of the whole repository.
    """
    per = events.where("actor_id is not null").groupBy("repo_id", "actor_id", "session_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    inside = F.max(F.col("session_id") == F.lit(session_id)).alias("inside") if session_id else F.lit(True).alias("inside")
    out = per.groupBy("repo_id", "actor_id").agg(F.min("a").alias("from_ts"), F.max("b").alias("to_ts"), F.sum("n").alias("event_count"), F.count("session_id").alias("session_count"), inside)
    return out.where("inside").drop("inside").orderBy(F.desc("event_count"), F.desc("to_ts"), "actor_id")


def changes(events: DataFrame) -> DataFrame:
    """One row for each file change of each event: the events' keys, path, kind, position."""
    parsed = events.withColumn("__p", payload.parsed(F.col("payload_json")))
    return parsed.select(*(c for c in ("repo_id", "session_id", "actor_id", "ts", "arrival_seq") if c in events.columns), F.posexplode(payload.file_changes(F.col("__p"))).alias("position", "c")).select("*", "c.path", "c.kind").drop("c")


def diff_summary(changed: DataFrame, keys: list[str] = ["session_id"], path: str | None = None) -> DataFrame:  # noqa: B006
    """(keys, path, kinds, occurrences) of changes(): kinds in the order in which they first appear; a path filter is exact."""
    rows = changed.where(F.col("path") == path) if path else changed
    per = rows.groupBy(*keys, "path", "kind").agg(F.min(F.struct("ts", "arrival_seq", "position")).alias("first"), F.count("*").alias("n"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"])
    return per.groupBy(*keys, "path").agg(kinds.alias("kinds"), F.sum("n").alias("occurrences"))


def by_path(df: DataFrame, *first: str) -> DataFrame:
    """Ordered as people read paths: Unicode collation."""
    return df.orderBy(*first, F.collate("path", "UNICODE"))


def by_weight(df: DataFrame, *first: str) -> DataFrame:
    """File stats with the most changed first, then as people read paths."""
    return df.orderBy(*first, F.desc(F.col("plus") + F.col("minus")), F.collate("path", "UNICODE"))


def file_stats(changed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, plus, minus): an addition counts once up, a deletion once down, any other change both."""
    kind = F.col("kind")
    return changed.groupBy(*keys, "path").agg(F.sum(F.when(kind == "delete", 0).otherwise(1)).alias("plus"), F.sum(F.when(kind == "add", 0).otherwise(1)).alias("minus"))


def recent(events: DataFrame, category: Column, n: int, keys: list[str]) -> DataFrame:
    """The last n of each category, newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "category").orderBy(F.desc("ts"), F.desc("arrival_seq"))
    return events.withColumn("category", category).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)

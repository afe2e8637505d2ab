"""The engine as one object: what a tool or a notebook asks of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import redact, text
from .operators import indexes, query, store


class Engine:
    """Queries over one store. Texts that leave through timeline() are redacted again."""

    def __init__(self, spark: SparkSession, path: str | None = None, events: DataFrame | None = None, session_index: DataFrame | None = None, thread_index: DataFrame | None = None, indexed: bool = False) -> None:
        """With `indexed`, path is a store whose indexes follow its writes (see operators.indexes): a session's, thread's or
        actor's timeline reads its days alone. So it does with indexes given, as long as they cover all of the store's events."""
        self._root = path if indexed else None
        self._events = events if events is not None else indexes.typed_events(spark, path) if indexed else store.read_typed(spark, path)
        self._indexes = {"session_id": session_index, "thread_id": thread_index}
        self._covering: dict[str, bool] = {}

    def events(self, repo_id: str | None = None) -> DataFrame:
        return self._of(repo_id).drop("item_type")

    def _of(self, repo_id: str | None) -> DataFrame:
        return self._events.where(F.col("repo_id") == repo_id) if repo_id else self._events

    def sessions(self, repo_id: str | None = None, limit: int = 200) -> DataFrame:
        return query.page(query.sessions(self.events(repo_id)), 0, limit, 5000)

    def contributors(self, repo_id: str | None = None, session_id: str | None = None, limit: int = 200) -> DataFrame:
        return query.page(query.contributors(self.events(repo_id), session_id), 0, limit, 5000)

    def timeline(self, repo_id: str | None = None, offset: int = 0, limit: int = 200, include_payload: bool = True, **filters) -> DataFrame:
        return self._shown(query.page(self._timeline(repo_id, filters), offset, limit), include_payload)

    def timeline_page(self, repo_id: str | None = None, offset: int = 0, limit: int = 200, include_payload: bool = True, **filters) -> tuple[DataFrame, int, bool]:
        """(the page, how many events meet the filters, whether some come after it)."""
        events, filters = self._pruned(repo_id, filters)
        rows, total, more = query.page_with_total(events, offset, limit, **filters)
        return self._shown(rows, include_payload), total, more

    def _covers(self, key: str, index: DataFrame) -> bool:
        """Whether an index given counts as many events as the store has: one made before later appends leaves days out."""
        if key not in self._covering:
            counted = index.agg(F.coalesce(F.sum("event_count"), F.lit(0))).first()[0]
            self._covering[key] = counted >= self._events.agg(F.count(F.lit(1) if key == "session_id" else F.col(key))).first()[0]
        return self._covering[key]

    def _pruned(self, repo_id: str | None, filters: dict) -> tuple[DataFrame, dict]:
        """(events of the days that the indexes name for a session, thread or actor, filters)."""
        events = self._of(repo_id)
        if self._root:
            for key, name in (("session_id", "sessions"), ("thread_id", "threads"), ("actor_id", "actors")):
                if filters.get(key):
                    return indexes.at_days(events, indexes.days(events.sparkSession, self._root, name, **{key: filters[key]})), filters
        for key, index in self._indexes.items():
            if index is not None and filters.get(key) and "days" not in filters and self._covers(key, index):
                return events, filters | {"days": store.days_of(index, **{key: filters[key]})}
        return events, filters

    def _timeline(self, repo_id: str | None, filters: dict) -> DataFrame:
        events, filters = self._pruned(repo_id, filters)
        return query.timeline(events, **filters)

    def _shown(self, rows: DataFrame, include_payload: bool = True) -> DataFrame:
        return rows.drop("item_type").withColumn("payload_json", redact.redact_payload("payload_json") if include_payload else F.lit("{}"))

    def timeline_count(self, repo_id: str | None = None, **filters) -> int:
        events, filters = self._pruned(repo_id, filters)
        return query.filtered(events, **filters).count()

    def timeline_stream(self, repo_id: str | None = None, **filters):
        """Rows one by one, a partition at a time, redacted as in timeline()."""
        return self._shown(self._timeline(repo_id, filters)).toLocalIterator()

    def diff_summary(self, session_id: str, repo_id: str | None = None, path: str | None = None) -> DataFrame:
        rows = self._pruned(repo_id, {"session_id": session_id})[0].where(F.col("session_id") == session_id)
        return query.by_path(query.diff_summary(query.changes(rows), ["session_id"], path))

    def status(self, repo_id: str | None = None) -> DataFrame:
        """(event_count, session_count, contributor_count, thread_count, first_ts, last_ts, providers): one row."""
        provider = text.provider_of(F.col("source"))
        seen = F.array_sort(F.collect_set(provider)).alias("providers")
        return self.events(repo_id).agg(F.count("*").alias("event_count"), F.count_distinct("session_id").alias("session_count"), F.count_distinct("actor_id").alias("contributor_count"), F.count_distinct("thread_id").alias("thread_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), seen)

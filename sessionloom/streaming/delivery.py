"""Delivery of events to a sink outside the store: items, activities and prompts, with counters and a breaker.

What is to be written is a DataFrame (requests), and tasks hand it over from where it lies (deliver): rows of one run go
together, up to `batch` in a call. Every row has the event's id as its key, so that a task or a batch that runs again
after a loss writes the same keys again. Counters are a small table in the log, one set for each batch: it is replaced
when the batch runs again, so they count once.

Items are written by the widest call that the sink has: insert_batch(run_id, items), ingest(run_id, items, key), where key
is the item's id when there is one item, or insert(run_id, item) for each. A sink that has append(stream, run_id,
item_id, body) also gets activities: one that fails is tried once more in its smaller form (prompts have none) and then
counted as failed. A sink without append gets none, and its activities count as dropped.

Breaker: after give_up_after failed item calls in a row, with none that succeeded between them, nothing is sent any more;
what follows counts as dropped. A task counts on from the failures in a row before its batch. Over tasks, which have no
order, a batch in which any item call succeeded starts the count again. It stays open for the life of its Delivery;
a new one, as after a restart, starts closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators import memory

ITEMS, ACTIVITY, PROMPTS = "items", "activity", "prompts"
#: Sums that a delivery counts for each stream; calls are those of items.
COUNTS = ("attempted", "accepted", "shrunk", "failed", "dropped", "good_calls", "bad_calls")
_ITEM = ("item_id", "node_id", "text", "payload_json", "metadata_json", "source")
_COUNTED = ", ".join(["stream string", *(f"{c} long" for c in COUNTS), "error string"])


def requests(events: DataFrame, namespace: str = "sessionloom", project: str | None = None, default_actor: str | None = None) -> DataFrame:
    """(stream, run_id, item_id, item, body, small): what a sink is to get of each event; prompts twice as activities.

    item is set for items; body (the compact envelope) and small (the minimal one) for activities.
    """
    ordered = events.sortWithinPartitions("arrival_seq")
    none = F.lit(None).cast("string")
    items = memory.memory_items(ordered, namespace, project, default_actor).select(F.lit(ITEMS).alias("stream"), "run_id", "item_id", F.struct(*_ITEM).alias("item"), none.alias("body"), none.alias("small"))
    no_item = F.lit(None).cast(items.schema["item"].dataType)

    def appended(stream: str, rows: DataFrame, small) -> DataFrame:
        return rows.select(F.lit(stream).alias("stream"), "run_id", F.col("event_id").alias("item_id"), no_item.alias("item"), F.col("activity").alias("body"), small.alias("small"))

    main = memory.activities(ordered, namespace, with_minimal=True)
    return reduce(DataFrame.unionByName, [items, appended(ACTIVITY, main, F.col("minimal")), appended(PROMPTS, memory.prompt_activities(ordered, namespace), none)])


class _Sender:
    """One task's calls to a sink and what came of them."""

    def __init__(self, sink, batch: int, give_up_after: int, lost: int) -> None:
        self.sink, self.batch, self.give_up_after, self.lost = sink, max(1, batch), give_up_after, lost
        self.counts: dict[str, dict[str, int]] = {}
        self.errors: dict[str, str] = {}

    def add(self, stream: str, **by: int) -> None:
        counts = self.counts.setdefault(stream, dict.fromkeys(COUNTS, 0))
        for name, n in by.items():
            counts[name] += n

    def tried(self, stream: str, call: Callable, *args) -> bool:
        try:
            call(*args)
        except Exception as error:  # whatever a sink raises is a failed write
            self.errors.setdefault(stream, f"{type(error).__name__}: {error}"[:200])
            return False
        return True

    def send(self, stream: str, run_id: str, rows: list[dict]) -> None:
        for i in range(0, len(rows), self.batch):
            some = rows[i : i + self.batch]
            if self.lost >= self.give_up_after or (stream != ITEMS and not hasattr(self.sink, "append")):
                self.add(stream, dropped=len(some))
            elif stream == ITEMS:
                self.items(run_id, [row["item"] for row in some])
            else:
                for row in some:
                    self.activity(stream, row)

    def items(self, run_id: str, items: list[dict]) -> None:
        sink = self.sink
        if hasattr(sink, "insert_batch"):
            groups, call = [items], lambda group: sink.insert_batch(run_id, group)
        elif hasattr(sink, "ingest"):
            groups, call = [items], lambda group: sink.ingest(run_id, group, group[0]["item_id"] if len(group) == 1 else None)
        else:
            groups, call = [[item] for item in items], lambda group: sink.insert(run_id, group[0])
        for group in groups:
            if self.lost >= self.give_up_after:
                self.add(ITEMS, dropped=len(group))
                continue
            good = self.tried(ITEMS, call, group)
            self.lost = 0 if good else self.lost + 1
            self.add(ITEMS, attempted=len(group), **({"accepted": len(group), "good_calls": 1} if good else {"failed": len(group), "bad_calls": 1}))

    def activity(self, stream: str, row: dict) -> None:
        place = (stream, row["run_id"], row["item_id"])
        whole = self.tried(stream, self.sink.append, *place, row["body"])
        shrunk = not whole and row["small"] is not None and self.tried(stream, self.sink.append, *place, row["small"])
        self.add(stream, attempted=1, accepted=int(whole or shrunk), shrunk=int(shrunk), failed=int(not (whole or shrunk)))


def deliver(wanted: DataFrame, make_sink: Callable[[], object], batch: int = 32, give_up_after: int = 3, lost: int = 0, concurrency: int | None = None) -> DataFrame:
    """(stream, COUNTS, error): hand requests() to a sink that each task makes for itself; error is one of those met.

    Reading the result sends: store it once. concurrency bounds how many tasks send at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = None
        for rows in batches:
            runs: dict[tuple[str, str], list[dict]] = {}
            for row in rows.to_pylist():
                runs.setdefault((row["stream"], row["run_id"]), []).append(row)
            sender = sender or _Sender(make_sink(), batch, give_up_after, lost)
            for (stream, run_id), some in runs.items():
                sender.send(stream, run_id, some)
        if sender:
            counted = [{"stream": s, **n, "error": sender.errors.get(s)} for s, n in sender.counts.items()]
            yield pa.RecordBatch.from_pylist(counted, schema=pa.schema([("stream", pa.string()), *((c, pa.int64()) for c in COUNTS), ("error", pa.string())]))

    rows = wanted.coalesce(concurrency) if concurrency else wanted
    done = rows.mapInArrow(run, _COUNTED)
    return done.groupBy("stream").agg(*(F.sum(c).alias(c) for c in COUNTS), F.min("error").alias("error"))


class Delivery:
    """Deliveries of one run of a program: the breaker's state and the log of counters (a folder)."""

    def __init__(self, make_sink: Callable[[], object], log: str, namespace: str = "sessionloom", project: str | None = None, default_actor: str | None = None, batch: int = 32, give_up_after: int = 3, concurrency: int | None = None) -> None:
        self.make_sink, self.log, self.give_up_after, self.lost = make_sink, log.rstrip("/"), give_up_after, 0
        self._shape = {"namespace": namespace, "project": project, "default_actor": default_actor}
        self._calls = {"batch": batch, "concurrency": concurrency}

    @property
    def open(self) -> bool:
        return self.lost >= self.give_up_after

    def write(self, events: DataFrame, number: int) -> None:
        """Deliver a batch's events and log its counters; a batch has a number of its own and keeps it when it runs again."""
        spark, path = events.sparkSession, f"{self.log}/batch={number}"
        wanted = requests(events, **self._shape)
        deliver(wanted, self.make_sink, give_up_after=self.give_up_after, lost=self.lost, **self._calls).write.mode("overwrite").parquet(path)
        calls = spark.read.schema(_COUNTED).parquet(path).agg(F.sum("good_calls").alias("good"), F.sum("bad_calls").alias("bad")).first()
        if not self.open:
            self.lost = 0 if calls.good else self.lost + (calls.bad or 0)


def delivered(spark: SparkSession, log: str) -> DataFrame:
    """(stream, COUNTS, error): the counters of all batches of a log."""
    if not tables.exists(spark, log):
        return spark.createDataFrame([], _COUNTED)
    rows = spark.read.schema(f"{_COUNTED}, batch long").parquet(log)
    return rows.groupBy("stream").agg(*(F.sum(c).alias(c) for c in COUNTS), F.min("error").alias("error"))

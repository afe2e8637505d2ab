"""A store with indexes that follow its writes: each batch adds its own sums, readers merge them, compaction bounds them.

Below a folder lie `events` (see store.append), one table for each index, and `ids`. An index keeps sums that can be
merged: for the combinations of its keys and listed values their first and last ts, count and first arrival. A batch
writes the sums of its new events as a layer, in buckets of the keys' hash; compact() merges the layers of a bucket that
has many into one. Rows of a layer are in folders bucket=, first=, last= (the batches that it covers), and readers leave
out a layer that another one covers. So

* a batch costs what it holds, not what the store holds, and rewrites nothing; compaction rewrites buckets with many layers alone;
* a batch that is run again writes its layer again, and nothing is counted twice;
* a compaction that ends early, or files that vacuum() hasn't deleted yet, change no result.

Indexes are written before the events: whatever is stored is indexed. `ids` are the stored ids in buckets, each with a
Bloom filter of its ids in the Parquet footers; a batch is held against the buckets that its own ids fall in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, tables
from . import store

#: Index: (keys, what lists hold), as store.merged() takes them.
INDEXES = {"segments": store.SEGMENTS, "sessions": store.SESSIONS, "threads": store.THREADS, "actors": store.ACTORS}
BUCKETS = 32
_AT = "__sessionloom_at"
_LAYER = ["bucket", "first", "last"]


def _sums(events: DataFrame, name: str, buckets: int) -> DataFrame:
    keys, lists = INDEXES[name]
    return store.partial(events, keys, lists).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, first: int, last: int) -> None:
    """Rows as a layer; where the layer is there already, its buckets are replaced."""
    layer = rows.withColumns({"first": F.lit(first).cast("long"), "last": F.lit(last).cast("long")})
    layer.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_LAYER).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """An index's rows of all layers; none of a batch may have a thread or an actor, and then the folder may be empty."""
    keys, lists = INDEXES[path.rsplit("/", 1)[-1]]
    text = ", ".join(f"{c} string" for c in dict.fromkeys([*keys, *lists.values(), "a", "b"]))
    return spark.read.schema(f"{text}, n long, o long, bucket int, first long, last long").parquet(path)


def _layers(spark: SparkSession, path: str) -> DataFrame:
    """The layers (bucket, first, last) that readers take: of those that overlap the widest."""
    found = _read(spark, path).select(*_LAYER).distinct()
    wide = found.select("bucket", F.col("first").alias("f"), F.col("last").alias("l"))
    # a row for each layer: buckets times the batches since the last compaction
    covered = found.join(wide, "bucket").where("f <= first and last <= l and (f < first or last < l)").select(*_LAYER).distinct()
    return found.join(covered, _LAYER, "left_anti")


def sums(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An index's sums, from the layers that count."""
    path = f"{root}/{name}"
    rows = _read(spark, path)
    return rows.join(F.broadcast(_layers(spark, path)), _LAYER, "left_semi")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An index as store.session_index(), thread_index(), actor_index() or segment_manifest() would compute it over all events."""
    return store.merged(sums(spark, root, name), name)


def known_ids(spark: SparkSession, root: str, batch: DataFrame, number: int, buckets: int = BUCKETS) -> DataFrame:
    """(repo_id, event_id) that other batches stored, in the buckets that the batch's ids fall in."""
    bucket = F.pmod(F.xxhash64(*store.KEY), F.lit(buckets)).cast("int")
    touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # `buckets` of them at most
    return spark.read.parquet(f"{root}/ids").where(F.col("bucket").isin(touched) & (F.col("batch") != number)).select(*store.KEY)


def new_events(batch: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """First arrivals of a batch that the store doesn't have from another batch.

    The batch is stored with its rows' numbers; only ids and numbers are grouped and held against the store, and of the
    rows that stay and those that go the fewer are joined with the stored batch. So events themselves are not shuffled
    or sorted unless both are many.
    """
    spark = batch.sparkSession
    rows = tables.stored(batch.withColumn(_AT, F.monotonically_increasing_id()), "indexed-batch")
    kept = rows.groupBy(*store.KEY).agg(F.min_by(_AT, F.coalesce("arrival_seq", F.lit((1 << 63) - 1))).alias(_AT))
    if tables.exists(spark, f"{root}/ids"):
        kept = kept.join(known_ids(spark, root, rows, number, buckets), store.KEY, "left_anti")
    kept = tables.stored(kept.select(_AT), "indexed-kept")
    n, m = rows.count(), kept.count()
    if m < n:
        rows = rows.join(kept, _AT, "left_semi") if m <= n - m else rows.join(tables.stored(rows.select(_AT).join(kept, _AT, "left_anti"), "indexed-gone"), _AT, "left_anti")
    return rows.drop(_AT)


def add(batch: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """Add a batch's new events to the store and to its indexes; they are returned. A batch has a number of its own and keeps it when it is run again."""
    spark = batch.sparkSession
    new = new_events(batch, root, number, buckets)
    if new.isEmpty():
        return new
    for name in INDEXES:
        _write(_sums(new, name, buckets), f"{root}/{name}", number, number)
    rows = store.item_typed(store.dated(new)).withColumn("batch", F.lit(number).cast("long"))
    # rebalanced: few files for each partition, and large ones are shared out
    rows.hint("rebalance", "repo_id", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "event_date", "batch").parquet(f"{root}/events")
    ids = new.select(*store.KEY, F.pmod(F.xxhash64(*store.KEY), F.lit(buckets)).cast("int").alias("bucket"), F.lit(number).cast("long").alias("batch"))
    ids = ids.hint("rebalance", "bucket").sortWithinPartitions("bucket", *store.KEY)
    ids.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#event_id", "true").partitionBy("bucket", "batch").parquet(f"{root}/ids")
    return new


def events(spark: SparkSession, root: str) -> DataFrame:
    """The stored events, with event_date."""
    return typed_events(spark, root).drop("item_type")


def typed_events(spark: SparkSession, root: str) -> DataFrame:
    """The stored events, with event_date and item_type."""
    return store.read_typed(spark, f"{root}/events").select(*schema.ENVELOPE.names, "event_date", "item_type")


def compact(spark: SparkSession, root: str, name: str, layers: int = 8) -> list[int]:
    """Merge the layers of each of an index's buckets that has `layers` or more; these buckets. Covered files stay until vacuum()."""
    path = f"{root}/{name}"
    keys, lists = INDEXES[name]
    live = _layers(spark, path).groupBy("bucket").agg(F.count("*").alias("n"), F.min("first").alias("from"), F.max("last").alias("to")).where(F.col("n") >= layers)
    spans: dict[tuple[int, int], list[int]] = {}
    for row in live.collect():  # a row for each bucket
        spans.setdefault((row["from"], row["to"]), []).append(row.bucket)
    for (first, last), some in spans.items():
        rows = sums(spark, root, name).where(F.col("bucket").isin(some))
        _write(tables.stored(store.partial_again(rows, ["bucket", *keys], lists), "compacted"), path, first, last)
    return sorted(b for some in spans.values() for b in some)


def vacuum(spark: SparkSession, root: str, name: str) -> int:
    """Delete the layers that compaction has covered, once no reader is at them any more; how many there were."""
    path = f"{root}/{name}"
    old = _read(spark, path).select(*_LAYER).distinct().join(_layers(spark, path), _LAYER, "left_anti").collect()
    for row in old:
        tables.delete(spark, f"{path}/bucket={row.bucket}/first={row['first']}/last={row['last']}")
    return len(old)


def days(spark: SparkSession, root: str, name: str, **ids: str) -> DataFrame:
    """(repo_id, event_date) under which the events of a session, thread or actor are stored, as its index says."""
    rows = sums(spark, root, name)
    for column, value in ids.items():
        rows = rows.where(F.col(column) == value)
    return rows.select("repo_id", F.to_date("segment", "yyyyMMdd").alias("event_date")).distinct()


def at_days(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The stored events of the days found. The days prune the partitions that are read while the query runs; nothing is collected.

    Events without a readable ts have no day: their partition is read where the days found have a null.
    """
    named = stored.join(F.broadcast(found.where("event_date is not null")), ["repo_id", "event_date"], "left_semi")
    unnamed = stored.where("event_date is null").join(F.broadcast(found.where("event_date is null").select("repo_id")), "repo_id", "left_semi")
    return named.unionByName(unnamed)

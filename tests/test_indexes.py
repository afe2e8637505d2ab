"""Indexes that follow a store's writes, against those computed over all events; timelines through them; arrival."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom import schema, tables
from sessionloom.api import Engine
from sessionloom.operators import indexes, store
from sessionloom.streaming import ingest

FULL = {"sessions": store.session_index, "threads": store.thread_index, "actors": store.actor_index, "segments": store.segment_manifest}


def events(spark, rows):
    out = [(i, "codex_exec", repo, actor, session, thread, ts, "k", "{}", "unavailable", n) for i, repo, actor, session, thread, ts, n in rows]
    return spark.createDataFrame(out, schema.ENVELOPE)


def batches(spark):
    """Three batches: ids that come again, a late event, no thread or actor, a ts that has no day."""
    made = []
    for b in range(3):
        rows = [(f"e{b}-{i}", f"r{i % 2}", f"a{(i + b) % 4}" if i % 5 else None, f"s{i % 6}", f"t{i % 3}" if i % 4 else None, f"2024-01-{1 + (i + 3 * b) % 9:02d}T00:00:{i:02d}Z", 100 * b + i) for i in range(30)]
        rows += [("e0-1", "r1", "other", "other", "other", "2030-01-01T00:00:00Z", 100 * b + 50), (f"odd{b}", "r0", "a1", "s1", "t1", "soon", 100 * b + 60)]
        made.append(events(spark, rows))
    return made


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))


def same(spark, root):
    stored = indexes.events(spark, root).drop("event_date")
    for name, whole in FULL.items():
        assert rows_of(indexes.read(spark, root, name)) == rows_of(whole(stored)), name


def files_of(root, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/{name}") for f in names if f.endswith(".parquet")}


def test_indexes_follow_the_store(spark, tmp_path):
    root, seen = str(tmp_path / "root"), {}
    for number, batch in enumerate(batches(spark)):
        new = indexes.add(batch, root, number)
        assert new.count() == 31
        same(spark, root)
        for name in FULL:  # what was there isn't written again, and the new layer holds the keys of the batch alone
            now = files_of(root, name)
            assert seen.get(name, {}).items() <= now.items()
            layer = spark.read.parquet(f"{root}/{name}").where(F.col("first") == number)
            assert layer.agg(F.sum("n")).first()[0] == (new.count() if name not in ("threads", "actors") else new.where(F.col({"threads": "thread_id", "actors": "actor_id"}[name]).isNotNull()).count())
            seen[name] = now
    assert indexes.events(spark, root).count() == 93


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    root, made = str(tmp_path / "root"), batches(spark)
    for number in (0, 1, 1, 0, 2, 1):
        indexes.add(made[number], root, number)
    same(spark, root)
    assert indexes.events(spark, root).count() == 93
    tables.delete(spark, f"{root}/ids/bucket=0")  # as if the last write had ended early: the batch is new again
    indexes.add(made[2], root, 2)
    same(spark, root)


def test_compaction_rewrites_buckets_with_many_layers(spark, tmp_path):
    root = str(tmp_path / "root")
    for number, batch in enumerate(batches(spark)):
        indexes.add(batch, root, number, buckets=4)
    indexes.add(events(spark, [("x", "r0", "a", "s1", "t1", "2024-02-01T00:00:00Z", 900)]), root, 3, buckets=4)
    before = files_of(root, "sessions")
    done = indexes.compact(spark, root, "sessions", layers=4)
    assert 0 < len(done) < 4 and before.items() <= files_of(root, "sessions").items()
    assert {p.split("bucket=")[1].split("/")[0] for p in files_of(root, "sessions").keys() - before.keys()} == {str(b) for b in done}
    same(spark, root)
    assert indexes.vacuum(spark, root, "sessions") > 0 and indexes.vacuum(spark, root, "sessions") == 0
    same(spark, root)
    assert indexes.compact(spark, root, "sessions", layers=4) == []
    indexes.add(events(spark, [("y", "r0", "a", "s1", "t9", "2024-02-02T00:00:00Z", 901)]), root, 4, buckets=4)
    same(spark, root)


def test_a_batch_reads_the_buckets_of_its_ids(spark, tmp_path):
    root = str(tmp_path / "root")
    indexes.add(batches(spark)[0], root, 0)
    one = events(spark, [("e0-1", "r1", "a", "s", "t", "2024-01-01T00:00:00Z", 5), ("e0-1", "r9", "a", "s", "t", "2024-01-01T00:00:00Z", 6)])
    known = indexes.known_ids(spark, root, one, 7)
    assert len({f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{root}/ids").where(F.col("bucket").isin([r.b for r in one.select(F.pmod(F.xxhash64("repo_id", "event_id"), F.lit(32)).alias("b")).distinct().collect()])).inputFiles()}) <= 32
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and known.count() < 32
    assert [r.repo_id for r in indexes.new_events(one, root, 7).collect()] == ["r9"]


def test_timelines_are_pruned_while_they_run(spark, tmp_path):
    root = str(tmp_path / "root")
    for number, batch in enumerate(batches(spark)):
        indexes.add(batch, root, number)
    stored, engine = indexes.events(spark, root), Engine(spark, root, indexed=True)
    for filters in ({"session_id": "s1"}, {"thread_id": "t1"}, {"actor_id": "a1"}, {"session_id": "none"}):
        (key, value), = filters.items()
        found = engine._timeline(None, filters)
        assert [r.event_id for r in found.collect()] == [r.event_id for r in stored.where(F.col(key) == value).orderBy("ts", "arrival_seq").collect()]
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
        assert engine.timeline_count(**filters) == stored.where(F.col(key) == value).count()
    assert stored.where("session_id = 's1' and event_date is null").count() == 3  # events whose ts has no day aren't lost
    assert engine.timeline_page(limit=5, session_id="s1")[1] == stored.where("session_id = 's1'").count()
    days = indexes.days(spark, root, "sessions", session_id="s4")
    assert indexes.at_days(stored, days).select("repo_id", "event_date").distinct().count() == days.count() < stored.select("repo_id", "event_date").distinct().count()


def test_indexes_given_lose_no_rows(spark, tmp_path):
    """An event whose ts has no day, and events appended after the index was made."""
    path = str(tmp_path / "t")
    first = events(spark, [("1", "r", "x", "s", "t", "2024-01-01T00:00:00Z", 1), ("2", "r", "x", "s", "t", "soon", 2)])
    store.append(first, path)
    index = {"session_index": store.session_index(first), "thread_index": store.thread_index(first)}
    for key in ({"session_id": "s"}, {"thread_id": "t"}):
        assert {r.event_id for r in Engine(spark, path, **index).timeline(**key).collect()} == {"1", "2"}
    store.append(events(spark, [("3", "r", "x", "s", "t", "2024-03-01T00:00:00Z", 3)]), path)
    for key in ({"session_id": "s"}, {"thread_id": "t"}):
        assert {r.event_id for r in Engine(spark, path, **index).timeline(**key).collect()} == {"1", "2", "3"}


def test_status_has_one_row(spark):
    row = Engine(spark, events=batches(spark)[0]).status().first()
    assert (row.event_count, row.session_count, row.thread_count, row.first_ts, row.last_ts, row.providers) == (32, 7, 4, "2024-01-01T00:00:00Z", "soon", ["codex"])


@pytest.mark.parametrize("indexed", [False, True])
def test_landed_lines_arrive_as_they_stand(spark, tmp_path, indexed):
    """400 lines of one file in many splits, and two files of one time: the first line of an id stays, in whatever order splits are read."""
    landed, table = tmp_path / "landed", str(tmp_path / "t")
    landed.mkdir()
    line = lambda i, kind: json.dumps({"event_id": str(i % 250 if i < 900 else i), "repo_id": "r", "session_id": "s", "ts": "2024-01-01T00:00:00Z", "event_type": kind, "payload": {"p": "x" * 200}}) + "\n"
    (landed / "b.jsonl").write_text("".join(line(i, f"b{i}") for i in range(400)))
    (landed / "a 1.jsonl").write_text("".join(line(i, f"a{i}") for i in range(100)))
    for name in ("a 1", "b"):
        os.utime(landed / f"{name}.jsonl", (1_700_000_000, 1_700_000_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        ingest.run_ingest(ingest.read_landed(spark, str(landed)), table, str(tmp_path / "c"), indexed=indexed).awaitTermination()
        (landed / "c.jsonl").write_text(line(0, "late") + line(999, "late"))
        os.utime(landed / "c.jsonl", (1_699_990_000, 1_699_990_000))  # an older file that lands later
        ingest.run_ingest(ingest.read_landed(spark, str(landed)), table, str(tmp_path / "c"), indexed=indexed).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = (indexes.events(spark, table) if indexed else store.read(spark, table)).orderBy("arrival_seq").collect()
    assert [(r.event_id, r.event_type) for r in kept] == [(str(i), f"a{i}" if i < 100 else f"b{i}") for i in range(250)] + [("999", "late")]
    if indexed:
        same(spark, table)


def test_segments_in_order_whatever_their_names(spark, tmp_path):
    """Names with blanks, and a path that is the end of another."""
    line = lambda i, kind: json.dumps({"eventId": str(i), "source": "codex_exec", "repoId": "r", "sessionId": "s", "ts": "t", "eventType": kind, "payload": {}}) + "\n"
    paths = [tmp_path / "x" / tmp_path.name / "b.jsonl", tmp_path / "z 1.jsonl", tmp_path / "a%b.jsonl", tmp_path / "b.jsonl"]
    for n, path in enumerate(paths):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(line(10 * n + i, f"k{n}") for i in range(3)))
    for order in (paths, paths[::-1]):
        rows = store.read_segments(spark, [str(p) for p in order]).orderBy("arrival_seq").collect()
        assert [int(r.event_id) for r in rows] == [10 * paths.index(p) + i for p in order for i in range(3)] and len({r.arrival_seq for r in rows}) == 12


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("x"), (F.col("id") % 7).alias("y"))
    rows = tables.numbered(df.repartition(9), ["y", "x"], "place").collect()
    assert [r.place for r in sorted(rows, key=lambda r: (r.y, r.x))] == list(range(5000))


def test_a_batch_is_deduplicated_by_ids_and_numbers_alone(spark, tmp_path):
    from sessionloom.operators import indexes, store

    rows = [("1", "codex_exec", "r", "u", "s", "t", "2024-01-01T00:00:00Z", "x", "{}", "full", seq) for seq in (3, 1, None)] + [("2", "codex_exec", "r", "u", "s", "t", "2024-01-01T00:00:00Z", "x", "{}", "full", None)]
    batch, root = spark.createDataFrame(rows, schema.ENVELOPE), str(tmp_path / "root")
    found = indexes.new_events(batch, root, 0)
    # what arrives without a number comes last and isn't lost; events are not grouped, so not sorted as wide rows
    assert sorted((r.event_id, r.arrival_seq) for r in found.collect()) == [("1", 1), ("2", None)]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.event_id for r in indexes.add(batch, root, 0).collect()} == {"1", "2"}
    again = spark.createDataFrame([(*r[:2], "r", *r[3:]) for r in rows[:1]] + [("3", *rows[0][1:])], schema.ENVELOPE)
    assert [r.event_id for r in indexes.new_events(again, root, 1).collect()] == ["3"]

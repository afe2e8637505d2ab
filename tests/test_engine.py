import json

import pytest
from pyspark.sql import functions as F

from sessionloom import schema
from sessionloom.api import Engine
from sessionloom.operators import analysis, artifacts, indexes, memory, query, replay, store
from sessionloom.streaming import ingest

NAMES = schema.ENVELOPE.names


def events(spark, *rows):
    """rows: (event_id, session, actor, ts, event_type, payload)."""
    out = [(i, "codex_exec", "r", actor, session, None, ts, kind, json.dumps(body), "unavailable", n) for n, (i, session, actor, ts, kind, body) in enumerate(rows)]
    return spark.createDataFrame(out, schema.ENVELOPE)


def change(*changes):
    return {"item": {"type": "file_change", "changes": [{"path": p, "kind": k} for p, k in changes]}}


def test_first_arrival_wins_and_the_store_is_asked(spark, tmp_path):
    ev = events(spark, ("a", "s", "x", "2024-01-02T00:00:00Z", "e", {}), ("a", "s", "x", "2023-01-01T00:00:00Z", "e", {}), ("b", "s", "x", "2024-01-01T00:00:00Z", "e", {}))
    path = str(tmp_path / "t")
    store.append(store.new_events(ev, spark.createDataFrame([], schema.ENVELOPE)), path)
    kept = {r.event_id: r.ts for r in store.read(spark, path).collect()}
    assert kept == {"a": "2024-01-02T00:00:00Z", "b": "2024-01-01T00:00:00Z"}
    assert store.new_events(ev, store.read(spark, path)).count() == 0


def test_envelopes_make_ids_and_reasoning(spark):
    staged = spark.createDataFrame([("codex_exec", "r", " ", "s", None, 1, "t", "item.completed", json.dumps({"item": {"type": "reasoning", "text": "why"}}), 0)], "source string, repo_id string, actor_id string, session_id string, thread_id string, sequence long, ts string, event_type string, payload_json string, arrival_seq long")
    row = store.envelopes(staged).first()
    assert len(row.event_id) == 24 and row.actor_id is None and row.reasoning_availability == "full"


def test_contributors_keep_their_counts_under_a_session(spark):
    ev = events(spark, ("1", "s1", "x", "1", "e", {}), ("2", "s2", "x", "2", "e", {}), ("3", "s2", "y", "3", "e", {}), ("4", "s2", None, "4", "e", {}))
    assert [(r.actor_id, r.event_count, r.session_count) for r in query.contributors(ev, "s1").collect()] == [("x", 2, 2)]
    assert [r.actor_id for r in query.contributors(ev).collect()] == ["x", "y"]


def test_timeline_bounds_are_text_and_inclusive(spark):
    ev = events(spark, ("1", "s", "x", "2024-01-01T00:00:05Z", "e", {}), ("2", "s", "x", "2024-01-01T00:00:05.000Z", "e", {}))
    assert [r.event_id for r in query.timeline(ev, from_ts="2024-01-01T00:00:05", to_ts="2024-01-01T00:00:05Z", actor_id="").collect()] == ["2", "1"]


def test_diff_summary_keeps_kinds_in_order(spark):
    ev = events(spark, ("1", "s", "x", "1", "i", change(("a", "update"), ("b", "add"))), ("2", "s", "x", "2", "i", change(("a", "add"), ("a", "update"))), ("3", "s", "x", "3", "i", {"item": {"type": "other", "changes": [{"path": "c", "kind": "add"}]}}))
    engine = Engine(spark, events=ev)
    assert [tuple(r) for r in engine.diff_summary("s").select("path", "kinds", "occurrences").collect()] == [("a", ["update", "add"], 3), ("b", ["add"], 1)]
    stats = {r.path: (r.plus, r.minus) for r in query.file_stats(query.changes(ev), ["session_id"]).collect()}
    assert stats == {"a": (3, 2), "b": (1, 0)}


def test_engine_pages_redacts_and_strips(spark):
    ev = events(spark, *((str(i), "s", "x", f"{i:03d}", "e", {"password": "secret-word"}) for i in range(5)))
    engine = Engine(spark, events=ev)
    assert [r.event_id for r in engine.timeline(offset=1, limit=2).collect()] == ["1", "2"]
    assert json.loads(engine.timeline(limit=1).first().payload_json) == {"password": "[REDACTED]"}
    assert engine.timeline(limit=0, include_payload=False).first().payload_json == "{}"
    assert engine.timeline_count(actor_id="x") == 5 and engine.status().first().session_count == 1
    assert [r.event_id for r in engine.timeline_stream()] == list("01234") and "secret-word" not in str(list(engine.timeline_stream()))


def test_placeholder_takes_number_one(spark):
    rows = [("s", 0, False), ("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 0, True), ("t", 1, False)]
    df = spark.createDataFrame(rows, "session_id string, n long, p boolean")
    found = analysis.prompt_slices(df, F.col("p"), ["session_id"], ["n"]).orderBy("session_id", "n").collect()
    assert [r.prompt_id for r in found] == [1, 2, 2, 3, 1, 1]


def test_diff_lines_before_the_first_thought_go_to_it(spark):
    rows = [("s", 0, False, ["a"]), ("s", 1, True, []), ("s", 2, False, ["b"]), ("s", 3, True, ["c"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "session_id string, n long, t boolean, l array<string>, prompt_id long")
    found = analysis.attribute_diffs(df, F.col("t"), F.col("l"), ["session_id"], ["n"], 2).orderBy("thought_no").collect()
    assert [(r.thought_no, r.diff_lines) for r in found] == [(1, ["a", "b"]), (2, ["c"])]


def test_day_rollup_follows_the_session_time_zone(spark):
    rows = spark.createDataFrame([("s", "2024-01-01T22:00:00Z", "2024-01-01T23:30:00Z", 1, "synced"), ("t", "2024-01-01T10:00:00Z", "2024-01-01T11:00:00Z", 2, "no_files")], "session_id string, from_ts string, to_ts string, event_count long, status string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert [(str(r.day), r.event_count, r.status) for r in analysis.day_rollup(rows).collect()] == [("2024-01-02", 1, "synced"), ("2024-01-01", 2, "no_files")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_actor_filter_falls_back_to_all(spark):
    df = spark.createDataFrame([("s", "x", 1), ("s", "y", 2), ("t", "z", 1)], "session_id string, actor_id string, prompt_id long")
    found = analysis.for_actor(df, "x", ["session_id"])
    assert sorted((r.session_id, r.prompt_id) for r in found.collect()) == [("s", 1), ("t", 1)]


def test_artifacts_round_trip(spark):
    lines = [f"+{i}" for i in range(330)]
    prompts = spark.createDataFrame([("r", "x", "s", 2, "e2", "t1", [("a", 1, 0)], lines), ("r", "x", "s", 3, None, "t2", [], [])], "repo_id string, actor_id string, session_id string, prompt_id long, prompt_event_id string, ts string, files array<struct<path: string, plus: bigint, minus: bigint>>, diff_lines array<string>")
    parts = artifacts.diff_part_events(prompts).withColumn("arrival_seq", F.monotonically_increasing_id())
    assert parts.count() == 3 and parts.select("event_id").distinct().count() == 3
    read = artifacts.read_diff_parts(parts)
    whole = analysis.assemble_parts(read, ["session_id", "prompt_event_id"]).first()
    assert whole.lines == lines and whole.has_code and whole.line_count == 330
    shown = spark.createDataFrame([("s", 2, "e2", ["old"]), ("s", 3, "e3", ["kept"])], "session_id string, prompt_id long, event_id string, diff_lines array<string>")
    snaps = analysis.best_snapshot(analysis.assemble_parts(read, ["session_id", "prompt_event_id"]), ["session_id", "prompt_event_id"]).withColumn("prompt_id", F.lit(None).cast("long"))
    assert {r.prompt_id: r.diff_lines[:1] for r in analysis.apply_snapshots(shown, snaps, ["session_id"]).collect()} == {2: ["+0"], 3: ["kept"]}
    sessions = spark.createDataFrame([("r", "x", "s", "t9", 4, 1, 99, [("a", 1, 0)])], "repo_id string, actor_id string, session_id string, to_ts string, prompt_count long, file_count long, token_estimate long, files array<struct<path: string, plus: bigint, minus: bigint>>")
    summary = artifacts.summary_events(sessions).withColumn("arrival_seq", F.lit(1).cast("long"))
    assert summary.first().event_id == artifacts.summary_events(sessions).first().event_id
    back = artifacts.read_summaries(summary).first()
    assert (back.prompt_count, back.file_count, back.token_estimate, back.files[0].path) == (4, 1, 99, "a")


def record(i, created, **parts):
    return (i, created, parts.get("payload"), parts.get("activity"), 3, int(i[1:]))


def test_replay_unwraps_every_shape(spark):
    event = {"eventId": "e1", "sessionId": "s1", "eventType": "prompt.submitted", "ts": "2024-01-01T00:00:00Z", "source": "nope", "actorId": "x", "payload": {"prompt": "hi"}}
    rows = [
        record("t0", "2024-01-01T00:00:01Z", payload=json.dumps({"type": "sessionloom_event", "input_ref": "s9", "output_ref": "o9", "payload": json.dumps({"eventType": "k"})})),
        record("t1", "2024-01-01T00:00:02Z", payload=json.dumps({"schema": "sessionloom_event.v2", "event": event})),
        record("t2", "2024-01-01T00:00:03Z", activity=json.dumps({"type": "sessionloom_prompt", "payload": json.dumps({"schema": "sessionloom_prompt.v1", "event": event})})),
        record("t3", "2024-01-01T00:00:04Z", payload=json.dumps({"type": "other", "payload": "{}"})),
        record("t4", "bad", payload="not json"),
    ]
    df = spark.createDataFrame(rows, "id string, created_at string, payload string, activity string, stream_rank int, pos long")
    parsed = replay.parse_records(df, "r", F.lit("2030-01-01").cast("timestamp"))
    found = {r.id: r for r in parsed.collect()}
    assert (found["t0"].event_id, found["t0"].session_id, found["t0"].event_type) == ("o9", "s9", "k")
    assert (found["t1"].event_id, found["t1"].source, found["t1"].actor_id, json.loads(found["t1"].payload_json)) == ("e1", "codex_history", "x", {"prompt": "hi"})
    assert found["t2"].event_id == "e1" and found["t3"].event_id is None and found["t4"].event_id is None
    outcomes = replay.import_new(parsed, spark.createDataFrame([], schema.ENVELOPE))
    total = replay.replay_counters(outcomes, F.current_timestamp()).first()
    assert (total.imported, total.deduplicated, total.skipped, total.sessions, total.contributors) == (2, 1, 2, 2, 1)


def test_same_snapshots_in_a_row_suggest_a_cap(spark):
    df = spark.createDataFrame([("r", i, f, 200) for i, f in enumerate("aaaab")], "repo string, n long, fingerprint string, received long")
    found = replay.same_snapshot_runs(df, ["repo"], "n", F.lit(1200), F.col("received")).orderBy("n").collect()
    assert [(r.same_count, r.suspected_cap) for r in found] == [(0, False), (1, False), (2, False), (3, True), (0, False)]


def test_memory_texts_and_compaction(spark):
    ev = events(spark, ("ab12", "s", "x", "t", "item.completed", {"item": {"type": "agent_message", "text": "m" * 3000, "extra": 1}}), ("cd", "s", None, "t", "turn.started", {}))
    rows = {r.item_id: r for r in memory.memory_items(ev).collect()}
    assert rows["ab12"].text.startswith("item.completed [actor:x]: mmm") and len(rows["ab12"].text) == len("item.completed [actor:x]: ") + 2002
    assert rows["cd"].text == "turn.started event in session s"
    activity = json.loads({r.event_id: r.activity for r in memory.activities(ev).collect()}["ab12"])
    assert list(activity["event"]["payload"]["item"]) == ["type", "text"] and len(activity["event"]["payload"]["item"]["text"]) == 1802
    assert activity["event"]["threadId"] is None


def test_landed_lines_take_the_names_of_segments(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    line = {"eventId": "e1", "source": "codex_exec", "repoId": "r", "sessionId": "s", "ts": "2024-01-01T00:00:00Z", "eventType": "k", "payload": {"b": 1}, "reasoningAvailability": "full", "actorId": "x"}
    (tmp_path / "landed/1.jsonl").write_text("\n".join([json.dumps(line), "bad", "bad", json.dumps(line | {"ts": "2030"})]) + "\n")
    table = str(tmp_path / "t")
    ingest.run_ingest(ingest.read_landed(spark, str(tmp_path / "landed")), table, str(tmp_path / "c")).awaitTermination()
    rows = store.read(spark, table).collect()
    assert sorted(r.event_type for r in rows) == ["error", "error", "k"] and len({r.event_id for r in rows}) == 3  # equal bad lines are two events
    (one,) = (r for r in rows if r.event_type == "k")
    assert (one.ts, one.repo_id, one.actor_id, one.reasoning_availability) == ("2024-01-01T00:00:00Z", "r", "x", "full")  # the first line came first


def test_a_failed_read_is_no_empty_store(spark, tmp_path):
    (tmp_path / "table").mkdir()
    (tmp_path / "table/broken.parquet").write_text("not parquet")
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed/1.jsonl").write_text(json.dumps({"event_id": "e", "repo_id": "r", "ts": "2024-01-01T00:00:00Z"}) + "\n")
    with pytest.raises(Exception, match="(?s)."):
        ingest.run_ingest(ingest.read_landed(spark, str(tmp_path / "landed")), str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    assert [p.name for p in (tmp_path / "table").iterdir()] == ["broken.parquet"]


def test_stream_ingests_each_event_once(spark, tmp_path):
    landed, table, check = (str(tmp_path / x) for x in ("landed", "table", "check"))
    (tmp_path / "landed").mkdir()
    line = {"event_id": "e1", "source": "codex_exec", "repo_id": "r", "session_id": "s", "ts": "2024-01-01T00:00:00Z", "event_type": "k", "payload": {"b": 1, "a": 2}, "reasoning_availability": "unavailable", "arrival_seq": 1}
    (tmp_path / "landed/1.jsonl").write_text(json.dumps(line) + "\n" + "not json\n")
    ingest.run_ingest(ingest.deduplicated(ingest.read_landed(spark, landed)), table, check).awaitTermination()
    (tmp_path / "landed/2.jsonl").write_text(json.dumps(line | {"ts": "2025-01-01T00:00:00Z"}) + "\n" + json.dumps(line | {"event_id": "e2"}) + "\n")
    ingest.run_ingest(ingest.deduplicated(ingest.read_landed(spark, landed)), table, check).awaitTermination()
    kept = {r.event_id: r for r in store.read(spark, table).collect()}
    assert sorted(r.event_type for r in kept.values()) == ["error", "k", "k"]
    assert kept["e1"].ts == "2024-01-01T00:00:00Z" and kept["e1"].payload_json == '{"b":1,"a":2}'


def test_backfill_counts(spark):
    class Picky:
        """Takes no batch that holds a bad row."""

        def write(self, rows):
            if any(r["event_type"] == "bad" for r in rows):
                raise RuntimeError("refused")

    class Down:
        def write(self, rows):
            raise RuntimeError("down")

    ev = events(spark, *((str(i), f"s{i % 2}", "x", "t", "bad" if i == 3 else "ok", {}) for i in range(20)), ("0", "s0", "x", "t", "ok", {}))
    row = ingest.backfill(ev, Picky, 8).first()
    assert row.asDict() == {"attempted": 20, "accepted": 19, "deduplicated": 1, "failed": 1, "sessions": 2}
    assert ingest.backfill(ev, Down, 2).first().failed == 20


def test_segments_skip_bad_lines_and_missing_actors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"eventId": "1", "source": "codex_exec", "repoId": "r", "sessionId": "s", "ts": "t", "eventType": "k", "payload": {"z": 1}, "reasoningAvailability": "full"}) + "\n{broken\n")
    rows = store.read_segments(spark, [str(tmp_path / "a.jsonl")]).collect()
    assert len(rows) == 1 and rows[0].actor_id is None and rows[0].payload_json == '{"z":1}'


def test_segments_arrive_in_the_order_of_the_list(spark, tmp_path):
    line = lambda i, kind, pad=0: json.dumps({"eventId": str(i), "source": "codex_exec", "repoId": "r", "sessionId": "s", "ts": "t", "eventType": kind, "payload": {"p": "x" * pad}}) + "\n"
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("".join(line(i, "a") for i in range(40)))
    b.write_text("".join(line(i, "b", 2000) for i in range(60)))  # the larger file is read first
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        for paths, first in (([a, b], "a"), ([b, a], "b")):
            rows = store.read_segments(spark, [str(p) for p in paths])
            assert spark.read.text([str(p) for p in paths]).rdd.getNumPartitions() > 4 and rows.select("arrival_seq").distinct().count() == 100
            ordered = [(r.event_type, int(r.event_id)) for r in rows.orderBy("arrival_seq").collect()]
            second = "b" if first == "a" else "a"
            assert ordered == [(k, i) for k in (first, second) for i in range(40 if k == "a" else 60)]
            kept = {r.event_id: r.event_type for r in store.first_arrivals(rows).collect()}
            assert all(kept[str(i)] == first for i in range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_timelines_read_the_days_that_can_hold_events(spark, tmp_path):
    ev = events(spark, *((str(i), f"s{i % 3}", "x", f"2024-01-{i + 1:02d}T00:00:00Z", "e", {}) for i in range(20)))
    path = str(tmp_path / "t")
    store.append(ev, path)
    engine = Engine(spark, path, session_index=store.session_index(ev), thread_index=store.thread_index(ev))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)  # plans cut their filters' text otherwise
    some = engine.timeline(from_ts="2024-01-05", to_ts="2024-01-06T12:00:00Z")
    assert [r.event_id for r in some.collect()] == ["4", "5"]
    filters = plan(some).split("PartitionFilters: [")[1].split("]")[0]
    assert "2024-01-04" in filters and "2024-01-07" in filters
    assert engine.timeline(from_ts="2024-13-45").count() == 0 and engine.timeline(to_ts="zz").count() == 20
    own = engine.timeline(session_id="s1")
    assert [r.event_id for r in own.collect()] == [str(i) for i in range(1, 20, 3)]
    assert "event_date" in plan(own).split("PartitionFilters: [")[1].split("]")[0]
    rows, total, more = engine.timeline_page(limit=5, session_id="s1")
    assert (rows.count(), total, more) == (5, 7, True) and engine.timeline_page(offset=5, limit=5, session_id="s1")[1:] == (7, False)


def test_raw_lines_are_kept_redacted_by_session(spark, tmp_path):
    lines = spark.createDataFrame([("codex", "s1", json.dumps({"token": "abcdefgh", "n": 1})), ("codex", "s2", "password=abcdefgh")], "provider string, session_id string, line string")
    store.append_raw(lines, str(tmp_path / "raw"))
    found = {(r.provider, r.session_id): r.value for r in spark.read.text(str(tmp_path / "raw")).collect()}
    assert found == {("codex", "s1"): '{"token":"[REDACTED]","n":1}', ("codex", "s2"): "password=[REDACTED]"}


def test_two_snapshots_of_a_prompt_give_one_row(spark):
    prompts = spark.createDataFrame([("s", 1, "e1", ["old"], [("x", 1, 0)]), ("s", 2, "e2", ["kept"], [("y", 1, 0)])], "session_id string, prompt_id long, event_id string, diff_lines array<string>, files array<struct<path: string, plus: bigint, minus: bigint>>")
    snaps = spark.createDataFrame(
        [("s", "e1", None, "t1", 1, 1, False, ["a"], [("z", 2, 2)]), ("s", "e1", None, "t2", 2, 1, True, ["+b"], []), ("s", None, 2, "t1", 3, 0, False, [], [("w", 1, 1)])],
        "session_id string, prompt_event_id string, prompt_id long, ts string, arrival_seq long, line_count long, has_code boolean, lines array<string>, files array<struct<path: string, plus: bigint, minus: bigint>>")
    found = {r.prompt_id: (r.diff_lines, [f.path for f in r.files]) for r in analysis.apply_snapshots(prompts, snaps, ["session_id"]).collect()}
    assert found == {1: (["+b"], ["x"]), 2: (["kept"], ["w"])}


def test_prompt_activities_of_two_repositories_stay_apart(spark):
    ev = events(spark, ("1", "s", "x", "t", "prompt.submitted", {"prompt": "p"}), ("1", "s", "x", "t", "prompt.submitted", {"prompt": "p"})).withColumn("repo_id", F.concat(F.lit("r"), "arrival_seq"))
    found = memory.prompt_activities(ev).collect()
    assert len(found) == 2 and len({r.run_id for r in found}) == 2


def test_clipping_counts_utf16_units(spark):
    from sessionloom.functions import text

    rows = ["abc", "abcdef", "\U0001F600" * 3, "a\U0001F600\U0001F600b"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.c for r in df.select(text.clip(F.col("t"), 5).alias("c")).collect()] == ["abc", "abcd...", "\U0001F600" * 2 + "...", "a\U0001F600..."]
    assert [memory.clipped(r, 5) for r in rows] == ["abc", "abcd...", "\U0001F600" * 2 + "...", "a\U0001F600..."]


def test_analysis_keeps_placeholders_and_stored_summaries(spark):
    ev = events(
        spark, ("1", "s", "x", "1", "item.completed", {"item": {"type": "tool_call", "name": "apply_patch", "arguments": "*** Begin Patch\n*** Update File: a b\n+x"}}),
        ("2", "s", "y", "2", "prompt.submitted", {"prompt": "ask"}), ("3", "s", "y", "3", "item.completed", {"item": {"type": "reasoning", "text": "why"}}), ("4", "s", "y", "4", "item.completed", change(("f", "delete"))),
        ("5", "s", "y", "5", "k", {"item": {"type": "sessionloom_session_summary", "prompt_count": 9, "files": [{"path": "q", "plus": 1, "minus": 0}]}}),
    )
    found = analysis.analyse(ev)
    prompts = {r.prompt_id: r for r in found["prompts"].collect()}
    assert (prompts[1].prompt, prompts[1].actor_id, prompts[1].diff_lines) == ("(No prompt captured)", None, ["--- a/a b", "+++ b/a b", "+x"])
    assert (prompts[2].event_id, [tuple(f) for f in prompts[2].files], prompts[2].diff_lines) == ("2", [("f", 0, 1)], ["FILE - f"])
    thoughts = {(r.prompt_id, r.thought_no): (r.text, len(r.diff_lines)) for r in found["thoughts"].collect()}
    assert thoughts == {(1, 1): ("(No exposed reasoning text)", 3), (2, 1): ("why", 1)}
    session = found["sessions"].first()
    assert (session.prompt_count, session.file_count, [f.path for f in session.files], session.event_count, session.providers) == (9, 1, ["q"], 5, ["codex"])
    assert {r.actor: (r.prompt_count, r.thought_count, r.file_count) for r in found["contributors"].collect()} == {"unknown": (1, 1, 0), "y": (1, 1, 1)}
    assert all(t.count() == 0 for t in analysis.analyse(ev.limit(0)).values())


def test_fingerprints_of_split_groups(spark):
    import hashlib

    rows = spark.range(25_000).select(F.col("id").alias("pos"), (F.col("id") % 2).alias("k"), F.col("id").cast("string"), F.lit(None).cast("string").alias("created_at"), F.lit("p").alias("payload"))
    short = hashlib.sha256(b"p").hexdigest()[:16]
    want = {k: hashlib.sha256("".join(f"{i}||{short}\n" for i in range(k, 25_000, 2)).encode()).hexdigest()[:24] for k in (0, 1)}
    assert {r.k: r.fingerprint for r in replay.fingerprint(rows, ["k"]).collect()} == want


@pytest.mark.parametrize("index", ["session_index", "thread_index", "actor_index", "segment_manifest", "event_id_index"])
def test_indexes_of_an_empty_store(spark, index):
    assert getattr(store, index)(spark.createDataFrame([], schema.ENVELOPE)).count() == 0


@pytest.mark.parametrize("indexed", [False, True])
def test_item_types_are_filtered_in_the_scan(spark, tmp_path, indexed):
    path = str(tmp_path / "t")
    ev = events(spark, *((str(i), "s", "x", "2024-01-01T00:00:00Z", "item.completed", {"item": {"type": "reasoning" if i % 4 == 0 else "tool_call", "text": "why"}} if i % 3 else {}) for i in range(40)))
    indexes.add(ev, path, 0) if indexed else store.append(ev, path)
    engine = Engine(spark, path, indexed=indexed)
    found = engine.timeline(item_type="reasoning")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(item_type,reasoning)" in plan and "$.item.type" not in plan
    wanted = [str(i) for i in range(40) if i % 4 == 0 and i % 3]
    assert sorted(r.event_id for r in found.collect()) == sorted(wanted) and engine.timeline_count(item_type="reasoning") == len(wanted)
    assert "item_type" not in found.columns and set(engine.events().columns) == {*NAMES, "event_date"}
    bare = Engine(spark, events=engine.events())  # without the column the payloads are read
    assert bare.timeline_count(item_type="reasoning") == len(wanted)
    old = str(tmp_path / "old")
    store.dated(ev).write.partitionBy("repo_id", "event_date").parquet(old)
    assert Engine(spark, old).timeline_count(item_type="reasoning") == len(wanted)


def test_contributors_deal_slices_out_before_they_count(spark):
    prompts = spark.createDataFrame([("s", 1, "a", "t1"), ("s", 2, None, "t2"), ("s", 3, "a", "t3")], "session_id string, prompt_id long, actor_id string, ts string")
    files = spark.createDataFrame([("s", 1, "x"), ("s", 1, "x"), ("s", 1, None), ("s", 2, "y")], "session_id string, prompt_id long, path string")
    thoughts = spark.createDataFrame([("s", 3), ("s", 3), ("s", 2)], "session_id string, prompt_id long")
    columns = ["actor", "prompt_count", "thought_count", "file_count", "last_ts"]
    both = analysis.session_contributors(prompts, files, files, ["session_id"])
    assert [tuple(r) for r in both.select(columns).collect()] == [("a", 2, 3, 1, "t3"), ("unknown", 1, 1, 1, "t2")]
    apart = analysis.session_contributors(prompts, thoughts, files, ["session_id"])
    assert [tuple(r) for r in apart.select(columns).collect()] == [("a", 2, 2, 1, "t3"), ("unknown", 1, 1, 1, "t2")]
    # files are shuffled once, as rows, before any sum over them
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1

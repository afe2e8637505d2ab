"""Analyses that follow the store, against those of all events; the choice of diff; days with members."""

import json
import os

from pyspark.sql import functions as F

from sessionloom import schema
from sessionloom.operators import analysis, indexes, refresh


def events(spark, rows):
    out = [(f"e{n}", "codex_exec", repo, "x", session, None, ts, kind, json.dumps(body), "unavailable", n) for n, repo, session, ts, kind, body in rows]
    return spark.createDataFrame(out, schema.ENVELOPE)


def turns(session, first, n, day):
    for i in range(n):
        kind, body = ("prompt.submitted", {"prompt": f"p{i}"}) if i % 3 == 0 else ("item.completed", {"item": {"type": "reasoning", "text": f"t{i}"}})
        yield first + i, "r", session, f"2024-01-{day:02d}T00:00:{i:02d}Z", kind, body


def rows_of(df):
    return sorted(str(r.asDict(True)) for r in df.select(sorted(df.columns)).collect())


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_only_changed_sessions_are_analysed_again(spark, tmp_path):
    root, results = str(tmp_path / "store"), str(tmp_path / "results")
    first = [t for k in range(6) for t in turns(f"s{k}", 100 * k, 5, k + 1)]
    indexes.add(events(spark, first), root, 0)
    assert refresh.refresh(spark, root, results).count() == 6
    kept = {name: files_of(f"{results}/{name}") for name in ("sessions", "prompts", "thoughts")}
    assert refresh.refresh(spark, root, results).count() == 0 and kept["prompts"] == files_of(f"{results}/prompts")
    indexes.add(events(spark, [*turns("s2", 700, 4, 9), *turns("new", 800, 3, 10)]), root, 1)
    again = refresh.changed_sessions(spark, root, results)
    read = refresh._events_of(spark, root, again)
    assert sorted(r.session_id for r in again.collect()) == ["new", "s2"] and read.count() == 12
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    filters = refresh._events_of(spark, root, again)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "2024-01-03" in filters and "2024-01-10" in filters and "2024-01-02" not in filters
    assert sorted(r.session_id for r in refresh.refresh(spark, root, results).collect()) == ["new", "s2"]
    stored = analysis.analyse(indexes.events(spark, root).drop("event_date"))
    for name, whole in stored.items():
        assert rows_of(refresh.read(spark, results, name)) == rows_of(whole), name
    for name, before in kept.items():  # buckets without a changed session are the files that they were
        assert before & files_of(f"{results}/{name}")
    assert refresh.changed_sessions(spark, root, results).count() == 0


def test_each_thought_shows_its_own_lines_or_its_prompts(spark):
    files = "array<struct<path: string, plus: bigint, minus: bigint>>"
    code, named, counted = ["+++ b/x", "+x"], ["FILE + x"], ["+ x (+1 -0)"]
    prompts = spark.createDataFrame([("s", 1, code, []), ("s", 2, named, []), ("s", 3, [], [("y", 2, 1)]), ("t", 4, [], []), ("u", 5, [], [])], f"session_id string, prompt_id long, diff_lines array<string>, files {files}")
    thoughts = spark.createDataFrame([("s", 1, 1, ["@@ 1"]), ("s", 1, 2, named), ("s", 1, 3, []), ("s", 2, 1, counted), ("s", 2, 2, None), ("s", 3, 1, []), ("t", 4, 1, []), ("u", 5, 1, [])], "session_id string, prompt_id long, thought_no long, diff_lines array<string>")
    stored = spark.createDataFrame([("t", [("z", 1, 1)])], f"session_id string, files {files}")
    found = {(r.prompt_id, r.thought_no): (r.lines, r.shown_of, r.only_summary) for r in analysis.preferred_diffs(thoughts, prompts, ["session_id"], stored).collect()}
    assert found == {
        (1, 1): (["@@ 1"], "thought", False), (1, 2): (code, "prompt", True), (1, 3): (code, "prompt", False), (2, 1): (counted, "thought", True), (2, 2): (named, "prompt", False),
        (3, 1): (["+ y (+2 -1)"], "prompt", False), (4, 1): (["+ z (+1 -1)"], "prompt", False), (5, 1): (["(No diff captured)"], "prompt", False),
    }


def test_days_have_members_threads_and_providers(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", "2024-01-02T01:00:00Z", 3, 2, "synced", ["gemini-cli"]), ("b", "2024-01-01", "2024-01-02T02:00:00Z", 4, 1, "no_files", ["codex", "gemini-cli"]), ("c", "2024-01-01", "2024-01-03T02:00:00Z", 5, 1, "no_files", [])], "session_id string, from_ts string, to_ts string, event_count long, thread_count long, status string, providers array<string>")
    found = {str(r.day): (r.member_count, r.thread_count, r.event_count, r.providers, r.status) for r in analysis.day_rows(rows).collect()}
    assert found == {"2024-01-02": (2, 3, 7, ["codex", "gemini-cli"], "synced"), "2024-01-03": (1, 1, 5, [], "no_files")}
    assert [r.session_id for r in analysis.day_members(rows).collect()] == ["b", "a", "c"]


def test_payloads_are_passed_once(spark):
    for table in analysis.analyse(events(spark, turns("s", 0, 4, 1))).values():
        assert str(table._jdf.queryExecution().executedPlan().toString()).count("ArrowEvalPython") == 0
    assert analysis.analyse(events(spark, []).where(F.lit(False)))["sessions"].count() == 0

import json
import random

from pyspark.sql import functions as F

from sessionloom.functions import diffs, ids, payload, redact, text
from sessionloom.sources import codex


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first()["v"]


def test_trim_takes_unicode_spaces_and_blank_is_null(spark):
    assert one(spark, text.text_or_null(F.col("t")), t=" ﻿a b\t\n") == "a b"
    assert one(spark, text.text_or_null(F.col("t")), t=" \n﻿") is None


def test_utf16_length_counts_surrogates(spark):
    assert one(spark, text.utf16_length(F.col("t")), t="a\U0001f600b") == 4


def test_clip_is_two_longer_than_its_limit(spark):
    assert one(spark, text.clip(F.col("t"), 5), t="abcdef") == "abcd..."
    assert one(spark, text.clip(F.col("t"), 5), t="abcde") == "abcde"


def test_labels(spark):
    assert [one(spark, text.token_label(F.lit(n))) for n in (999, 1234, 11_600)] == ["999", "1.2k", "12k"]
    assert one(spark, text.time_ago(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:00:01").cast("timestamp"))) == "2h ago"
    assert one(spark, text.iso_millis(F.col("t"), F.lit("2020-01-01").cast("timestamp")), t="2024-05-06T07:08:09Z") == "2024-05-06T07:08:09.000Z"
    assert one(spark, text.iso_millis(F.col("t"), F.lit("2020-01-01").cast("timestamp")), t="no time") == "2020-01-01T00:00:00.000Z"
    assert one(spark, text.without_transcript(F.col("t"), ["##", "@@"]), t="say this @@ x ## y") == "say this"


def test_owner_repo_forms(spark):
    for url in ("https://h.example/o/r.git", "git@h.example:o/r.git", "ssh://git@h.example/o/r", "https://h.example/o/r/"):
        assert one(spark, text.owner_repo(F.col("t")), t=url) == "o/r"


def test_ids(spark):
    import hashlib

    expected = hashlib.sha256(b"codex_exec|no-thread|3|x|2024").hexdigest()[:24]
    assert one(spark, ids.event_id(F.lit("codex_exec"), F.lit(None).cast("string"), F.lit(3), F.lit("x"), F.lit("2024"))) == expected
    assert one(spark, ids.node_id(F.col("t")), t="zz-0000") == 1
    assert one(spark, ids.node_id(F.col("t")), t="a1") == int("a1" + "0" * 11, 16)
    assert one(spark, ids.roots_key(F.array(F.lit("/b"), F.lit("/a")))) == one(spark, ids.roots_key(F.array(F.lit("/a"), F.lit("/b"), F.lit("/a"))))


def test_redaction_of_token_families(spark):
    # put together here, so that none stands in the file
    secrets = ["sk-" + "a" * 24, "ghp_" + "b" * 24, "github_pat_" + "c" * 24, "AIza" + "d" * 30, "xoxb-" + "1" * 12, "AKIA" + "E" * 16]
    found = one(spark, redact.redact_text(F.col("t")), t=" ".join(secrets))
    assert not any(s in found for s in secrets) and "[REDACTED" in found
    assert redact.redact_string(" ".join(secrets)) == found


def test_redaction_applies_twice_to_an_assigned_token(spark):
    assert one(spark, redact.redact_text(F.col("t")), t="token: sk-" + "a" * 24) == "token: [REDACTED]]"


def test_redaction_of_headers_and_urls(spark):
    found = one(spark, redact.redact_text(F.col("t")), t="Authorization: Bearer " + "a" * 12 + " https://u:" + "p" * 6 + "@h.example/?api_key=" + "k" * 8)
    assert "[REDACTED_BEARER_TOKEN]" in found and "[REDACTED_URL_CREDENTIAL]:[REDACTED_URL_CREDENTIAL]@" in found and "api_key=[REDACTED]" in found


def test_json_redaction_goes_by_keys(spark):
    body = {"tokenEstimate": "24k", "session_id": "s1", "sessionId": "s2", "api_key": ["x", {"note": "y"}], "password": 5, "deep": {"client-secret": "z"}}
    found = json.loads(one(spark, redact.redact_payload(F.col("t")), t=json.dumps(body)))
    assert found == {"tokenEstimate": "24k", "session_id": "[REDACTED]", "sessionId": "s2", "api_key": ["[REDACTED]", {"note": "y"}], "password": 5, "deep": {"client-secret": "[REDACTED]"}}
    assert one(spark, redact.redact_payload(F.col("t")), t="{no json token=abcdefgh") == "{no json token=[REDACTED]"
    assert list(json.loads(redact.redact_json('{"b":1,"a":2}'))) == ["b", "a"]


def test_event_texts(spark):
    rows = [
        ("prompt.submitted", {"prompt": [{"text": " hi "}, "there"]}, "unavailable", ("hi\nthere", None, None)),
        ("item.completed", {"item": {"type": "user_message", "role": "assistant", "text": "x"}}, "unavailable", (None, None, None)),
        ("item.completed", {"item": {"type": "reasoning"}}, "partial", (None, payload.NO_THOUGHT, None)),
        ("item.completed", {"item": {"type": "agent_message", "content": {"message": "m"}}}, "unavailable", (None, None, "m")),
        ("x", {"item": {}}, "full", (None, payload.PART_THOUGHT, None)),
        ("x", {"item": {"type": "tool_call", "name": "apply_patch", "arguments": {"q": 1}}}, "unavailable", (None, None, None, '{"q":1}', None)),
        ("x", {"item": {"type": "tool_result", "output": {"stderr": "e"}}}, "unavailable", (None, None, None, None, "e")),
    ]
    df = spark.createDataFrame([(i, a, json.dumps(b), c) for i, (a, b, c, _) in enumerate(rows)], "i int, e string, p string, r string")
    found = df.select("i", payload.event_texts("e", "p", "r").alias("t")).orderBy("i").collect()
    assert [tuple(r["t"]) for r in found] == [(r[3] + (None, None))[:5] for r in rows]


def test_patch_lines_may_exceed_the_limit_by_one(spark):
    body = "\n".join(["+x"] * 3 + ["*** Update File: f", "+y"])
    assert one(spark, diffs.patch_lines(F.col("t"), 4), t=body) == ["+x", "+x", "+x", "--- a/f", "+++ b/f"]
    assert len(one(spark, diffs.patch_lines(F.col("t"), 280), t="\n".join(["+x"] * 400))) == 280


def test_unified_lines_and_classes(spark):
    body = "noise\ndiff --git a/x b/y\nindex 1\n--- a/x\n+++ b/y\n@@ 1\n ctx\n-old  \n+new\n+++z"
    assert one(spark, diffs.unified_lines(F.col("t")), t=body) == ["diff --git a/x b/y", "index 1", "--- a/x", "+++ b/y", "@@ 1", "-old", "+new"]
    assert one(spark, diffs.has_code(F.array(F.lit("+ a/b (+1 -2)"), F.lit("FILE + q")))) is False
    assert one(spark, diffs.file_label(F.col("t")), t="+ a/b (+1 -2)") == "a/b"


def test_paths_sort_as_people_read_them(spark):
    from sessionloom.operators import query

    df = spark.createDataFrame([("b",), ("B",), ("a",), ("_x",), ("é",), ("z",)], "path string")
    assert [r.path for r in query.by_path(df).collect()] == ["_x", "a", "b", "B", "é", "z"]


def test_imports_and_columns_read_patches_and_status_lines_alike(spark):
    rng = random.Random(4)
    heads = ["*** Add File: a.py", "*** Delete File:  b c ", "*** Update File: d/é.py", "*** Update File: ", " *** Add File: no", "*** Add File: a.py", "*** Move File: x", "+*** Add File: y"]
    marks = ["M a.py", "A  b", "D\tc", "D c d ", "  M e ", "M ", "MM f", "?? g", "A b", "M é", ""]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randrange(8))) for some in (heads, marks) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", diffs.patch_changes(F.col("t")).alias("p"), diffs.status_changes(F.col("t")).alias("s")).collect()
    for row in rows:
        assert [x.asDict() for x in row.p] == codex.patch_headers(row.t), row.t
        assert [x.asDict() for x in row.s] == codex.status_lines(row.t), row.t

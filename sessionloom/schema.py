"""The event envelope and the vocabulary of events and items."""

from __future__ import annotations

from pyspark.sql import types as T

#: Sources of events.
SOURCES = ("codex_sdk", "codex_exec", "codex_history", "claude_code_history", "gemini_cli_history")
#: How much of the reasoning is there.
REASONING = ("full", "partial", "unavailable")
#: Texts shown where nothing was captured, and a synthetic prompt's id.
NO_PROMPT = "(No prompt captured)"
NO_REASONING = "(No exposed reasoning text)"

#: One captured event. payload_json keeps the payload's text, whose key order hashes depend on. ts is compared as text.
#: arrival_seq is the order of arrival, which first-wins rules and ties depend on.
ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("repo_id", T.StringType()),
    T.StructField("actor_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload_json", T.StringType()),
    T.StructField("reasoning_availability", T.StringType()),
    T.StructField("arrival_seq", T.LongType()),
])

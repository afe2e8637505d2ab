"""Projections of events for a remote memory service: texts, compact payloads, activity envelopes, items."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..functions.payload import TEXT_KEYS, deep_text, load, strip
from ..functions.text import clip

#: UTF-16 units or entries that each field of a compact item keeps.
TEXT, ARGUMENTS, OUTPUT, PROMPT, EVENT_TEXT = 1800, 1200, 2000, 2000, 2000
CHANGES, LINES, LINE, SUMMARY_FILES, DIFF_FILES = 240, 220, 500, 300, 120


def clipped(text: str, limit: int) -> str:
    """text.clip() of one text."""
    units = text.encode("utf-16-be", "surrogatepass")
    return text if len(units) <= 2 * limit else units[: 2 * (limit - 1)].decode("utf-16-be", "ignore") + "..."


def _short(value, limit: int) -> str | None:
    found = deep_text(value, TEXT_KEYS["memory"])
    return found and clipped(found, limit)


def _name(value) -> str | None:
    return (strip(value) or None) if isinstance(value, str) else None


def _number(value):
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _pick(item: dict, texts=(), numbers=()) -> dict:
    found = {k: _name(item.get(k)) for k in texts} | {k: _number(item.get(k)) for k in numbers}
    return {k: v for k, v in found.items() if v is not None}


def _files(item: dict, limit: int) -> dict:
    rows = [{"path": _name(f.get("path")) or "(unknown)", "plus": _number(f.get("plus")) or 0, "minus": _number(f.get("minus")) or 0} for f in item.get("files") or [] if isinstance(f, dict)]
    return {"files": rows[:limit]} if rows else {}


def compact_item(item: dict, namespace: str) -> dict:
    """What is kept of an item, by its type."""
    kind = _name(item.get("type"))
    if kind == f"{namespace}_session_summary":
        return _pick(item, ("type", "snapshot_id", "session_id"), ("prompt_count", "file_count", "token_estimate")) | _files(item, SUMMARY_FILES)
    if kind == f"{namespace}_prompt_diff_part":
        out = _pick(item, ("type", "snapshot_id", "prompt_event_id"), ("prompt_id", "part_index", "part_count"))
        if isinstance(item.get("truncated"), bool):
            out["truncated"] = item["truncated"]
        lines = [clipped(x, LINE) for x in item.get("lines") or [] if isinstance(x, str) and x]
        return out | ({"lines": lines[:LINES]} if lines else {}) | _files(item, DIFF_FILES)
    out = _pick(item, ("type", "role", "name", "call_id"))
    text = next((t for t in (_short(item.get(k), TEXT) for k in ("text", "content", "message", "summary")) if t), None)
    for key, found in (("text", text), ("arguments", _short(item.get("arguments"), ARGUMENTS)), ("output", _short(item.get("output"), OUTPUT))):
        if found:
            out[key] = found
    changes = [{"path": _name(c.get("path")) or "(unknown)", "kind": _name(c.get("kind")) or "update"} for c in item.get("changes") or [] if isinstance(c, dict)] if isinstance(item.get("changes"), list) else []
    return out | ({"changes": changes[:CHANGES]} if changes else {})


def compact_payload(payload: str | None, namespace: str = "sessionloom") -> str:
    value = load(payload)
    value = value if isinstance(value, dict) else {}
    out: dict = {}
    prompt = _short(value.get("prompt"), PROMPT) or _short(value.get("input"), PROMPT)
    if prompt:
        out["prompt"] = prompt
    if isinstance(value.get("item"), dict):
        item = compact_item(value["item"], namespace)
        if item:
            out["item"] = item
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def event_text(event_type: Column, actor: Column, session: Column, payload_text: Column) -> Column:
    """What an event says, in one text of bounded length."""
    who = F.coalesce(F.concat(F.lit(" [actor:"), actor, F.lit("]")), F.lit(""))
    return F.when(payload_text.isNull(), F.concat(event_type, who, F.lit(" event in session "), session)).otherwise(F.concat(event_type, who, F.lit(": "), clip(payload_text, EVENT_TEXT)))


@F.pandas_udf(T.StringType())
def payload_text(payload_json: pd.Series) -> pd.Series:
    """The text of a payload's item, or of the payload."""

    def one(text):
        value = load(text)
        item = value.get("item") if isinstance(value, dict) else None
        return deep_text(item, TEXT_KEYS["memory"]) or deep_text(value, TEXT_KEYS["memory"])

    return payload_json.map(one, na_action="ignore")


def activities(events: DataFrame, namespace: str = "sessionloom", minimal: bool = False, run_id: Column | None = None, with_minimal: bool = False) -> DataFrame:
    """(run_id, event_id, schema, activity): the compact envelope of each event, or one with an empty payload.

    The run follows from the event (see ids.run_id) unless one is given. with_minimal adds the other one as `minimal`.
    """

    @F.pandas_udf(T.StringType())
    def compacted(payload_json: pd.Series) -> pd.Series:
        return payload_json.map(lambda p: compact_payload(p, namespace))

    compact_name, minimal_name = f"{namespace}_event.v2", f"{namespace}_event.min"
    head = F.to_json(F.struct(*(F.col(old).alias(new) for old, new in (("event_id", "eventId"), ("source", "source"), ("repo_id", "repoId"), ("actor_id", "actorId"), ("session_id", "sessionId"), ("thread_id", "threadId"), ("ts", "ts"), ("event_type", "eventType"), ("reasoning_availability", "reasoningAvailability")))), {"ignoreNullFields": "false"})

    def enveloped(name: str, body: Column) -> Column:
        event = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), body, F.lit("}"))
        return F.concat(F.lit(f'{{"schema":"{name}","event":'), event, F.lit("}"))

    small = enveloped(minimal_name, F.lit("{}"))
    whole = small if minimal else enveloped(compact_name, compacted("payload_json"))
    run = ids.run_id(F.col("event_type"), F.col("repo_id"), F.col("session_id"), namespace) if run_id is None else run_id
    beside = [small.alias("minimal")] if with_minimal else []
    return events.select(run.alias("run_id"), "event_id", F.lit(minimal_name if minimal else compact_name).alias("schema"), whole.alias("activity"), *beside)


def prompt_activities(events: DataFrame, namespace: str = "sessionloom") -> DataFrame:
    """Prompts again, for the prompts' own run."""
    prompts = events.where("event_type = 'prompt.submitted'")
    return activities(prompts, namespace, run_id=ids.prompt_run_id(F.col("repo_id"), namespace)).withColumn("schema", F.lit(f"{namespace}_prompt.v1"))


def memory_items(events: DataFrame, namespace: str = "sessionloom", project: str | None = None, default_actor: str | None = None, scope: str = "session") -> DataFrame:
    """(run_id, item_id, node_id, text, payload_json, metadata_json, source): one item for each event."""
    meta = F.to_json(F.struct("repo_id", F.coalesce(F.lit(project), "repo_id").alias("project_id"), F.coalesce("actor_id", F.lit(default_actor)).alias("actor_id"), "session_id", "thread_id", "ts", "source", "event_type", "reasoning_availability"))
    said = event_text(F.col("event_type"), F.col("actor_id"), F.col("session_id"), payload_text("payload_json"))
    return events.select(ids.run_id(F.col("event_type"), F.col("repo_id"), F.col("session_id"), namespace, scope, project).alias("run_id"), F.col("event_id").alias("item_id"), ids.node_id(F.col("event_id")).alias("node_id"), said.alias("text"), "payload_json", meta.alias("metadata_json"), "source")

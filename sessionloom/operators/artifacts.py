"""Session summaries and diff parts as events of their own, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

SUMMARY_FILES, DIFF_FILES, READ_FILES = 300, 120, 240
DIFF_LINES, PART_LINES, READ_LINES = 2000, 160, 220
FILES = "array<struct<path: string, plus: bigint, minus: bigint>>"


def summary_events(sessions: DataFrame, namespace: str = "sessionloom") -> DataFrame:
    """An event for each row of (repo_id, actor_id, session_id, to_ts, prompt_count, file_count, token_estimate, files).

    The id follows from the content, so publishing the same analysis again gives the same event.
    """
    files = F.slice("files", 1, SUMMARY_FILES).cast(FILES)
    core = [F.lit(2).alias("schema_version"), F.col("session_id"), F.col("prompt_count"), F.col("file_count"), F.col("token_estimate"), files.alias("files")]
    snapshot = ids.short_hash(F.to_json(F.struct(*core)))
    item = F.struct(F.lit(f"{namespace}_session_summary").alias("type"), F.col("snapshot_id"), *core)
    rows = sessions.withColumn("snapshot_id", snapshot)
    return rows.select(
        F.concat_ws("-", F.lit(f"{namespace}-session-summary-v2"), "session_id", "snapshot_id").alias("event_id"), F.lit("codex_exec").alias("source"), "repo_id", "actor_id", "session_id", F.lit(None).cast("string").alias("thread_id"), F.col("to_ts").alias("ts"),
        F.lit(f"{namespace}.session.summary").alias("event_type"), F.to_json(F.struct(item.alias("item"), F.lit(f"{namespace}_session_stream").alias("source"))).alias("payload_json"), F.lit("unavailable").alias("reasoning_availability"),
    )


def diff_part_events(prompts: DataFrame, namespace: str = "sessionloom") -> DataFrame:
    """Events for the diffs of (repo_id, actor_id, session_id, prompt_id, prompt_event_id, ts, files, diff_lines).

    At most DIFF_LINES lines, in parts of PART_LINES; files are in the first part. Prompts without lines and files give none.
    """
    rows = prompts.withColumns({"lines": F.slice("diff_lines", 1, DIFF_LINES), "files": F.slice("files", 1, DIFF_FILES).cast(FILES), "truncated": F.size("diff_lines") > DIFF_LINES}).where((F.size("lines") > 0) | (F.size("files") > 0))
    rows = rows.withColumn("snapshot_id", ids.short_hash(F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.col("session_id").alias("sessionId"), F.col("prompt_id").alias("promptId"), F.col("prompt_event_id").alias("promptEventId"), "files", "lines", "truncated"))))
    count = F.greatest(F.lit(1), F.ceil(F.size("lines") / PART_LINES)).cast("int")
    rows = rows.withColumn("part_count", count).withColumn("part_index", F.explode(F.sequence(F.lit(0), F.col("part_count") - 1)))
    part = F.slice("lines", F.col("part_index") * PART_LINES + 1, PART_LINES)
    item = F.struct(F.lit(f"{namespace}_prompt_diff_part").alias("type"), F.col("snapshot_id"), F.lit(2).alias("schema_version"), F.col("prompt_id"), F.col("prompt_event_id"), F.col("part_index"), F.col("part_count"), F.col("truncated"), F.when(F.col("part_index") == 0, F.col("files")).alias("files"), part.alias("lines"))
    return rows.select(
        F.concat_ws("-", F.lit(f"{namespace}-prompt-diff-v2"), "session_id", F.coalesce("prompt_event_id", F.col("prompt_id").cast("string")), "snapshot_id", F.col("part_index").cast("string")).alias("event_id"), F.lit("codex_exec").alias("source"), "repo_id", "actor_id", "session_id",
        F.lit(None).cast("string").alias("thread_id"), "ts", F.lit(f"{namespace}.prompt.diff.part").alias("event_type"), F.to_json(F.struct(item.alias("item"), F.lit(f"{namespace}_diff_stream").alias("source"))).alias("payload_json"), F.lit("unavailable").alias("reasoning_availability"),
    )


def _number(v: Column, path: str) -> Column:
    """A number or a text of an integer, at least 0."""
    n = F.coalesce(F.try_variant_get(v, path, "bigint"), F.try_variant_get(v, path, "double").cast("bigint"))
    return F.when(n.isNotNull(), F.greatest(n, F.lit(0)))


def _files(v: Column, limit: int) -> Column:
    rows = F.try_variant_get(v, "$.item.files", FILES)
    good = F.filter(rows, lambda f: f["path"].isNotNull())
    return F.slice(F.transform(good, lambda f: F.struct(f["path"].alias("path"), F.greatest(F.coalesce(f["plus"], F.lit(0)), F.lit(0)).alias("plus"), F.greatest(F.coalesce(f["minus"], F.lit(0)), F.lit(0)).alias("minus"))), 1, limit)


def read_summaries(events: DataFrame, namespace: str = "sessionloom") -> DataFrame:
    """Counts and files of summary events; those without any are left out."""
    v = F.try_parse_json("payload_json")
    rows = events.withColumn("__v", v).where(F.try_variant_get("__v", "$.item.type", "string") == f"{namespace}_session_summary")
    out = rows.select("repo_id", "session_id", "ts", "arrival_seq", *(_number(F.col("__v"), f"$.item.{c}").alias(c) for c in ("prompt_count", "file_count", "token_estimate")), _files(F.col("__v"), SUMMARY_FILES).alias("files"))
    return out.where(F.coalesce("prompt_count", "file_count", "token_estimate").isNotNull() | (F.size("files") > 0))


def read_diff_parts(events: DataFrame, namespace: str = "sessionloom") -> DataFrame:
    """Parts with a snapshot id and lines or files."""
    g = lambda p, kind: F.try_variant_get("__v", f"$.item.{p}", kind)
    rows = events.withColumn("__v", F.try_parse_json("payload_json")).where(F.try_variant_get("__v", "$.item.type", "string") == f"{namespace}_prompt_diff_part")
    out = rows.select("repo_id", "session_id", "ts", "arrival_seq", g("snapshot_id", "string").alias("snapshot_id"), g("prompt_id", "bigint").alias("prompt_id"), g("prompt_event_id", "string").alias("prompt_event_id"), F.greatest(F.coalesce(g("part_index", "bigint"), F.lit(0)), F.lit(0)).alias("part_index"), F.greatest(F.coalesce(g("part_count", "bigint"), F.lit(1)), F.lit(1)).alias("part_count"), F.coalesce(g("truncated", "boolean"), F.lit(False)).alias("truncated"), F.slice(F.coalesce(g("lines", "array<string>"), F.array().cast("array<string>")), 1, READ_LINES).alias("lines"), _files(F.col("__v"), DIFF_FILES).alias("files"))
    return out.where(F.col("snapshot_id").isNotNull() & ((F.size("lines") > 0) | (F.size("files") > 0)))

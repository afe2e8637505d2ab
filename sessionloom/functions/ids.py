"""Identifiers of events, repositories and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_null


def event_id(source: Column, thread_id: Column, sequence: Column, event_type: Column, ts: Column) -> Column:
    """24 hex digits of a SHA-256 over the event's coordinates."""
    seed = F.concat_ws("|", source, F.coalesce(thread_id, F.lit("no-thread")), sequence.cast("string"), event_type, ts)
    return F.substring(F.sha2(seed, 256), 1, 24)


def repo_id(path: Column) -> Column:
    """12 hex digits of the SHA-1 of an absolute path."""
    return F.substring(F.sha1(path), 1, 12)


def roots_key(roots: Column) -> Column:
    """A key of a set of project roots that doesn't depend on their order."""
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(roots)), "\n"))


def short_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def node_id(event: Column) -> Column:
    """A positive number from the first 13 hex digits of an event id."""
    digits = F.rpad(F.regexp_replace(event, "[^a-fA-F0-9]", ""), 13, "0")
    return F.greatest(F.conv(F.substring(digits, 1, 13), 16, 10).cast("long"), F.lit(1).cast("long"))


def run_id(event_type: Column, repo: Column, session: Column, namespace: str = "sessionloom", scope: str = "session", project: str | None = None) -> Column:
    """The run that an event is written to: summaries and diffs have runs of their own, other events their session's or project's."""
    owner = F.lit(project) if project else repo
    main = F.concat_ws(":", F.lit(namespace), owner) if scope == "project" else F.concat_ws(":", F.lit(namespace), owner, session)
    return F.when(event_type == f"{namespace}.session.summary", F.concat_ws(":", F.lit(f"{namespace}-sessions"), owner)).when(event_type == f"{namespace}.prompt.diff.part", F.concat_ws(":", F.lit(f"{namespace}-diffs"), owner)).otherwise(main)


def prompt_run_id(repo: Column, namespace: str = "sessionloom") -> Column:
    return F.concat_ws(":", F.lit(f"{namespace}-prompts"), repo)


def actor(c: Column) -> Column:
    return text_or_null(c)

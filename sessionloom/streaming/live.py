"""Sessions followed while they run: each event's slice and thought, as the analysis of the whole session would number them.

State is seven values for each session (how many prompts and thoughts were there, how many lines are kept, the last event),
in the RocksDB state store. A micro-batch brings a session's new events to one task, as its windows do in a batch; they
are put in order there. An event that comes after a later one of an earlier batch is marked late and goes to the slice that
is open: its session's numbers are right again once refresh.refresh() has analysed it from the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import analysis

_STATE = "leading long, opened long, thoughts long, thought_lines long, prompt_lines long, ts string, seq long"
_NEW = (0, 0, 0, 0, 0, None, None)
#: Columns of followed events.
FOLLOWED = "repo_id string, session_id string, event_id string, actor_id string, ts string, arrival_seq long, prompt_id long, thought_no long, kind string, text string, thought_lines array<string>, prompt_lines array<string>, late boolean"


def advance(state: tuple, events: list[dict], thought_limit: int = analysis.THOUGHT_LINES, prompt_limit: int = analysis.PROMPT_LINES) -> tuple[tuple, list[dict]]:
    """(the state after some events of a session, these in order with their slice, thought and the lines that are kept)."""
    leading, opened, thoughts, in_thought, in_prompt, last_ts, last_seq = state
    out = []
    for event in sorted(events, key=lambda e: (e["ts"] is not None, e["ts"] or "", e["arrival_seq"])):
        first = last_seq is None
        place = (event["ts"] is not None, event["ts"] or "", event["arrival_seq"])
        late = not first and place < (last_ts is not None, last_ts or "", last_seq)
        is_prompt, is_thought = event["kind"] == "prompt", event["kind"] == "thought"
        if first:
            leading = int(not is_prompt)
        if is_prompt:
            opened, thoughts, in_thought, in_prompt = opened + 1, 0, 0, 0
        if is_thought:
            thoughts += 1
            if thoughts > 1:  # lines before the first thought are its own
                in_thought = 0
        lines = list(event["lines"])
        mine, whole = lines[: max(0, thought_limit - in_thought)], lines[: max(0, prompt_limit - in_prompt)]
        in_thought, in_prompt = in_thought + len(mine), in_prompt + len(whole)
        out.append({**event, "prompt_id": max(1, opened + leading), "thought_no": max(1, thoughts), "thought_lines": mine, "prompt_lines": whole, "late": late})
        if not late:
            last_ts, last_seq = event["ts"], event["arrival_seq"]
    return (leading, opened, thoughts, in_thought, in_prompt, last_ts, last_seq), out


class _Follower(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        found = [event for some in rows for event in some.astype(object).where(some.notna(), None).to_dict("records")] if rows else []
        state, out = advance(self._state.get() if self._state.exists() else _NEW, found)
        self._state.update(state)
        if out:
            yield pd.DataFrame(out)[[c.split()[0] for c in FOLLOWED.split(", ")]]

    def close(self) -> None:
        pass


def follow(events: DataFrame, namespace: str = "sessionloom") -> DataFrame:
    """A stream of FOLLOWED rows from a stream of envelopes, one for each event that is no stored artifact.

    kind is prompt, thought, answer or null, text what it says; thought_lines and prompt_lines are those of the event's diff
    lines that its thought and its slice keep. The session needs the RocksDB state store provider.
    """
    said = analysis.spoken(events, namespace)
    kind = F.when(F.col("prompt").isNotNull(), "prompt").when(F.col("thought").isNotNull(), "thought").when(F.col("answer").isNotNull(), "answer")
    rows = said.select("repo_id", "session_id", "event_id", "actor_id", "ts", "arrival_seq", kind.alias("kind"), F.coalesce("prompt", "thought", "answer").alias("text"), "lines")
    return rows.groupBy("repo_id", "session_id").transformWithStateInPandas(_Follower(), FOLLOWED, outputMode="Append", timeMode="None")

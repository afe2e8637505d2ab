"""Lines of Codex histories: (ts, session_id, cwd, actor_id, events)."""

from __future__ import annotations

import json
import re

from ..functions.diffs import PATCH_KINDS, STATUS_KINDS, header_pattern
from ..functions.payload import TEXT_KEYS, deep_text, load, strip

_HEADER = {kind: re.compile(header_pattern(word)) for word, kind in PATCH_KINDS.items()}


def name(value) -> str | None:
    return (strip(value) or None) if isinstance(value, str) else None


def unique(changes: list[tuple[str, str]]) -> list[dict]:
    return [{"path": path, "kind": kind} for path, kind in dict.fromkeys(changes)]


def patch_headers(text: str) -> list[dict]:
    return unique([(strip(path), kind) for kind, pattern in _HEADER.items() for path in pattern.findall(text)])


def status_lines(text: str) -> list[dict]:
    lines = (strip(x) for x in text.split("\n"))
    return unique([(strip(x[2:]), STATUS_KINDS[x[0]]) for x in lines if len(x) > 2 and x[0] in STATUS_KINDS and x[1] == " " and strip(x[2:])])


def changed(changes: list[dict]) -> list[tuple[str, dict]]:
    return [("item.completed", {"item": {"type": "file_change", "changes": changes}})] if changes else []


def said(kind: str, text: str | None, **more) -> list[tuple[str, dict]]:
    return [("item.completed", {"item": {"type": kind, **more, "text": text}})] if text else []


def _text(*values) -> str | None:
    return next((t for t in (deep_text(v, TEXT_KEYS["codex"]) for v in values) if t), None)


def _patch(tool: str | None, arguments) -> str | None:
    if tool == "apply_patch":
        return _text(arguments) or (arguments if isinstance(arguments, str) else json.dumps(arguments))
    if tool != "exec_command":
        return None
    inner = arguments if isinstance(arguments, dict) else load(arguments) if isinstance(arguments, str) else None
    if isinstance(inner, dict) and isinstance(inner.get("cmd"), str):
        return inner["cmd"]
    return arguments if isinstance(arguments, str) else None


def _response(p: dict) -> list[tuple[str, dict]]:
    kind = name(p.get("type"))
    if kind == "reasoning":
        return said("reasoning", _text(p.get("content"), p.get("summary")))
    if kind == "function_call":
        tool = name(p.get("name"))
        patch = _patch(tool, p.get("arguments"))
        call = ("item.completed", {"item": {"type": "tool_call", "name": tool, "arguments": p.get("arguments")}})
        return [call, *changed(patch_headers(patch) if patch and "*** Begin Patch" in patch else [])]
    if kind == "function_call_output":
        text = _text(p.get("output"))
        result = ("item.completed", {"item": {"type": "tool_result", "call_id": p.get("call_id"), "output": text if text is not None else p.get("output")}})
        return [result, *changed(status_lines(text) if text else [])]
    if kind == "message" and name(p.get("role")) == "assistant" and name(p.get("phase")) == "final_answer":
        return said("agent_message", _text(p.get("content")))
    return []


def _message(p: dict) -> list[tuple[str, dict]]:
    kind = name(p.get("type"))
    if kind == "user_message":
        prompt = _text(p.get("message"), p.get("text"))
        return [("prompt.submitted", {"prompt": prompt, "source": "codex_history"})] if prompt else []
    if kind == "agent_reasoning":
        return said("reasoning", _text(p.get("text"), p.get("message")))
    if kind == "agent_message":
        return said("agent_message", _text(p.get("message"), p.get("text")))
    return [("turn.completed", {"turnId": name(p.get("turn_id"))})] if kind == "task_complete" else []


def project_codex(line: dict) -> tuple:
    kind, p = name(line.get("type")), line.get("payload")
    p = p if isinstance(p, dict) else {}
    session = cwd = None
    events: list = []
    if kind == "session_meta":
        session, cwd = name(p.get("id")), name(p.get("cwd"))
        events = [("thread.started", {"thread_id": session, "cwd": cwd, "source": p.get("source"), "originator": p.get("originator")})]
    elif kind == "turn_context":
        events = [("turn.started", {"turnId": name(p.get("turn_id")), "cwd": p.get("cwd"), "model": p.get("model")})]
    elif kind == "event_msg":
        events = _message(p)
    elif kind == "response_item":
        events = _response(p)
    return name(line.get("timestamp")), session, cwd, None, events

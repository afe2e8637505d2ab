"""Redaction of secrets: ordered patterns as one chain of built-in replacements, and a walk over JSON payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

# The patterns and what replaces them, in the order in which they apply.
# The label of memory keys is this project's own: the service that they belong to goes unnamed here.
# $1, $2 and so on stand for groups. No pattern looks around, so Java, Python and RE2 read them alike.
_PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
_PEM_NAMED = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
RULES: list[tuple[str, str]] = [
    (_PEM, "[REDACTED_PRIVATE_KEY_BLOCK]"),
    (_PEM_NAMED, "[REDACTED_PRIVATE_KEY_BLOCK]"),
    (r'(?i)("private_key"\s*:\s*")([\s\S]*?)(")', "$1[REDACTED_PRIVATE_KEY]$3"),
    (r"\bmbt_[A-Za-z0-9._-]{20,}\b", "[REDACTED_MEMORY_KEY]"),
    (r"\bsk-ant-[A-Za-z0-9._-]{16,}\b", "[REDACTED_API_KEY]"),
    (r"\bsk-[A-Za-z0-9._-]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\bgh(?:p|o|u|s|r)_[A-Za-z0-9]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\bAIza[0-9A-Za-z\-_]{20,}\b", "[REDACTED_API_KEY]"),
    (r"(?i)\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED_API_KEY]"),
    (r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{16}\b", "[REDACTED_API_KEY]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[REDACTED_JWT]"),
    (r"(?i)(authorization\s*[:=]\s*(?:bearer|token)\s+)([^\s\"',;]{8,})", "$1[REDACTED_BEARER_TOKEN]"),
    (r"(?i)(authorization\s*[:=]\s*basic\s+)([A-Za-z0-9+/=]{8,})", "$1[REDACTED]"),
    (r"(?i)([?&](?:api[_-]?key|token|access[_-]?token|refresh[_-]?token|secret|password)=)([^&#\s]+)", "$1[REDACTED]"),
    (r"(?i)(\bhttps?:\/\/)([^\/\s:@]+):([^@\s\/]+)@", "$1[REDACTED_URL_CREDENTIAL]:[REDACTED_URL_CREDENTIAL]@"),
    (r"(?i)(\baws(?:_|-)?secret(?:_|-)?access(?:_|-)?key\b\s*[:=]\s*[\"']?)([^\s\"']{16,})", "$1[REDACTED]"),
    (r"\b([A-Z0-9_]*(?:API_KEY|APIKEY|TOKEN|SECRET|PASSWORD|PASSWD|PRIVATE_KEY|ACCESS_KEY|REFRESH_TOKEN|SESSION_TOKEN)[A-Z0-9_]*)\s*=\s*(\"[^\"]{4,}\"|'[^']{4,}'|[^\s\"']{4,})", "$1=[REDACTED]"),
    (r"(?im)(^|[\s,{(\[])((?:api[_-]?key|access[_-]?token|refresh[_-]?token|session[_-]?token|client[_-]?secret|private[_-]?key|password|passwd|pwd|token|secret))(\s*[:=]\s*[\"']?)([^\s\"',}\])]{6,})", "$1$2$3[REDACTED]"),
]
#: Fixed value: names of keys whose text is a secret.
SENSITIVE_KEY = r"(?i)(?:^|[_-])(api(?:[_-]?key)?|apikey|token|secret|password|passwd|pwd|authorization|auth|private(?:[_-]?key)?|client(?:[_-]?secret)?|access(?:[_-]?token)?|refresh(?:[_-]?token)?|session(?:[_-]?token)?)(?:$|[_-])"

_COMPILED = [(re.compile(pattern, re.ASCII), re.sub(r"\$(\d)", r"\\\1", to)) for pattern, to in RULES]
_KEY = re.compile(SENSITIVE_KEY)


def redact_text(c: Column) -> Column:
    """All patterns in their order, inside generated code. A second pattern may hit what an earlier one left."""
    for pattern, to in RULES:
        c = F.regexp_replace(c, pattern, to)
    return c


def redact_string(text: str) -> str:
    for pattern, to in _COMPILED:
        text = pattern.sub(to, text)
    return text


def _walk(value, secret: bool = False):
    """Text under a sensitive key goes whole; arrays pass their key on, objects' own keys replace it; numbers stay."""
    if isinstance(value, str):
        return REDACTED if secret else redact_string(value)
    if isinstance(value, list):
        return [_walk(x, secret) for x in value]
    if isinstance(value, dict):
        return {k: _walk(v, bool(k and _KEY.search(k))) for k, v in value.items()}
    return value


def redact_json(text: str | None) -> str | None:
    """A JSON text with its texts redacted; any other text by the patterns."""
    if text is None:
        return None
    head = text.strip()
    if len(head) > 1 and head[0] in "{[":
        try:
            return json.dumps(_walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            pass
    return redact_string(text)


@F.pandas_udf(T.StringType())
def redact_payload(payload: pd.Series) -> pd.Series:
    """Payloads and raw lines, keys in their order."""
    return payload.map(redact_json, na_action="ignore")

"""Lenient JSON: objects out of running text, and truncated ones closed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def closed(text: str) -> str:
    """``text`` with an open string and open brackets closed, and what hangs at its end taken off."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted = not (c == '"' and not escaped)
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    out = text + ('"' if quoted else "")
    out = re.sub(r"[,\s]+$", "", out)
    if re.search(r":\s*$", out):
        out += "null"
    if stack and stack[-1] == "}" and re.search(r'[{,]\s*"(?:[^"\\]|\\.)*"\s*$', out):
        out += ":null"
    return out + "".join(reversed(stack))


def balanced_object(text: str) -> str | None:
    """The first balanced object or array in ``text``."""
    for start, c in enumerate(text):
        if c in "{[":
            depth, quoted, escaped = 0, False, False
            for end in range(start, len(text)):
                x = text[end]
                if quoted:
                    quoted = not (x == '"' and not escaped)
                    escaped = x == "\\" and not escaped
                elif x == '"':
                    quoted = True
                elif x in "{[":
                    depth += 1
                elif x in "}]":
                    depth -= 1
                    if depth == 0:
                        return text[start : end + 1]
            return None
    return None


def extracted(text: str | None) -> str | None:
    """Canonical JSON found in ``text``: itself, inside a fence, the first balanced object, or the rest repaired."""
    if not text:
        return None
    fence = _FENCE.search(text)
    start = re.search(r"[{\[]", text)
    tries = [text, fence and fence[1], balanced_object(text), start and closed(text[start.start() :])]
    for t in tries:
        if not t:
            continue
        try:
            got = json.loads(t)
        except ValueError:
            continue
        if isinstance(got, dict | list):
            return json.dumps(got, ensure_ascii=False, sort_keys=True)
    return None


def extract_json(text: Column) -> Column:
    """Column of :func:`extracted`; well-formed objects are not sent to Python."""

    @F.pandas_udf(StringType())
    def repair(s: pd.Series) -> pd.Series:
        return s.map(extracted)

    return repair(text)

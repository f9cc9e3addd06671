"""Reading JSON that a writer left slightly broken, as a column."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEHIND_STRING = re.compile(r"""\s*+(?:\Z|:\s*+["{\[\-tfn0-9]|,\s*+["{\[]|[}\]][}\]\s]*+(?:,|\Z))""")
#: What counts when a balanced object is sought: whole strings, the quote of one that is cut off, braces.
OBJECT_MARK = re.compile(r'"(?:[^"\\]|\\.)*+"|["{}]', re.S)
DECODED = T.StructType([T.StructField("value", T.StringType()), T.StructField("fault", T.StringType())])


def first_object(text: str) -> str | None:
    """The first balanced ``{...}``, braces inside strings not counted."""
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def repaired(text: str) -> str:
    """Strings with bare quotes, control characters and invalid escapes made valid.

    A quote ends a string only if what follows it may stand behind a string: the
    end, a colon before a value, a comma before a string, object or array, or
    closing brackets before a comma or the end.
    """
    out, quoted, i = [], False, 0
    while i < len(text):
        c = text[i]
        if not quoted:
            quoted = c == '"'
            out.append(c)
        elif c == "\\":
            follow = text[i + 1 : i + 2]
            valid = follow in '"\\/bfnrt' if follow != "u" else len(text[i + 2 : i + 6]) == 4 and all(x in "0123456789abcdefABCDEF" for x in text[i + 2 : i + 6])
            out.append(c + follow if valid and follow else "\\\\")
            i += bool(valid and follow)
        elif c == '"':
            quoted = not BEHIND_STRING.match(text, i + 1)
            out.append('\\"' if quoted else c)
        else:
            out.append(json.dumps(c)[1:-1] if c < " " else c)
        i += 1
    return "".join(out)


def decode(text: str | None) -> tuple[str | None, str | None]:
    """(compact JSON, null) or (null, why not): empty, truncated or invalid."""
    body = (text or "").strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    if not body:
        return None, "empty"
    for attempt in (body, repaired(body), first_object(body) or "", first_object(repaired(body)) or ""):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":")), None
        except ValueError:
            continue
    return None, "truncated" if body.count("{") > body.count("}") else "invalid"


@F.pandas_udf(DECODED)
def decode_json(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([decode(t) for t in texts], columns=["value", "fault"])


def complete_objects(text: str | None, field: str) -> list[str]:
    """The complete objects, as JSON, of the array that ``field`` names in a text that may be cut off.

    Other elements and objects that are no JSON are passed over; the first ``]`` outside objects ends the array.
    """
    start = (text or "").find(f'"{field}"')
    at = text.find("[", start) + 1 if start >= 0 else 0
    out = []
    while at > 0 and (m := re.compile(r"[{\]]").search(text, at)) and m[0] == "{":
        depth, at = 0, 0
        for mark in OBJECT_MARK.finditer(text, m.start()):
            if mark[0] == '"':
                break
            depth += {"{": 1, "}": -1}.get(mark[0], 0)
            if not depth:
                at = mark.end()
                break
        try:
            out.append(json.dumps(json.loads(text[m.start() : at], parse_constant=_no_value), separators=(",", ":"), ensure_ascii=False))
        except ValueError:
            continue
    return out


def _no_value(name: str):
    raise ValueError(name)


def array_prefix(text: Column, field: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([complete_objects(t, field) for t in texts])

    return found(text)

"""Positions in generated files resolved through source maps (base 64 VLQ segments), in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

_DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
KIND = "source string, line int"


def segments(text: str) -> list[int]:
    """The signed numbers of one segment."""
    out, value, shift = [], 0, 0
    for c in text:
        d = _DIGITS[c]
        value |= (d & 31) << shift
        shift += 5
        if not d & 32:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return out


def resolve(content: str | None, line: int, column: int | None) -> tuple[str | None, int]:
    """(source, line) of a generated position. Without a column, or a mapping at or before it: the first source
    outside of installed packages, and the line as it is."""
    try:
        m = json.loads(content)
        sources = m["sources"]
        rest = next((s for s in sources if "node_modules" not in s), None)
    except (TypeError, ValueError, KeyError):
        return None, line
    best = None
    if column is not None and isinstance(m.get("mappings"), str):
        source = original = 0
        for number, row in enumerate(m["mappings"].split(";"), 1):
            at = 0
            for text in filter(None, row.split(",")):
                try:
                    s = segments(text)
                except KeyError:
                    return rest, line
                at += s[0]
                if len(s) >= 4:
                    source, original = source + s[1], original + s[2]
                    if number == line and at <= column:
                        best = source, original + 1
            if number >= line:
                break
    if best and 0 <= best[0] < len(sources):
        return sources[best[0]], best[1]
    return rest, line


def resolved(content, line, column):
    """struct(source, line) of columns, in Arrow batches."""

    def run(contents: pd.Series, lines: pd.Series, columns: pd.Series) -> pd.DataFrame:
        rows = [
            resolve(c, int(n or 0), None if pd.isna(k) else int(k))
            for c, n, k in zip(contents, lines, columns, strict=True)
        ]
        return pd.DataFrame(rows, columns=["source", "line"])

    return F.pandas_udf(run, KIND)(content, line, column)

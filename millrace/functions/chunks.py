"""Lossless cuts of texts into bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("content", T.StringType())]))


def char_start(data: bytes, at: int) -> int:
    """``at``, or before it the beginning of the character that it would cut."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cut(data: bytes, most: int, boundaries: list[int] = (), least: int = 0) -> list[bytes]:
    """Pieces of at most ``most`` bytes whose concatenation is ``data``.

    A cut is at the last boundary more than ``least`` bytes on, else after the
    last line end, else between characters.
    """
    out, start, b = [], 0, 0
    while start < len(data):
        end = min(start + most, len(data))
        if end < len(data):
            best = 0
            while b < len(boundaries) and boundaries[b] <= end:
                if boundaries[b] > start + least:
                    best = boundaries[b]
                b += 1
            line = data.rfind(b"\n", start, end) + 1
            end = best or (line if line > start else 0) or char_start(data, end)
            b = max(0, b - 1)
            if end <= start:  # a character longer than the limit
                end = start + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
        out.append(data[start:end])
        start = end
    return out


def numbered(pieces: list[bytes]) -> list[dict]:
    line, out = 1, []
    for p in pieces:
        lines = p.count(b"\n")
        out.append({"start_line": line, "end_line": line + lines - (lines > 0 and p.endswith(b"\n")), "content": p.decode("utf-8", "replace")})
        line += lines
    return out


@F.pandas_udf(CHUNK)
def _chunks(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, boundaries, most, least in batches:
        yield pd.Series([numbered(cut((t or "").encode(), m, [int(x) for x in b], n)) for t, b, m, n in zip(text, boundaries, most, least, strict=True)])


def chunk_text(text: Column, boundaries: Column | None = None, most: int = 12_000, least: int = 4_000) -> Column:
    """Chunks with their lines; ``boundaries`` are sorted byte offsets at which cuts are best."""
    return _chunks(text, F.array().cast("array<int>") if boundaries is None else boundaries, F.lit(most), F.lit(least))


def segments(text: Column, most: int) -> Column:
    """Segments of at most ``most`` bytes (four at least), cut after line ends where possible."""
    return _chunks(text, F.array().cast("array<int>"), F.lit(max(most, 4)), F.lit(0))

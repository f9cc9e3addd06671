"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 1 << 20


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where this machine keeps a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` by ``folds``; null keys are in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, the same ones in any order or partitioning of ``df``.

    A hash of the key takes all rows of a key or none. If keys repeat so often
    that this gives over twice or under half of ``rows``, rows are drawn one by one instead.
    """
    if total <= rows:
        return df
    bound = int(rows / total * (1 << 30))
    chosen = df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < bound)
    return chosen if rows / 2 <= chosen.select(key).count() <= 2 * rows else df.sample(rows / total, seed=7)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts are about ``limit`` bytes together; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it can give freed memory back; else None."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` whose freed memory goes back to the system: Python workers live on, and one stage's arrays are no use to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if (libc := _libc()) is not None:
            libc.malloc_trim(0)

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one array of bytes, and where each begins (and the end)."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def padded_slice(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column with one byte ``pad`` before each, and where each of these pads is."""
    data, starts = text_bytes(column)
    n = len(column)
    out = np.full(len(data) + n, pad, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(starts))] = data
    return out, starts[:-1] + np.arange(n)

"""Texts of an Arrow batch as byte arrays, and numpy arrays as binary values."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 4 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns the operators read: ``doc_id`` BIGINT and the text's UTF-8 bytes.

    All other columns stay behind, so their names cannot clash.
    """
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(F.col(text)).alias("text"))


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: Column) -> Column:
    return text.cast("string").cast("binary")


def give_back() -> None:
    """Return memory that Arrow and the C library keep for reuse: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES,
           text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        del batch
        give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or text column one after another, and each row's offset; null is empty."""
    if column.null_count:
        text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        column = column.fill_null("" if text else b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0]: offsets[-1]], offsets - offsets[0]


def pack(values: np.ndarray) -> bytes:
    """Values of one type, byte planes apart so that small or sorted numbers compress well."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)

"""Shared helpers: table reads, stable splits, word splitting and hashing over Arrow text columns.

Texts are handled as UTF-8 byte buffers. A *word class* is a table of 256 booleans saying which bytes
belong to words, so a whole Arrow batch is split into words by a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18  # bytes hashed at a time; a worker keeps tables of sixteen times as much
TEXT_BYTES = 1 << 22  # bytes of texts split at a time
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that other columns never leave the scan."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def word_class(separators: bytes = b"", *, alphanumeric: bool = False) -> np.ndarray:
    """Bytes of words: all but ``separators``, or ASCII letters and digits and everything above ASCII."""
    table = np.ones(256, dtype=bool)
    if alphanumeric:
        table[:128] = False
        table[48:58] = table[65:91] = table[97:123] = True
    table[list(separators)] = False
    return table


WHITESPACE = b" \t\n\x0b\x0c\r"
SPACED = word_class(WHITESPACE)
ALPHANUMERIC = word_class(alphanumeric=True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(column: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, starts and ends of all words, and n + 1 offsets of each text's words."""
    data, offsets = text_buffer(column)
    size = len(data)
    inside = word_bytes[data]
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offsets[(offsets > 0) & (offsets < size)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return _LOWER[data], starts, ends, np.searchsorted(starts, offsets)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < size:
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        size = max(size, SLICE_BYTES)
        for name, factor in (("up", _FACTOR), ("down", inverse)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; a word's hash depends on its bytes alone.

    A polynomial over the bytes is read off prefix sums (wrapping at 64 bits), slice by slice, so memory
    is bounded by the slice (or by one word where that is longer).
    """
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, side="right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        begin = starts[first:last] - low
        out[first:last] = (sums[ends[first:last] - low] - sums[begin]) * down[begin]
        first = last
    return mix(out)


def slices(column: pa.Array, limit: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (one row at least)."""
    _, offsets = text_buffer(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and n + 1 offsets of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each offset range along the first axis; empty ranges give zero."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]

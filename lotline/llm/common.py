"""What the text operators share: cleaned input, word hashes, result tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.runtime import stored

#: Spaces between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"\x20\x09-\x0D"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Any odd base works; the inverse makes hashes of equal words equal wherever they stand.
_BASE = 0x9E3779B97F4A7C15 | 1


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and ``more`` columns; every other column is left behind, so that no name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def keep(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors."""
    return stored(df)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps; longer rows are made anew.
KEPT_POWERS = 1 << 21


def _power(n: int, base: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        row = np.full(size, base & (2**64 - 1), np.uint64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= KEPT_POWERS:
            _powers[key] = have
    return have[:n]


def text_bytes(values: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, a blank after each, and where each text starts (one more for the end)."""
    raw = [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v for v in values]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(v) + 1 for v in raw], out=starts[1:])
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), starts


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of the bytes: equal bytes, equal hash, wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), _BASE, "up"), out=total[1:])
    return (total[end] - total[begin]) * _power(len(data), pow(_BASE, -1, 2**64), "down")[begin]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end."""
    edge = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(values: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and the offsets of each text's words."""
    data, starts = text_bytes(values)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(values) + 1, np.int64)
    begin, end = word_spans(data)
    return mix(span_hashes(data, begin, end)), np.searchsorted(begin, starts)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a text, and offsets; a text of fewer words has one shingle of them
    all, one without words has none."""
    n = np.diff(offsets)
    short = (n > 0) & (n < width)
    count = np.where(short, 1, np.maximum(n - width + 1, 0))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], count)
    last = np.repeat(offsets[1:], count)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < last
        value[inside] = mix(value[inside] * np.uint64(0xD6E8FEB86659FD93) + words[(at + k)[inside]], k)
    return value, out


def columns(batch: pa.RecordBatch) -> Iterator[list]:
    return (column.to_pylist() for column in batch.columns)


def portions(batch: pa.RecordBatch, column: int = 1, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of the text column, whole rows each; nothing is copied."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def blocks(values: list[str], limit: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about ``limit`` characters together."""
    block, size = [], 0
    for value in values:
        block.append(value)
        size += len(value)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block

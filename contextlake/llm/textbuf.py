"""Vectorised views of Arrow text columns for the Python stages.

A batch of texts is one UTF-8 buffer with offsets; words, hashes and counts
are computed over the whole buffer at once, in blocks of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BLOCK = 1 << 21
#: Bytes of the Arrow batches that go to Python, and their setting, without which only
#: rows are counted: 10,000 texts were 34 MB, held by the executor and by each worker.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = _powers(int(_P), 1 << 12)
_INV = _powers(pow(int(_P), -1, 1 << 64), 1 << 12)


def _power_run(which: str, n: int) -> np.ndarray:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW = _powers(int(_P), size)
        _INV = _powers(pow(int(_P), -1, 1 << 64), size)
    return (_POW if which == "pow" else _INV)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back to the system, Arrow's own and, where it can, the C
    library's: a worker waits for its next task with all that it ever held, and an
    executor has several."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mapped(df: DataFrame, apply: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` on batches of about ``BATCH_BYTES``, or a single longer row.

    The setting is the session's and stays, as the plan may run later; where it
    has a value already, that stands.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(apply, schema)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets); a null text is an empty one.

    A block holds rows of about ``limit`` bytes, or a single longer row.  What the
    blocks took is given back at the end of the column.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        arr = chunk.cast(pa.large_binary()).fill_null(b"") if len(chunk) else chunk
        if not len(arr):
            continue
        _, off_buf, data_buf = arr.buffers()
        offsets = np.frombuffer(off_buf, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), len(arr))
            yield row + i, row + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        row += len(arr)
    trim()


def words(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the buffer, and the row of each word."""
    inside = ~is_gap[data]
    starts_mask = inside.copy()
    if len(data) > 1:
        starts_mask[1:] &= ~inside[:-1]
    ends_mask = inside.copy()
    if len(data) > 1:
        ends_mask[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts_mask[edges] = inside[edges]
    ends_mask[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(starts_mask)
    ends = np.flatnonzero(ends_mask) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, row


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _ASCII_LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_CODE[data] * _power_run("pow", n), out=sums[1:])
        value = (sums[ends] - sums[starts]) * _power_run("inv", n)[starts]
        return mix(value + (ends - starts).astype(np.uint64))

"""Helpers the operators of this package share: tables in the shared folder, Arrow text buffers, hashes of symbol runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the warehouse where that is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, each: int, least: int) -> int:
    return max(least, -(-rows // each))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (two rounds of xor-shift and multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: One fixed pseudo-random value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, exponent, 1 << 64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column laid end to end and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows [lo, hi) of about `most` bytes together (one row at least), their bytes and their offsets."""
    data, at = text_buffer(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes that are not `outside` ([^\\x20\\x09-\\x0D]+); a row's end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~outside[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    ends = np.empty(len(data), bool)
    ends[:-1] = inside[:-1] & (~inside[1:] | starts[1:])
    ends[-1] = inside[-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of values: differences of prefix sums of a polynomial, brought to the span's own origin."""
    n = len(values)
    up = np.ones(n + 1, np.uint64)
    up[1:] = np.uint64(MULTIPLIER)
    np.multiply.accumulate(up, out=up)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    down = np.full(n + 1, np.uint64(pow(MULTIPLIER, -1, 1 << 64)))
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(symbols: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... symbols that begin at each place, up to `longest`."""
    runs, p = {1: symbols}, 1
    while 2 * p <= longest and len(runs[p]) > p:
        a = runs[p]
        runs[2 * p] = a[:-p] * power(p) + a[p:]
        p *= 2
    return runs


def run_hash(runs: dict[int, np.ndarray], length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of `length` symbols at the places `at`, or at all places where one fits."""
    n, done, out = len(runs[1]) - length + 1, 0, None
    for p in sorted((1 << b for b in range(length.bit_length()) if length >> b & 1), reverse=True):
        part = runs[p][done : done + n] if at is None else runs[p][at + done]
        out = part if out is None else out * power(p) + part
        done += p
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    p, best = 1, values
    while 2 * p <= width:
        best = np.minimum(best[:-p], best[p:])
        p *= 2
    return np.minimum(best[: len(values) - width + 1], best[width - p : width - p + len(values) - width + 1]) if p < width else best


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)

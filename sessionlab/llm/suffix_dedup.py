"""Suffix-array dedup: bytes covered by a string of a given length that also starts earlier in the corpus.

In each task the segments of shared anchors (see windows) are laid end to end and sorted by suffix. Threshold-bounded
interval expansion then finds which suffixes share a prefix of that length: the interval of the empty string is
extended to the left, character by character, through the Burrows-Wheeler transform, breadth first. A string of length
l + 1 whose interval ends at a place without a boundary proves a common prefix of l there, so common prefixes appear by
increasing value, and the expansion stops when they reach the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import BYTE_VALUES, ranges, text_buffer, text_slices
from sessionlab.llm.windows import LAST_ID, covered, identified, pack, repeated_places, unpack, whole_anchors

END = 0xFF  # never in UTF-8


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` bytes at least: prefixes of 8 bytes, then of three (or two, where three
    ranks fill no word) of the prefixes sorted before."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, END, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        if known >= depth or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        ranks, bits = (3, 21) if n < 1 << 21 else (2, 32)
        key = rank << np.uint64(bits * (ranks - 1))
        for i in range(1, ranks):
            key[: max(0, n - i * known)] |= rank[i * known :] << np.uint64(bits * (ranks - 1 - i))
        known *= ranks


def common_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and, along it, a number for each class of suffixes with one prefix of `length` bytes."""
    n = len(text)
    order = suffix_order(text, length)
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    by_char = by_char.astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_char] = np.arange(n, dtype=np.int32)
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # next and last place of the same character
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    after[by_char[:-1][same]] = by_char[1:][same]
    before[by_char[1:][same]] = by_char[:-1][same]
    run = np.cumsum(np.append(0, bwt[1:] != bwt[:-1]), dtype=np.int32)
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    left, right = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        plain = run[left] == run[right - 1]
        new_left, new_right = lf[left[plain]], lf[right[plain] - 1] + 1
        l, r = left[~plain], right[~plain]
        if len(l):
            size = r - l
            inside, owner = ranges(l, size), np.repeat(np.arange(len(l)), size)
            opens, closes = before[inside] < l[owner], after[inside] >= r[owner]
            a, b = inside[opens], inside[closes]
            a = a[np.argsort(owner[opens] * 256 + bwt[a])]
            b = b[np.argsort(owner[closes] * 256 + bwt[b])]
            new_left, new_right = np.concatenate([new_left, lf[a]]), np.concatenate([new_right, lf[b] + 1])
        fresh = ~boundary[new_right]
        left, right = new_left[fresh], new_right[fresh]
        boundary[right] = True
        if not len(left):
            break
    return order, np.cumsum(boundary[:n])


def repeats_in(table: pa.Table, length: int) -> pa.RecordBatch:
    """Runs of windows, as (doc_id, tag, place), that occur in another segment of the table at a smaller (doc_id, start)."""
    table = table.sort_by([("doc_id", "ascending"), ("place", "ascending")]).combine_chunks()
    doc, tag, (start, count) = table["doc_id"].to_numpy(), table["tag"].to_numpy(), unpack(table["place"].to_numpy())
    data, at = text_buffer(table["content"])
    size, n = np.diff(at), len(doc)
    begin = at[:-1] + np.arange(n)
    text = np.full(size.sum() + n, END, np.uint8)
    text[ranges(begin, size)] = data
    order, group = common_prefix_groups(text, length)
    of = np.empty(len(text), np.int64)
    of[order] = group
    row = np.repeat(np.arange(n), count)
    place = ranges(begin, count)
    offset = place - begin[row]
    first = np.zeros(group[-1] + 1, np.int64)
    first[of[place][::-1]] = np.arange(len(place))[::-1]  # the smallest stays
    f = first[of[place]]
    again = (doc[row] != doc[row[f]]) | (start[row] + offset != start[row[f]] + offset[f])
    edge = np.ones(len(place), bool)
    edge[1:] = (row[1:] != row[:-1]) | (again[1:] != again[:-1])
    head = np.flatnonzero(edge)
    long = np.diff(np.append(head, len(place)))
    head, long = head[again[head]], long[again[head]]
    r = row[head]
    return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tag[r]), pa.array(pack(start[r] + offset[head], long))], ["doc_id", "tag", "place"])


def bytes_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], at


def raw_bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def repeated_runs(docs: DataFrame, length: int = 100, most_segments: int = 16_384, batch_bytes: int = 1 << 18) -> DataFrame:
    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_anchors(batches, batch_bytes):
            yield repeats_in(table, length)

    return repeated_places(docs, bytes_of, raw_bytes, length, max(1, length // 6), False, examine, most_segments)


def suffix_dedup(docs: DataFrame, length: int = 100, most_segments: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary, the bytes that stay).

    A null text is empty. Rows without doc_id come after all others; rows that share a doc_id are not earlier than one
    another at the same start. Other columns are ignored. An empty table gives an empty result.
    """
    docs = identified(docs)
    runs = repeated_runs(docs, length, most_segments)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_slices(batch["text"]):
                gone = covered(batch["places"].fill_null([]) if batch["places"].null_count else batch["places"], lo, hi, at, length)
                heads = gone.copy()
                heads[1:] &= ~gone[:-1]
                inner = at[1:-1]
                inner = inner[inner < len(data)]
                heads[inner] = gone[inner]
                kept = data[~gone]
                edge = np.append(0, np.cumsum(~gone))[at]
                texts = [kept[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
                removed = np.diff(at) - np.diff(edge)
                spans = np.diff(np.append(0, np.cumsum(heads))[at])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = docs.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))

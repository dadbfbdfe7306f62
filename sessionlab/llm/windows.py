"""Which windows of a fixed number of symbols occur earlier in the corpus: anchors, the segments they own, and marks.

A window of W symbols is represented by the least hash among its k-grams (the leftmost on ties), so equal windows have
equal anchors at equal offsets wherever they lie. Consecutive windows whose anchor is the same k-gram form a segment; a
document becomes about 2 / (W - k + 2) segments per symbol. Windows of one segment differ, and windows in different
segments can only be equal if the anchors are, so each anchor can be settled alone: copies of a whole segment need no
text, and only the first copy of each different segment of a shared anchor is fetched and handed to the exact structure
of the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sessionlab.llm.common import mixed, ranges, rolling, run_hash, sliding_min, stage, text_buffer, text_slices

#: The low bits of a gram's hash give way to its place while the least is sought.
SPOT = np.uint64((1 << 31) - 1)


def segments(symbols: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, identity) of each segment of the rows of symbols that `at` bounds.

    A segment of n windows covers n + window - 1 symbols; n is less than `window`, so its first and last window give its
    whole content.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    n = len(symbols) - window + 1
    if n <= 0:
        return empty
    runs = rolling(symbols, window)
    grams = run_hash(runs, k)
    spot = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~SPOT) | spot, window - k + 1)
    fits = np.zeros(n + 1, np.int8)
    long = np.diff(at) >= window
    np.add.at(fits, at[:-1][long], 1)
    np.add.at(fits, at[1:][long] - window + 1, -1)
    valid = np.cumsum(fits[:n]).astype(bool)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return empty
    ends = np.flatnonzero(valid & np.append(~valid[1:], True)) + 1  # of the rows' valid places
    stops = np.minimum(np.append(starts[1:], n), ends[np.searchsorted(ends, starts, "right")])
    count = stops - starts
    whole = mixed(run_hash(runs, window, starts)) + mixed(run_hash(runs, window, stops - 1) ^ np.uint64(0x5851F42D4C957F2D))
    return starts, count, mixed(grams[(least[starts] & SPOT).astype(np.int64)]), mixed(whole ^ count.astype(np.uint64))


#: A place packs where a segment lies: its start and its windows. Places sort by start. The tag beside it, 64 bits of the
#: text's hash, keeps apart the rows of one doc_id (or of none) with different texts.
COUNT_BITS = 24
SEGMENT = "anchor long, segment long, doc_id long, tag long, place long"
FOUND = "anchor long, doc_id long, tag long, place long, repeated boolean"
LAST_ID = (1 << 63) - 1
#: Of the hash by which rows of one doc_id are only dealt or ordered.
TAG_BITS = 26


def pack(start, count):
    return (start << COUNT_BITS) | count


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1)


def row_key() -> tuple[Column, Column]:
    """What tells rows apart: doc_id, where none is given the largest, and the text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def document_key() -> tuple[Column, Column]:
    """row_key with TAG_BITS of the hash: enough to deal or order rows, not to tell them apart."""
    doc_id, tag = row_key()
    return doc_id, tag.bitwiseAND((1 << TAG_BITS) - 1)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): a document without id counts as the one with the largest id."""
    doc_id, tag = row_key()
    return docs.select(doc_id.alias("doc_id"), tag.alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def segmenter(symbols: Callable, window: int, k: int, by_document: bool):
    """Arrow batches of (doc_id, tag, text) to SEGMENT rows; symbols(data, at) gives a slice's symbols and their bounds.

    Copies of a segment that the same batch shows to be later than another are settled here: their place becomes
    negative and their anchor a number of their own, so that no hot segment meets in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch["doc_id"].to_numpy(), batch["tag"].to_numpy()
            parts = []
            for lo, _, data, at in text_slices(batch["text"]):
                values, bounds = symbols(data, at)
                start, count, anchor, segment = segments(values, bounds, window, k)
                row = np.searchsorted(bounds, start, "right") - 1
                parts.append((anchor.view(np.int64), segment.view(np.int64), ids[lo + row], tags[lo + row], pack(start - bounds[row], count)))
            anchor, segment, doc, tag, place = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
            order = np.lexsort((place, doc, segment))
            same = np.append(False, segment[order[1:]] == segment[order[:-1]])
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
            later = order[(doc[order] > doc[first]) | ((doc[order] == doc[first]) & (place[order] >> COUNT_BITS > place[first] >> COUNT_BITS) & (not by_document))]
            anchor[later] = mixed((doc[later] ^ tag[later] ^ (place[later] << 20)).view(np.uint64)).view(np.int64)
            place[later] = -1 - place[later]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, segment, doc, tag, place)], ["anchor", "segment", "doc_id", "tag", "place"])

    return run


def finder(by_document: bool):
    """Rows sorted by (anchor, segment, doc_id, place) to FOUND rows: segments all of whose windows occur earlier
    (repeated), and the first copies of segments whose anchor has other segments too (to be examined).

    With by_document only smaller documents count as earlier, so every copy in the first document is a first copy.
    State between batches: the anchor and segment at hand and the first copies that still wait for a second segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand = None  # anchor, segment, first doc_id, first start, whether the anchor has two segments
        waiting: list[pa.RecordBatch] = []

        def out(batch: pa.RecordBatch, rows: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
            arrays = [*(batch[c].take(pa.array(rows)) for c in ("anchor", "doc_id", "tag")), pa.array(place[rows]), pa.array(repeated)]
            return pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "tag", "place", "repeated"])

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            anchor, segment, doc = (batch[c].to_numpy() for c in ("anchor", "segment", "doc_id"))
            place = batch["place"].to_numpy()
            settled = place < 0
            place = np.where(settled, -1 - place, place)
            start = unpack(place)[0]
            new_anchor, new_segment = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_anchor[0] = at_hand is None or at_hand[0] != anchor[0]
            new_segment[1:] = new_anchor[1:] | (segment[1:] != segment[:-1])
            new_segment[0] = new_anchor[0] or at_hand[1] != segment[0]
            first = np.maximum.accumulate(np.where(new_segment, np.arange(n), -1))
            known = first >= 0
            first_doc = np.where(known, doc[first], at_hand[2] if at_hand else 0)
            first_start = np.where(known, start[first], at_hand[3] if at_hand else 0)
            is_first = (doc == first_doc if by_document else (doc == first_doc) & (start == first_start)) & ~settled
            group = np.cumsum(new_anchor) - 1  # -1: goes on from the batch before
            several = np.zeros(group[-1] + 2, bool)
            several[group[new_segment & ~new_anchor]] = True
            if group[0] < 0 and at_hand[4]:
                several[-1] = True
            if waiting:
                if several[-1]:
                    yield from waiting
                if several[-1] or group[-1] >= 0:
                    waiting = []
            last = group[-1]
            examined = is_first & several[group]
            keep = np.flatnonzero(~is_first | examined)
            yield out(batch, keep, ~is_first[keep])
            if not several[last]:
                held = np.flatnonzero(is_first & (group == last))
                waiting.append(out(batch, held, np.zeros(len(held), bool)))
            at_hand = (anchor[-1], segment[-1], first_doc[-1], first_start[-1], bool(several[last]))

    return run


def fetcher(symbols: Callable, values_of: Callable, window: int):
    """Batches of (doc_id, tag, text, places) to (anchor, segment, doc_id, tag, place, content): the values of each wanted segment
    as bytes, or, where it is to be split, each of its windows by two hashes and without content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "segment", "doc_id", "tag", "place", "content"]
        for batch in batches:
            ids, tags = batch["doc_id"].to_numpy(), batch["tag"].to_numpy()
            wanted = batch["places"]
            bounds = wanted.offsets.to_numpy().astype(np.int64)
            anchors, places, splits = (x.to_numpy(zero_copy_only=False) for x in wanted.values.flatten())
            for lo, hi, data, at in text_slices(batch["text"]):
                values, edges = values_of(data, at)
                a, b = bounds[lo], bounds[hi]
                anchor, place, split = anchors[a:b], places[a:b], splits[a:b].astype(bool)
                start, count = unpack(place)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                doc, tag, begin = ids[lo + row], tags[lo + row], edges[row] + start
                length = np.where(split, 0, (count + window - 1) * values.itemsize)
                offsets = np.append(0, np.cumsum(length[~split])).astype(np.int32)
                content = values.view(np.uint8)[ranges(begin * values.itemsize, length)]
                content = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(content)])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[~split]), pa.array(np.zeros(len(content), np.int64)), pa.array(doc[~split]), pa.array(tag[~split]), pa.array(place[~split]), content], names)
                if split.any():
                    each = np.repeat(np.flatnonzero(split), count[split])
                    at_window = ranges(begin[split], count[split])
                    whole = run_hash(rolling(symbols(data, at)[0], window), window, at_window)
                    spots = pack(start[each] + at_window - begin[each], 1)
                    yield pa.RecordBatch.from_arrays([pa.array(mixed(whole ^ anchor[each].view(np.uint64)).view(np.int64)), pa.array(mixed(whole).view(np.int64)), pa.array(doc[each]), pa.array(tag[each]), pa.array(spots), pa.nulls(len(each), pa.binary())], names)

    return run


def settler(by_document: bool, examine: Callable):
    """Rows of fetcher, those without content first, each kind sorted by anchor, to (doc_id, tag, place) of repeated runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        rest: list[pa.RecordBatch] = []

        def windows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch["content"].null_count
                yield batch.slice(0, n)
                if n < len(batch):
                    rest.append(batch.slice(n))
                    return

        for found in finder(by_document)(windows()):
            found = found.filter(found["repeated"])
            yield found.select(["doc_id", "tag", "place"])
        yield from examine(chain(rest, batches))

    return run


def whole_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor in tables of whole anchors with about `most` bytes of content."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        at = text_buffer(batch["content"])[1]
        lo = 0
        anchor = batch["anchor"].to_numpy()
        edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if held and held[-1]["anchor"][-1].as_py() != anchor[0]:
            edges = np.append(0, edges)
        for e in edges:
            if size + at[e] - at[lo] >= most:
                if e > lo:
                    held.append(batch.slice(lo, e - lo))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, lo = [], 0, e
        held.append(batch.slice(lo))
        size += int(at[-1] - at[lo])
    if held:
        yield pa.Table.from_batches(held)


def repeated_places(docs: DataFrame, symbols: Callable, values_of: Callable, window: int, k: int, by_document: bool, examine: Callable, most_segments: int) -> DataFrame:
    """(doc_id, tag, places): for each document the runs of windows that occur earlier, as places of runs.

    docs: identified(). symbols hash well; values_of gives what the contents hold. examine(batches of (anchor, doc_id,
    tag, place, content) sorted by anchor) gives (doc_id, tag, place) rows. An anchor with more than most_segments different
    segments would be too much for one task: its segments are split into windows, which are compared by 128 bits of hash.
    """
    if window >> COUNT_BITS:
        raise ValueError(f"a window of {window} symbols is too long: a place counts up to {(1 << COUNT_BITS) - 1}")
    segmented = docs.mapInArrow(segmenter(symbols, window, k, by_document), SEGMENT)
    found = stage(segmented.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc_id", "place").mapInArrow(finder(by_document), FOUND), "found")
    asked = found.where("not repeated").select("anchor", "doc_id", "tag", "place")
    hot = asked.groupBy("anchor").count().where(F.col("count") > most_segments).select("anchor", F.lit(True).alias("split"))
    asked = asked.withColumn("split", F.lit(False)) if hot.isEmpty() else asked.join(hot, "anchor", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    listed = asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "place", "split")).alias("places"))
    contents = docs.join(listed, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places").mapInArrow(fetcher(symbols, values_of, window), f"{SEGMENT}, content binary")
    sorted_contents = contents.repartition("anchor").sortWithinPartitions(F.col("content").isNotNull(), "anchor", "segment", "doc_id", "place")
    examined = sorted_contents.mapInArrow(settler(by_document, examine), "doc_id long, tag long, place long")
    return found.where("repeated").select("doc_id", "tag", "place").unionByName(examined).groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))


def covered(places: pa.Array, lo: int, hi: int, bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether each symbol of the rows [lo, hi) of a slice lies in a repeated window; bounds are the slice's row bounds."""
    change = np.zeros(bounds[-1] + 1, np.int32)
    at = places.offsets.to_numpy().astype(np.int64)
    start, count = unpack(places.values.to_numpy(zero_copy_only=False)[at[lo] : at[hi]])
    begin = bounds[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))] + start
    np.add.at(change, begin, 1)
    np.add.at(change, begin + count + window - 1, -1)
    return np.cumsum(change[:-1]) > 0

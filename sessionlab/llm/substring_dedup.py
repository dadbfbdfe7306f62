"""Substring dedup: words covered by a window of words that also starts in an earlier document.

The segments of one anchor (see windows) from the documents so far are a reference shard, held as a suffix automaton.
The segments are streamed past it in the order of documents: walking the automaton gives at each word the longest match
that ends there (matching statistics), and every window inside a match of the window's length is removed. Then the
document's own segments join the shard. Shards meet their segments through a shuffle on the anchor, not through a
broadcast: all shards together grow with the corpus, and every shard would have to meet every document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import BYTE_VALUES, ranges, span_hashes, text_buffer, text_slices, word_spans
from sessionlab.llm.windows import LAST_ID, covered, identified, pack, repeated_places, unpack, whole_anchors


class Automaton:
    """A suffix automaton of several sequences; one symbol at a time can be added."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _exact(self, p: int, symbol: int) -> int:
        """The state p leads to by the symbol, split so that its longest string is p's longest and the symbol."""
        q = self.step[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(symbol) == q:
            self.step[p][symbol] = twin
            p = self.link[p]
        return twin

    def add(self, symbols: list[int]) -> None:
        last = 0
        for symbol in symbols:
            p = last
            if symbol in self.step[p]:
                last = self._exact(p, symbol)
                continue
            last = self._state(self.length[p] + 1, 0, {})
            while p >= 0 and symbol not in self.step[p]:
                self.step[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._exact(p, symbol)

    def matches(self, symbols: list[int]) -> list[int]:
        """For each place the length of the longest string of the automaton that ends there."""
        state, length, out = 0, 0, []
        step, link, longest = self.step, self.link, self.length
        for symbol in symbols:
            while state and symbol not in step[state]:
                state = link[state]
                length = longest[state]
            if symbol in step[state]:
                state = step[state][symbol]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


def matched_runs(symbols: list[list[int]], documents: list[int], window: int) -> Iterator[tuple[int, int, int]]:
    """(sequence, start, windows) of the runs of windows that occur in a sequence of a smaller document; in their order."""
    shard, at = Automaton(), 0
    while at < len(symbols):
        to = at
        while to < len(symbols) and documents[to] == documents[at]:
            to += 1
        if at:
            for i in range(at, to):
                begun = None
                for end, length in enumerate([*shard.matches(symbols[i]), 0]):
                    if length >= window:
                        begun = end - window + 1 if begun is None else begun
                    elif begun is not None:
                        yield i, begun, end - window + 1 - begun
                        begun = None
        if to < len(symbols):
            for i in range(at, to):
                shard.add(symbols[i])
        at = to


def word_symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(data, at)
    return span_hashes(BYTE_VALUES[data], starts, ends), np.searchsorted(starts, at)


def repeated_runs(docs: DataFrame, window: int = 13, most_segments: int = 16_384, batch_bytes: int = 1 << 20) -> DataFrame:
    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_anchors(batches, batch_bytes):
            table = table.combine_chunks()
            anchor, doc, tag, place = (table[c].to_numpy() for c in ("anchor", "doc_id", "tag", "place"))
            start, _ = unpack(place)
            data, at = text_buffer(table["content"])
            words, at = np.frombuffer(data.tobytes(), np.int64).tolist(), (at // 8).tolist()
            edges = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])).tolist() + [len(anchor)]
            rows: list[tuple[int, int, int]] = []
            for a, b in zip(edges[:-1], edges[1:]):
                rows += [(a + i, s, n) for i, s, n in matched_runs([words[at[j] : at[j + 1]] for j in range(a, b)], doc[a:b].tolist(), window)]
            row, begin, count = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tag[row]), pa.array(pack(start[row] + begin, count))], ["doc_id", "tag", "place"])

    return repeated_places(docs, word_symbols, word_symbols, window, max(1, window // 3), True, examine, most_segments)


def substring_dedup(docs: DataFrame, window: int = 13, most_segments: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space).

    Words are [^\\x20\\x09-\\x0D]+ as they stand, compared by 64-bit hashes. A null text has none. Rows without doc_id
    count as one document after all others; rows that share a doc_id are not earlier than one another. Other columns
    are ignored. An empty table gives an empty result.
    """
    docs = identified(docs)
    runs = repeated_runs(docs, window, most_segments)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch["places"].fill_null([]) if batch["places"].null_count else batch["places"]
            for lo, hi, data, at in text_slices(batch["text"]):
                starts, ends = word_spans(data, at)
                bounds = np.searchsorted(starts, at)
                gone = covered(places, lo, hi, bounds, window)
                s, size = starts[~gone], (ends - starts)[~gone]
                edge = np.append(0, np.cumsum(size + 1))
                joined = np.full(edge[-1], 0x20, np.uint8)
                joined[ranges(edge[:-1], size)] = data[ranges(s, size)]
                kept = np.append(0, np.cumsum(~gone))[bounds]
                texts = [joined[a : max(a, b - 1)].tobytes() for a, b in zip(edge[kept[:-1]], edge[kept[1:]])]
                words = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), pa.array(words), pa.array(words - np.diff(kept)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = docs.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))

"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes triggers a chunk boundary where it is -1 modulo the block size; each chunk
becomes one of 64 signs. The block size is the least 3 * 2^k that gives at most SIGNS chunks, and a fingerprint holds
the signs at that size and at the double of it, so fingerprints of equal or neighbouring sizes can be compared: by the
edit distance of insertions and deletions between the signs of the size they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import BYTE_VALUES, ranges, span_hashes, text_buffer
from sessionlab.llm.windows import LAST_ID, document_key

WINDOW, SIGNS, LEVELS = 7, 64, 31
#: Signs in a row that two fingerprints must share to be alike at all (all of them where one has fewer).
COMMON_RUN = 5
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def triggers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte the largest k for which it ends a chunk at the block size 3 * 2^k, or -1."""
    n = len(data)
    inside = np.arange(n, dtype=np.int64) - np.repeat(at[:-1], np.diff(at))
    total, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    byte = data.astype(np.uint32)
    for k in range(WINDOW):
        seen = byte if k == 0 else np.where(inside >= k, np.concatenate([np.zeros(k, np.uint32), byte[:-k]])[:n], np.uint32(0))
        total += seen
        weighted += seen * np.uint32(WINDOW - k)
        shifted ^= seen << np.uint32(5 * k) if 5 * k < 32 else np.uint32(0)
    value = (total + weighted + shifted).astype(np.int64) + 1
    low = value & -value
    level = np.log2(low.astype(np.float64)).astype(np.int64)
    return np.where(value % 3 == 0, np.minimum(level, LEVELS), -1)


def signatures(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a slice: k of its block size, its signs at that size and at the double (n, 2, SIGNS), their numbers."""
    n = len(at) - 1
    level = triggers(data, at)
    hit = np.flatnonzero(level >= 0)
    row = np.searchsorted(at, hit, "right") - 1
    inner = hit + 1 < at[row + 1]  # a trigger at the very end closes nothing more
    counts = np.zeros((n, LEVELS + 1), np.int64)
    np.add.at(counts, (row[inner], level[hit[inner]]), 1)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # inner boundaries at each size
    k = (counts + 1 <= SIGNS).argmax(axis=1)
    signs, number = np.full((n, 2, SIGNS), 255, np.uint8), np.zeros((n, 2), np.int64)
    some = np.flatnonzero(np.diff(at))
    for double in (0, 1):
        keep = inner & (level[hit] >= k[row] + double)
        begins = np.sort(np.concatenate([at[:-1][some], hit[keep] + 1]))
        owner = np.searchsorted(at, begins, "right") - 1
        ends = np.minimum(np.append(begins[1:], len(data)), at[owner + 1])
        sign = (span_hashes(BYTE_VALUES[data], begins, ends) >> np.uint64(58)).astype(np.uint8)
        first = np.searchsorted(owner, np.arange(n))
        signs[owner, double, np.arange(len(owner)) - first[owner]] = sign
        number[:, double] = np.bincount(owner, minlength=n)
    return k, signs, number


def texts_of(k: np.ndarray, signs: np.ndarray, number: np.ndarray) -> list[str]:
    shown = ALPHABET[np.minimum(signs, 63)]
    return [f"{3 << int(a)}:{s[0, :x].tobytes().decode()}:{s[1, :y].tobytes().decode()}" for a, s, (x, y) in zip(k, shown, number)]


def likeness_of_signs(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """1 - (insertions and deletions from a to b) / (signs of both), or 0 without a common run; row by row.

    The longest common subsequence is found for all rows at once, with the places of b as bits of one word.
    """
    n = len(a)
    columns = np.arange(SIGNS)
    valid = columns[None, :] < nb[:, None]
    free = np.full(n, np.uint64(2**64 - 1))
    before = [np.zeros(n, np.uint64) for _ in range(COMMON_RUN)]
    longest = np.zeros(n, np.int64)
    for i in range(SIGNS):
        here = (i < na)[:, None] & valid & (b == a[:, i : i + 1])
        match = np.packbits(here, axis=1, bitorder="little").view(np.uint64)[:, 0]
        free = (free + (free & match)) | (free & ~match)
        runs = [match]
        for r in range(1, COMMON_RUN):
            runs.append(match & (before[r - 1] << np.uint64(1)))
        for r, x in enumerate(runs):
            longest = np.where(x != 0, np.maximum(longest, r + 1), longest)
        before = runs
    common = np.bitwise_count(~free).astype(np.float64)
    alike = 2 * common / np.maximum(na + nb, 1)
    return np.where((longest >= np.minimum(COMMON_RUN, np.minimum(na, nb))) & (longest > 0), alike, 0.0)


def likeness(one: tuple, other: tuple) -> np.ndarray:
    """From 0 to 1 for each pair of fingerprints; two of empty texts are alike."""
    (k, s, n), (l, t, m) = one, other
    out = np.zeros(len(k))
    for i in (0, 1):
        for j in (0, 1):
            rows = np.flatnonzero(k + i == l + j)
            if len(rows):
                out[rows] = np.maximum(out[rows], likeness_of_signs(s[rows, i], n[rows, i], t[rows, j], m[rows, j]))
    same = (k == l) & (n == m).all(axis=1) & (s == t).all(axis=(1, 2))
    return np.where(same, 1.0, out)


def picked(parts: tuple, rows: np.ndarray) -> tuple:
    return tuple(p[rows] for p in parts)


def judged(data: np.ndarray, at: np.ndarray) -> tuple:
    """For consecutive texts (the last only serves as the next of the one before): what fingerprint_neighbours returns."""
    n = len(at) - 2
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(letters, at)
    letters = np.append(letters, len(data))
    chars = np.diff(bounds)
    half = chars[:n] // 2
    kept = letters[bounds[:n] + chars[:n] - half] - at[:n]
    taken = letters[bounds[1 : n + 1] + np.minimum(half, chars[1:])] - at[1 : n + 1]
    starts = np.stack([at[:n], at[1 : n + 1]], axis=1).ravel()
    sizes = np.stack([kept, taken], axis=1).ravel()
    edited = data[ranges(starts, sizes)]
    edge = np.append(0, np.cumsum(kept + taken))
    own, new = signatures(data, at), signatures(edited, edge)
    first, following = picked(own, np.arange(n)), picked(own, np.arange(1, n + 1))
    digest = [hashlib.sha256(edited[a:b].tobytes()).hexdigest() for a, b in zip(edge[:-1], edge[1:])]
    return chars[:n], digest, texts_of(*first), texts_of(*new), likeness(first, new), likeness(first, following)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, fingerprint, the fingerprint and hash of its edited text (its last half
    replaced by the beginning of the next document), and the likeness of its fingerprint to that and to the next one's.

    The next document is the next row in the order of doc_id (null last), rows of one doc_id in the order of their
    texts' hashes; after the last comes the first. A null text is empty. Other columns are ignored; an empty table gives
    an empty result. Documents are dealt by ranges of doc_id, each with a copy of the first row of the next range.
    """
    spark = docs.sparkSession
    doc_id, tag = document_key()
    keyed = docs.select(doc_id.alias("doc_id"), tag.alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(doc_id.alias("doc_id"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the value that stands for no doc_id has no place among doubles; any sorted whole numbers serve as cuts
    known = ids.where(F.col("doc_id") != LAST_ID).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)
    cuts = np.unique(np.array([min(int(q), LAST_ID - 1) for q in known], np.int64))

    def slab(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch["doc_id"].to_numpy(), "right")), batch["doc_id"]], ["slab", "doc_id"])

    firsts = sorted((r.slab, r.first) for r in ids.mapInArrow(slab, "slab long, doc_id long").groupBy("slab").agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    heads = np.array(sorted(before), np.int64)
    earlier = np.array([before[h] for h in sorted(before)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its slab, and the rows that may open a slab once more, for the slab before."""
        for batch in batches:
            value = batch["doc_id"].to_numpy()
            halo = np.flatnonzero(np.isin(value, heads))
            for rows, at, late in ((batch, np.searchsorted(cuts, value, "right"), False), (batch.take(pa.array(halo)), earlier[np.searchsorted(heads, value[halo])] if len(halo) else halo, True)):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(rows), late)), *rows.columns], ["slab", "late", *rows.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                table = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks()
                held = part.slice(len(part) - 1)
                if len(table) < 2:
                    continue
                data, at = text_buffer(table["text"])
                slabs, late = table["slab"].to_numpy(), table["late"].to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(~late[:-1])  # a row that is not a copy always has its next behind it
                assert (slabs[keep] == slabs[keep + 1]).all()
                out = judged(data, at)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().slice(0, len(table) - 1).take(keep), *[pa.array(x).take(keep) for x in out]], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = keyed.mapInArrow(deal, "slab long, late boolean, doc_id long, tag long, text string")
    out = dealt.repartition("slab").sortWithinPartitions("slab", "late", "doc_id", "tag").mapInArrow(run, RESULT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))

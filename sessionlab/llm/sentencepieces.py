"""SentencePiece encoding and decoding with a given model, as a batched Viterbi search in numpy.

A text becomes units: a run of word marks and the characters up to the next one (no piece spans two units). Different
units of equal length advance together, one character at a time: the hashes of the substrings that end there probe the
sorted hashes of the pieces, and the best way to reach the place is kept with its backpointer. In a unigram model the
best is the largest sum of scores. In a BPE model scores only order merges; there a way counts if each of its pieces,
merged alone with its predecessor, comes out as these two pieces. Exactly one way does, the one that merging gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sessionlab.llm.common import MULTIPLIER, mixed, ranges, span_hashes, text_slices

MARK = 0x2581
#: Kinds of pieces and of models in the format.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Bits of the table of answered pairs and of the sieve in front of the sorted keys.
SLOTS, SIEVE = 20, 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    bpe: bool
    prefix: bool
    #: Answers of admissible() by the hash of the pair; a later pair takes the place of an earlier one.
    asked: np.ndarray | None = None
    answers: np.ndarray | None = None

    def ready(self) -> "Model":
        if self.asked is None:
            self.asked, self.answers = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        return self

    def __post_init__(self):
        usual = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        self.rank = {self.pieces[i]: float(self.scores[i]) for i in reversed(usual)}
        self.longest = max(len(self.pieces[i]) for i in usual)
        points = [np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32) for i in usual]
        size = np.array([len(p) for p in points])
        ends = np.cumsum(size)
        keys = span_hashes(values_of(np.concatenate(points)), ends - size, ends)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(usual, np.int32)[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.keys & np.uint64((1 << SIEVE) - 1)] = True
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        texts = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode() if k in (NORMAL, USER_DEFINED) else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds)]
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The symbols of a short text after all merges, best score first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while True:
            best, place = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, i
            if best is None:
                return parts
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def admissible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves these two pieces beside each other (before -1: the piece alone)."""
        pairs = (before.astype(np.int64) + 1) * (len(self.pieces) + 1) + piece
        slot = (mixed(pairs.view(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.answers[slot]
        other = np.flatnonzero(self.asked[slot] != pairs)
        if len(other):
            some, where = np.unique(pairs[other], return_index=True)
            for key, at in zip(some.tolist(), slot[other[where]].tolist()):
                a, b = divmod(key, len(self.pieces) + 1)
                right = self.pieces[b]
                self.asked[at] = key
                self.answers[at] = self.merged(right) == [right] if a == 0 else self.merged(self.pieces[a - 1] + right) == [self.pieces[a - 1], right]
            # two of these pairs may share a slot: those that lost theirs are asked once more
            mine = self.asked[slot[other]] == pairs[other]
            out[other[mine]] = self.answers[slot[other[mine]]]
            if not mine.all():
                rest = other[~mine]
                out[rest] = self.admissible(before[rest], piece[rest])
        return out


def values_of(points: np.ndarray) -> np.ndarray:
    return mixed(points.astype(np.uint64) + np.uint64(1))


def read_model(path: str) -> Model:
    """A model of the SentencePiece format whose normaliser is the identity; read on the driver, shipped with the code."""
    pieces, scores, kinds, bpe, prefix = [], [], [], False, True
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                piece = dict(fields(value))
                pieces.append(piece[1].decode())
                scores.append(np.frombuffer(piece.get(2, bytes(4)), np.float32)[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                bpe = dict(fields(value)).get(3, UNIGRAM) == BPE
            elif number == 3:
                rules = dict(fields(value))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models with an identity normaliser that keeps white space are supported")
                prefix = bool(rules.get(3, 1))
    if any("▁" in p.lstrip("▁") for p, k in zip(pieces, kinds) if k in (NORMAL, USER_DEFINED)):
        raise ValueError("pieces over several words are not supported")
    return Model(pieces, np.array(scores, np.float64), kinds, bpe, prefix)


def search(points: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of n units of equal length (n, length): flat ids and the number of each unit's ids. A character that is
    in no piece has the id -1 - its code point."""
    n, length = points.shape
    value = values_of(points)
    prefix = np.zeros((length + 1, n), np.uint64)
    for j in range(length):
        prefix[j + 1] = prefix[j] + value[:, j] * np.uint64(pow(MULTIPLIER, j, 1 << 64))
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    score = np.full((length + 1, n), -np.inf)
    score[0] = 0
    last, back = np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
    foreign = float(model.scores.min()) - 10
    for j in range(1, length + 1):
        for i in range(max(0, j - model.longest), j):
            key = mixed((prefix[j] - prefix[i]) * np.uint64(pow(inverse, i, 1 << 64)) + np.uint64(j - i))
            maybe = np.flatnonzero(model.sieve[key & np.uint64((1 << SIEVE) - 1)])
            spot = np.minimum(np.searchsorted(model.keys, key[maybe]), len(model.keys) - 1)
            maybe, spot = maybe[model.keys[spot] == key[maybe]], spot[model.keys[spot] == key[maybe]]
            piece = np.full(n, -1, np.int32)
            piece[maybe] = model.ids[spot]
            rows = maybe[np.isneginf(score[j, maybe])] if model.bpe else maybe
            if len(rows) and model.bpe:
                before = np.maximum(last[i, rows], -1)  # nothing merges with a foreign character
                rows = rows[model.admissible(before, piece[rows])]
                gain = np.zeros(len(rows))
            else:
                gain = model.scores[piece[rows]]
            if len(rows):
                reached = score[i, rows] + gain
                better = reached > score[j, rows]
                rows = rows[better]
                score[j, rows], last[j, rows], back[j, rows] = reached[better], piece[rows], i
            if j - i == 1:
                alone = np.flatnonzero((piece < 0) & (score[i] + foreign > score[j]))
                score[j, alone], last[j, alone], back[j, alone] = score[i, alone] + (0 if model.bpe else foreign), -1 - points[alone, i].astype(np.int32) - 1, i
    ids, at, steps = [], np.full(n, length), 0
    each = np.arange(n)
    count = np.zeros(n, np.int64)
    while at.any():
        going = at > 0
        ids.append(np.where(going, last[at, each], 0))
        count += going
        at = np.where(going, back[at, each], 0)
        steps += 1
    table = np.array(ids).T[:, ::-1] if ids else np.zeros((n, 0), np.int32)
    return table[np.arange(steps)[None, :] >= (steps - count)[:, None]], count


def encode_slice(data: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts of a slice, laid end to end, and their bounds."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
    points = np.where(points == 0x20, MARK, points).astype(np.uint32)
    if model.prefix:
        filled = np.flatnonzero(np.diff(bounds))
        points = np.insert(points, bounds[filled], MARK)
        bounds = bounds + np.append(0, np.cumsum(np.diff(bounds) > 0))
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    mark = points == MARK
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    _, first, of = np.unique(span_hashes(values_of(points), starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    count, found = np.zeros(len(first), np.int64), {}
    for length in np.unique(size).tolist():
        same = np.flatnonzero(size == length)
        for a in range(0, len(same), 16384):
            rows = same[a : a + 16384]
            ids, count[rows] = search(points[starts[first[rows]][:, None] + np.arange(length)], model)
            if (ids < 0).any():
                ids, count[rows] = with_bytes(ids, count[rows], model)
            found[length, a] = rows, ids
    offset = np.cumsum(count) - count
    flat = np.empty(count.sum(), np.int32)
    for rows, ids in found.values():
        flat[ranges(offset[rows], count[rows])] = ids
    ids = flat[ranges(offset[of], count[of])]
    unit = np.searchsorted(starts, bounds)
    return ids, np.append(0, np.cumsum(count[of]))[unit]


def with_bytes(ids: np.ndarray, count: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become the pieces of their bytes, or the unknown piece where the model has none."""
    owner, foreign = np.repeat(np.arange(len(count)), count), np.flatnonzero(ids < 0)
    spelled = [[model.bytes[b] for b in chr(-2 - i).encode()] if model.bytes else [model.unknown] for i in ids[foreign].tolist()]
    size = np.ones(len(ids), np.int64)
    size[foreign] = [len(s) for s in spelled]
    begin = np.cumsum(size) - size
    out = np.empty(size.sum(), np.int32)
    out[begin] = ids
    out[ranges(begin[foreign], size[foreign])] = [i for s in spelled for i in s]
    return out, np.bincount(owner, size, len(count)).astype(np.int64)


def decode_slice(ids: np.ndarray, at: np.ndarray, model: Model) -> list[bytes]:
    """The texts of lists of ids laid end to end with bounds `at`."""
    size = model.sizes[ids]
    data = model.flat[ranges(model.starts[ids], size)]
    edge = np.append(0, np.cumsum(size))[at]
    texts = [data[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    return [t[1:] if model.prefix and t[:1] == b" " else t for t in texts]


#: Models of this worker by their content, so that what was learned about pairs of pieces outlives a task.
_HELD: dict[str, Model] = {}


def held(model: Model, name: str) -> Model:
    return _HELD.setdefault(name, model).ready()


def encode(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """The columns `keep` of each row of docs with ids (array<int>), ids_sha256 (of the ids as little-endian 32-bit
    numbers), n_tokens and round_trip (whether decoding the ids gives the text back).

    A null or empty text has no ids and round-trips. The only texts that do not are those that hold the word mark
    U+2581 itself: the format reads it as a space.
    """
    kept = docs.select(*keep)
    name = hashlib.sha256(repr((model.pieces, model.scores.tolist(), model.bpe)).encode()).hexdigest()
    work = docs.select(F.struct(*keep).alias("keep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(model, name)
        for batch in batches:
            for lo, hi, data, at in text_slices(batch["text"], 1 << 22):
                ids, bounds = encode_slice(data, at, own)
                back = decode_slice(ids, bounds, own)
                ids = ids.astype("<i4")
                same = [data[a:b].tobytes() == t for a, b, t in zip(at[:-1], at[1:], back)]
                digest = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch["keep"].slice(lo, hi - lo), lists, pa.array(digest), pa.array(np.diff(bounds)), pa.array(same)], ["keep", "ids", "ids_sha256", "n_tokens", "round_trip"])

    out = T.StructType([T.StructField("keep", kept.schema), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return work.mapInArrow(run, out).select("keep.*", "ids", "ids_sha256", "n_tokens", "round_trip")


def decode(encoded: DataFrame, model: Model, keep: list[str | Column], ids: str = "ids") -> DataFrame:
    """The columns `keep` and the text of each list of ids; a null list or id counts as none. Bytes that are no UTF-8
    become replacement characters."""
    kept = encoded.select(*keep)
    work = encoded.select(F.struct(*keep).alias("keep"), F.filter(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")), lambda i: i.isNotNull()).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            at = lists.offsets.to_numpy().astype(np.int64)
            texts = decode_slice(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0], model)
            yield pa.RecordBatch.from_arrays([batch["keep"], pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["keep", "text"])

    return work.mapInArrow(run, T.StructType([T.StructField("keep", kept.schema), T.StructField("text", T.StringType())])).select("keep.*", "text")

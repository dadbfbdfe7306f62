"""N-gram Jaccard join by chosen paths.

Each set of shingles is embedded as COORDINATES least hashes, so that two sets share a coordinate with the probability
of their Jaccard similarity. A run starts with all sets in one node and splits recursively: at each node some coordinates
are chosen (the choice depends on the run and the path alone, 1 / threshold of them on average), and a set goes to one
child for each chosen coordinate, named by the token it has there. Pairs at the threshold stay together in some child
with the probability of a critical branching process; runs are repeated until the wanted recall. Nodes small enough, and
nodes at the last level of whatever size, are compared by brute force over their sets, large ones in tiles. Nodes that
overlap are first put together where the whole stays small, so that a set travels once. Where it does not, a pair counts
in the first of its common nodes only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import BYTE_VALUES, mixed, ranges, rolling, run_hash, span_hashes, stage, text_slices, word_spans
from sessionlab.llm.windows import identified, row_key
from sessionlab.operators.models import components

COORDINATES = 64
FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


#: Levels that all sets go through, and how many times more coordinates nodes choose that are too large after them: a
#: third as many pairs get lost there, for three times the rows of these nodes alone.
FIRST_LEVELS, LATER_CHOICES = 2, 3


def survival(levels: int) -> float:
    """Of a pair at the threshold: the probability that it shares a node after so many levels of one run."""
    p = 1.0
    for level in range(levels, 0, -1):
        p = 1 - math.exp(-p * (LATER_CHOICES if level > FIRST_LEVELS else 1))
    return p


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text of a slice, sorted, and their bounds. A text of fewer words has one
    shingle of all of them, a text without words none."""
    starts, ends = word_spans(data, at)
    symbols = span_hashes(BYTE_VALUES[data], starts, ends)
    edge = np.searchsorted(starts, at)
    count = np.diff(edge)
    row = np.repeat(np.arange(len(count)), np.maximum(count - words + 1, 0))
    runs = rolling(symbols, words)
    first = ranges(edge[:-1], np.maximum(count - words + 1, 0))
    value = mixed(run_hash(runs, words, first)) if len(first) else np.zeros(0, np.uint64)
    for n in np.unique(count[(count > 0) & (count < words)]).tolist():
        short = np.flatnonzero(count == n)
        value = np.append(value, mixed(run_hash(runs, n, edge[short])))
        row = np.append(row, short)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def sketch(words: int):
    """(doc_id, tag, text) to (doc_id, tag, node, tokens): node names the set by a 64-bit hash, 0 for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_slices(batch["text"]):
                value, bounds = shingle_sets(data, at, words)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                node = np.zeros(hi - lo, np.uint64)
                tokens = np.zeros((hi - lo, COORDINATES), np.uint32)
                if len(some):
                    begin = bounds[:-1][some]
                    node[some] = mixed(np.add.reduceat(mixed(value ^ np.uint64(0x3C6EF372FE94F82B)), begin) + size[some].astype(np.uint64)) | np.uint64(1)
                    for i in range(COORDINATES):
                        tokens[some, i] = np.minimum.reduceat(value * FACTORS[i], begin) >> np.uint64(32)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((np.arange(hi - lo + 1) * COORDINATES * 4).astype(np.int32)), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["tag"].slice(lo, hi - lo), pa.array(node.view(np.int64)), packed], ["doc_id", "tag", "node", "tokens"])

    return run


def splitter(levels: int, threshold: float, choices: int = 1, runs: int = 0):
    """(path, node, tokens) to (path, node) `levels` levels further down; with runs, from the start of each of so many."""
    share = choices / (threshold * COORDINATES)
    most = np.uint64(int(2**64 * share) if share < 1 else 2**64 - 1)
    names = mixed(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(0x6A09E667))
    starts = mixed(np.arange(runs, dtype=np.uint64) + np.uint64(0xBB67AE85))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                node = part["node"].to_numpy()
                tokens = np.frombuffer(b"".join(part["tokens"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
                row, path = np.arange(len(part)), part["path"].to_numpy().view(np.uint64)
                if runs:
                    row, path = np.repeat(row, runs), np.tile(starts, len(part))
                for _ in range(levels):
                    at, coordinate = np.nonzero(mixed(path[:, None] ^ names[None, :]) < most)
                    row = row[at]
                    path = mixed(path[at] ^ mixed(tokens[row, coordinate].astype(np.uint64) + (coordinate.astype(np.uint64) << np.uint64(32))))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row])], ["path", "node"])

    return run


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, as products of blocks of their token matrices."""
    tokens, code = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in [*sets, *others]])
    left = np.bincount(code[row < len(sets)], minlength=len(tokens)) > 0
    right = np.bincount(code[row >= len(sets)], minlength=len(tokens)) > 0
    shared = np.cumsum(left & right) - 1
    keep = (left & right)[code]
    code, row = shared[code[keep]], row[keep]
    out = np.zeros((len(sets), len(others)), np.float32)
    width = 4096
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [at, at + width])
        block = np.zeros((len(sets) + len(others), min(width, int(code[-1]) + 1 - at)), np.float32)
        block[row[a:b], code[a:b] - at] = 1
        out += block[: len(sets)] @ block[len(sets) :].T
    return out


def shared_earlier(leaf: int, leaves: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Whether each pair also meets in a node of a smaller name."""
    return overlaps([x[x < leaf] for x in leaves], [x[x < leaf] for x in others]) > 0


def judge(threshold: float):
    """Rows of one tile sorted by (leaf, a, b): its members with their sets, to (node, least, links): for each member one
    member for all of its connected part of this tile, and the copies of those it is linked to here for the first time."""

    def tile(rows: pa.Table) -> pa.RecordBatch:
        leaf, a, b = (rows[c][0].as_py() for c in ("leaf", "a", "b"))
        node, weight, chunk = (rows[c].to_numpy() for c in ("node", "copies", "chunk"))
        sets = [s.values.to_numpy() for s in rows["shingles"].combine_chunks()]
        leaves = [s.values.to_numpy() for s in rows["leaves"].combine_chunks()]
        left = np.flatnonzero(chunk == a)
        right = left if a == b else np.flatnonzero(chunk == b)
        pick = lambda x, at: [x[i] for i in at.tolist()]
        size = np.array([len(s) for s in sets])
        common = overlaps(pick(sets, left), pick(sets, right))
        linked = common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-6
        if a == b:
            np.fill_diagonal(linked, False)
        fresh = linked & ~shared_earlier(leaf, pick(leaves, left), pick(leaves, right)) if linked.any() else linked
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        sides = ((left, right, linked, fresh), (right, left, linked.T, fresh.T))[: 1 if a == b else 2]
        for mine, theirs, _, f in sides:
            links[mine] += f @ weight[theirs]
        while True:  # the least number of each connected part
            before = label.copy()
            for mine, theirs, m, _ in sides:
                label[mine] = np.minimum(label[mine], np.where(m, label[theirs][None, :], len(node)).min(axis=1, initial=len(node)))
            if (label == before).all():
                break
        some = np.flatnonzero((links > 0) | (label != np.arange(len(node))) | np.isin(np.arange(len(node)), label[label != np.arange(len(node))]))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some])], ["node", "least", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch[c].to_numpy() for c in ("leaf", "a", "b")], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if waiting and any(waiting[-1][c][-1].as_py() != batch[c][0].as_py() for c in ("leaf", "a", "b")):
                edges = np.append(0, edges)
            lo = 0
            for e in edges.tolist():
                if e > lo:
                    waiting.append(batch.slice(lo, e - lo))
                if waiting:
                    yield tile(pa.Table.from_batches(waiting))
                waiting, lo = [], e
            waiting.append(batch.slice(lo))
        if waiting:
            yield tile(pa.Table.from_batches(waiting))

    return run


def shingler(words: int):
    """(node, text) to (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_slices(batch["text"]):
                value, bounds = shingle_sets(data, at, words)
                yield pa.RecordBatch.from_arrays([batch["node"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))], ["node", "shingles"])

    return run


def similar(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9999, levels: int = 4, small: int = 4096, tile: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, tag (of the text, see windows), class_key, class_id and n_links.

    Documents are linked if the Jaccard similarity of their sets of `words`-word shingles is `threshold` or more;
    n_links counts the documents linked to one, its copies included. A class is what links connect: class_id is its least
    doc_id, class_key a number for it. recall is the least probability to find a pair just at the threshold (closer pairs
    are found more surely); it sets the number of runs. Texts without words are linked to nothing and have a class each
    of their own doc_id; a null doc_id counts as the largest; repeated rows are copies. Sets are named by 64-bit hashes.
    """
    docs = identified(docs)
    known = stage(docs.mapInArrow(sketch(words), "doc_id long, tag long, node long, tokens binary"), "sketches")
    sets = stage(known.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("tag", "doc_id").alias("tag"), F.count("*").alias("copies"), F.any_value("tokens").alias("tokens")), "sets")
    runs = math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))
    level = min(FIRST_LEVELS, levels)
    rows = sets.select(F.lit(0).cast("long").alias("path"), "node", "tokens").mapInArrow(splitter(level, threshold, runs=runs), "path long, node long")
    leaves: DataFrame | None = None
    while True:
        rows = stage(rows, "paths")
        together = rows.repartition("path")  # one exchange for both uses
        sized = together.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
        ready = together.join(sized if level >= levels else sized.where(F.col("n") <= small), "path")
        leaves = ready if leaves is None else leaves.unionByName(ready)
        if level >= levels:
            break
        large = stage(sized.where(F.col("n") > small).select("path"), "large")
        if large.isEmpty():
            break
        rows = rows.join(large, "path", "left_semi").join(sets.select("node", "tokens"), "node").mapInArrow(splitter(1, threshold, LATER_CHOICES), "path long, node long")
        level += 1
    members = stage(leaves, "leaves")
    # of the nodes with the same members one is enough
    chosen = members.groupBy("n", "x", "y").agg(F.min("path").alias("path"))
    members = stage(members.join(chosen.select("path"), "path", "left_semi").select(F.col("path").alias("leaf"), "node", "n").distinct(), "members")
    heads = members.groupBy("leaf").agg(F.min("node").alias("head"))
    whole = components(members.join(heads, "leaf").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    whole = stage(whole.join(whole.groupBy("component").agg(F.count("*").alias("n")), "component"), "wholes")
    units = whole.where(F.col("n") <= small).select(F.col("component").alias("leaf"), "node", "n")
    units = units.unionByName(members.join(whole.where(F.col("n") > small).select("node"), "node", "left_semi"))
    listed = units.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    full = docs.join(sets.join(listed.select("node"), "node", "left_semi").select("node", "doc_id", "tag"), ["doc_id", "tag"]).select("node", "text").dropDuplicates(["node"]).mapInArrow(shingler(words), "node long, shingles array<long>")
    detail = full.join(listed, "node").join(sets.select("node", "copies"), "node")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = units.withColumn("chunk", F.when(tiles > 1, F.pmod(F.xxhash64("node"), tiles)).otherwise(F.lit(0)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.select("leaf", "node", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    judged = placed.join(detail, "node").repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "node").mapInArrow(judge(threshold), "node long, least long, links long")
    found = stage(judged, "links")
    parts = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()).select("node", F.col("component").alias("class_key"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = sets.select("node", "doc_id", "copies").join(parts, "node", "left").join(linked, "node", "left").withColumn("class_key", F.coalesce("class_key", "node"))
    named = stage(classes, "classes")
    least = named.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    by_node = named.join(least, "class_key").select("node", "class_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return known.select("doc_id", "tag", "node").join(by_node, "node", "left").select("doc_id", "tag", F.coalesce("class_key", F.xxhash64("doc_id", "tag")).alias("class_key"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Of each class of similar documents the one with the least doc_id (of equal ids the least text hash), with the
    columns of docs. Texts without words all stay."""
    classes = similar(docs, **options)
    best = classes.groupBy("class_key").agg(F.min(F.struct("doc_id", "tag")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("_doc_id"), F.col("best.tag").alias("_tag"))
    doc_id, tag = row_key()
    return docs.withColumns({"_doc_id": doc_id, "_tag": tag}).join(kept, ["_doc_id", "_tag"], "left_semi").dropDuplicates(["_doc_id", "_tag"]).select(*docs.columns)

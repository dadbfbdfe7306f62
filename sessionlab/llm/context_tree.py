"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own whose contexts are the last DEPTH bytes, one more
at each depth. A node holds how often each bit followed it in training; its Krichevsky-Trofimov estimate is weighted with
the product of what its children predict, half and half before the counts are seen, so every depth is mixed by how well
it has coded the training bytes. A context that training never met leaves the estimate to the deepest one it met.

The model is never gathered in one place. Documents are dealt to blocks; each block lists its different grams (a byte
and its context) and words with their training counts. Grams are shuffled by their two last context bytes, which keeps
whole subtrees together, so depths 2 and beyond are settled there; depths 0 and 1 have at most 65,536 nodes and follow
from sums. Each block then gets back the values of its own grams and words, and its documents are scored from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sessionlab.llm.common import BYTE_VALUES, blocks_for, ranges, span_hashes, stage, text_slices, word_spans
from sessionlab.llm.windows import LAST_ID, document_key

DEPTH, TOP = 5, 2
END = 0x0A
#: The token that ends a text, among the hashes of words (no word holds this byte).
END_WORD = int(span_hashes(BYTE_VALUES[np.array([END])], np.array([0]), np.array([1])).view(np.int64)[0])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
HALF = float(np.log(0.5))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up from x."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - float(np.log(np.pi))


def weighted(estimate: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, weight of the node's own estimate); below: the sum of its children's logs."""
    if below is None:
        return estimate, np.ones_like(estimate)
    total = HALF + np.logaddexp(estimate, below)
    return total, np.exp(HALF + estimate - total)


def subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
    """For the depths DEPTH to TOP of whole subtrees of different sorted grams, by bit: the node of each gram, and the
    nodes' zeros, ones, weights and logs of weighted probabilities."""
    symbol = keys & 255
    owners, nodes = [], []
    deeper = None
    for depth in range(DEPTH, TOP - 1, -1):
        value = ((keys >> (8 * (DEPTH - depth + 1))) << 8) | symbol
        value, first, of = np.unique(value, return_index=True, return_inverse=True)
        count = np.bincount(of, counts, len(value))
        owner, node = [], []
        for b in range(8):
            prefix = value >> (8 - b)
            new = np.append(True, prefix[1:] != prefix[:-1])
            run = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            total = np.add.reduceat(count, begin)
            ones = np.add.reduceat(count * ((value >> (7 - b)) & 1), begin)
            below = None
            if deeper is not None:
                at, logs = deeper[b]
                below = np.bincount(run[of[at]], logs, len(begin))
            log, weight = weighted(log_kt(total - ones, ones), below)
            owner.append(run[of])
            node.append((total - ones, ones, weight, log, first[begin]))
        deeper = [(n[4], n[3]) for n in node]
        owners.append(owner)
        nodes.append(node)
    return owners, nodes


def top_sums(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(node of depth 1, zeros, ones, sum of the logs of its children) of whole subtrees; a node is its byte * 256 + its
    bit prefix with a leading one."""
    _, nodes = subtrees(keys, counts)
    out = np.zeros((65536, 3))
    for b in range(8):
        zeros, ones, _, log, at = nodes[-1][b]
        key = keys[at]
        name = ((key >> (8 * DEPTH)) << 8) | (1 << b) | ((key & 255) >> (8 - b))
        for i, x in enumerate((zeros, ones, log)):
            out[:, i] += np.bincount(name, x, 65536)
    some = np.flatnonzero(out[:, :2].any(axis=1))
    return np.column_stack([some, out[some]])


def top_tables(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(zeros, ones, weight) of the nodes of depths 0 and 1 from the added rows of top_sums."""
    one = np.zeros((65536, 3))
    one[rows[:, 0].astype(np.int64)] = rows[:, 1:]
    log, weight = weighted(log_kt(one[:, 0], one[:, 1]), one[:, 2])
    root = one[:, :2].reshape(256, 256, 2).sum(axis=0)
    _, root_weight = weighted(log_kt(root[:, 0], root[:, 1]), log.reshape(256, 256).sum(axis=0))
    return [(root[:, 0], root[:, 1], root_weight), (one[:, 0], one[:, 1], weight)]


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, top: list) -> np.ndarray:
    """The log10 probability of each gram's byte in its context."""
    owners, nodes = subtrees(keys, counts)
    out = np.zeros(len(keys))
    symbol, byte = keys & 255, keys >> (8 * DEPTH)
    for b in range(8):
        bit = (symbol >> (7 - b)) & 1
        guess, met = np.full(len(keys), 0.5), np.zeros(len(keys), bool)

        def mix(zeros, ones, weight):
            nonlocal guess, met
            total = zeros + ones
            own = (np.where(bit, ones, zeros) + 0.5) / (total + 1.0)
            guess = np.where(met, weight * own + (1 - weight) * guess, own)
            met = met | (total > 0)

        for owner, node in zip(owners, nodes):
            zeros, ones, weight = (x[owner[b]] for x in node[b][:3])
            mix(zeros, ones, weight)
        prefix = (1 << b) | (symbol >> (8 - b))
        mix(*(x[(byte << 8) | prefix] for x in top[1]))
        mix(*(x[prefix] for x in top[0]))
        out += np.log10(guess)
    return out


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a slice: the hashes of their tokens and their bounds, the grams of their bytes and theirs.

    The bytes of a text are its lower-cased words with a space between and the end byte behind; the context before its
    first byte are end bytes.
    """
    data = LOWER[data]
    starts, ends = word_spans(data, at)
    edge = np.searchsorted(starts, at)
    n = len(at) - 1
    size = ends - starts
    words = np.diff(edge)
    token_at = edge + np.arange(n + 1)
    tokens = np.full(len(starts) + n, END_WORD, np.int64)
    tokens[np.arange(len(starts)) + np.repeat(np.arange(n), words)] = span_hashes(BYTE_VALUES[data], starts, ends).view(np.int64)
    row = np.repeat(np.arange(n), words)
    length = np.bincount(row, size + 1, n).astype(np.int64)
    length[words == 0] = 1
    bounds = np.append(0, np.cumsum(length))
    padded = np.full(bounds[-1] + DEPTH * n, END, np.uint8)
    before = np.cumsum(size + 1) - (size + 1)
    place = before - np.append(0, np.cumsum(size + 1))[edge[:-1]][row] + bounds[:-1][row] + DEPTH * (row + 1)
    padded[ranges(place, size)] = data[ranges(starts, size)]
    inner = np.ones(len(starts), bool)
    inner[edge[1:][words > 0] - 1] = False
    padded[(place + size)[inner]] = 0x20
    spot = np.arange(bounds[-1]) + DEPTH * (np.repeat(np.arange(n), length) + 1)
    key = np.zeros(bounds[-1], np.int64)
    for k in range(1, DEPTH + 1):
        key = (key << 8) | padded[spot - k]
    return tokens, token_at, (key << 8) | padded[spot], bounds


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their counts."""
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else np.zeros(0, np.int64)


def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, learn, text) sorted by block to (block, word, key, n): the words and grams of a block, n times in training."""
    block, held = None, {True: ([], []), False: ([], [])}

    def flush() -> Iterator[pa.RecordBatch]:
        for word, (keys, counts) in held.items():
            if keys:
                k, n = added(keys, counts)
                for lo in range(0, len(k), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    m = len(k[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.full(m, word)), pa.array(k[part]), pa.array(n[part])], ["block", "word", "key", "n"])
            keys.clear()
            counts.clear()

    for batch in batches:
        blocks, learn = batch["block"].to_numpy(), batch["learn"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a and blocks[a] != block:
                yield from flush()
                block = blocks[a]
            for lo, hi, data, at in text_slices(batch["text"].slice(a, b - a)):
                tokens, token_at, grams, bounds = stream(data, at)
                taught = learn[a + lo : a + hi]
                for word, keys, edge in ((True, tokens, token_at), (False, grams, bounds)):
                    k, n = added([keys], [np.repeat(taught, np.diff(edge)).astype(np.int64)])
                    held[word][0].append(k)
                    held[word][1].append(n)
                    sizes = [len(x) for x in held[word][0]]
                    if sum(sizes[1:]) > max(400_000, sizes[0]):  # what came since has outgrown what is compact
                        k, n = added(*held[word])
                        held[word] = ([k], [n])
    yield from flush()


def whole_subtrees(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Rows sorted by key in tables of whole subtrees (all grams with the same two last context bytes)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        tree = batch["key"].to_numpy() >> (8 * (DEPTH - TOP + 1))
        last = int(np.searchsorted(tree, tree[-1]))
        if sum(map(len, held)) + len(batch) >= least and (last or (held and held[-1]["key"][-1].as_py() >> (8 * (DEPTH - TOP + 1)) != tree[0])):
            if last:
                held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def score_block(documents: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a block scored from its values: (key, value, mark); the mark of a word is 1, and 2 in the first
    block that has it, and 4 times its training count there; that of a gram is 0."""
    mark = values["mark"].to_numpy()
    word = mark > 0
    key, value = values["key"].to_numpy(), values["value"].to_numpy()
    found = {}
    for kind in (True, False):
        rows = np.flatnonzero(word == kind)
        rows = rows[np.argsort(key[rows], kind="stable")]
        found[kind] = key[rows], value[rows]
    first = (mark & 2 > 0) & (value > 0)
    trained = int((mark >> 2).sum())
    parts = []
    for batch in documents.to_batches():
        for lo, hi, data, at in text_slices(batch["text"]):
            tokens, token_at, grams, bounds = stream(data, at)
            looked = []
            for kind, keys in ((True, tokens), (False, grams)):
                some, of = np.unique(keys, return_inverse=True)
                known, what = found[kind]
                looked.append(what[np.searchsorted(known, some)][of])
            count, log = looked
            parts.append((batch["doc_id"].slice(lo, hi - lo), batch["held_out"].slice(lo, hi - lo), np.diff(token_at), np.add.reduceat((count > 0).astype(np.int64), token_at[:-1]), np.add.reduceat(np.log10(count + 1), token_at[:-1]), np.add.reduceat(log, bounds[:-1])))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "counts", "score", "vocabulary", "trained"]
    tables = [pa.Table.from_arrays([a, b, *map(pa.array, rest), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names) for a, b, *rest in parts]
    total = pa.Table.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.bool_()), *[pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array([int(first.sum())]), pa.array([trained])], names)
    return pa.concat_tables([*tables, total])


def context_tree_scores(docs: DataFrame, modulus: int = 7, held_remainder: int = 2, block_bytes: int = 24 << 20) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Training texts are those whose CRC-32 of doc_id as text leaves another remainder (a null doc_id is never held out).
    Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case and one end; base_score adds log10((c + 1) / (N + V +
    1)) over them, score is the log10 probability of their bytes (its code length in bits is -score / log10(2)). A null
    text has the end alone. Words are compared by 64-bit hashes. Repeated rows count as often as they occur.
    """
    doc_id, tag = document_key()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_remainder, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks_for(size, block_bytes, 1)
    dealt = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.pmod(F.xxhash64(doc_id, tag), blocks).alias("block"), text.alias("text"))
    listed = stage(dealt.select("block", (~F.col("held_out")).alias("learn"), "text").repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(listing, "block long, word boolean, key long, n long"), "grams")

    tree = F.shiftright("key", 8 * (DEPTH - TOP + 1))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_subtrees(batches):
            keys, counts = added([table["key"].to_numpy()], [table["n"].to_numpy()])
            rows = top_sums(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int64)), *[pa.array(rows[:, i]) for i in (1, 2, 3)]], ["node", "zeros", "ones", "below"])

    taught = listed.where("not word and n > 0").select("key", "n")
    sums = taught.repartition(tree).sortWithinPartitions("key").mapInArrow(roots, "node long, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()
    top = top_tables(np.array([tuple(r) for r in sums], np.float64).reshape(-1, 4))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_subtrees(batches):
            every = table["key"].to_numpy()
            keys, of = np.unique(every, return_inverse=True)
            log = log10_probabilities(keys, np.bincount(of, table["n"].to_numpy(), len(keys)), top)
            yield pa.RecordBatch.from_arrays([table["block"].combine_chunks(), pa.array(every), pa.array(log[of])], ["block", "key", "value"])

    grams = listed.where("not word").select("block", "key", "n").repartition(tree).sortWithinPartitions("key").mapInArrow(value, "block long, key long, value double")
    by_key = W.partitionBy("key")
    first = F.when(F.row_number().over(by_key.orderBy("block")) == 1, 2).otherwise(0)
    words = listed.where("word").select("block", "key", F.sum("n").over(by_key).cast("double").alias("value"), (F.col("n") * 4 + first + 1).alias("mark"))
    values = words.unionByName(grams.select("block", "key", "value", F.lit(0).cast("long").alias("mark")))
    scored = stage(dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score_block, "doc_id long, held_out boolean, n_tokens long, n_known long, counts double, score double, vocabulary long, trained long"), "scores")
    total = scored.agg(F.sum("trained"), F.sum("vocabulary")).first()
    trained, vocabulary = total[0] or 0, total[1] or 0
    rows = scored.where("trained is null")
    base = F.col("counts") - F.col("n_tokens") * F.log10(F.lit(float(trained + vocabulary + 1)))
    return rows.select(F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

"""Language ID: a byte convolutional network over fixed-length windows, trained here in numpy.

Each byte has a vector; filters of several widths slide over a window, the largest response of each filter (and zero)
goes into a softmax over the languages seen in training. A text is cut into windows that cover it whole, and its
prediction is the mean of their probabilities, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sessionlab.llm.common import ranges, text_slices

UNKNOWN = "und"
WIDTHS, FILTERS, SIZE, WINDOW = (2, 3, 4), 16, 8, 256
WIDEST = max(WIDTHS)
#: Shares in which the sample of a language is first looked for.
SHARES = 64
#: Bytes that belong to letters: ASCII letters and all bytes of longer UTF-8 sequences.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Network:
    """vectors: byte to SIZE numbers; filters: WIDEST * SIZE to all filters; weights and bias: filters to languages."""

    languages: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All filters at all places (n, places, filters), and the patches they saw."""
        x = self.vectors[windows].reshape(len(windows), -1)
        patches = np.lib.stride_tricks.sliding_window_view(x, WIDEST * SIZE, axis=1)[:, ::SIZE]
        return np.matmul(patches, self.filters), patches

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.responses(windows)[0].max(axis=1) + self.offset, 0)
        return softmax(top @ self.weights + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the cross entropy; only the place of each filter's largest response passes a gradient."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    reach = np.repeat(np.arange(WIDEST), SIZE)[:, None] < np.repeat(WIDTHS, FILTERS)[None, :]
    net = Network(languages, rng.normal(0, 0.5, (256, SIZE)).astype(np.float32), (rng.normal(0, 0.3, (WIDEST * SIZE, total)) * reach).astype(np.float32),
                  np.zeros(total, np.float32), rng.normal(0, 0.2, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    names = ("vectors", "filters", "offset", "weights", "bias")
    first, second, step = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2)), None, 0
    first, second = first
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, n = windows[rows], len(rows)
            response, patches = net.responses(x)
            place = response.argmax(axis=1)
            top = np.take_along_axis(response, place[:, None, :], 1)[:, 0] + net.offset
            hidden = np.maximum(top, 0)
            error = softmax(hidden @ net.weights + net.bias)
            error[np.arange(n), labels[rows]] -= 1
            error /= n
            back = (error @ net.weights.T) * (top > 0)
            seen = patches[np.arange(n)[:, None], place]  # n, filters, WIDEST * SIZE
            vectors = np.zeros_like(net.vectors)
            touched = x[np.arange(n)[:, None, None], place[:, :, None] + np.arange(WIDEST)]
            np.add.at(vectors, touched, (back[:, :, None] * net.filters.T).reshape(n, total, WIDEST, SIZE))
            slopes = {"vectors": vectors, "filters": np.einsum("nf,nfk->kf", back, seen) * reach, "offset": back.sum(0), "weights": hidden.T @ error, "bias": error.sum(0)}
            step += 1
            for k in names:
                first[k] += 0.1 * (slopes[k] - first[k])
                second[k] += 0.001 * (slopes[k] ** 2 - second[k])
                value = getattr(net, k)
                value -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def padded(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Windows of WINDOW bytes each from its own start, zero beyond its size."""
    out = np.zeros((len(begin), WINDOW), np.uint8)
    out.reshape(-1)[ranges(np.arange(len(begin)) * WINDOW, size)] = data[ranges(begin, size)]
    return out


def fit(labelled: DataFrame, per_language: int = 400, windows_each: int = 4) -> Network | None:
    """A network from a bounded sample: of each language the per_language rows (doc_id, text, lang) with the least
    hashes of their doc_id, and of each the first window and those at windows_each - 1 places spread over it."""
    usable = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    order = ["h", "t"]
    some = usable.select("lang", *order, F.pmod(F.xxhash64(*order), F.lit(SHARES)).alias("share"))  # hashes alone, in shares, before the texts of the chosen
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= per_language)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_language).select("lang", *order, "rank")
    piece = lambda i: F.expr(f"substring(text, 1 + cast(length(text) * {i} / {windows_each} as int), {WINDOW})")
    texts = usable.join(F.broadcast(best), ["lang", *order]).select("lang", "rank", F.array(*[piece(i) for i in range(windows_each)]).alias("pieces"))
    rows = texts.dropDuplicates(["lang", "rank"]).orderBy("lang", "rank").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    pairs = [(p.encode()[:WINDOW], languages.index(r.lang)) for r in rows for p in dict.fromkeys(r.pieces) if p.strip()]
    size = np.array([len(p) for p, _ in pairs])
    windows = padded(np.frombuffer(b"".join(p for p, _ in pairs), np.uint8), np.cumsum(size) - size, size)
    return train(windows, np.array([i for _, i in pairs]), languages)


def predict(docs: DataFrame, net: Network | None, keep: list[str | Column]) -> DataFrame:
    """The columns `keep` of each row of docs, its lang_pred and its score, the probability of that language.

    A text that is null or has no letter is `und` with score 0, and so is every text where nothing could be learned.
    """
    kept = docs.select(*keep)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    work = docs.select(F.struct(*keep).alias("keep"), F.when(text.rlike(r"\p{L}"), text).otherwise("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_slices(batch["text"], 1 << 16):
                n = hi - lo
                sums = np.zeros((n, max(1, len(net.languages) if net else 1)))
                if net and len(data):
                    count = -(-np.diff(at) // WINDOW)
                    row = np.repeat(np.arange(n), count)
                    begin = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
                    windows = padded(data, begin, np.minimum(at[row + 1] - begin, WINDOW))
                    for a in range(0, len(row), 128):
                        part = windows[a : a + 128]
                        np.add.at(sums, row[a : a + 128], net.probabilities(part) * (LETTERS[part].sum(axis=1) + 1e-3)[:, None])
                total = sums.sum(axis=1)
                best = sums.argmax(axis=1)
                known = total > 0
                score = np.where(known, sums[np.arange(n), best] / np.where(known, total, 1), 0.0)
                names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)] if net else [UNKNOWN] * n
                yield pa.RecordBatch.from_arrays([batch["keep"].slice(lo, n), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], ["keep", "lang_pred", "score"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField("keep", kept.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return work.mapInArrow(run, out).select("keep.*", "lang_pred", "score")


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def language_id(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Learns from rows that are not held out (the CRC-32
    of doc_id as text, modulo 4, is not 2) and have a language. A null doc_id is not held out and not learned from."""
    labelled = docs.where(remainder(4) != 2).select("doc_id", "text", "lang")
    return predict(docs, fit(labelled, per_language), ["doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")])

"""Benchmark decontamination by spaced seeds.

A mask selects some of the tokens of a span and ignores the others, so a hash of the selected tokens survives
substitutions at the ignored places. Every place of every benchmark item is hashed under every mask and joined with the
hashes of the documents; around each hit the item is laid over the document and their agreement is counted. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlab.llm.common import stage

#: Offsets of the tokens that each mask selects.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
#: Benchmark hashes up to this many are sent to all executors (about 40 bytes each beside the items); beyond, both sides
#: are shuffled by hash.
BROADCAST_SEEDS = 1_000_000


def tokens(text: str) -> Column:
    """Runs of letters and digits, in lower case; a text that begins or ends otherwise has an empty token there."""
    return F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def seeds(words: Column, at: Column, mask: int) -> Column:
    """The hash under one mask of the words from place `at` on; null where the mask does not fit."""
    inside = at + MASKS[mask][-1] < F.size(words)
    return F.when(inside, F.xxhash64(F.lit(mask), *[F.get(words, at + o) for o in MASKS[mask]]))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, misses: int = 2, stride: int = 1) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal): where a document overlaps a benchmark item.

    An overlap is a place where the item (as far as the document goes) agrees with the document in all but `misses` of
    some `window` consecutive tokens; items shorter than the window must agree as a whole, in all but a share of misses
    / window of their tokens. start is the token of the document at the item's first token (it may be negative), n_tokens
    the tokens laid over each other, n_equal those that agree. Documents are hashed at every stride-th place and items
    at every place; at stride 1 and the window and misses given here, every overlap is hit by some mask, wherever the
    misses lie. Items of fewer tokens than the shortest mask's span are not searched.
    Null texts and ids have no overlaps; repeated rows give one row.
    """
    item = benchmark.where("item_id is not null").select("item_id", F.filter(tokens("text"), lambda w: w != "").alias("item")).distinct()
    places = item.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("item") - 1, F.lit(0)))))
    hashed = places.withColumn("seed", F.explode(F.array(*[seeds(F.col("item"), F.col("item_at"), m) for m in range(len(MASKS))]))).where("seed is not null")
    known = stage(hashed.groupBy("seed").agg(F.collect_set(F.struct("item_id", "item", "item_at")).alias("at")), "seeds")
    few = known.select(F.sum(F.size("at"))).first()[0] or 0
    words = docs.where("doc_id is not null").select("doc_id", tokens("text").alias("words"))
    spots = words.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))))
    own = spots.withColumn("seed", F.explode(F.array(*[seeds(F.col("words"), F.col("place"), m) for m in range(len(MASKS))]))).where("seed is not null")
    if few <= BROADCAST_SEEDS:
        hits = own.join(F.broadcast(known), "seed")
    else:  # only places and hashes are shuffled; the documents join the hits
        met = own.select("doc_id", "place", "seed").join(known, "seed").select("doc_id", "place", "at")
        hits = met.join(words, "doc_id")
    hit = hits.select("doc_id", "words", "place", F.explode("at").alias("t")).select("doc_id", "t.item_id", "t.item", (F.col("place") - F.col("t.item_at")).alias("start"), "words")
    laid = hit.select("doc_id", "item_id", "item", "start", F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("item") + F.least(F.col("start"), F.lit(0))).alias("part"), F.greatest(-F.col("start"), F.lit(0)).alias("skip")).withColumn("of", F.xxhash64("part"))
    laid = laid.dropDuplicates(["doc_id", "item_id", "start", "of"])
    agree = F.transform(F.col("part"), lambda w, i: (w == F.get(F.col("item"), i + F.col("skip"))).cast("int"))
    span = F.least(F.lit(window), F.size("item"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("agree") - span + 1, F.lit(1))), lambda i: F.aggregate(F.slice("agree", i, span), F.lit(0), lambda a, b: a + b)))
    judged = laid.withColumn("agree", agree).where(F.size("agree") >= span).withColumn("best", best)
    need = F.when(F.size("item") >= window, F.lit(window - misses)).otherwise(F.ceil(F.size("item") * (1 - misses / window)))
    out = judged.where(F.col("best") >= need).select("doc_id", "item_id", "start", F.size("agree").alias("n_tokens"), F.aggregate("agree", F.lit(0), lambda a, b: a + b).alias("n_equal"))
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id has no overlap with an item; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti")

"""Exact dedup by a Golomb-coded exchange of fingerprints; only suspects are shuffled and compared byte by byte.

The documents are written once to the shared folder, bucketed by sender, a sender being a run of at most 2^18 rows of one
task. From then on:

1. Each sender sorts its different fingerprints and sends every owner (a range of fingerprints) the gaps between those
   that fall to it, as Golomb codes of a power of two, with one bit for those it has itself more than once.
2. An owner decodes the messages, finds the fingerprints that more than one sender has, and answers each message with a
   bitmap in the order of the message.
3. The sender turns the bitmaps into one bit per row. Rows with the bit are suspects. The bucketed table meets the bits
   without moving, and only suspects go on.
4. Suspects are grouped by their whole text. Copies are combined before the shuffle, so a text that a third of all rows
   share moves once per task.
5. Classes go back to the senders, one row per (sender, text), and each row takes its answer there.

What is shuffled for a document that has no copy is its coded gap, about bits - log2(rows of the message) + 1.5 bits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import blocks_for, shared_folder, stage

SENDER_BITS = 18
#: Fingerprints an owner decodes at once (8 bytes each, some five arrays).
OWNER_ROWS = 1 << 22
#: Bits a fingerprint has beyond those that count the rows: about one document in 2^12 is a suspect without a copy.
SPARE_BITS = 12
#: Spark's own bound on buckets is 100,000. More rows make larger buckets.
MOST_BUCKETS = 1 << 16


def golomb(gaps: np.ndarray, shift: int) -> bytes:
    """Golomb codes of modulus 2^shift: all remainders, then all quotients in unary (q zeros and a one)."""
    low = np.packbits((gaps[:, None] >> np.arange(shift)) & 1 == 1)
    ends = np.cumsum((gaps >> shift) + 1)
    unary = np.zeros(int(ends[-1]), bool)
    unary[ends - 1] = True
    return low.tobytes() + np.packbits(unary).tobytes()


def golomb_decoded(code: bytes, n: int, shift: int) -> np.ndarray:
    bits = np.frombuffer(code, np.uint8)
    cut = -(-n * shift // 8)
    low = np.unpackbits(bits[:cut], count=n * shift).reshape(n, shift).astype(np.int64) @ (np.int64(1) << np.arange(shift, dtype=np.int64))
    ends = np.flatnonzero(np.unpackbits(bits[cut:]))[:n]
    return ((np.diff(ends, prepend=-1) - 1) << shift) + low


def modulus_bits(span: int, n: int) -> int:
    """The power of two next below 0.69 times the mean gap."""
    return max(0, int(0.69 * span / n).bit_length() - 1)


def _messages(table: pa.Table, width: int) -> pa.Table:
    """The messages of one sender; width: bits of a fingerprint below its owner's number."""
    own, times = np.unique(table["fp"].to_numpy(), return_counts=True)
    owners, first = np.unique(own >> width, return_index=True)
    out = []
    for owner, lo, hi in zip(owners, first, [*first[1:], len(own)]):
        n, shift = int(hi - lo), modulus_bits(1 << width, int(hi - lo))
        gaps = np.diff(own[lo:hi] - (int(owner) << width), prepend=-1) - 1
        out.append((int(owner), n, shift, golomb(gaps, shift), np.packbits(times[lo:hi] > 1).tobytes()))
    names, types = ("owner", "n", "shift", "code", "repeated"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
    return pa.table([pa.array(np.full(len(out), table["sender"][0].as_py()), pa.int64()), *columns], ["sender", *names])


def _bitmaps(table: pa.Table) -> pa.Table:
    """What an owner answers: per message the bitmap of the fingerprints that occur more than once anywhere."""
    sizes = table["n"].to_numpy()
    messages = zip(sizes.tolist(), table["shift"].to_pylist(), table["code"].to_pylist(), table["repeated"].to_pylist())
    values, seen = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), bool)
    ends = np.cumsum(sizes)
    for (n, shift, code, repeated), end in zip(messages, ends):
        values[end - n : end] = np.cumsum(golomb_decoded(code, n, shift) + 1) - 1
        seen[end - n : end] = np.unpackbits(np.frombuffer(repeated, np.uint8), count=n)
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    seen[order[1:][same]] = True
    seen[order[:-1][same]] = True
    bitmaps = [np.packbits(seen[end - n : end]).tobytes() for n, end in zip(sizes, ends)]
    return pa.table([table["sender"], table["owner"], pa.array(bitmaps, pa.binary())], ["sender", "owner", "bits"])


def _marks(held: pa.Table, bitmaps: pa.Table, width: int) -> pa.Table:
    """One row for a sender: the suspects among its rows as the bits of an array of longs, by place."""
    own, back = np.unique(held["fp"].to_numpy(), return_inverse=True)
    twice, owners = np.zeros(len(own), bool), own >> width
    for owner, bits in zip(bitmaps["owner"].to_pylist(), bitmaps["bits"].to_pylist()):
        lo, hi = np.searchsorted(owners, [owner, owner + 1])
        twice[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    at = (held["place"].to_numpy() & ((1 << SENDER_BITS) - 1))[twice[back]]
    flags = np.zeros((int(at.max()) // 64 + 1) * 64 if len(at) else 64, np.uint8)
    flags[at] = 1
    words = np.packbits(flags, bitorder="little").view("<i8")
    return pa.table([held["sender"][:1], pa.array([words], pa.list_(pa.int64()))], ["sender", "marks"])


def _settled(held: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of one sender with the answer to their text; a row without one is alone."""
    if pc.count_distinct(answers["text_sha256"]).as_py() != len(answers):
        raise ValueError("different texts have one SHA-256")
    at = pc.index_in(held["text_sha256"], answers["text_sha256"].combine_chunks())
    alone = pc.is_null(at)
    keep_id = pc.if_else(alone, held["doc_id"], answers["keep_id"].take(at))
    size = pc.fill_null(answers["group_size"].take(at), 1)
    kept = pc.if_else(alone, True, pc.equal(answers["keep_place"].take(at), held["place"]))
    return pa.table([held["doc_id"], keep_id, size, kept, held["text_sha256"]], ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> str:
    """The name of a table of df in the shared folder, in buckets of `key`; readers grouped or joined by `key` need no shuffle."""
    spark, table = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return table


def exact_dedup(docs: DataFrame, owner_rows: int = OWNER_ROWS, spare_bits: int = SPARE_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    docs: doc_id (a whole number), text; other columns are left out. Texts are equal if all their bytes are; a null text is
    empty. The row with the largest doc_id stays; a null doc_id is less than all others, and of rows that share text and
    doc_id exactly one stays. keep_id is null only if no row of the group has a doc_id. An empty table gives no rows.
    """
    rows = docs.count()
    bits = min(62, max(1, rows).bit_length() + spare_bits)
    width = bits - min(bits - 1, (blocks_for(rows, owner_rows, 16) - 1).bit_length())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), F.shiftrightunsigned(F.xxhash64("text"), 64 - bits).alias("fp"), F.monotonically_increasing_id().alias("place"))
    buckets = min(MOST_BUCKETS, blocks_for(rows, 1 << 16, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    name = bucketed(texts.withColumn("sender", F.shiftright("place", SENDER_BITS)), "texts", buckets, "sender")
    held = lambda *columns: docs.sparkSession.table(name).select(*[F.col(c).alias(c) for c in columns])
    ids = docs.schema["doc_id"].dataType.simpleString()

    messages = held("sender", "fp").groupBy("sender").applyInArrow(lambda t: _messages(t, width), "sender bigint, owner int, n int, shift int, code binary, repeated binary")
    bitmaps = messages.groupBy("owner").applyInArrow(_bitmaps, "sender bigint, owner int, bits binary")
    marks = stage(held("sender", "place", "fp").groupBy("sender").cogroup(bitmaps.groupBy("sender"))
                  .applyInArrow(lambda a, b: _marks(a, b, width), "sender bigint, marks array<bigint>"), "marks").withColumnRenamed("sender", "marked")

    word = f"get(marks, CAST((place & {(1 << SENDER_BITS) - 1}) DIV 64 AS INT))"
    marked = (F.col("sender") == F.col("marked")) & F.expr(f"shiftright(coalesce({word}, 0L), CAST(place & 63 AS INT)) & 1 = 1")
    suspects = lambda *columns: held("sender", "place", *columns).join(marks.hint("shuffle_hash"), marked, "left_semi")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    classes = suspects("doc_id", "text_sha256", "text").groupBy("text_sha256", "text").agg(F.max_by("place", order).alias("keep_place"), F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.where("group_size > 1").drop("text")
    asked = suspects("text_sha256").select("sender", "text_sha256").distinct()
    answers = asked.join(classes, "text_sha256").select("sender", "text_sha256", "keep_place", "keep_id", "group_size")
    return held("sender", "place", "doc_id", "text_sha256").groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(
        _settled, f"doc_id {ids}, keep_id {ids}, group_size bigint, kept boolean, text_sha256 string")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

"""Source divergence audit: how far the term shares of each source lie from the other sources and from the whole language.

Only nonzero counts are stored. A term is a row: its counts in source order. Equal rows of a language become one with a
multiplicity, and sorted rows are a frequent-pattern tree: what a row shares with the row before is a shared path. The
divergence of two sources over all kept terms is then a sum of three parts:

* both counts zero for every kept term: V times one value;
* for every different share of one source, as often as it occurs, the change if only that source has the term;
* for every node and ancestor of the tree, once, times the rows below the node, the rest where both have it.

Shares, products and sums are exact integers. Rows are dealt by sorted ranges, so shared paths meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sessionlab.llm.common import ranges, stage, text_slices, word_spans

#: Terms are runs of ASCII letters and of bytes above 0x7F.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
NO_TERM = np.arange(256) < 0x80
NO_TERM[ord("a") : ord("z") + 1] = False
#: Bytes of text that are counted at once.
TEXT_SLICE = 1 << 24
SCALE = 1_000_000_000
#: Node-ancestor combinations that are worked out at once in a task.
TOGETHER = 1 << 18


def share(count: str, total: str = "n") -> str:
    """SQL of 1 + floor(SCALE * (count + 2) / (total + 2 * v)); 0 where no term is kept."""
    return f"CASE WHEN v > 0 THEN 1 + (CAST({count} + 2 AS DECIMAL(20,0)) * {SCALE} DIV CAST({total} + 2 * v AS DECIMAL(20,0))) ELSE 0L END"


def apart(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q))."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q})))"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of (lang, source, text) rows."""
    for batch in batches:
        keys = batch.select(["lang", "source"]).to_pandas()
        group, first = keys.groupby(["lang", "source"], sort=False).ngroup().to_numpy(), keys.drop_duplicates().index.to_numpy()
        for lo, hi, data, at in text_slices(batch["text"], TEXT_SLICE):
            low = LOWERED[data]
            starts, ends = word_spans(low, at, NO_TERM)
            if not len(starts):
                continue
            letters, offsets = low[~NO_TERM[low]], np.concatenate([[0], np.cumsum(ends - starts)])
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
            size = len(terms.dictionary)
            in_row, n = np.unique((np.searchsorted(at, starts, "right") - 1) * size + terms.indices.to_numpy(), return_counts=True)
            key = group[lo + in_row // size] * size + in_row % size
            order = np.argsort(key, kind="stable")
            key, here = np.unique(key[order], return_index=True)
            who = pa.array(first[key // size])
            yield pa.RecordBatch.from_arrays([batch["lang"].take(who), batch["source"].take(who), terms.dictionary.take(pa.array(key % size)).cast(pa.string()),
                                              pa.array(np.add.reduceat(n[order], here)), pa.array(np.diff(here, append=len(order)))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that contain the term; both combined before the shuffle."""
    parts = docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tree_nodes(lengths: np.ndarray, nodes: tuple[np.ndarray, ...], rows: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(ancestor, node, multiplicity) of the tree of sorted rows, in pieces of about TOGETHER; both are places in `nodes`.

    Row r holds the next lengths[r] entries of each array of nodes; rows: the language of each row; times: its multiplicity.
    A place opens a node unless the row before has the same path down to it; the node's multiplicity is that of all
    rows until the path ends.
    """
    starts = np.cumsum(lengths) - lengths
    n, deepest = len(lengths), int(lengths.max())
    total = np.concatenate([[0], np.cumsum(times)])
    below = np.empty(len(nodes[0]), np.int64)
    opens = np.zeros(len(nodes[0]), bool)
    same = np.concatenate([[False], rows[1:] == rows[:-1]])
    for depth in range(deepest):
        has = lengths > depth
        at = np.where(has, starts + depth, 0)
        ahead = np.concatenate([[0], at[:-1]])
        same &= has & np.concatenate([[False], has[:-1]])
        for column in nodes:
            same &= column[at] == column[ahead]
        new = np.flatnonzero(has & ~same)
        # a path ends where the next one begins, or at a row too short for it
        ends = np.flatnonzero(~same)
        until = np.concatenate([ends, [n]])[np.searchsorted(ends, new, "right")]
        opens[at[new]] = True
        below[at[new]] = total[until] - total[new]
    place = np.flatnonzero(opens)
    depth = place - np.repeat(starts, lengths)[place]
    cuts = np.searchsorted(np.cumsum(depth), np.arange(TOGETHER, int(depth.sum()) + TOGETHER, TOGETHER), "left") + 1
    for lo, hi in zip(np.concatenate([[0], cuts[:-1]]), cuts):
        some, deep = place[lo:hi], depth[lo:hi]
        if deep.sum():
            yield ranges(some - deep, deep), np.repeat(some, deep), np.repeat(below[some], deep)


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) summed for each batch of sorted rows (lang, row of (source, p, zero), times)."""
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for batch in batches:
        if not len(batch):
            continue
        lengths = batch["row"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        entries = batch["row"].flatten()
        source, p, zero = (entries.field(name) for name in ("source", "p", "zero"))
        names, p, zero = source.dictionary_encode(), p.to_numpy(), zero.to_numpy()
        source, langs = names.indices.to_numpy().astype(np.int64), batch["lang"].dictionary_encode()
        row_lang, n = langs.indices.to_numpy().astype(np.int64), len(names.dictionary)
        lang = np.repeat(row_lang, lengths)
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b, times in tree_nodes(lengths, (source, p), row_lang, batch["times"].to_numpy()):
            rest = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            keys, back = np.unique(np.concatenate([keys, (lang[a] * n + source[a]) * n + source[b]]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, back, np.concatenate([values, rest * times]))
            values = sums
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // (n * n))), names.dictionary.take(pa.array(keys // n % n)), names.dictionary.take(pa.array(keys % n)), pa.array(values)],
                                         ["lang", "a", "b", "value"])


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) that occurs.

    docs: text, lang, source; nulls are read as empty, other columns are left out, repeated rows count each time. A term is
    kept for a language if `least` of its rows contain it. A source's share of a term is
    1 + floor(10^9 * (count + 2) / (N + 2 * V)), two shares differ by floor((p - q)^2 / (p + q)). Part pair: each other
    source of the language with the sum over all kept terms, 0 if none is kept; all ranks. Part term: the `top` kept terms
    of a source that lie furthest above the language's share. Ties of value go by the item's bytes. An empty table gives
    no rows.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = stage(term_counts(docs), "terms")
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = stage(counts.drop("docs").join(in_lang, ["lang", "term"]).withColumnRenamed("n", "count"), "kept")
    size = in_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    total = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(size, "lang", "left").join(total, ["lang", "source"], "left").na.fill(0, ["v", "n", "lang_total"])
    groups = stage(groups.withColumn("zero", F.expr(share("0"))), "sources")
    entries = stage(kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("count"))), "shares")

    rows = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("row"))
    paths = rows.groupBy("lang", "row").agg(F.count("*").alias("times")).where(F.size("row") > 1)
    # ranges by the first entries of a row: short keys, as Spark samples them to the driver; the hash splits a hot beginning
    begin = [F.expr(f"get(row, {i}).{c}") for i in range(3) for c in ("source", "p")]
    tree = paths.repartitionByRange("lang", *begin, F.xxhash64("row")).sortWithinPartitions("lang", "row").mapInArrow(corrections, "lang string, a string, b string, value bigint")

    one = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("a_zero"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b_zero"))
    pairs = one.join(other, "lang").where("a <> b")
    base = pairs.where("a < b").select("lang", "a", "b", F.expr(f"CASE WHEN v > 0 THEN v * {apart('a_zero', 'b_zero')} ELSE 0L END").alias("value"))
    shares = entries.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    single = (pairs.join(shares, ["lang", "a"]).withColumn("value", F.expr(f"times * ({apart('p', 'b_zero')} - {apart('a_zero', 'b_zero')})"))
              .select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value"))
    found = stage(base.unionByName(single).unionByName(tree).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    terms = entries.withColumn("q", F.expr(share("lang_n", "lang_total"))).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))
    return part(both, "pair").unionByName(part(terms, "term").where(F.col("rank") <= top))


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
lang_size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
share AS (SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(x.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * z.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (k.c + 2)) // (z.n + 2 * z.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN lang_size z ON z.lang = g.lang LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM share WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

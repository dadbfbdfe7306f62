"""Ordered scans over a key that may hold a large share of all rows.

A plain ``Window.partitionBy(session)`` puts a whole session into one task.  Here
every session is cut into slabs of bounded size; the windows run inside a slab, and
each slab also gets what the rows before it would have contributed (the last row, the
last known value, the sum or maximum so far).  Those carries come from one summary row
per slab, so only the summaries are ever ordered per session.

A step reads its input twice (once for the summary, once for the rows), so the input is first
written to the cluster's checkpoint folder (``cut``): it is computed once, both readers prune
columns, the lineage stays short, and a lost executor costs nothing but its own tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

SLAB = "_slab"


_WRITTEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the warehouse where that is not set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read, and return the written table."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this process has cut; frames built on them must no longer be used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column


def prev_row(value: Column) -> Step:
    """Value of ``value`` on the row just before (NULL on the first row)."""
    return Step("prev_row", value)


def carry(value: Column) -> Step:
    """Last non-NULL ``value`` strictly before the row."""
    return Step("carry", value)


def carry_here(value: Column) -> Step:
    """Last non-NULL ``value`` up to and including the row."""
    return Step("carry_here", value)


def running_sum(value: Column) -> Step:
    """Sum of ``value`` up to and including the row."""
    return Step("running_sum", value)


def running_max(value: Column) -> Step:
    """Largest ``value`` strictly before the row."""
    return Step("running_max", value)


def slabs(df: DataFrame, slab: Column) -> DataFrame:
    """Add the slab number."""
    return df.withColumn(SLAB, slab)


def ordinal_slab(order: str = "ordinal", rows: int = 65536) -> Column:
    """Slabs of at most ``rows`` distinct ordinals (ordinals are gap-free per session)."""
    return F.floor(F.col(order) / F.lit(rows)).cast("long")


def by_range(df: DataFrame, order: list[str]) -> DataFrame:
    """df in even ranges of ``order``, whatever the spread of its values, with the number of the range as _cell.

    The ranges come from a sample, so the result has to be written (``cut``) before it is used.
    """
    return df.repartitionByRange(*order).withColumn("_cell", F.spark_partition_id().cast("long"))


def step(df: DataFrame, keys: list[str], order: list[str], stored: bool = False, **columns: Step) -> DataFrame:
    """Add one scanned column per keyword to a frame prepared by ``slabs``.

    ``stored`` says that reading the frame twice is cheap: it is little more than a table scan.
    """
    df = df if stored else cut(df)
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    local = W.partitionBy(*keys, SLAB).orderBy(*order)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    here = local.rowsBetween(W.unboundedPreceding, 0)
    over_slabs = W.partitionBy(*keys).orderBy(SLAB)
    earlier = over_slabs.rowsBetween(W.unboundedPreceding, -1)

    inside, totals, carried, final = [], [], [], []
    for name, s in columns.items():
        t, c, mine = f"_t_{name}", f"_c_{name}", f"_w_{name}"
        if s.kind == "prev_row":
            inside.append(F.lag(F.struct(s.value.alias("v"))).over(local).alias(mine))
            totals.append(F.max_by(F.struct(s.value.alias("v")), rank).alias(t))
            carried.append(F.lag(t).over(over_slabs).alias(c))
            final.append(F.coalesce(F.col(mine), F.col(c))["v"].alias(name))
        elif s.kind in ("carry", "carry_here"):
            frame = before if s.kind == "carry" else here
            inside.append(F.last(s.value, ignorenulls=True).over(frame).alias(mine))
            totals.append(F.max_by(s.value, F.when(s.value.isNotNull(), rank)).alias(t))
            carried.append(F.last(t, ignorenulls=True).over(earlier).alias(c))
            final.append(F.coalesce(F.col(mine), F.col(c)).alias(name))
        elif s.kind == "running_sum":
            inside.append(F.sum(s.value).over(here).alias(mine))
            totals.append(F.sum(s.value).alias(t))
            carried.append(F.sum(t).over(earlier).alias(c))
            final.append((F.coalesce(F.col(mine), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(name))
        elif s.kind == "running_max":
            inside.append(F.max(s.value).over(before).alias(mine))
            totals.append(F.max(s.value).alias(t))
            carried.append(F.max(t).over(earlier).alias(c))
            final.append(F.greatest(F.col(mine), F.col(c)).alias(name))
        else:
            raise ValueError(s.kind)

    marks = [*keys, SLAB]
    summary = (
        df.groupBy(*marks).agg(*totals)
        .select(*[F.col(m).alias(f"_j_{m}") for m in marks], *carried)
    )
    same = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"_j_{m}") for m in marks])
    return (
        df.select("*", *inside)
        .join(summary, same, "left")
        .select(*df.columns, *final)
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], slab: Column, name: str, stored: bool = False) -> DataFrame:
    """1-based position per key: position inside the slab plus the sizes of earlier slabs."""
    placed = slabs(df, slab)
    return step(placed, keys, order, stored, **{name: running_sum(F.lit(1))}).drop(SLAB)


def halo(df: DataFrame, keys: list[str], at: str, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Time slabs for operators that look only ``back`` and ``ahead`` in time.

    A row goes to its own slab (``_own`` is true) and, near an edge, to the neighbours that need it as
    context.  Any depth of windows over (keys, _slab) is then exact for the owned rows, with one
    shuffle and no task larger than ``width`` plus the context.
    """
    first, last, own = (f"CAST(floor(({e}) / {width}) AS BIGINT)" for e in (f"{at} - {ahead}", f"{at} + {back}", at))
    return (df.selectExpr("*", f"{own} AS _own_slab", f"explode(sequence({first}, {last})) AS {SLAB}")
            .selectExpr(*df.columns, SLAB, f"_own_slab = {SLAB} AS _own").repartition(*keys, SLAB))


def by_group(df: DataFrame, marks: list[str], order: str, fn, schema: StructType) -> DataFrame:
    """``fn(table, bounds)`` over sorted whole groups, many small ones at a time: group g is rows bounds[g] to bounds[g + 1]."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            edges = starts(table)
            held = table.slice(edges[-1])
            if len(edges) > 1:
                yield from fn(table.slice(0, edges[-1]), edges).to_batches()
        if held is not None and len(held):
            yield from fn(held, np.append(starts(held), len(held))).to_batches()

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in marks:
            codes = table[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    return df.repartition(*marks).sortWithinPartitions(*marks, order).mapInArrow(run, schema)


def chain(df: DataFrame, keys: list[str], at: str, hop: str, rows: int = 65536) -> DataFrame:
    """df with ``_on``: whether the row lies on the chain that starts at position 1 of its key and goes on by ``hop`` rows.

    ``at`` numbers the rows of a key from 1; every hop is positive; no key is null. Inside a slab, chains are followed by
    pointer doubling: every row takes its successor's successor until all are outside. Where the chain enters a slab
    depends on all rows before it, so each slab first tells its different exits (chains that meet stay together, so these
    are few), then answers for the entries that the slab before offers; only these pairs are followed per key. A slab holds
    at least the longest hop.
    """
    df = cut(df)
    longest, last = df.agg(F.max(hop), F.max(at)).first()
    width = max(rows, longest or 1)
    marks = [*keys, SLAB]
    placed = df.withColumn(SLAB, F.floor((F.col(at) - 1) / width).cast("long"))
    fields = [f for f in placed.schema.fields if f.name in keys]
    slab, entry, exit_ = (StructField(n, LongType()) for n in (SLAB, "_entry", "_exit"))

    def ends_of(table: pa.Table, bounds: np.ndarray) -> np.ndarray:
        """Where the chain from each row leaves its group, as an offset behind the group's end."""
        n = len(table)
        end = np.repeat(bounds[1:], np.diff(bounds))
        to = np.arange(n) + table[hop].to_numpy()
        over = to - end
        to = np.where(over < 0, to, np.arange(n))
        while (inside := over < 0).any():
            over[inside], to[inside] = over[to[inside]], to[to[inside]]
        return over

    def exits(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        some = np.unique(np.stack([group, ends_of(table, bounds)], axis=1), axis=0)
        firsts = table.take(pa.array(bounds[:-1][some[:, 0]]))
        return pa.table([*[firsts[k] for k in keys], pa.array(firsts[SLAB].to_numpy() + 1), pa.array(some[:, 1])], [*keys, SLAB, "_entry"])

    def answer(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        over, first = ends_of(table, bounds), table.take(pa.array(bounds[:-1]))
        group, asked = [], []
        for g, (number, entries) in enumerate(zip(first[SLAB].to_pylist(), first["_entries"].to_pylist())):
            mine = [e for e in ({0} if number == 0 else set()) | set(entries or []) if e < bounds[g + 1] - bounds[g]]
            group += [g] * len(mine)
            asked += mine
        group, asked = np.array(group, np.int64), np.array(asked, np.int64)
        picked = first.take(pa.array(group))
        return pa.table([*[picked[k] for k in keys], picked[SLAB], pa.array(asked), pa.array(over[bounds[group] + asked])], [*keys, SLAB, "_entry", "_exit"])

    def follow(pairs: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(zip(pairs[SLAB], pairs["_entry"]), pairs["_exit"]))
        out, here = [], (0, 0)
        while here in known:
            out.append(here)
            here = here[0] + 1, known[here]
        return pairs[keys].head(1).merge(pd.DataFrame(out, columns=[SLAB, "_entry"]), how="cross")

    def mark(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        n, size = len(table), np.diff(bounds)
        end = np.repeat(bounds[1:], size)
        to = np.append(np.arange(n) + table[hop].to_numpy(), n)
        to[:-1][to[:-1] >= end] = n
        enters = table["_entry"].to_numpy()[bounds[:-1]]
        on = np.zeros(n + 1, bool)
        on[(bounds[:-1] + enters)[(enters >= 0) & (enters < size)]] = True
        while (to[:-1] < n).any():
            on[to[on]] = True
            to = to[to]
        return table.drop_columns([SLAB, "_entry"]).append_column("_on", pa.array(on[:-1]))

    if (last or 0) <= width:
        entered = placed.withColumn("_entry", F.lit(0).cast("long"))
    else:
        narrow = placed.select(*marks, at, hop)
        offered = by_group(narrow, marks, at, exits, StructType([*fields, slab, entry])).groupBy(*marks).agg(F.collect_list("_entry").alias("_entries"))
        pairs = by_group(narrow.join(offered, marks, "left"), marks, at, answer, StructType([*fields, slab, entry, exit_]))
        entries = pairs.groupBy(*keys).applyInPandas(follow, StructType([*fields, slab, entry]))
        entered = placed.join(entries, marks, "left").withColumn("_entry", F.coalesce("_entry", F.lit(-1)))
    return by_group(entered.select(*df.columns, SLAB, "_entry"), marks, at, mark, StructType([*df.schema.fields, StructField("_on", BooleanType())]))


def settle(starts: DataFrame, keys: list[str], fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Slabs of a state that must be followed in order, each started with a guess and done again until all guesses hold.

    ``starts`` has the keys, the slab number (``slab``), what ``fold`` needs besides, and ``starts``: the guessed state
    before the slab. ``fold`` returns the same columns with ``ends``, the state after it, and what the slab yields. Where a
    slab did not start with what the one before ended with, it is done again. States that meet stay together, so a wrong
    guess is mended in the slabs up to there; a key of n slabs needs n rounds at worst.
    """
    kept = starts.columns
    ends = cut(fold(starts))
    while True:
        links = " AND ".join(f"a.{k} <=> b.{k}" for k in keys)
        wrong = cut(sql(f"""SELECT {", ".join("a.ends AS starts" if c == "starts" else f"b.{c}" for c in kept)}
          FROM {{ends}} a JOIN {{ends}} b ON {links} AND a.slab + 1 = b.slab WHERE NOT a.ends <=> b.starts""", ends=ends))
        if not wrong.limit(1).count():
            return ends
        right = sql(f"SELECT * FROM {{ends}} a LEFT ANTI JOIN {{wrong}} b ON {links} AND a.slab = b.slab", ends=ends, wrong=wrong)
        ends = cut(right.unionByName(fold(wrong)))


def sql(text: str, **frames: DataFrame) -> DataFrame:
    """SQL over DataFrames named as ``{name}`` in the text."""
    return next(iter(frames.values())).sparkSession.sql(text, **frames)

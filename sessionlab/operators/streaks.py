"""Repeated suspicious samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .scan import SLAB, carry, chain, halo, ordinal_slab, prev_row, running_sum, slabs, step

KEY, ORDER = ["session"], ["ordinal"]


def anchored_streaks(samples: DataFrame, keys: list[str], most: int, rows: int = 65536) -> DataFrame:
    """Alerts where ``needed`` suspicious samples fall in a window anchored at the first of them; a clean sample clears.

    ``samples``: keys, ordinal, ns, suspicious, window_ns, needed (at most ``most``). Each suspicious sample knows from the
    next ``needed`` ones where the anchor would go from it; the anchors are then a chain of such hops (``scan.chain``), so no
    task follows a whole session.
    """
    framed = step(slabs(samples.select(*keys, "ordinal", "ns", "suspicious", "window_ns", "needed"), ordinal_slab(rows=rows)), keys, ORDER, _before=prev_row(F.col("suspicious")))
    fresh = framed.filter("suspicious").withColumn("_fresh", ~F.coalesce("_before", F.lit(False))).drop("_before")
    placed = step(fresh, keys, ORDER, _at=running_sum(F.lit(1))).drop(SLAB).withColumn("_at", F.col("_at").cast("long"))
    need = halo(placed, keys, "_at", rows, ahead=max(most, 2))
    w = W.partitionBy(*keys, SLAB).orderBy("_at").rowsBetween(1, max(most, 2) - 1)
    ahead = need.withColumn("_ahead", F.collect_list(F.struct("ordinal", "ns", "_fresh")).over(w)).filter("_own")
    hops = ahead.withColumn("_ahead", F.expr("slice(_ahead, 1, needed - 1)")).selectExpr(
        *keys, "ordinal", "ns", "needed", "_at", "_ahead", "array_position(transform(_ahead, x -> x._fresh OR x.ns - ns NOT BETWEEN 0 AND window_ns), true) AS _break")
    hops = hops.selectExpr(*keys, "ordinal", "needed", "_at", "CASE WHEN _break > 0 THEN _break ELSE CAST(needed AS BIGINT) END AS _hop",
                           "CASE WHEN _break = 0 AND size(_ahead) = needed - 1 THEN coalesce(get(_ahead, needed - 2), named_struct('ordinal', ordinal, 'ns', ns, '_fresh', false)) END AS _hit")
    return (chain(hops, keys, "_at", "_hop", rows).filter("_on AND _hit IS NOT NULL")
            .select(*keys, F.col("_hit.ordinal").alias("ordinal"), F.col("_hit.ns").alias("ns"), F.col("needed").cast("int").alias("samples"), F.col("ordinal").alias("first_sample")))


def anchored_streak(samples: DataFrame, window_ms: float, needed: int, rows: int = 65536) -> DataFrame:
    """``anchored_streaks`` of one check over sessions."""
    timed = samples.withColumns({"window_ns": F.lit(int(window_ms * 1e6)), "needed": F.lit(needed)})
    return anchored_streaks(timed, KEY, needed, rows)


def sliding_streaks(samples: DataFrame, keys: list[str], rows: int = 65536) -> DataFrame:
    """``streak`` of each suspicious sample in its run, and an alert at every ``needed``-th; a step longer than
    ``window_ns`` or a clean sample ends the run."""
    framed = step(slabs(samples.select(*keys, "ordinal", "ns", "suspicious", "window_ns", "needed"), ordinal_slab(rows=rows)), keys, ORDER,
                  _before=carry(F.col("ns")), _n=running_sum(F.col("suspicious").cast("long")))
    late = ~F.coalesce((F.col("ns") - F.col("_before")).between(F.lit(0), F.col("window_ns")), F.lit(False))
    runs = step(framed.withColumn("_late", late), keys, ORDER,
                _clean=carry(F.when(~F.col("suspicious"), F.col("_n"))),
                _run=carry(F.when(F.col("_late"), F.col("_n") - F.col("suspicious").cast("long"))))
    start = F.greatest(F.coalesce("_clean", F.lit(0)), F.coalesce("_run", F.lit(0)),
                       F.when(F.col("_late"), F.col("_n") - 1).otherwise(F.lit(0)))
    return (runs.filter("suspicious").withColumn("streak", F.col("_n") - start)
            .select(*keys, "ordinal", "ns", "streak", (F.col("streak") % F.col("needed") == 0).alias("alert")))


def sliding_streak(samples: DataFrame, window_ms: float, needed: int, rows: int = 65536) -> DataFrame:
    """``sliding_streaks`` of one check over sessions."""
    return sliding_streaks(samples.withColumns({"window_ns": F.lit(int(window_ms * 1e6)), "needed": F.lit(needed)}), KEY, rows)

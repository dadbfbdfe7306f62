"""Fixed behaviour windows over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import schemas as S
from ..functions.columns import angle_wrap
from .folds import fold_sorted
from .scan import cut
from .segments import MS, segmented
from .window_fold import WindowFold

SPAN_NS, GUARD_NS = 30_000 * MS, 5_000 * MS


def _cv(dt):
    return F.coalesce(F.when(F.sum(dt) > 0, F.stddev_pop(dt) / F.avg(dt)), F.lit(0.0))


def behavior_windows(obs: DataFrame, span_ns: int = SPAN_NS, guard_ns: int = GUARD_NS,
                     gap_ns: int = 750 * MS, queue_ns: int = 100 * MS, rows: int = 65536) -> DataFrame:
    """Closed windows with their eight features, one row per (session, segment, k).

    Windows start ``guard`` after the segment's first move and are emitted once a later move of the
    segment reaches the next one.  An attack counts only in the window that is current at its
    delivery position.  Attack times that do not grow reset inside the window; only the stretches (between hard
    resets) with such rows go through the fold.
    """
    if span_ns <= gap_ns:
        raise ValueError("a window must be longer than the largest gap inside a segment")
    rows_in, unclear = segmented(obs, gap_ns, queue_ns, rows)
    seg = rows_in.filter("inside")
    ready = F.col("start_ns") + guard_ns
    slot = lambda c: F.floor((c - ready) / span_ns).cast("long")
    is_move = F.col("kind") == S.MOVE
    is_attack = F.col("kind") == S.ATTACK
    current = F.greatest(F.lit(0), slot(F.col("last_ns")))
    placed = seg.withColumn("k", slot(F.col("ns"))).filter(
        (F.col("ns") >= ready) & (is_move | (F.col("k") == current)))

    # A move that is first in its window also closes the window before, as an extra row there.
    closes = is_move & (F.col("k") > 0)
    placed = placed.withColumn("_prev_k", slot(F.col("prev_ns"))).withColumn(
        "_part", F.explode(F.when(closes & (F.col("_prev_k") < F.col("k")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    placed = placed.withColumn("k", F.col("k") - F.col("_part"))
    closing = F.col("_part") == 1
    is_move = is_move & ~closing

    unit = ["session", "segment", "k"]
    w = W.partitionBy(*unit, "kind").orderBy("ordinal")  # the closing row comes last
    in_window = is_move & (slot(F.col("prev_ns")) == F.col("k")) & (F.col("prev_ns") >= ready)
    before = F.lag("ns").over(w)
    look = F.last(F.when(F.col("has_look"), F.col("yaw")), ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, -1))
    timed = (
        placed.withColumn("_before", before)
        .withColumn("move_dt", F.when(in_window, (F.col("ns") - F.col("prev_ns")) / 1e6))
        .withColumn("attack_dt", F.when(is_attack, (F.col("ns") - F.col("_before")) / 1e6))
        .withColumn("turn", F.when(is_move & F.col("has_look"), F.abs(angle_wrap(F.col("yaw") - look))))
        .withColumn("_same", F.when(is_attack, F.abs(F.col("attack_dt") - F.lag("attack_dt").over(w)) <= 1))
    )
    moves, attacks = F.count_if(is_move), F.count_if(is_attack)
    seconds = span_ns / 1e9
    windows = timed.groupBy(*unit).agg(
        F.min("start_ns").alias("start_ns"), F.min("stretch").alias("stretch"),
        (moves / seconds).alias("movement_pps"),
        _cv(F.col("move_dt")).alias("movement_cv"),
        (attacks / seconds).alias("attack_pps"),
        _cv(F.col("attack_dt")).alias("attack_cv"),
        F.coalesce(F.avg(F.col("_same").cast("double")), F.lit(0.0)).alias("attack_repeat"),
        F.coalesce(F.avg(F.when(is_move, F.col("ground").cast("double"))), F.lit(0.0)).alias("ground_fraction"),
        F.coalesce(F.avg("turn"), F.lit(0.0)).alias("turn_mean"),
        attacks.cast("double").alias("attacks"),
        F.max(closing).alias("_closed"),
        F.coalesce(F.min("attack_dt") <= 0, F.lit(False)).alias("_dirty"),
    )
    windows = cut(windows)
    redo = (windows.filter("_dirty").select("session", "stretch")
            .union(unclear).distinct())
    columns = ["session", "segment", "k", "start_ns", *S.BEHAVIOR_FEATURES]
    if not redo.limit(1).count():
        return windows.filter("_closed").select(*columns)
    redo = cut(redo)
    clean = windows.filter("_closed").join(redo, ["session", "stretch"], "left_anti")
    folded = fold_sorted(
        rows_in.join(redo, ["session", "stretch"], "left_semi"), ["session", "stretch"], ["ordinal"],
        lambda: WindowFold(span_ns, guard_ns, gap_ns),
        "session bigint, segment bigint, k bigint, start_ns bigint, movement_pps double, movement_cv double,"
        "attack_pps double, attack_cv double, attack_repeat double, ground_fraction double, turn_mean double, attacks double",
    )
    return clean.select(*columns).unionByName(folded)

"""Timing perturbations of recorded sessions, and how a linear rule holds up under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .models import score
from .scan import cut
from .windows import behavior_windows

MS = 1_000_000
SCENARIOS = {"batch_100ms": (100 * MS, 0), "batch_250ms": (250 * MS, 0), "pause_1s": (0, 1000 * MS)}


def _shift(obs: DataFrame, to: str, when: str = "kind IN (7, 11)") -> DataFrame:
    """Move the receive time and keep the snapshot's age."""
    at = f"CASE WHEN {when} THEN {to} ELSE ns END"
    return obs.withColumn("_to", F.expr(at)).withColumn("sampled_ns", F.expr("sampled_ns + (_to - ns)")).withColumn("ns", F.col("_to")).drop("_to")


def batch_receive(obs: DataFrame, grid_ns: int) -> DataFrame:
    """Receive times of moves and attacks rounded up to an absolute grid; delivery order stays."""
    return _shift(obs, f"((ns + {grid_ns - 1}) DIV {grid_ns}) * {grid_ns}")


def insert_pause(obs: DataFrame, after_ns: int = 40_000 * MS, pause_ns: int = 1000 * MS) -> DataFrame:
    """A pause for moves and attacks from ``after_ns`` past the session's first event."""
    first = obs.groupBy("session").agg(F.min_by("ns", "ordinal").alias("_first"))
    return _shift(obs.join(first, "session"), f"ns + CASE WHEN ns - _first >= {after_ns} THEN {pause_ns} ELSE 0 END").drop("_first")


def perturb_moves(obs: DataFrame, scenario: str, grid_ns: int = 100 * MS, after_ns: int = 90_000 * MS, pause_ns: int = 1000 * MS) -> DataFrame:
    """Study variants: a grid anchored at the first move, or a pause; only moves are shifted."""
    first = obs.filter("kind = 11").groupBy("session").agg(F.min_by("ns", "ordinal").alias("_first"))
    to = {"batch_100ms": f"_first + ((ns - _first + {grid_ns - 1}) DIV {grid_ns}) * {grid_ns}",
          "pause_1000ms": f"ns + CASE WHEN ns - _first >= {after_ns} THEN {pause_ns} ELSE 0 END"}
    if scenario not in to:
        raise ValueError("unknown stress scenario")
    return _shift(obs.join(first, "session", "left"), to[scenario], "kind = 11").drop("_first")


def run_scores(windows: DataFrame, model: dict, count: int, minimum_attacks: float) -> DataFrame:
    """Best sustained margin per session: runs end at a new segment, a missing window or one with too few attacks."""
    scored = score(windows, model).filter(F.col("attacks") >= minimum_attacks)
    held = f"""CASE WHEN count(*) OVER w = {count} AND max(k) OVER w - min(k) OVER w = {count - 1} THEN min(margin) OVER w END"""
    # windows of one segment that stand next to each other: k grows by one
    return scored.sparkSession.sql(f"""
      SELECT session, max(held) AS score FROM (SELECT session, {held} AS held FROM {{s}}
        WINDOW w AS (PARTITION BY session, segment ORDER BY k RANGE BETWEEN {count - 1} PRECEDING AND CURRENT ROW)) GROUP BY session""", s=scored)


def stress_eval(obs: DataFrame, labels: DataFrame, model: dict, threshold: float, count: int, minimum_attacks: float,
                scenarios: dict | None = None, pause_after_ns: int = 40_000 * MS, **window_args) -> DataFrame:
    """tp, fp, tn, fn and abstained per scenario; ``labels`` has session and label."""
    out = None
    for name, (grid, pause) in (scenarios or SCENARIOS).items():
        shifted = batch_receive(obs, grid) if grid else insert_pause(obs, pause_after_ns, pause)
        scores = run_scores(cut(behavior_windows(shifted, **window_args)), model, count, minimum_attacks)
        judged = labels.join(scores, "session", "left").withColumn("hit", F.col("score") > threshold)
        y, hit, known = F.col("label") == 1, F.col("hit"), F.col("score").isNotNull()
        row = judged.agg(F.count_if(known & y & hit).alias("tp"), F.count_if(known & ~y & hit).alias("fp"), F.count_if(known & ~y & ~hit).alias("tn"),
                         F.count_if(known & y & ~hit).alias("fn"), F.count_if(~known).alias("abstained"), F.count(F.lit(1)).alias("samples")).withColumn("scenario", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out

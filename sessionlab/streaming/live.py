"""Live scoring of windows: batch twins and the streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_models(windows: DataFrame, models: DataFrame, most: int = 1000) -> DataFrame:
    """Every window beside every deployed model, as the models are few: their number is checked first.

    The models travel as one array value and are exploded, so no table is joined without a key.
    """
    n = models.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} deployed models")
    packed = models.agg(F.collect_list(F.struct(*models.columns)).alias("m"))
    spark = windows.sparkSession
    return spark.sql("SELECT w.*, explode((SELECT m FROM {m})) AS _model FROM {w} w", m=packed, w=windows).select(*windows.columns, "_model.*")


def decide_action(outside, enforced, candidate, shadow):
    """State of a decision, in the order the rules apply."""
    return (F.when(outside, "outside_training_support").when(enforced, "pending").when(candidate & shadow, "shadow_candidate")
            .when(candidate, "below_response_cutoff").otherwise("observed"))


def score_windows(windows: DataFrame, model: dict, gap_ms: int = 45_000, slab_ms: int = 3_600_000) -> DataFrame:
    """Decisions of one deployed model over closed windows (session, event, epoch_ms, segment, features).

    Margins are held for ``consecutive`` windows of one segment; a low-attack window, a step back, a
    pause or a window outside the training support starts over.  ``looks`` counts a session's ready
    decisions, and the response cutoff of look k is alpha/(k(k+1)).
    """
    from ..operators.models import score
    from ..operators.scan import SLAB, halo, running_sum, slabs, step

    n, refs = model["consecutive_windows"], sorted(model["references"])
    if len(refs) > 4096:
        raise ValueError("a deployed model holds at most 4096 references")
    outside = F.lit(False)
    for f, lo, hi in zip(model["features"], model["minimum"], model["maximum"]):
        outside = outside | (F.col(f) < lo) | (F.col(f) > hi)
    base = score(windows, model).select("session", "event", "epoch_ms", "segment", "margin", outside.alias("outside"), (F.col("attacks") < model["minimum_attacks"]).alias("low"))
    need = halo(base, ["session"], "epoch_ms", slab_ms, back=(n + 1) * gap_ms)
    ref = ", ".join(f"{r!r}D" for r in refs)
    held = need.sparkSession.sql(f"""
      WITH b AS (SELECT *, max(CASE WHEN low THEN event END) OVER (PARTITION BY session, _slab ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_at FROM {{n}}),
      linked AS (SELECT *, lag(struct(event, epoch_ms, segment, outside)) OVER (PARTITION BY session, _slab ORDER BY event) AS p FROM b WHERE NOT low),
      f AS (SELECT *, CASE WHEN coalesce(p.segment = segment AND epoch_ms > p.epoch_ms AND epoch_ms - p.epoch_ms <= {gap_ms} AND NOT p.outside AND p.event > coalesce(low_at, -1), false) THEN 0 ELSE 1 END AS fresh FROM linked),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY session, _slab ORDER BY event) AS island FROM f)
      SELECT session, event, epoch_ms, outside, min(margin) OVER w AS sustained, count(*) OVER w = {n} AS ready, _own
      FROM i WINDOW w AS (PARTITION BY session, _slab, island ORDER BY event ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""", n=need).filter("_own").drop("_own")
    looked = step(slabs(held.withColumn("_r", F.col("ready").cast("long")), F.floor(F.col("epoch_ms") / slab_ms).cast("long")), ["session"], ["event"], looks=running_sum(F.col("_r")))
    ranked = looked.drop("_r", SLAB).withColumn("tail_p", F.expr(f"(1 + size(filter(array({ref}), r -> r >= sustained))) / {len(refs) + 1}"))
    candidate = F.col("ready") & (F.col("sustained") > model["threshold"]) & ~F.col("outside")
    spent = F.when(F.col("looks") > 0, F.lit(float(model["tail_cutoff"])) / (F.col("looks") * (F.col("looks") + 1))).otherwise(0.0)
    out = ranked.withColumn("candidate", candidate).withColumn("enforced", F.lit(model["mode"] == "enforce") & candidate & F.coalesce(F.col("tail_p") <= spent, F.lit(False)))
    return out.withColumn("action", decide_action(F.col("outside"), F.col("enforced"), F.col("candidate"), F.lit(model["mode"] == "shadow")))

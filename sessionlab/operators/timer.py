"""Episode statistics of the movement cadence and their empirical tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .folds import EpisodeFold, fold_sorted
from .scan import SLAB, carry_here, chain, cut, halo, ordinal_slab, running_sum, slabs, sql, step
from .segments import MS, segmented

WINDOW_NS, WINDOWS, GUARD_NS = 5_000 * MS, 34, 5_000 * MS


def timer_episodes(obs: DataFrame, bucket_ns: int = WINDOW_NS, buckets: int = WINDOWS, guard_ns: int = GUARD_NS,
                   gap_ns: int = 750 * MS, queue_ns: int = 100 * MS, rows: int = 65536) -> DataFrame:
    """Uninterrupted episodes: guard plus equal half-open buckets; ``counts`` holds one count per bucket.

    The move that ends an episode starts the next, which no fixed grid reproduces: every move of a segment knows the first
    move past an episode that would start with it, and the true starts are a chain of such hops (``scan.chain``).
    Only unclear stretches are folded in order.
    """
    keys, span = ["session", "segment"], guard_ns + bucket_ns * buckets
    rows_in, unclear = segmented(obs, gap_ns, queue_ns, rows, attacks=False)
    unclear = cut(unclear)
    moves = rows_in.filter("inside").join(unclear, ["session", "stretch"], "left_anti").select(*keys, "ordinal", "ns")
    placed = step(slabs(moves, ordinal_slab(rows=rows)), keys, ["ordinal"], at=running_sum(F.lit(1))).drop(SLAB).withColumn("at", F.col("at").cast("long"))
    need = halo(placed, keys, "ns", max(4 * span, 3_600_000 * MS), ahead=span)
    past = F.max("at").over(W.partitionBy(*keys, SLAB).orderBy("ns").rangeBetween(0, span - 1))
    hops = need.withColumn("hop", past - F.col("at") + 1).filter("_own").select(*keys, "ordinal", "ns", "at", "hop")
    on = cut(chain(hops, keys, "at", "hop", rows))
    starts = on.filter("_on").select(*keys, F.col("ns").alias("start_ns"), F.lead("ns").over(W.partitionBy(*keys).orderBy("at")).alias("end_ns")).filter("end_ns IS NOT NULL")
    inside = step(slabs(on, ordinal_slab("at", rows)), keys, ["at"], True, start_ns=carry_here(F.expr("CASE WHEN _on THEN ns END")))
    slot = F.floor((F.col("ns") - F.col("start_ns") - guard_ns) / bucket_ns).cast("int")
    slots = inside.withColumn("slot", slot).filter("slot >= 0").groupBy(*keys, "start_ns", "slot").agg(F.count(F.lit(1)).alias("n"))
    counted = slots.groupBy(*keys, "start_ns").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("n"))
    found = starts.join(counted, [*keys, "start_ns"], "left").selectExpr(
        "session", "start_ns", f"transform(sequence(0, {buckets - 1}), i -> coalesce(n[i], 0L)) AS counts", "end_ns")
    if unclear.limit(1).count():
        units = rows_in.join(unclear, ["session", "stretch"], "left_semi").selectExpr("session", "stretch AS unit", "ordinal", "ns", "packet")
        found = found.unionByName(fold_sorted(units, ["session", "unit"], ["ordinal"], lambda: EpisodeFold(bucket_ns, buckets, guard_ns, gap_ns),
                                              "session bigint, start_ns bigint, counts array<bigint>, end_ns bigint"))
    return score_episodes(found, bucket_ns, buckets, guard_ns)


def score_episodes(found: DataFrame, bucket_ns: int, buckets: int, guard_ns: int) -> DataFrame:
    """Score: the best rate held for three adjacent buckets; excess: paid time above real time."""
    seconds = bucket_ns / 1e9
    return found.selectExpr(
        "session", "start_ns", f"start_ns + {guard_ns} AS first_window_ns", "end_ns", "counts",
        "aggregate(counts, 0L, (a, c) -> a + c) AS packets",
        f"array_max(transform(sequence(1, {buckets - 2}), i -> array_min(slice(counts, i, 3)))) / {seconds}D AS score",
    ).selectExpr("*", f"CAST(packets * 50 - {int(buckets * seconds * 1000)} AS DOUBLE) AS excess_ms")


def assess_episodes(episodes: DataFrame, reference: DataFrame, alpha: float = 0.001,
                    least_score: float = 20.5, least_excess: float = 1000.0) -> DataFrame:
    """Empirical tail of each episode against the reference, with error spending over a session's episodes.

    The reference is bounded by its build rule (at most 4096 scores), so its sorted array is one value;
    its size is checked before use.
    """
    ref = reference.selectExpr("score").limit(4097).agg(F.array_sort(F.collect_list("score")).alias("ref"))
    ref = ref.selectExpr("CASE WHEN assert_true(size(ref) BETWEEN 1 AND 4096, 'reference must hold 1 to 4096 scores') IS NULL THEN ref END AS ref")
    return sql(f"""
      WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start_ns) AS episode FROM {{episodes}}),
      ranked AS (SELECT *, size(ref) AS n_ref, (1 + size(filter(ref, r -> r >= score))) / (size(ref) + 1) AS tail_p,
          {alpha}D / (episode * (episode + 1)) AS alpha_spent 
        FROM (SELECT *, (SELECT ref FROM {{ref}}) AS ref FROM numbered)),
      judged AS (SELECT *, tail_p <= alpha_spent AND score >= {least_score} AND excess_ms >= {least_excess} AS eligible FROM ranked)
      SELECT session, start_ns, episode, score, packets, excess_ms, tail_p, alpha_spent, eligible,
        CASE WHEN eligible THEN 'sustained_timer_excess' WHEN 1 / (n_ref + 1) > alpha_spent THEN 'insufficient_reference'
             ELSE 'within_policy' END AS reason
      FROM judged""", episodes=episodes, ref=ref)

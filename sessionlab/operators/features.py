"""Feature windows over trials: dataset windows, trial features, cadence features, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scan import SLAB, by_range, cut, ordinal_slab, prev_row, running_sum, slabs, sql, step

MS = 1_000_000
LOW_QUANTILE = "get(array_sort(collect_list({x})), CAST(floor((count({x}) - 1) * {q}D) AS INT))"

# The registered dataset features; labels and identifiers are never among them.
DATASET_FEATURES = [
    "movement_pps", "dt_p50_ms", "dt_p95_ms", "dt_std_ms", "same_batch_fraction", "position_fraction", "hstep_p95", "abs_dy_p95",
    "yaw_change_p95", "pitch_change_p95", "air_ground_fraction", "gravity_error_p95", "item_input_p95", "attack_pps",
    "attack_distance_p95", "impulse_count", "ack_count",
]
TRIAL_FEATURES = [
    "movement_pps", "sustained_pps", "interval_median_ms", "interval_cv", "burst_fraction", "window_rate_std",
    "horizontal_step_p95", "vertical_step_p95", "turn_p95", "ground_fraction",
]
CADENCE_FEATURES = TRIAL_FEATURES[:6]


def quantile_lower(x: str, q: float) -> str:
    """SQL text of the quantile at index floor((n-1)q) of the sorted values; NULL when there are none.

    The values of one window are collected, and a window is bounded in time.
    """
    return LOW_QUANTILE.format(x=x, q=q)


def running_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Distinct values of ``x`` per key with ``upto`` (rows at or below) and ``total``, for groups of any size.

    Rows first shrink to counts of distinct values; the running count goes by slabs of the value range.
    """
    counts = cut(df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = slabs(cut(by_range(counts, [*keys, x])).join(total, keys), F.col("_cell")).drop("_cell")
    return step(placed, keys, [x], upto=running_sum(F.col("n"))).drop(SLAB)


def quantile_lower_by(df: DataFrame, keys: list[str], x: str, q: float) -> DataFrame:
    """The same quantile for groups of any size."""
    run = running_counts(df, keys, x)
    return run.filter(F.col("upto") > F.floor((F.col("total") - 1) * q)).groupBy(*keys).agg(F.min(x).alias("q"))


def median_by(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Exact median (mean of the two middle values) for groups of any size."""
    run = running_counts(df, keys, x)
    at = lambda pos: F.min(F.when(F.col("upto") > pos, F.col(x)))
    half = (F.col("total") - 1) / 2
    return run.groupBy(*keys).agg(((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("median"))


def bucketed(obs: DataFrame, trials: DataFrame, seconds: float) -> DataFrame:
    """Events inside the guard interval with their bucket; the incomplete last bucket is left out."""
    size = int(seconds * 1e9)
    bounds = trials.selectExpr("trial_id AS trial", f"start_observed_ns + coalesce(guard_ms, 5000) * {MS} AS t0",
                               f"end_observed_ns - coalesce(guard_ms, 5000) * {MS} AS t1")
    return (obs.join(bounds, "trial").filter("ns >= t0 AND ns < t1")
            .withColumn("bucket", F.floor((F.col("ns") - F.col("t0")) / size).cast("long"))
            .filter(F.col("t0") + (F.col("bucket") + 1) * size <= F.col("t1")))


def reorder_violations(obs: DataFrame, trials: DataFrame, seconds: float, most: int = 20_000) -> DataFrame:
    """Buckets that break the bounds: an event more than one bucket late, or too many events.

    Lateness needs only the first and last ordinal of each bucket, so the ordering works on one row per bucket.
    """
    cells = bucketed(obs, trials, seconds).groupBy("trial", "bucket").agg(
        F.count(F.lit(1)).alias("events"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))
    return sql(f"""
      WITH seen AS (SELECT *, min(first_ordinal) OVER (PARTITION BY trial ORDER BY bucket
            ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_first FROM {{cells}}),
      judged AS (SELECT trial, bucket, events, coalesce(later_first < last_ordinal, false) AS reordered, events > {most} AS too_many FROM seen)
      SELECT * FROM judged WHERE reordered OR too_many""", cells=cells)


def dataset_windows(obs: DataFrame, trials: DataFrame, seconds: float = 5) -> DataFrame:
    """Seventeen nullable features per complete bucket; fewer than ten moves or a boundary kind gives no row."""
    cells = bucketed(obs, trials, seconds)
    q = quantile_lower
    padded = " + ".join(f"pow(greatest(low_{a} - 0.13125 - eye_{a}, 0D, eye_{a} - high_{a} - 0.13125), 2)" for a in "xyz")
    return sql(f"""
      WITH base AS (SELECT *, kind = 11 AS mv, max(CASE WHEN kind IN (3,10,14) THEN 1 ELSE 0 END) OVER cell AS broken,
          sum(CASE WHEN kind = 11 THEN 1 ELSE 0 END) OVER cell AS n_moves FROM {{cells}} WINDOW cell AS (PARTITION BY trial, bucket)),
      good AS (SELECT * FROM base WHERE broken = 0 AND n_moves >= 10),
      prior AS (SELECT *, lag(struct(ns, batch, has_pos, world, x, y, z, available, clear, source, destination, flat, item)) OVER byp AS p,
          last_value(CASE WHEN has_look THEN struct(yaw, pitch) END) IGNORE NULLS OVER
            (PARTITION BY trial, bucket, mv ORDER BY packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS look
        FROM good WINDOW byp AS (PARTITION BY trial, bucket, mv ORDER BY packet)),
      moved AS (SELECT *, mv AND coalesce(has_pos AND p.has_pos AND p.world = world, false) AS stepped,
          x - p.x AS dx, y - p.y AS dy, z - p.z AS dz, CASE WHEN mv THEN (ns - p.ns) / 1e6 END AS dt FROM prior),
      twice AS (SELECT *, lag(struct(stepped AS ok, dx, dy, dz)) OVER (PARTITION BY trial, bucket, mv ORDER BY packet) AS o,
          stepped AND available AND p.available AND clear AND p.clear AS usable FROM moved),
      flags AS (SELECT *, usable AND NOT (source OR destination OR p.source OR p.destination) AS air,
          usable AND flat AND p.flat AND item AND p.item AND coalesce(o.ok, false) AS uses FROM twice),
      parts AS (SELECT *, CASE WHEN stepped THEN sqrt(dx * dx + dz * dz) END AS hstep, CASE WHEN stepped THEN abs(dy) END AS ady,
          CASE WHEN mv AND has_look THEN abs(pmod(yaw - look.yaw + 180, 360) - 180) END AS yaw_d,
          CASE WHEN mv AND has_look THEN abs(pitch - look.pitch) END AS pitch_d,
          CASE WHEN air AND o.ok THEN abs(dy - (o.dy - 0.08D) * 0.98D) END AS gravity,
          CASE WHEN uses THEN sqrt(pow(dx - o.dx * (0.91D * friction), 2) + pow(dz - o.dz * (0.91D * friction), 2)) END AS input,
          CASE WHEN kind = 7 AND available THEN sqrt({padded}) END AS distance FROM flags)
      SELECT trial, bucket, min(t0) + bucket * {int(seconds * 1e9)} AS start_ns,
        count_if(mv) / {float(seconds)}D AS movement_pps, {q('dt', 0.5)} AS dt_p50_ms, {q('dt', 0.95)} AS dt_p95_ms, stddev_pop(dt) AS dt_std_ms,
        count_if(mv AND batch = p.batch) / greatest(1, count_if(mv) - 1) AS same_batch_fraction,
        count_if(mv AND has_pos) / count_if(mv) AS position_fraction, {q('hstep', 0.95)} AS hstep_p95, {q('ady', 0.95)} AS abs_dy_p95,
        {q('yaw_d', 0.95)} AS yaw_change_p95, {q('pitch_d', 0.95)} AS pitch_change_p95,
        CASE WHEN count_if(air) > 0 THEN count_if(air AND ground AND dy < -0.03D) / count_if(air) END AS air_ground_fraction,
        {q('gravity', 0.95)} AS gravity_error_p95, {q('input', 0.95)} AS item_input_p95,
        count_if(kind = 7) / {float(seconds)}D AS attack_pps, {q('distance', 0.95)} AS attack_distance_p95,
        count_if(kind = 12) AS impulse_count, count_if(kind = 13) AS ack_count
      FROM parts GROUP BY trial, bucket HAVING min(coalesce(dt, 0)) >= 0""", cells=cells)


def trial_features(obs: DataFrame, episodes: DataFrame, least: int = 100) -> DataFrame:
    """Ten features of the one scored episode of a trial; ``episodes`` has trial, first_window_ns, bucket_ns,
    counts, packets and score.

    An episode lasts a fixed time, so its moves are a bounded group.
    """
    span = "size(counts) * bucket_ns"
    inside = obs.filter("kind = 11").join(episodes, "trial").filter(f"ns >= first_window_ns AND ns < first_window_ns + {span}")
    return sql(f"""
      WITH moves AS (SELECT *, (ns - lag(ns) OVER o) / 1e6 AS dt FROM {{inside}} WINDOW o AS (PARTITION BY trial ORDER BY ordinal)),
      placed AS (SELECT *, lag(CASE WHEN has_pos THEN struct(x, y, z) END) OVER (PARTITION BY trial, has_pos ORDER BY ordinal) AS p,
          lag(CASE WHEN has_look THEN yaw END) OVER (PARTITION BY trial, has_look ORDER BY ordinal) AS look FROM moves),
      parts AS (SELECT *, CASE WHEN has_pos THEN sqrt(pow(x - p.x, 2) + pow(z - p.z, 2)) END AS hstep,
          CASE WHEN has_pos THEN abs(y - p.y) END AS vstep, CASE WHEN has_look THEN abs(pmod(yaw - look + 180, 360) - 180) END AS turn FROM placed),
      per_trial AS (SELECT trial, first(packets) AS packets, first(score) AS score, first(counts) AS counts, first(bucket_ns) / 1e9D AS seconds,
          count(dt) AS n, avg(dt) AS mean, percentile(dt, 0.5) AS mid, stddev_pop(dt) AS sd, avg(CAST(dt < 1 AS DOUBLE)) AS burst,
          percentile(hstep, 0.95) AS h95, percentile(vstep, 0.95) AS v95, coalesce(percentile(turn, 0.95), 0) AS t95,
          avg(CAST(ground AS DOUBLE)) AS grounded, count(hstep) AS n_steps FROM parts GROUP BY trial)
      SELECT trial, packets / (size(counts) * seconds) AS movement_pps, score AS sustained_pps, mid AS interval_median_ms, sd / mean AS interval_cv,
        burst AS burst_fraction,
        sqrt(greatest(0D, aggregate(counts, 0D, (a, c) -> a + pow(c / seconds - packets / (size(counts) * seconds), 2)) / size(counts))) AS window_rate_std,
        h95 AS horizontal_step_p95, v95 AS vertical_step_p95, t95 AS turn_p95, grounded AS ground_fraction, n AS intervals
      FROM per_trial WHERE n >= {least} AND mean > 0 AND n_steps >= 2""", inside=inside)


def attack_features(obs: DataFrame, least: int = 100, bin_ms: float = 5.0, rows: int = 65536) -> DataFrame:
    """Attack cadence per trial: variation, entropy of binned intervals, share of repeats; else a reason.

    The attack before, and the interval before, come from ordered scans, so an interval of any length counts wherever
    it lies. Means and bin counts are ordinary partial aggregates; a trial of any length never meets in one task.
    """
    attacks = slabs(obs.filter("kind = 7").select("trial", "ordinal", "ns"), ordinal_slab(rows=rows))
    spaced = step(attacks, ["trial"], ["ordinal"], before=prev_row(F.col("ns"))).withColumn("dt", F.expr("(ns - before) / 1e6"))
    steps = cut(step(spaced, ["trial"], ["ordinal"], earlier=prev_row(F.col("dt"))).selectExpr("trial", "ordinal", "dt", "abs(dt - earlier) <= 1 AS same"))
    return sql(f"""
      WITH totals AS (SELECT trial, count(*) AS attacks, min(dt) AS least_dt, stddev_pop(dt) / avg(dt) AS cv, avg(CAST(same AS DOUBLE)) AS rep, count(dt) AS n
        FROM {{steps}} GROUP BY trial),
      bins AS (SELECT trial, floor(dt / {bin_ms}) AS b, count(*) AS c FROM {{steps}} WHERE dt IS NOT NULL GROUP BY trial, floor(dt / {bin_ms})),
      entropy AS (SELECT trial, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM bins GROUP BY trial)
      SELECT t.trial, attacks, attacks >= {least} AND least_dt > 0 AS eligible,
        CASE WHEN attacks < {least} THEN 'needs_{least}_attacks' WHEN least_dt <= 0 THEN 'batched_or_unordered' END AS reason,
        CASE WHEN attacks >= {least} AND least_dt > 0 THEN cv END AS interval_cv,
        CASE WHEN attacks >= {least} AND least_dt > 0 THEN bits END AS interval_entropy_bits,
        CASE WHEN attacks >= {least} AND least_dt > 0 THEN rep END AS repeat_within_1ms
      FROM totals t LEFT JOIN entropy e ON t.trial = e.trial""", steps=steps)


def feature_summary(windows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Windows, minimum, median and maximum of every feature and class."""
    long = windows.unpivot([label], features, "feature", "x")
    long = cut(long)
    ends = long.groupBy("feature", label).agg(F.count("x").alias("windows"), F.min("x").alias("minimum"), F.max("x").alias("maximum"))
    return ends.join(median_by(long, ["feature", label], "x"), ["feature", label])


def macro_report(windows: DataFrame, keys: list[str], least_windows: int = 3, least_attacks: float = 100) -> DataFrame:
    """Median features per trial of a macro study, and whether its windows are adjacent and dense enough.

    A trial holds at most ten thousand windows, so a median per trial is taken in place.
    """
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.countDistinct("segment").alias("segments"),
        *[F.expr(f"percentile({c}, 0.5)").alias(c) for c in ("attack_pps", "attack_cv", "attack_repeat")],
        F.min("attacks").alias("least_attacks"),
    ).withColumn("eligible", (F.col("windows") >= least_windows) & (F.col("segments") == 1) & (F.col("least_attacks") >= least_attacks))

"""Joins, rollups, latest-row and limit operators over registry and finding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .scan import SLAB, carry, halo, running_sum, slabs, sql, step

MS = 1_000_000


def detections_with_mode(detections: DataFrame, deployments: DataFrame, limit: int = 100) -> DataFrame:
    """Detections with their deployment, by name; the list shows at most ``limit``."""
    return (detections.join(deployments.selectExpr("detection_id AS id", "mode", "experiment_id"), "id", "left")
            .orderBy("name", "id").limit(limit))


def reconcile_verdicts(attacks: DataFrame, findings: DataFrame) -> DataFrame:
    """Violations of "every attack has exactly one verdict": missing, duplicate, left over, other target."""
    verdicts = findings.filter("level <> 'suspicious'").groupBy("trial", "ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.min("target").alias("f_target"))
    return sql("""
      SELECT coalesce(a.trial, v.trial) AS trial, coalesce(a.ordinal, v.ordinal) AS ordinal,
        CASE WHEN v.trial IS NULL THEN 'missing_verdict' WHEN a.trial IS NULL THEN 'verdict_without_attack' WHEN v.n > 1 THEN 'duplicate_verdict' ELSE 'target_mismatch' END AS violation
      FROM {attacks} a FULL OUTER JOIN {verdicts} v ON a.trial = v.trial AND a.ordinal = v.ordinal
      WHERE v.trial IS NULL OR a.trial IS NULL OR v.n > 1 OR a.target <> v.f_target""", attacks=attacks, verdicts=verdicts)


def contaminated(held: DataFrame, development: DataFrame, old_tests: DataFrame) -> DataFrame:
    """Held samples whose group, day or id was already used."""
    groups = development.select("group").distinct()
    days = development.select("day").distinct()
    ids = old_tests.select("id").distinct()
    return sql("""SELECT h.* FROM {held} h WHERE h.group IN (SELECT group FROM {g}) OR h.day IN (SELECT day FROM {d}) OR h.id IN (SELECT id FROM {i})""",
               held=held, g=groups, d=days, i=ids)


def untouched(held: DataFrame, used: DataFrame) -> DataFrame:
    return held.join(used.select("id"), "id", "left_anti")


def missing_controls(samples: DataFrame, cell: tuple[str, ...] = ("client", "network")) -> DataFrame:
    """Positive cells without any negative sample."""
    return samples.filter("y = 1").select(*cell).subtract(samples.filter("y = 0").select(*cell))


def leave_group_out(scores: DataFrame, group: str = "seed", value: str = "score") -> DataFrame:
    """For each group, size and maximum of the per-group maxima of all other groups.

    The two largest maxima and the group count answer every group, so no group meets all others.
    """
    per = scores.groupBy(group).agg(F.max(value).alias("own"))
    return sql(f"""
      WITH top AS (SELECT count(*) AS n, max(own) AS best FROM {{per}}),
      holders AS (SELECT count(*) AS c FROM {{per}} WHERE own = (SELECT best FROM top)),
      rest AS (SELECT max(own) AS second FROM {{per}} WHERE own < (SELECT best FROM top))
      SELECT {group}, (SELECT n FROM top) - 1 AS others,
        CASE WHEN own = (SELECT best FROM top) AND (SELECT c FROM holders) = 1 THEN (SELECT second FROM rest) ELSE (SELECT best FROM top) END AS others_max
      FROM {{per}}""", per=per)


def frames_around(attacks: DataFrame, frames: DataFrame, before_ns: int, after_ns: int, width_ns: int) -> DataFrame:
    """Pairs of an attack and the frames of the same target near it; time slabs bound the fan-out of a hot key."""
    a = attacks.withColumn(SLAB, F.floor(F.col("ns") / width_ns).cast("long"))
    # a frame is needed by attacks up to before_ns later and after_ns earlier
    f = halo(frames, ["session", "target"], "ns", width_ns, back=before_ns, ahead=after_ns).drop("_own")
    f = f.select(*[F.col(c).alias(f"f_{c}") for c in frames.columns], F.col(SLAB).alias("f_slab"))
    near = F.col("f_ns").between(F.col("ns") - before_ns, F.col("ns") + after_ns)
    same = (F.col("session") == F.col("f_session")) & (F.col("target") == F.col("f_target")) & (F.col(SLAB) == F.col("f_slab"))
    return a.join(f, same & near).drop(SLAB, "f_slab", "f_session", "f_target")


def last_known(df: DataFrame, keys: list[str], order: list[str], slab, **values) -> DataFrame:
    """Last non-NULL value of each named expression strictly before the row."""
    return step(slabs(df, slab), keys, order, **{k: carry(v) for k, v in values.items()}).drop(SLAB)


def compare_conditions(off: DataFrame, on: DataFrame) -> DataFrame:
    """OFF beside ON per (pair, center); a missing or unusable side shows as pending, never as zero."""
    cell = "CASE WHEN {s}.usable THEN concat({s}.swings, '/', {s}.attacks) ELSE 'pending/invalid' END"
    sus = "CASE WHEN {s}.usable THEN CAST({s}.suspicious AS STRING) ELSE '-' END"
    return sql(f"""
      SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.center, b.center) AS center, {cell.format(s='a')} AS off_cell, {cell.format(s='b')} AS on_cell,
        concat({sus.format(s='a')}, '/', {sus.format(s='b')}) AS suspicious
      FROM {{off}} a FULL OUTER JOIN {{on}} b ON a.pair = b.pair AND a.center = b.center""", off=off, on=on)


def live_sessions(windows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest window of each session with its latest decision, if any."""
    w = windows.groupBy("session").agg(F.max_by(F.struct("created_ms", "event"), F.struct("created_ms", "event")).alias("w"))
    d = decisions.groupBy("session").agg(F.max_by(F.struct("action", "margin"), F.struct("created_ms", "event")).alias("d"))
    return w.join(d, "session", "left").select("session", F.col("w.created_ms").alias("created_ms"), F.col("w.event").alias("event"),
                                               F.col("d.action").alias("action"), F.col("d.margin").alias("margin"))


def class_coverage(samples: DataFrame) -> DataFrame:
    """Do the negatives cover every client and network seen among the positives?"""
    def covered(field):
        left = samples.filter("y = 1").select(field).subtract(samples.filter("y = 0").select(field))
        return left.agg((F.count(F.lit(1)) == 0).alias(f"{field}_covered"))
    any_positive = samples.agg((F.count_if(F.col("y") == 1) > 0).alias("any_positive"))
    a, b = covered("client"), covered("network")
    return sql("""SELECT any_positive AND (SELECT client_covered FROM {a}) AS same_client_control,
      any_positive AND (SELECT network_covered FROM {b}) AS matched_network_controls FROM {p}""", a=a, b=b, p=any_positive)


def check_decisions(findings: DataFrame, recomputed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Findings whose tail or spent error differs from the recomputed value."""
    return (findings.join(recomputed.selectExpr("session", "episode", "tail_p AS t", "alpha_spent AS a"), ["session", "episode"])
            .filter(f"abs(tail_p - t) > {tolerance}D OR abs(alpha_spent - a) > {tolerance}D").select("session", "episode", "tail_p", "t"))


def check_deployments(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Deployed files and registry rows that do not agree on id, mode and digest."""
    return sql("""
      SELECT coalesce(f.detection_id, r.detection_id) AS detection_id,
        CASE WHEN r.detection_id IS NULL THEN 'not_registered' WHEN f.detection_id IS NULL THEN 'file_missing' WHEN f.experiment_id <> r.experiment_id THEN 'other_experiment'
          WHEN f.mode <> r.mode THEN 'other_mode' ELSE 'other_digest' END AS problem
      FROM {f} f FULL OUTER JOIN {r} r ON f.detection_id = r.detection_id
      WHERE r.detection_id IS NULL OR f.detection_id IS NULL OR f.experiment_id <> r.experiment_id OR f.mode <> r.mode OR f.digest <> r.digest""", f=files, r=registry)


def parity(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], rel: float = 1e-8, absolute: float = 1e-8) -> DataFrame:
    """Keys that only one side has, or whose values differ beyond both tolerances."""
    x = a.select(*keys, F.struct(*values).alias("_a"))
    y = b.select(*keys, F.struct(*values).alias("_b"))
    def off(v):
        p, q = F.col(f"_a.{v}"), F.col(f"_b.{v}")
        return F.coalesce(F.abs(p - q) > F.greatest(F.lit(absolute), rel * F.greatest(F.abs(p), F.abs(q))), p.isNull() != q.isNull())
    differs = F.lit(False)
    for v in values:
        differs = differs | off(v)
    j = x.join(y, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(differs, "differs").alias("problem")).filter("problem IS NOT NULL")


def match_acks(obs: DataFrame, limit_ns: int = 2_000_000_000) -> DataFrame:
    """First acknowledgement of each impulse token within the limit; each is used at most once.

    An acknowledgement goes to the latest earlier impulse with its token, which the last-known scan finds.
    """
    base = obs.filter("kind IN (12, 13)").select("session", "token", "ordinal", "ns", "kind")
    known = last_known(base, ["session", "token"], ["ordinal"], F.floor(F.col("ordinal") / 65536).cast("long"),
                       sent=F.expr("CASE WHEN kind = 12 THEN struct(ordinal, ns) END"))
    hits = known.filter(f"kind = 13 AND sent IS NOT NULL AND ns - sent.ns BETWEEN 0 AND {limit_ns}")
    return hits.groupBy("session", "token", F.col("sent.ordinal").alias("impulse")).agg(
        F.min("ordinal").alias("ack"), F.min_by((F.col("ns") - F.col("sent.ns")) / 1e6, "ordinal").alias("delay_ms"))


# --- counts and rollups ----------------------------------------------------------------------------------------------

def coverage_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("input_source", "review").agg(F.count(F.lit(1)).alias("count"))


def totals(decisions: DataFrame, budget: DataFrame, since_ms) -> DataFrame:
    """Bans of both decision tables and flagged decisions since a time."""
    return sql(f"""SELECT (SELECT count_if(action = 'banned') FROM {{d}}) + (SELECT count_if(action = 'banned') FROM {{b}}) AS bans,
      (SELECT count_if(flagged = 1 AND created_ms > {since_ms}) FROM {{d}}) AS candidates""", d=decisions, b=budget)


def coverage(samples: DataFrame, windows: DataFrame, seconds: float = 30, approximate: bool = False) -> DataFrame:
    """Distinct players, days and networks, and hours of human legitimate windows.

    The sets are small per class but the rows are not, so they are reduced by group before counting.
    """
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    human = (F.col("input_source") == "human") & (F.col("y") == 0)
    who = samples.agg(distinct(F.when(human, F.col("player_group"))).alias("human_players"), distinct("day").alias("days"), distinct("network").alias("network_conditions"))
    hours = windows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).join(samples.filter(human).select(F.col("id").alias("sample_id")), "sample_id").agg(
        (F.coalesce(F.sum("n"), F.lit(0)) * seconds / 3600).alias("legit_hours"))
    return sql("SELECT *, (SELECT legit_hours FROM {h}) AS legit_hours FROM {w}", h=hours, w=who)


def coverage_cube(samples: DataFrame, windows: DataFrame, by: tuple[str, ...] = ("label", "client", "network")) -> DataFrame:
    n = windows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    j = samples.join(n, samples["id"] == n["sample_id"], "left")
    return j.cube(*by).agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("windows"),
                           F.grouping_id().cast("int").alias("level"))


def reach_trials(obs: DataFrame, verdicts: DataFrame, trials: DataFrame, least_swings: int = 20) -> DataFrame:
    """One row per usable recording: input counts, verdict counts and distances, over the guarded interval."""
    inside = "t.start_observed_ns + t.guard_ms * 1000000 <= {x}.ns AND {x}.ns < t.end_observed_ns - t.guard_ms * 1000000"
    gap = " + ".join(f"pow(greatest(low_{a} - eye_{a}, 0D, eye_{a} - high_{a}), 2)" for a in "xyz")
    return sql(f"""
      WITH raw AS (SELECT o.trial, count_if(kind = 9) AS swings, count_if(kind = 7) AS attacks, min(CASE WHEN kind = 7 AND available THEN sqrt({gap}) END) AS raw_min,
          max(CASE WHEN kind = 7 AND available THEN sqrt({gap}) END) AS raw_max FROM {{obs}} o JOIN {{trials}} t ON t.trial_id = o.trial WHERE {inside.format(x='o')} GROUP BY o.trial),
      v AS (SELECT v.trial, count_if(v.message = 'reach_suspicious_sample') AS suspicious, count_if(v.message = 'reach_within_bound') AS within,
          count_if(v.message = 'reach_skipped') AS skipped, count_if(v.level = 'suspicious') AS alerts, min(CASE WHEN v.level <> 'suspicious' THEN v.distance END) AS conservative_min
        FROM {{verdicts}} v JOIN {{trials}} t ON t.trial_id = v.trial WHERE {inside.format(x='v')} GROUP BY v.trial)
      SELECT t.trial_id AS trial, t.pair, t.center, (t.end_observed_ns - t.start_observed_ns - 2 * t.guard_ms * 1000000) / 1e9D AS seconds, r.swings, r.attacks,
        coalesce(v.suspicious, 0) + coalesce(v.within, 0) AS evaluated, coalesce(v.suspicious, 0) AS suspicious, coalesce(v.skipped, 0) AS skipped, coalesce(v.alerts, 0) AS alerts,
        r.raw_min, r.raw_max, v.conservative_min
      FROM {{trials}} t JOIN raw r ON r.trial = t.trial_id LEFT JOIN v ON v.trial = t.trial_id WHERE r.swings >= {least_swings}""", obs=obs, verdicts=verdicts, trials=trials)


def reach_report(trials: DataFrame) -> DataFrame:
    """Grid of a study: totals per (pair number, center)."""
    return sql("""SELECT dense_rank() OVER (ORDER BY pair) AS pair_number, pair, center, sum(attacks) AS attacks, sum(evaluated) AS evaluated, sum(suspicious) AS suspicious,
      sum(skipped) AS skipped, min(raw_min) AS raw_min, max(raw_max) AS raw_max, count(*) AS recordings FROM {t} GROUP BY pair, center""", t=trials)


def player_rollup(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """Per player of either side: records, alerts, last time and status; a ban wins over any session state."""
    f = findings.groupBy("player").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("level") == "suspicious").alias("alerts"), F.max("epoch_ms").alias("last_ms"),
        F.max_by("message", F.when(F.col("message").isin("session_open", "session_closed"), F.col("event"))).alias("state"))
    b = responses.filter("event = 'banned'").select("player").distinct().withColumn("banned", F.lit(True))
    return f.join(b, "player", "full").select(
        "player", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("records", "alerts")], "last_ms",
        F.when(F.col("banned"), "Banned").when(F.col("state") == "session_open", "Session open").when(F.col("state") == "session_closed", "Offline").otherwise("Observed").alias("status"))


def trend_series(windows: DataFrame, gap_ms: int = 45_000, players: int = 8, width_ms: int = 86_400_000) -> DataFrame:
    """Points of the first players' lines; a longer pause starts a new line piece."""
    top = windows.select("player").distinct().orderBy("player").limit(players)
    need = halo(windows.join(F.broadcast(top), "player"), ["player"], "created_ms", width_ms, back=gap_ms)
    flagged = sql(f"""SELECT player, created_ms, event, value, CASE WHEN created_ms - lag(created_ms) OVER (PARTITION BY player, _slab ORDER BY created_ms, event) <= {gap_ms} THEN 0 ELSE 1 END AS fresh, _own
      FROM {{n}}""", n=need).filter("_own").drop("_own")
    placed = slabs(flagged, F.floor(F.col("created_ms") / width_ms).cast("long"))
    return step(placed, ["player"], ["created_ms", "event"], piece=running_sum(F.col("fresh"))).drop("fresh", SLAB)


def verdict_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("message", F.col("evidence")["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- order, limits, sets ---------------------------------------------------------------------------------------------

def recent(df: DataFrame, order: list[str], n: int, since: tuple[str, int] | None = None) -> DataFrame:
    """The newest ``n`` rows, optionally only those after a time."""
    if since:
        df = df.filter(F.col(since[0]) > since[1])
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest_experiment(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("detection_id").agg(F.max_by("id", F.struct("created_ms", "id")).alias("id"), F.max("created_ms").alias("created_ms"))


def recent_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = 64) -> DataFrame:
    """The newest ``n`` rows per key.  Salted: every part keeps its own ``n`` first, so a hot key never gathers whole."""
    newest = [F.desc(c) for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*newest))).filter(F.col("_r") <= n)
    return (part.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).filter(F.col("rank") <= n)
            .drop("_salt", "_r"))


def incidents(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def search_findings(findings: DataFrame, text: str, alerts_only: bool = False) -> DataFrame:
    hit = F.lower(F.concat_ws(" ", "name", "json")).contains(text.lower())
    return findings.filter(hit & (F.col("level") == "suspicious") if alerts_only else hit)

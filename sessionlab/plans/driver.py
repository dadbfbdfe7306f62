"""Driver tables read as observation streams and registry tables.

The driver's ``events`` are hours apart, so the queries use day-long spans and gaps.
Each view exists twice: as a DataFrame and as the SQL text its oracle uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scan import number_rows

H = 3_600_000_000_000
DAY = 24 * H
SPAN, GUARD, GAP, QUEUE = 5 * DAY, 6 * H, 3 * DAY, 100_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


OBS_SQL = """
obs AS (
  SELECT *,
    CASE WHEN event_type='purchase' THEN 7 WHEN event_type<>'error' THEN 11 WHEN k>=90 THEN 14 ELSE 4 END AS kind,
    CASE WHEN k=13 THEN event_id-1000000 ELSE event_id END AS packet,
    event_id AS batch, ns+k*1000000 AS sampled_ns, value<400 AS available,
    'w'||CAST(session%3 AS VARCHAR) AS world, k*3.6::DOUBLE AS yaw, k*0.9::DOUBLE-45 AS pitch,
    k%2=0 AS has_look, k%3=0 AS ground, k%5<>0 AS has_pos,
    value*0.01::DOUBLE AS x, 64-k*0.01::DOUBLE AS y, k*0.02::DOUBLE AS z
  FROM (SELECT user_id AS session, event_id, event_type, value, epoch_us(ts)*1000 AS ns, epoch_us(ts)//1000 AS epoch_ms,
          CAST(json_extract(props,'$.k') AS BIGINT) AS k,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal
        FROM events))
"""


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    us = micros("ts")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"), "event_id", "event_type", "value", (us * 1000).alias("ns"),
        F.floor(us / 1000).cast("long").alias("epoch_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their ordinal per user, numbered in day slabs, never over a whole user at once."""
    return number_rows(raw_events(spark, sf), ["session"], ["ns", "event_id"],
                       F.floor(F.col("ns") / DAY).cast("long"), "ordinal", stored=True)


def obs_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as observations."""
    k, t = F.col("k"), F.col("event_type")
    kind = F.when(t == "purchase", 7).when(t != "error", 11).when(k >= 90, 14).otherwise(4)
    return numbered(spark, sf).select(
        "session", "ordinal", "ns", "epoch_ms", "event_id", "value", "k", kind.alias("kind"),
        F.when(k == 13, F.col("event_id") - 1000000).otherwise(F.col("event_id")).alias("packet"),
        F.col("event_id").alias("batch"), (F.col("ns") + k * 1000000).alias("sampled_ns"),
        (F.col("value") < 400).alias("available"), F.concat(F.lit("w"), (F.col("session") % 3).cast("string")).alias("world"),
        (k * F.lit(3.6)).alias("yaw"), (k * F.lit(0.9) - 45).alias("pitch"),
        (k % 2 == 0).alias("has_look"), (k % 3 == 0).alias("ground"), (k % 5 != 0).alias("has_pos"),
        (F.col("value") * 0.01).alias("x"), (64 - k * F.lit(0.01)).alias("y"), (k * F.lit(0.02)).alias("z"))


EV_SQL = """
ev AS (SELECT user_id AS session, event_id, event_type, value, epoch_us(ts)*1000 AS ns, epoch_us(ts)//1000 AS epoch_ms,
    CAST(json_extract(props,'$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events)
"""

# Event columns as other observation kinds; the expressions are read by both engines.
BASE = ["session", "ordinal", "ns", "epoch_ms", "event_id", "k"]
CONTEXT = ["value < 400 AS available", "concat('w', cast(session % 3 AS string)) AS world"]
VIEWS = {
    "digs": BASE + CONTEXT + [
        "CASE WHEN event_type IN ('purchase','click') THEN 5 WHEN event_type = 'signup' AND k >= 92 THEN 10 "
        "WHEN event_type = 'signup' AND k < 30 THEN 5 WHEN event_type = 'view' THEN 6 ELSE 4 END AS kind",
        "CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'click' THEN 2 WHEN event_type = 'signup' THEN 1 END AS action",
        "CASE WHEN k = 13 THEN event_id - 1000000 ELSE event_id END AS packet", "event_id - k % 7 AS batch",
        "ns + k * 2100000 AS sampled_ns", "CASE WHEN k % 10 = 9 THEN 1 ELSE 0 END AS bx", "0 AS by", "0 AS bz",
        "CASE WHEN event_type = 'view' AND k >= 70 THEN 's1' ELSE 's0' END AS state_key",
        "CAST(0.0000005 AS DOUBLE) * (1 + session % 3) AS damage"],
    "combat": BASE + CONTEXT + [
        "CASE WHEN event_type = 'purchase' THEN 7 WHEN event_type = 'error' THEN 4 WHEN event_type = 'signup' AND k >= 97 THEN 10 ELSE 8 END AS kind",
        "CASE WHEN k = 13 THEN event_id - 1000000 ELSE event_id END AS packet", "event_id - (k % 4) * 20 AS batch",
        "ns + k * 1020000 AS sampled_ns", "concat('t', cast(session % 7 AS string)) AS target", "CAST(session % 7 AS INT) AS target_id",
        "'player' AS target_kind", "'no_snapshot' AS reason", "CAST(k AS INT) AS ping", "true AS rotation", "k % 2 = 0 AS target_player",
        "CAST(0.002 AS DOUBLE) * (event_id % 5) + CASE WHEN k >= 93 THEN 1 ELSE 0 END AS eye_x", "CAST(1 AS DOUBLE) AS eye_y", "CAST(0 AS DOUBLE) AS eye_z",
        "CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (session % 4) AS low_x", "CAST(0 AS DOUBLE) AS low_y", "CAST(-0.3 AS DOUBLE) AS low_z",
        "CAST(2.6 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (session % 4) AS high_x", "CAST(2 AS DOUBLE) AS high_y", "CAST(0.3 AS DOUBLE) AS high_z",
        "CASE WHEN session % 5 = 0 THEN CAST(90 AS DOUBLE) ELSE CAST(-90 AS DOUBLE) END + CAST(0.01 AS DOUBLE) * (k % 3) AS yaw", "CAST(0 AS DOUBLE) AS pitch"],
    "motion": BASE + CONTEXT + [
        "CASE WHEN event_type = 'purchase' THEN 7 WHEN event_type <> 'error' THEN 11 WHEN k >= 97 THEN 14 WHEN k < 3 THEN 12 ELSE 4 END AS kind",
        "CASE WHEN k = 13 THEN event_id - 1000000 ELSE event_id END AS packet", "event_id - (k % 4) * 20 AS batch", "ns + k * 1020000 AS sampled_ns",
        "true AS target_player", "CAST(k AS INT) AS ping", "k % 6 <> 5 AS has_pos", "k % 2 = 0 AS has_look", "k % 3 = 0 AS ground",
        "CAST(0.1 AS DOUBLE) * (event_id % 7) AS x", "64 - CAST(0.08 AS DOUBLE) * (event_id % 5) AS y", "CAST(0.05 AS DOUBLE) * (event_id % 3) AS z",
        "k * CAST(3.6 AS DOUBLE) AS yaw", "k * CAST(0.9 AS DOUBLE) - 45 AS pitch",
        "session % 2 = 0 AS flat", "session % 2 = 0 AS source", "session % 2 = 0 AS destination", "k < 95 AS clear", "k % 5 < 3 AS item",
        "k % 11 <> 0 AS sprint", "CAST(0.1 AS DOUBLE) AS speed", "CASE WHEN k = 50 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS friction",
        "CAST(0.42 AS DOUBLE) AS jump", "k AS token", "CAST(0.1 AS DOUBLE) * (k % 9) AS vx", "CAST(0.2 AS DOUBLE) AS vy", "CAST(0 AS DOUBLE) AS vz", "k % 2 = 0 AS additive"],
    # A push every 24 moves, shown in full by two sessions of three, 30 ms a row; a second push too early now and then, acknowledged before it shows.
    "pushes": ["session", "ordinal", "ordinal * 30000000 AS ns", "k"] + CONTEXT + [
        "CASE WHEN event_type = 'error' AND k >= 97 THEN 14 WHEN event_type = 'purchase' AND k >= 98 THEN 7 WHEN ordinal % 24 = 4 OR (ordinal % 24 = 9 AND k < 10) THEN 12 "
        "WHEN ordinal % 24 = 5 AND k >= 20 OR ordinal % 24 = 6 THEN 13 ELSE 11 END AS kind",
        "CASE WHEN k = 13 THEN ordinal - 2 ELSE ordinal END AS packet", "ordinal * 30000000 + k * 1000000 AS sampled_ns", "k <> 49 AS has_pos", "k <> 48 AS clear",
        "session % 4 = 3 AS source", "false AS destination", "CAST(0.1 AS DOUBLE) AS speed", "CAST(0.42 AS DOUBLE) AS jump",
        "CAST(1 + floor((ordinal - 4) / 24) AS BIGINT) AS token", "CAST(0.8 AS DOUBLE) AS vx", "CAST(0.3 AS DOUBLE) AS vy", "CAST(0 AS DOUBLE) AS vz", "k % 4 = 1 AS additive",
        "CAST(0.004 AS DOUBLE) * (k % 6) + CASE WHEN ordinal % 24 > 6 THEN CAST(0.8 AS DOUBLE) * (CASE WHEN session % 3 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) "
        "* (1 - pow(CAST(0.91 AS DOUBLE), ordinal % 24 - 6)) / CAST(0.09 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x",
        "CASE WHEN ordinal % 24 > 6 THEN CAST(4.22 AS DOUBLE) * (1 - pow(CAST(0.98 AS DOUBLE), ordinal % 24 - 6)) / CAST(0.02 AS DOUBLE) - CAST(3.92 AS DOUBLE) * (ordinal % 24 - 6) ELSE CAST(0 AS DOUBLE) END "
        "+ CAST(0.002 AS DOUBLE) * (k % 5) AS y",
        "CAST(0 AS DOUBLE) AS z"],
    "impulses": BASE + ["CASE WHEN event_type = 'signup' THEN 12 WHEN event_type = 'view' THEN 13 ELSE 4 END AS kind", "k % 5 AS token"],
}


_MOTION_KIND = next(e for e in VIEWS["motion"] if e.endswith(" AS kind"))
VIEWS["full"] = (
    [e for e in VIEWS["motion"] if e != _MOTION_KIND]
    + ["CASE WHEN event_type = 'purchase' THEN 7 WHEN event_type <> 'error' THEN 11 WHEN k >= 99 THEN 14 WHEN k < 20 THEN 12 WHEN k < 40 THEN 13 ELSE 4 END AS kind"]
    + [e for e in VIEWS["combat"] if e.split(" AS ")[-1][:4] in ("eye_", "low_", "high")])


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as one recorded trial."""
    return raw_events(spark, sf).groupBy(F.col("session").alias("trial_id")).agg(
        F.min("ns").alias("start_observed_ns"), F.max("ns").alias("end_observed_ns"), F.lit(86_400_000).cast("long").alias("guard_ms"),
        F.count(F.lit(1)).alias("records"))


TRIALS_SQL = """trials AS (SELECT user_id AS trial_id, min(epoch_us(ts))*1000 AS start_observed_ns, max(epoch_us(ts))*1000 AS end_observed_ns,
  CAST(86400000 AS BIGINT) AS guard_ms, count(*) AS records FROM events GROUP BY user_id)"""


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return numbered(spark, sf).selectExpr(*VIEWS[name])


def view_sql(name: str) -> str:
    return EV_SQL + f", {name} AS (SELECT {', '.join(VIEWS[name])} FROM ev)"


# Segments: flags per valid move, then the open / dropped rules, then the running segment.
SEGMENT_SQL = OBS_SQL + f""",
s0 AS (SELECT *, kind=11 AND ok AS mv, kind NOT IN (7,11) OR NOT ok AS hard FROM (
  SELECT *, available AND world<>'' AND sampled_ns-ns BETWEEN 0 AND {QUEUE} AS ok FROM obs WHERE kind IN (1,2,3,10,14,7,11))),
s1 AS (SELECT *, last_value(CASE WHEN mv THEN {{'ns':ns,'p':packet,'o':ordinal}} END IGNORE NULLS) OVER w AS prev,
    coalesce(last_value(CASE WHEN hard THEN ordinal END IGNORE NULLS) OVER w,-1) AS hard_at
  FROM s0 WINDOW w AS (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, mv AND coalesce(prev.o>hard_at,false) AS linked, mv AND coalesce(prev.o>hard_at,false) AND packet<=prev.p AS bad FROM s1),
s3 AS (SELECT *, linked AND coalesce(last_value(CASE WHEN mv THEN bad END IGNORE NULLS) OVER w,false) AS after_drop
  FROM s2 WINDOW w AS (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, mv AND NOT bad AND (NOT linked OR after_drop OR ns<prev.ns OR ns-prev.ns>={GAP}) AS opens FROM s3),
s5 AS (SELECT *, last_value(CASE WHEN opens THEN {{'o':ordinal,'ns':ns}} END IGNORE NULLS) OVER w AS seg,
    coalesce(last_value(CASE WHEN hard OR bad THEN ordinal END IGNORE NULLS) OVER w,-1) AS cut_at,
    last_value(CASE WHEN mv AND NOT bad THEN ns END IGNORE NULLS) OVER w AS last_ns
  FROM s4 WINDOW w AS (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
segs AS (SELECT session, ordinal, ns, kind, yaw, has_look, ground, CASE WHEN NOT opens THEN prev.ns END AS prev_ns, last_ns,
    seg.o AS segment, seg.ns AS start_ns FROM s5 WHERE NOT hard AND NOT bad AND seg.o>cut_at)
"""

WINDOW_SQL = SEGMENT_SQL + f""",
w0 AS (SELECT *, (ns-start_ns-{GUARD})//{SPAN} AS k, (prev_ns-start_ns-{GUARD})//{SPAN} AS pk FROM segs
  WHERE ns>=start_ns+{GUARD}),
w1 AS (SELECT * FROM w0 WHERE kind=11 OR k=greatest(0,CASE WHEN last_ns<start_ns+{GUARD} THEN 0 ELSE (last_ns-start_ns-{GUARD})//{SPAN} END)),
w2 AS (SELECT *, CASE WHEN kind=11 AND pk=k AND prev_ns>=start_ns+{GUARD} THEN (ns-prev_ns)/1e6 END AS mdt,
    CASE WHEN kind=7 THEN (ns-lag(ns) OVER w)/1e6 END AS adt,
    CASE WHEN kind=11 AND has_look THEN abs(((yaw-last_value(CASE WHEN has_look THEN yaw END IGNORE NULLS) OVER
      (PARTITION BY session,segment,k,kind ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+540)%360)-180) END AS turn
  FROM w1 WINDOW w AS (PARTITION BY session,segment,k,kind ORDER BY ordinal)),
w3 AS (SELECT *, CASE WHEN kind=7 THEN abs(adt-lag(adt) OVER (PARTITION BY session,segment,k,kind ORDER BY ordinal))<=1 END AS same FROM w2),
w4 AS (SELECT session, segment, k, min(start_ns) AS start_ns,
    count(*) FILTER (kind=11)/{SPAN / 1e9} AS movement_pps,
    coalesce(CASE WHEN sum(mdt)>0 THEN sqrt(greatest(0,avg(mdt*mdt)-avg(mdt)*avg(mdt)))/avg(mdt) END,0) AS movement_cv,
    count(*) FILTER (kind=7)/{SPAN / 1e9} AS attack_pps,
    coalesce(CASE WHEN sum(adt)>0 THEN sqrt(greatest(0,avg(adt*adt)-avg(adt)*avg(adt)))/avg(adt) END,0) AS attack_cv,
    coalesce(avg(CAST(same AS DOUBLE)),0) AS attack_repeat,
    coalesce(avg(CAST(ground AS DOUBLE)) FILTER (kind=11),0) AS ground_fraction,
    coalesce(avg(turn),0) AS turn_mean, CAST(count(*) FILTER (kind=7) AS DOUBLE) AS attacks
  FROM w3 GROUP BY session, segment, k),
windows AS (SELECT * FROM (SELECT *, max(k) OVER (PARTITION BY session,segment) AS last_k FROM w4) WHERE k<last_k)
"""


# --- registry tables -------------------------------------------------------------------------------------------------
# Written once in the common dialect: Spark fills the braces with DataFrames, the oracle with table names.

REGISTRY = {
    "reg_trials": """SELECT o_orderkey AS trial_id, c_name AS player_uuid, o_custkey AS session_id,
        CASE WHEN o_orderstatus = 'F' THEN 'cheat' ELSE 'legit' END AS declared_label, CASE WHEN o_orderstatus = 'F' THEN 'timer' ELSE 'none' END AS module,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'vanilla-auto' ELSE o_orderpriority END AS client, concat('s', cast(o_orderkey % 3 AS string)) AS setting,
        concat('job-', cast(o_orderkey % 500 AS string)) AS scenario, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'complete' END AS status,
        o_orderkey % 13 <> 0 AS ok, CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 47 END AS protocol, 10808 AS model,
        cast(datediff(o_orderdate, cast('1970-01-01' AS date)) AS bigint) * 86400000 AS start_epoch_ms, c_mktsegment AS network, o_totalprice AS price, o_orderstatus AS state
      FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "reg_metadata": """SELECT trial_id, CASE WHEN client = 'vanilla-auto' THEN 'vanilla' ELSE client END AS client, CASE WHEN trial_id % 101 = 0 THEN NULL ELSE network END AS network,
        CASE WHEN trial_id % 103 = 0 THEN 'robot' WHEN trial_id % 2 = 0 THEN 'human' ELSE 'scripted' END AS input_source,
        CASE WHEN trial_id % 2 = 0 OR trial_id % 19 = 0 THEN '' ELSE concat('f', cast(trial_id % 29 AS string)) END AS script_family,
        CASE WHEN trial_id % 107 = 0 THEN 'fly' ELSE module END AS behavior, CASE WHEN trial_id % 109 = 0 THEN 'legit' ELSE declared_label END AS label,
        cast(trial_id % 40 AS string) AS route, CASE WHEN trial_id % 7 = 0 THEN 'validation' ELSE 'development' END AS purpose,
        CASE WHEN trial_id % 113 = 0 THEN 'other' ELSE setting END AS configuration FROM {reg_trials}""",
    "samples": """SELECT trial_id AS id, concat('p', cast(session_id AS string)) AS player_group, cast(floor(start_epoch_ms / 86400000) AS bigint) AS day, client, network,
        CASE WHEN trial_id % 2 = 0 THEN 'human' ELSE 'scripted' END AS input_source, CASE WHEN trial_id % 2 = 0 THEN '' ELSE concat('f', cast(trial_id % 29 AS string)) END AS script_family,
        module AS behavior, declared_label AS label, cast(trial_id % 40 AS string) AS route, CASE WHEN trial_id % 5 = 0 THEN 'rejected' WHEN trial_id % 3 = 0 THEN 'declared' ELSE 'reviewed' END AS review,
        '' AS reviewer, CASE WHEN session_id % 4 = 0 THEN 'validation' ELSE 'development' END AS purpose, concat('/m/', cast(trial_id AS string)) AS manifest_path,
        start_epoch_ms AS created_ms, price FROM {reg_trials}""",
    "sample_windows": """SELECT l_orderkey AS sample_id, l_linenumber AS ordinal, l_quantity AS attacks, CASE WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 2 ELSE 1 END AS segment,
        l_extendedprice / 10000 AS movement_pps, l_discount AS attack_cv, l_tax AS attack_repeat FROM {lineitem}""",
}
SPEC = {"id": "timer.cadence", "version": 1, "name": "Timer cadence", "mechanism": "faster client clock", "source": "study", "features": ["movement_pps"],
        "positive_behavior": "timer", "target": "cheat", "minimum_attacks": 3, "window_seconds": 30, "minimum_margin": 0.0, "tail_cutoff": 0.01, "consecutive_windows": 3,
        "validation": {"minimum_human_players": 5, "minimum_days": 3, "minimum_network_conditions": 3, "minimum_legit_hours": 20, "maximum_fpr_upper_95": 0.01,
                       "minimum_recall": 0.8, "require_same_client_control": True}}


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf: str, text: str, **given: DataFrame) -> DataFrame:
    """Evaluate common-dialect text; braces name driver tables, registry tables or given frames."""
    used = {}
    for n in _names(text):
        used[n] = given[n] if n in given else frame(spark, sf, REGISTRY[n]) if n in REGISTRY else table(spark, sf, n)
    return spark.sql(text, **used)


def reg(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return frame(spark, sf, REGISTRY[name])


def duck(text: str) -> str:
    """The same text for the oracle, with registry tables inlined."""
    for n in _names(text):
        text = text.replace("{" + n + "}", f"({duck(REGISTRY[n])})" if n in REGISTRY else n)
    return text.replace("datediff(o_orderdate, cast('1970-01-01' AS date))", "date_diff('day', date '1970-01-01', cast(o_orderdate AS date))")


def duck_with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({duck(REGISTRY[n])})" for n in names)

"""Windowed features."""

from pyspark.sql import functions as F

from ..operators.features import (attack_features, dataset_windows, feature_summary, macro_report, quantile_lower_by, reorder_violations,
                                  trial_features)
from ..operators.scan import cut
from ..operators.segments import (activity_islands, clip_guard, lifecycle_findings, ordinal_guard, segment_obs, snapshot_valid,
                                  with_identity)
from ..operators.timer import assess_episodes, timer_episodes
from ..operators.windows import behavior_windows
from . import driver as D
from .registry import query


def windows(spark, sf):
    return behavior_windows(D.obs_events(spark, sf), D.SPAN, D.GUARD, D.GAP, D.QUEUE)


def r6(df):
    """Doubles to six decimals, so that the order of additions cannot show."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


WINDOW_COLUMNS = """session, segment, k, start_ns, round(movement_pps,9) AS movement_pps, round(movement_cv,6) AS movement_cv,
  round(attack_pps,9) AS attack_pps, round(attack_cv,6) AS attack_cv, round(attack_repeat,6) AS attack_repeat,
  round(ground_fraction,6) AS ground_fraction, round(turn_mean,6) AS turn_mean, attacks"""


@query("behavior_windows", f"WITH {D.WINDOW_SQL} SELECT {WINDOW_COLUMNS} FROM windows")
def q_behavior_windows(spark, sf):
    return windows(spark, sf).selectExpr(*[c.strip() for c in WINDOW_COLUMNS.replace("\n", " ").split(", ")])


# --- segments and guards ---------------------------------------------------------------------------------------------

@query("segment_obs", f"WITH {D.SEGMENT_SQL} SELECT session, ordinal, ns, kind, segment, start_ns, prev_ns, last_ns FROM segs")
def q_segments(spark, sf):
    return segment_obs(D.obs_events(spark, sf), D.GAP, D.QUEUE).select("session", "ordinal", "ns", "kind", "segment", "start_ns", "prev_ns", "last_ns")


def as_trial(df):
    return df.withColumn("trial", F.col("session"))


@query("clip_guard", f"WITH {D.OBS_SQL}, {D.TRIALS_SQL} SELECT session, ordinal, kind FROM obs JOIN trials ON trial_id=session "
       "WHERE ns>=start_observed_ns+guard_ms*1000000 AND ns<end_observed_ns-guard_ms*1000000")
def q_clip(spark, sf):
    return clip_guard(as_trial(D.obs_events(spark, sf)), D.trials(spark, sf)).select("session", "ordinal", "kind")


@query("snapshot_valid", f"WITH {D.OBS_SQL} SELECT session, ordinal, available AND world<>'' AND sampled_ns-ns BETWEEN 0 AND 50000000 AS valid FROM obs")
def q_snapshot(spark, sf):
    return D.obs_events(spark, sf).select("session", "ordinal", snapshot_valid(50_000_000).alias("valid"))


STARTS = ["CASE WHEN event_type='signup' AND k<25 THEN 1 ELSE 4 END AS kind", "concat('p', cast(k as string)) AS player",
          "CASE WHEN k%4=0 THEN 5 ELSE 47 END AS protocol", "10808 AS model"]


@query("with_identity", f"WITH {D.EV_SQL}, o AS (SELECT *, {', '.join(STARTS)} FROM ev), c AS (SELECT session, ordinal, kind, "
       "last_value(CASE WHEN kind=1 THEN {'p':player,'r':protocol} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal) AS w FROM o) "
       "SELECT session, ordinal, kind, w.p AS player, w.r AS protocol, coalesce(w.r=47,false) AS supported FROM c")
def q_identity(spark, sf):
    obs = D.numbered(spark, sf).selectExpr(*D.BASE, *STARTS)
    return with_identity(obs).select("session", "ordinal", "kind", "player", "protocol", "supported")


# arrival = delivery position; every now and then an ordinal repeats or jumps
GUARDED = "ordinal AS arrival, CASE WHEN k=13 THEN ordinal-3 WHEN k=14 THEN ordinal+2 ELSE ordinal END AS o, CASE WHEN event_type='signup' AND k<5 THEN 1 WHEN k=99 THEN 3 WHEN k=98 THEN 2 ELSE 4 END AS kind"
GUARD_SQL = f"""WITH {D.EV_SQL}, a AS (SELECT session+1 AS session, {GUARDED} FROM ev), g AS (SELECT session, o AS ordinal, kind, arrival,
  max(o) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_accepted FROM a WHERE o>0),
  h AS (SELECT *, coalesce(ordinal<=last_accepted,false) AS dropped, coalesce(ordinal<=last_accepted OR ordinal>last_accepted+1,false) AS reset_before FROM g)"""


def guarded(spark, sf):
    obs = D.numbered(spark, sf).selectExpr("session + 1 AS session", *[e.strip() for e in GUARDED.replace("AS o,", "AS ordinal,").split(", ")])
    return ordinal_guard(obs)


@query("ordinal_guard", GUARD_SQL + " SELECT session, ordinal, arrival, last_accepted, dropped, reset_before FROM h")
def q_guard(spark, sf):
    return guarded(spark, sf).select("session", "ordinal", "arrival", "last_accepted", F.col("drop").alias("dropped"), "reset_before")


@query("lifecycle_findings", GUARD_SQL + """ SELECT * FROM (SELECT session, ordinal, 'trace' AS level, 'engine' AS "check", CASE WHEN dropped THEN 'event_discarded'
  WHEN reset_before THEN 'ordinal_gap_reset' WHEN kind=1 THEN 'session_opened' WHEN kind=2 THEN 'session_closed' WHEN kind=3 THEN 'session_reset' END AS message FROM h) WHERE message IS NOT NULL""")
def q_lifecycle(spark, sf):
    return lifecycle_findings(guarded(spark, sf))


@query("activity_sessions", f"""WITH ev AS (SELECT user_id AS session, event_id, epoch_us(ts)*1000 AS ns FROM events),
  a AS (SELECT *, CASE WHEN lag(ns) OVER w IS NULL OR ns-lag(ns) OVER w>{D.DAY} THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY session ORDER BY ns,event_id))
  SELECT session, event_id, sum(n) OVER (PARTITION BY session ORDER BY ns,event_id) AS island FROM a""")
def q_islands(spark, sf):
    return activity_islands(D.raw_events(spark, sf).select("session", "event_id", "ns"), ["session"], ["ns", "event_id"], "ns", D.DAY,
                            F.floor(F.col("ns") / (7 * D.DAY)).cast("long")).select("session", "event_id", "island")


# --- timer episodes: guard one day, ten buckets of one day -----------------------------------------------------------

# The SQL finds chained episode starts with a recursive query over each segment's moves.
EP_SQL = D.SEGMENT_SQL.replace("obs AS (", "RECURSIVE obs AS (", 1).replace("WHERE kind IN (1,2,3,10,14,7,11)", "WHERE kind IN (1,2,3,10,14,11)") + f""",
st AS (SELECT session, segment, start_ns FROM segs GROUP BY ALL),
eps AS (SELECT session, segment, start_ns AS a, (SELECT min(ns) FROM segs m WHERE m.session=st.session AND m.segment=st.segment AND m.ns>=st.start_ns+{11 * D.DAY}) AS b FROM st
 UNION ALL SELECT session, segment, b, (SELECT min(ns) FROM segs m WHERE m.session=eps.session AND m.segment=eps.segment AND m.ns>=eps.b+{11 * D.DAY}) FROM eps WHERE b IS NOT NULL),
cnt AS (SELECT e.session, e.segment, e.a, e.b, i, count(m.ns) AS c FROM eps e CROSS JOIN range(10) r(i)
  LEFT JOIN segs m ON m.session=e.session AND m.segment=e.segment AND m.ns>=e.a+{D.DAY}*(i+1) AND m.ns<e.a+{D.DAY}*(i+2) AND (m.ns<e.b) WHERE e.b IS NOT NULL GROUP BY ALL),
mins AS (SELECT *, CASE WHEN i>=2 THEN least(c, lag(c) OVER w, lag(c,2) OVER w) END AS m FROM cnt WINDOW w AS (PARTITION BY session,segment,a ORDER BY i)),
ep AS (SELECT session, a AS start_ns, CAST(sum(c) AS BIGINT) AS packets, max(m)/86400.0 AS score, CAST(sum(c)*50-864000000 AS DOUBLE) AS excess_ms FROM mins GROUP BY session, segment, a)
"""


def episodes(spark, sf):
    return timer_episodes(D.obs_events(spark, sf), D.DAY, 10, D.DAY, D.GAP, D.QUEUE)


@query("timer_episodes", f"WITH {EP_SQL} SELECT session, start_ns, packets, round(score,9) AS score, excess_ms FROM ep")
def q_episodes(spark, sf):
    return episodes(spark, sf).selectExpr("session", "start_ns", "packets", "round(score,9) AS score", "excess_ms")


@query("assess_episodes", f"""WITH {EP_SQL}, refs AS (SELECT max(score) AS r FROM ep GROUP BY session%20),
 n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start_ns) AS episode FROM ep),
 t AS (SELECT *, (1+(SELECT count(*) FROM refs WHERE r>=score))/((SELECT count(*) FROM refs)+1) AS tail_p, 0.5/(episode*(episode+1)) AS alpha_spent FROM n),
 g AS (SELECT *, tail_p<=alpha_spent AND score>=0.00001 AND excess_ms>=-900000000 AS eligible FROM t)
 SELECT session, start_ns, episode, round(tail_p,9) AS tail_p, round(alpha_spent,9) AS alpha_spent, eligible, CASE WHEN eligible THEN 'sustained_timer_excess'
  WHEN 1/((SELECT count(*) FROM refs)+1)>alpha_spent THEN 'insufficient_reference' ELSE 'within_policy' END AS reason FROM g""")
def q_assess(spark, sf):
    ep = cut(episodes(spark, sf))
    ref = ep.groupBy((F.col("session") % 20).alias("g")).agg(F.max("score").alias("score"))
    return assess_episodes(ep, ref, 0.5, 0.00001, -9e8).selectExpr(
        "session", "start_ns", "episode", "round(tail_p,9) AS tail_p", "round(alpha_spent,9) AS alpha_spent", "eligible", "reason")


# --- dataset windows -------------------------------------------------------------------------------------------------

def _q(x, q):
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[CAST(floor((count({x})-1)*{q}) AS INT)+1]"


CELLS = D.view_sql("full") + f""", {D.TRIALS_SQL}, cells AS (SELECT f.*, session AS trial, (ns-start_observed_ns-{D.DAY})//{10 * D.DAY} AS bucket, start_observed_ns+{D.DAY} AS t0, end_observed_ns-{D.DAY} AS t1
  FROM "full" f JOIN trials ON trial_id=session WHERE ns>=start_observed_ns+{D.DAY} AND ns<end_observed_ns-{D.DAY}),
 c1 AS (SELECT * FROM cells WHERE t0+(bucket+1)*{10 * D.DAY}<=t1)"""
CELLS = CELLS.replace("), full AS (SELECT", '), "full" AS (SELECT').replace(", full AS (SELECT", ', "full" AS (SELECT')
DATASET_SQL = CELLS + f""",
 m0 AS (SELECT *, kind=11 AS mv FROM c1 QUALIFY count(*) FILTER (kind IN (3,10,14)) OVER (PARTITION BY trial,bucket)=0 AND count(*) FILTER (kind=11) OVER (PARTITION BY trial,bucket)>=10),
 m1 AS (SELECT *, lag(m0) OVER (PARTITION BY trial,bucket,mv ORDER BY packet) AS p, last_value(CASE WHEN has_look THEN {{'y':yaw,'p':pitch}} END IGNORE NULLS)
   OVER (PARTITION BY trial,bucket,mv ORDER BY packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS look FROM m0),
 m2 AS (SELECT *, mv AND coalesce(has_pos AND p.has_pos,false) AS stepped, x-p.x AS dx, y-p.y AS dy, z-p.z AS dz, CASE WHEN mv THEN (ns-p.ns)/1e6 END AS dt FROM m1),
 m3 AS (SELECT *, stepped AND available AND p.available AND clear AND p.clear AS usable, lag({{'ok':stepped,'dx':dx,'dy':dy,'dz':dz}}) OVER (PARTITION BY trial,bucket,mv ORDER BY packet) AS o FROM m2),
 m4 AS (SELECT *, usable AND NOT source AS air FROM m3),
 m5 AS (SELECT *, CASE WHEN stepped THEN sqrt(dx*dx+dz*dz) END AS hs, CASE WHEN stepped THEN abs(dy) END AS ady, CASE WHEN mv AND has_look THEN abs(((yaw-look.y+540)%360)-180) END AS yd,
   CASE WHEN mv AND has_look THEN abs(pitch-look.p) END AS pd, CASE WHEN air AND o.ok THEN abs(dy-(o.dy-0.08)*0.98) END AS gr,
   CASE WHEN usable AND flat AND item AND p.item AND o.ok THEN sqrt(pow(dx-o.dx*(0.91*friction),2)+pow(dz-o.dz*(0.91*friction),2)) END AS inp,
   CASE WHEN kind=7 AND available THEN sqrt(pow(greatest(low_x-0.13125-eye_x,0,eye_x-high_x-0.13125),2)+pow(greatest(low_y-0.13125-eye_y,0,eye_y-high_y-0.13125),2)
     +pow(greatest(low_z-0.13125-eye_z,0,eye_z-high_z-0.13125),2)) END AS di FROM m4)
 SELECT trial, bucket, min(t0)+bucket*{10 * D.DAY} AS start_ns, round(count(*) FILTER (mv)/864000.0,9) AS movement_pps, round({_q('dt', .5)},3) AS dt_p50_ms, round({_q('dt', .95)},3) AS dt_p95_ms,
   round(stddev_pop(dt),3) AS dt_std_ms, round(count(*) FILTER (mv AND batch=p.batch)/greatest(1,count(*) FILTER (mv)-1),6) AS same_batch_fraction,
   round(count(*) FILTER (mv AND has_pos)/count(*) FILTER (mv),6) AS position_fraction, round({_q('hs', .95)},6) AS hstep_p95, round({_q('ady', .95)},6) AS abs_dy_p95,
   round({_q('yd', .95)},6) AS yaw_change_p95, round({_q('pd', .95)},6) AS pitch_change_p95,
   round(CASE WHEN count(*) FILTER (air)>0 THEN count(*) FILTER (air AND ground AND dy< -0.03)/count(*) FILTER (air) END,6) AS air_ground_fraction, round({_q('gr', .95)},6) AS gravity_error_p95,
   round({_q('inp', .95)},6) AS item_input_p95, round(count(*) FILTER (kind=7)/864000.0,9) AS attack_pps, round({_q('di', .95)},6) AS attack_distance_p95,
   count(*) FILTER (kind=12) AS impulse_count, count(*) FILTER (kind=13) AS ack_count FROM m5 GROUP BY trial, bucket HAVING min(coalesce(dt,0))>=0"""


@query("dataset_windows", "WITH " + DATASET_SQL)
def q_dataset(spark, sf):
    out = dataset_windows(as_trial(D.view(spark, sf, "full")), D.trials(spark, sf), 864000)
    digits = {"movement_pps": 9, "attack_pps": 9, "dt_p50_ms": 3, "dt_p95_ms": 3, "dt_std_ms": 3}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# Delivery order that strays from time order: k > 96 is delivered 40 events late.
@query("reorder_violations", "WITH " + CELLS + f""", o AS (SELECT trial, bucket, ordinal+CASE WHEN k>96 THEN 40 ELSE 0 END AS o FROM c1),
 c AS (SELECT trial, bucket, count(*) AS events, min(o) AS f, max(o) AS l FROM o GROUP BY ALL)
 SELECT a.trial, a.bucket, a.events, coalesce(min(b.f)<a.l,false) AS reordered, a.events>25 AS too_many FROM c a LEFT JOIN c b ON a.trial=b.trial AND b.bucket>=a.bucket+2
 GROUP BY a.trial, a.bucket, a.events, a.l HAVING coalesce(min(b.f)<a.l,false) OR a.events>25""")
def q_reorder(spark, sf):
    obs = as_trial(D.view(spark, sf, "full")).withColumn("ordinal", F.col("ordinal") + F.when(F.col("k") > 96, 40).otherwise(0))
    return reorder_violations(obs, D.trials(spark, sf), 864000, 25)


@query("trial_features", f"""WITH {EP_SQL}, one AS (SELECT * FROM (SELECT session, segment, a, b, CAST(sum(c) AS BIGINT) AS packets, max(m)/86400.0 AS score, stddev_pop(c/86400.0) AS wstd FROM mins GROUP BY session, segment, a, b)
   QUALIFY row_number() OVER (PARTITION BY session ORDER BY a)=1),
 mv AS (SELECT o.*, one.packets, one.score, one.wstd FROM obs o JOIN one USING (session) WHERE o.kind=11 AND ns>=one.a+{D.DAY} AND ns<one.a+{11 * D.DAY}),
 d AS (SELECT *, (ns-lag(ns) OVER (PARTITION BY session ORDER BY ordinal))/1e6 AS dt, lag({{'x':x,'y':y,'z':z}}) OVER (PARTITION BY session,has_pos ORDER BY ordinal) AS p,
   lag(yaw) OVER (PARTITION BY session,has_look ORDER BY ordinal) AS look FROM mv),
 e AS (SELECT *, CASE WHEN has_pos THEN sqrt(pow(x-p.x,2)+pow(z-p.z,2)) END AS h, CASE WHEN has_pos THEN abs(y-p.y) END AS v,
   CASE WHEN has_look THEN abs(((yaw-look+540)%360)-180) END AS t FROM d)
 SELECT session AS trial, round(min(packets)/864000.0,9) AS movement_pps, round(min(score),9) AS sustained_pps, round(quantile_cont(dt,0.5),3) AS interval_median_ms, round(stddev_pop(dt)/avg(dt),6) AS interval_cv,
  round(quantile_cont(h,0.95),6) AS horizontal_step_p95, round(quantile_cont(v,0.95),6) AS vertical_step_p95, round(coalesce(quantile_cont(t,0.95),0),6) AS turn_p95,
  round(avg(CAST(ground AS INT)),6) AS ground_fraction, round(min(wstd),9) AS window_rate_std, count(dt) AS intervals
 FROM e GROUP BY session HAVING count(dt)>=5 AND count(h)>=2""")
def q_trial_features(spark, sf):
    ep = cut(episodes(spark, sf))
    first = ep.groupBy("session").agg(F.min_by(F.struct("first_window_ns", "counts", "packets", "score"), "start_ns").alias("e")).select(
        F.col("session").alias("trial"), "e.*", F.lit(D.DAY).alias("bucket_ns"))
    out = trial_features(as_trial(D.obs_events(spark, sf)), first, least=5).drop("burst_fraction")
    digits = {"movement_pps": 9, "sustained_pps": 9, "window_rate_std": 9, "interval_median_ms": 3}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("attack_features", f"""WITH {D.OBS_SQL}, a AS (SELECT session, ordinal, (ns-lag(ns) OVER w)/1e6 AS dt FROM obs WHERE kind=7 WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
 b AS (SELECT *, abs(dt-lag(dt) OVER (PARTITION BY session ORDER BY ordinal))<=1 AS same, floor(dt/3600000) AS bin FROM a),
 t AS (SELECT session, count(*) AS n, stddev_pop(dt)/avg(dt) AS cv, avg(CAST(same AS INT)) AS rep FROM b GROUP BY session),
 e AS (SELECT session, -sum(p*log2(p)) AS bits FROM (SELECT session, bin, count(*)/sum(count(*)) OVER (PARTITION BY session) AS p FROM b WHERE dt IS NOT NULL GROUP BY session, bin) GROUP BY session)
 SELECT session AS trial, n AS attacks, n>=10 AS eligible, CASE WHEN n<10 THEN 'needs_10_attacks' END AS reason, round(CASE WHEN n>=10 THEN cv END,6) AS interval_cv,
  round(CASE WHEN n>=10 THEN bits END,6) AS interval_entropy_bits, round(CASE WHEN n>=10 THEN rep END,6) AS repeat_within_1ms FROM t LEFT JOIN e USING (session)""")
def q_attack_features(spark, sf):
    return r6(attack_features(as_trial(D.obs_events(spark, sf)), 10, 3600000, 64))


@query("feature_summary", f"""WITH {D.WINDOW_SQL}, l AS (SELECT *, session%2 AS label FROM windows),
 u AS (UNPIVOT (SELECT label, movement_pps, attack_pps, turn_mean FROM l) ON movement_pps, attack_pps, turn_mean INTO NAME feature VALUE x)
 SELECT feature, label, count(*) AS windows, round(min(x),9) AS minimum, round(median(x),9) AS median, round(max(x),9) AS maximum FROM u GROUP BY feature, label""")
def q_summary(spark, sf):
    out = feature_summary(windows(spark, sf).withColumn("label", F.col("session") % 2), ["movement_pps", "attack_pps", "turn_mean"])
    return out.select("feature", "label", "windows", *[F.round(c, 9).alias(c) for c in ("minimum", "median", "maximum")])


@query("macro_report", f"""WITH {D.WINDOW_SQL} SELECT session, count(*) AS windows, count(DISTINCT segment) AS segments, round(median(attack_pps),9) AS attack_pps, round(median(attack_cv),6) AS attack_cv,
 round(median(attack_repeat),6) AS attack_repeat, min(attacks) AS least_attacks, count(*)>=2 AND count(DISTINCT segment)=1 AND min(attacks)>=1 AS eligible FROM windows GROUP BY session""")
def q_macro(spark, sf):
    out = macro_report(windows(spark, sf), ["session"], 2, 1)
    return out.withColumn("attack_pps", F.round("attack_pps", 9)).withColumn("attack_cv", F.round("attack_cv", 6)).withColumn("attack_repeat", F.round("attack_repeat", 6))


@query("quantile_lower", f"WITH {D.OBS_SQL} SELECT session, list_sort(list(value))[CAST(floor((count(*)-1)*0.95) AS INT)+1] AS q FROM obs GROUP BY session")
def q_quantile(spark, sf):
    return quantile_lower_by(D.raw_events(spark, sf), ["session"], "value", 0.95)

"""Joins, rollups, limits and set queries."""

from pyspark.sql import functions as F

from ..operators import relations as J
from ..operators.timer import assess_episodes
from ..operators.scan import cut
from . import driver as D
from .q_registry import SELECT_SQL, selected
from .q_windows import EP_SQL, episodes, r6, windows
from .registry import query

DAY = D.DAY


def f(spark, sf, text, **given):
    return D.frame(spark, sf, text, **given)


DET = "SELECT p_partkey AS id, p_name AS name, p_size AS version FROM {part}"
DEP = "SELECT s_suppkey AS detection_id, CASE WHEN s_acctbal > 0 THEN 'shadow' ELSE 'enforce' END AS mode, s_name AS experiment_id FROM {supplier}"


@query("detections_with_mode", D.duck(f"SELECT id, name, version, mode, experiment_id FROM ({DET}) d LEFT JOIN ({DEP}) p ON detection_id=id ORDER BY name, id LIMIT 100"))
def q_modes(spark, sf):
    return J.detections_with_mode(f(spark, sf, DET), f(spark, sf, DEP))


ATT = "SELECT o_custkey AS trial, o_orderkey AS ordinal, o_orderpriority AS target FROM {orders} WHERE o_orderkey % 31 <> 0"
VER = "SELECT o_custkey AS trial, l_orderkey AS ordinal, CASE WHEN l_orderkey % 41 = 0 THEN 'x' ELSE o_orderpriority END AS target, CASE WHEN l_linenumber = 2 THEN 'suspicious' ELSE 'trace' END AS level FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_linenumber <= 2 OR (l_linenumber = 3 AND l_orderkey % 37 = 0)"


@query("reconcile_verdicts", D.duck(f"""WITH v AS (SELECT trial, ordinal, count(*) AS n, min(target) AS t FROM ({VER}) WHERE level<>'suspicious' GROUP BY ALL)
  SELECT coalesce(a.trial,v.trial) AS trial, coalesce(a.ordinal,v.ordinal) AS ordinal, CASE WHEN v.trial IS NULL THEN 'missing_verdict' WHEN a.trial IS NULL THEN 'verdict_without_attack' WHEN n>1 THEN 'duplicate_verdict' ELSE 'target_mismatch' END AS violation
  FROM ({ATT}) a FULL JOIN v ON a.trial=v.trial AND a.ordinal=v.ordinal WHERE v.trial IS NULL OR a.trial IS NULL OR n>1 OR a.target<>t"""))
def q_reconcile(spark, sf):
    return J.reconcile_verdicts(f(spark, sf, ATT), f(spark, sf, VER))


HELD = "SELECT id, player_group AS `group`, day, client, network, y FROM {pick} WHERE purpose = 'validation'"
DEV = "SELECT id, player_group AS `group`, day FROM {pick} WHERE purpose = 'development' AND day % 40 = 3"
TESTS = "SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 17 = 0"
HELD_SQL = SELECT_SQL + D.duck(f""", h AS ({HELD.replace("{pick}", "sel").replace("`", '"')}), d AS ({DEV.replace("{pick}", "sel").replace("`", '"')}), ot AS ({TESTS})""")


def held_dev(spark, sf):
    s = selected(spark, sf)
    return spark.sql(HELD, pick=s), spark.sql(DEV, pick=s), f(spark, sf, TESTS)


@query("contaminated", HELD_SQL + ' SELECT id FROM h WHERE "group" IN (SELECT "group" FROM d) OR day IN (SELECT day FROM d) OR id IN (SELECT id FROM ot)')
def q_contaminated(spark, sf):
    return J.contaminated(*held_dev(spark, sf)).select("id")


@query("untouched", HELD_SQL + " SELECT id FROM h WHERE id NOT IN (SELECT id FROM ot)")
def q_untouched(spark, sf):
    h, _, t = held_dev(spark, sf)
    return J.untouched(h, t).select("id")


@query("missing_controls", SELECT_SQL + """ SELECT route AS client, day//30 AS network FROM sel WHERE y=1 AND excluded IS NULL EXCEPT SELECT route, day//30 FROM sel WHERE y=0 AND excluded IS NULL""")
def q_controls(spark, sf):
    return J.missing_controls(selected(spark, sf).filter("excluded IS NULL").selectExpr("route AS client", "cast(floor(day / 30) AS bigint) AS network", "y"))


@query("class_coverage", SELECT_SQL + """ SELECT (SELECT count(*) FROM (SELECT client FROM sel WHERE y=1 AND id%50=7 EXCEPT SELECT client FROM sel WHERE y=0))=0 AS same_client_control,
  (SELECT count(*) FROM (SELECT network FROM sel WHERE y=1 EXCEPT SELECT network FROM sel WHERE y=0 AND network<>'BUILDING'))=0 AS matched_network_controls""")
def q_class(spark, sf):
    s = selected(spark, sf)
    return J.class_coverage(s.filter("(y = 1 OR network <> 'BUILDING')"))


@query("leave_group_out", """WITH p AS (SELECT o_custkey AS seed, max(o_totalprice) AS own FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY own DESC) AS rn FROM p)
  SELECT seed, (SELECT count(*) FROM p)-1 AS others, CASE WHEN rn=1 THEN (SELECT own FROM r WHERE rn=2) ELSE (SELECT own FROM r WHERE rn=1) END AS others_max FROM r""")
def q_logo(spark, sf):
    return J.leave_group_out(D.table(spark, sf, "orders"), "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "seed")


@query("frames_around", f"""WITH e AS (SELECT user_id AS session, event_id, event_type, epoch_us(ts)*1000 AS ns FROM events), a AS (SELECT session, event_id%3 AS target, event_id AS attack, ns FROM e WHERE event_type='purchase'),
  g AS (SELECT session, event_id%3 AS target, event_id AS frame, ns FROM e WHERE event_type='view')
  SELECT a.session, a.target, attack, a.ns, frame AS f_frame, g.ns AS f_ns FROM a JOIN g ON a.session=g.session AND a.target=g.target AND g.ns BETWEEN a.ns-{2 * DAY} AND a.ns+{DAY}""")
def q_frames(spark, sf):
    e = D.raw_events(spark, sf).withColumn("target", F.col("event_id") % 3)
    a = e.filter("event_type = 'purchase'").select("session", "target", F.col("event_id").alias("attack"), "ns")
    g = e.filter("event_type = 'view'").select("session", "target", F.col("event_id").alias("frame"), "ns")
    return J.frames_around(a, g, 2 * DAY, DAY, 5 * DAY)


@query("last_known", f"""WITH {D.EV_SQL} SELECT session, ordinal, last_value(CASE WHEN event_type='purchase' THEN k END IGNORE NULLS) OVER w AS attack_k, last_value(CASE WHEN k%2=0 THEN value END IGNORE NULLS) OVER w AS look
  FROM ev WINDOW w AS (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_last(spark, sf):
    return J.last_known(D.numbered(spark, sf), ["session"], ["ordinal"], F.floor(F.col("ordinal") / 16).cast("long"),
                        attack_k=F.expr("CASE WHEN event_type = 'purchase' THEN k END"), look=F.expr("CASE WHEN k % 2 = 0 THEN value END")).select("session", "ordinal", "attack_k", "look")


COND = "SELECT o_custkey AS pair, o_orderkey % 7 AS center, min(o_orderkey) % 90 AS swings, count(*) AS attacks, count(*) % 3 AS suspicious, max(o_orderkey) % 5 <> 0 AS usable, o_orderstatus AS s FROM {orders} WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey, o_orderkey % 7, o_orderstatus"


@query("compare_conditions", D.duck(f"""WITH c AS ({COND}), a AS (SELECT * FROM c WHERE s='O'), b AS (SELECT * FROM c WHERE s='F')
  SELECT coalesce(a.pair,b.pair) AS pair, coalesce(a.center,b.center) AS center, CASE WHEN a.usable THEN a.swings||'/'||a.attacks ELSE 'pending/invalid' END AS off_cell, CASE WHEN b.usable THEN b.swings||'/'||b.attacks ELSE 'pending/invalid' END AS on_cell,
  (CASE WHEN a.usable THEN CAST(a.suspicious AS VARCHAR) ELSE '-' END)||'/'||(CASE WHEN b.usable THEN CAST(b.suspicious AS VARCHAR) ELSE '-' END) AS suspicious FROM a FULL JOIN b ON a.pair=b.pair AND a.center=b.center"""))
def q_compare(spark, sf):
    c = f(spark, sf, COND)
    return J.compare_conditions(c.filter("s = 'O'"), c.filter("s = 'F'"))


MODELS = "SELECT s_suppkey AS model_id, s_acctbal / 1000 AS coefficient FROM {supplier} WHERE s_suppkey < 20"


@query("with_models", D.duck(f"""SELECT model_id, count(*) AS windows, count(*) FILTER (l_quantity*coefficient > 100) AS flagged, round(max(l_quantity*coefficient),6) AS best FROM lineitem JOIN ({MODELS}) ON true GROUP BY 1"""))
def q_models(spark, sf):
    from ..streaming.live import with_models
    w = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return with_models(w, f(spark, sf, MODELS)).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("windows"), F.expr("count_if(l_quantity * coefficient > 100) AS flagged"), F.expr("round(max(l_quantity * coefficient), 6) AS best"))


@query("live_sessions", """WITH w AS (SELECT user_id AS session, epoch_us(ts)//1000 AS created_ms, event_id AS event FROM events WHERE event_type<>'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)=1),
  d AS (SELECT user_id AS session, event_type||event_id AS action, value AS margin FROM events WHERE event_type='purchase' AND user_id%5<>0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)=1)
  SELECT session, created_ms, event, action, margin FROM w LEFT JOIN d USING (session)""")
def q_live(spark, sf):
    e = D.raw_events(spark, sf).withColumnsRenamed({"epoch_ms": "created_ms", "event_id": "event", "value": "margin"}).withColumn("action", F.concat("event_type", F.col("event").cast("string")))
    return J.live_sessions(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase' AND session % 5 <> 0"))


@query("check_decisions", f"""WITH {EP_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start_ns) AS episode FROM ep), refs AS (SELECT max(score) AS r FROM ep GROUP BY session%20),
 t AS (SELECT session, episode, (1+(SELECT count(*) FROM refs WHERE r>=score))/((SELECT count(*) FROM refs)+1) AS t FROM n)
 SELECT session, episode, round(t+0.001,9) AS tail_p, round(t,9) AS t FROM t WHERE session%4=0""")
def q_check(spark, sf):
    ep = cut(episodes(spark, sf))
    ref = ep.groupBy((F.col("session") % 20).alias("g")).agg(F.max("score").alias("score"))
    own = assess_episodes(ep, ref, 0.5)
    told = own.selectExpr("session", "episode", "tail_p + CASE WHEN session % 4 = 0 THEN 0.001D ELSE 0D END AS tail_p", "alpha_spent")
    return J.check_decisions(told, own).selectExpr("session", "episode", "round(tail_p,9) AS tail_p", "round(t,9) AS t")


FILES = "SELECT c_custkey AS detection_id, c_name AS experiment_id, c_mktsegment AS mode, cast(c_acctbal AS string) AS digest FROM {customer} WHERE c_custkey % 9 <> 0"
REGS = "SELECT c_custkey AS detection_id, CASE WHEN c_custkey % 10 = 1 THEN 'old' ELSE c_name END AS experiment_id, CASE WHEN c_custkey % 12 = 2 THEN 'disabled' ELSE c_mktsegment END AS mode, CASE WHEN c_custkey % 14 = 3 THEN '' ELSE cast(c_acctbal AS string) END AS digest FROM {customer} WHERE c_custkey % 8 <> 0"


@query("check_deployments", D.duck(f"""SELECT coalesce(f.detection_id,r.detection_id) AS detection_id, CASE WHEN r.detection_id IS NULL THEN 'not_registered' WHEN f.detection_id IS NULL THEN 'file_missing' WHEN f.experiment_id<>r.experiment_id THEN 'other_experiment'
  WHEN f.mode<>r.mode THEN 'other_mode' ELSE 'other_digest' END AS problem FROM ({FILES}) f FULL JOIN ({REGS}) r USING (detection_id) WHERE r.detection_id IS NULL OR f.detection_id IS NULL OR f.experiment_id<>r.experiment_id OR f.mode<>r.mode OR f.digest<>r.digest"""))
def q_deployments(spark, sf):
    return J.check_deployments(f(spark, sf, FILES), f(spark, sf, REGS))


PL = "SELECT l_orderkey AS session, l_linenumber AS k, max(l_extendedprice) AS pps, max(l_discount) AS cv, max(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
PA = f"SELECT session, k, pps, cv FROM ({PL}) WHERE q > 2"
PB = f"SELECT session, k, pps * CASE WHEN k = 3 THEN 1.0001 ELSE 1.000000000001 END AS pps, cv FROM ({PL}) WHERE q < 49"


@query("parity", D.duck(f"SELECT session, k, CASE WHEN q>=49 THEN 'only_left' WHEN q<=2 THEN 'only_right' ELSE 'differs' END AS problem FROM ({PL}) WHERE q>=49 OR q<=2 OR k=3"))
def q_parity(spark, sf):
    return J.parity(f(spark, sf, PA), f(spark, sf, PB), ["session", "k"], ["pps", "cv"])


@query("match_acks", f"""WITH {D.view_sql('impulses')[0:]}, i AS (SELECT * FROM impulses WHERE kind IN (12,13)),
 c AS (SELECT *, last_value(CASE WHEN kind=12 THEN {{'o':ordinal,'ns':ns}} END IGNORE NULLS) OVER (PARTITION BY session,token ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM i)
 SELECT session, token, s.o AS impulse, ordinal AS ack, round((ns-s.ns)/1e6,3) AS delay_ms FROM c WHERE kind=13 AND s IS NOT NULL AND ns-s.ns<={4 * DAY} QUALIFY row_number() OVER (PARTITION BY session,token,s.o ORDER BY ordinal)=1""")
def q_acks(spark, sf):
    return J.match_acks(D.view(spark, sf, "impulses"), 4 * DAY).withColumn("delay_ms", F.round("delay_ms", 3))


# --- counts ----------------------------------------------------------------------------------------------------------

@query("coverage_counts", D.duck("SELECT input_source, review, count(*) AS count FROM {samples} GROUP BY ALL"))
def q_counts(spark, sf):
    return J.coverage_counts(D.reg(spark, sf, "samples"))


DEC = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 20 = 0 THEN 'banned' ELSE 'observed' END AS action, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS flagged, cast(o_orderkey AS bigint) AS created_ms FROM {orders}"
BUD = "SELECT l_orderkey AS id, CASE WHEN l_quantity = 50 THEN 'banned' ELSE 'observed' END AS action FROM {lineitem}"


@query("totals", D.duck(f"SELECT (SELECT count(*) FROM ({DEC}) WHERE action='banned')+(SELECT count(*) FROM ({BUD}) WHERE action='banned') AS bans, (SELECT count(*) FROM ({DEC}) WHERE flagged=1 AND created_ms>5000) AS candidates"))
def q_totals(spark, sf):
    return J.totals(f(spark, sf, DEC), f(spark, sf, BUD), 5000)


@query("coverage", SELECT_SQL + """ SELECT (SELECT count(DISTINCT player_group) FROM sel WHERE input_source='human' AND y=0) AS human_players, (SELECT count(DISTINCT day) FROM sel) AS days, (SELECT count(DISTINCT network) FROM sel) AS network_conditions,
  round((SELECT count(*) FROM sample_windows WHERE sample_id IN (SELECT id FROM sel WHERE input_source='human' AND y=0))*30/3600,6) AS legit_hours""")
def q_coverage(spark, sf):
    return r6(J.coverage(selected(spark, sf), D.reg(spark, sf, "sample_windows")))


@query("coverage_cube", D.duck("""SELECT label, client, network, count(DISTINCT id) AS samples, count(ordinal) AS windows, CAST(grouping(label,client,network) AS INT) AS level FROM {samples} LEFT JOIN {sample_windows} ON sample_id=id GROUP BY CUBE (label, client, network)"""))
def q_cube(spark, sf):
    return J.coverage_cube(D.reg(spark, sf, "samples"), D.reg(spark, sf, "sample_windows"))


RT = "SELECT *, trial_id % 12 AS pair, trial_id % 3 AS center FROM {trials}"
RV = "SELECT session AS trial, ordinal, ns, CASE WHEN k % 10 = 0 THEN 'suspicious' ELSE 'trace' END AS level, CASE WHEN k % 10 = 0 THEN 'repeated' WHEN k % 4 = 0 THEN 'reach_suspicious_sample' WHEN k % 4 = 1 THEN 'reach_skipped' ELSE 'reach_within_bound' END AS message, CASE WHEN k % 4 <> 1 THEN k / 10 END AS distance FROM {combat} WHERE kind = 7"
REACH_ROLL = D.view_sql("combat") + f""", {D.TRIALS_SQL}, t AS ({RT.replace('{trials}', 'trials')}), v AS ({RV.replace('{combat}', 'combat')}),
 o AS (SELECT *, sqrt(pow(greatest(low_x-eye_x,0,eye_x-high_x),2)+pow(greatest(low_y-eye_y,0,eye_y-high_y),2)+pow(greatest(low_z-eye_z,0,eye_z-high_z),2)) AS d, CASE WHEN kind=8 AND k%2=0 THEN 9 ELSE kind END AS kd FROM combat),
 raw AS (SELECT session AS trial, count(*) FILTER (kd=9) AS swings, count(*) FILTER (kd=7) AS attacks, min(d) FILTER (kd=7 AND available) AS raw_min, max(d) FILTER (kd=7 AND available) AS raw_max FROM o JOIN t ON trial_id=session
   WHERE ns>=start_observed_ns+{DAY} AND ns<end_observed_ns-{DAY} GROUP BY 1),
 vv AS (SELECT trial, count(*) FILTER (message='reach_suspicious_sample') AS suspicious, count(*) FILTER (message='reach_within_bound') AS within, count(*) FILTER (message='reach_skipped') AS skipped, count(*) FILTER (level='suspicious') AS alerts,
   min(distance) FILTER (level<>'suspicious') AS conservative_min FROM v JOIN t ON trial_id=trial WHERE ns>=start_observed_ns+{DAY} AND ns<end_observed_ns-{DAY} GROUP BY 1),
 rt AS (SELECT trial_id AS trial, pair, center, round((end_observed_ns-start_observed_ns-{2 * DAY})/1e9,3) AS seconds, swings, attacks, coalesce(suspicious,0)+coalesce(within,0) AS evaluated, coalesce(suspicious,0) AS suspicious, coalesce(skipped,0) AS skipped, coalesce(alerts,0) AS alerts,
   round(raw_min,6) AS raw_min, round(raw_max,6) AS raw_max, round(conservative_min,6) AS conservative_min FROM t JOIN raw ON raw.trial=trial_id LEFT JOIN vv ON vv.trial=trial_id WHERE swings>=20)"""


def rolled(spark, sf):
    combat = cut(D.view(spark, sf, "combat"))
    obs = combat.withColumn("kind", F.expr("CASE WHEN kind = 8 AND k % 2 = 0 THEN 9 ELSE kind END")).withColumn("trial", F.col("session"))
    return J.reach_trials(obs, spark.sql(RV, combat=combat), spark.sql(RT, trials=D.trials(spark, sf)))


@query("reach_trials", "WITH " + REACH_ROLL[0:] + " SELECT * FROM rt" if not REACH_ROLL.startswith("WITH") else REACH_ROLL + " SELECT * FROM rt")
def q_reach_trials(spark, sf):
    return r6(rolled(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query("reach_report", "WITH " + REACH_ROLL + """ SELECT dense_rank() OVER (ORDER BY pair) AS pair_number, pair, center, sum(attacks)::BIGINT AS attacks, sum(evaluated)::BIGINT AS evaluated, sum(suspicious)::BIGINT AS suspicious, sum(skipped)::BIGINT AS skipped, min(raw_min) AS raw_min, max(raw_max) AS raw_max,
  count(*) AS recordings FROM rt GROUP BY pair, center""")
def q_reach_report(spark, sf):
    return r6(J.reach_report(rolled(spark, sf)))


PF = "SELECT concat('u', cast(user_id AS string)) AS player, event_id AS event, CASE WHEN event_type = 'error' THEN 'suspicious' ELSE 'trace' END AS level, CASE event_type WHEN 'signup' THEN 'session_open' WHEN 'click' THEN 'session_closed' ELSE event_type END AS message, value FROM {events}"


@query("player_rollup", D.duck(f"""WITH p AS ({PF}) SELECT player, count(level) AS records, count(*) FILTER (level='suspicious') AS alerts, max(event) AS last_ms, CASE WHEN right(player,1)='7' THEN 'Banned'
  WHEN arg_max(message, event) FILTER (message IN ('session_open','session_closed'))='session_open' THEN 'Session open' WHEN arg_max(message, event) FILTER (message IN ('session_open','session_closed'))='session_closed' THEN 'Offline' ELSE 'Observed' END AS status FROM (FROM p UNION ALL BY NAME SELECT 'c'||c_custkey AS player FROM customer WHERE c_custkey%10=7) GROUP BY player"""))
def q_rollup(spark, sf):
    p = f(spark, sf, PF).withColumn("epoch_ms", F.col("event"))
    named = f(spark, sf, "SELECT concat('c', cast(c_custkey AS string)) AS player FROM {customer}")  # known from the log alone
    bans = p.select("player").union(named).filter("player LIKE '%7'").selectExpr("player", "'banned' AS event").distinct()
    return J.player_rollup(p, bans)


@query("trend_series", f"""WITH e AS (SELECT 'u'||user_id AS player, epoch_us(ts)//1000 AS created_ms, event_id AS event, value FROM events), t AS (SELECT DISTINCT player FROM e ORDER BY player LIMIT 8),
  l AS (SELECT e.*, CASE WHEN created_ms-lag(created_ms) OVER w<=86400000 THEN 0 ELSE 1 END AS n FROM e JOIN t USING (player) WINDOW w AS (PARTITION BY player ORDER BY created_ms,event))
  SELECT player, created_ms, event, value, sum(n) OVER (PARTITION BY player ORDER BY created_ms,event)::BIGINT AS piece FROM l""")
def q_trend(spark, sf):
    e = D.raw_events(spark, sf).selectExpr("concat('u', cast(session AS string)) AS player", "epoch_ms AS created_ms", "event_id AS event", "value")
    return J.trend_series(e, 86_400_000, 8, 10 * 86_400_000)


@query("verdict_counts", "SELECT o_orderstatus AS message, CASE WHEN o_orderstatus='P' THEN o_orderpriority END AS reason, count(*) AS n FROM orders GROUP BY ALL")
def q_verdicts(spark, sf):
    o = D.table(spark, sf, "orders").selectExpr("o_orderstatus AS message", "CASE WHEN o_orderstatus = 'P' THEN map('reason', o_orderpriority) ELSE map('target', 'x') END AS evidence")
    return J.verdict_counts(o)


# --- order, limits, sets ---------------------------------------------------------------------------------------------

@query("recent", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice>1000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def q_recent(spark, sf):
    return J.recent(D.table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 500, ("o_totalprice", 1000)).select("o_orderkey", "o_totalprice")


@query("latest_experiment", "SELECT o_custkey AS detection_id, arg_max(o_orderkey, (epoch_ms(o_orderdate), o_orderkey)) AS id, max(epoch_ms(o_orderdate)) AS created_ms FROM orders GROUP BY 1")
def q_latest(spark, sf):
    return J.latest_experiment(D.table(spark, sf, "orders").select(F.col("o_custkey").alias("detection_id"), F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms")))


@query("recent_per_key", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank<=5")
def q_recent_key(spark, sf):
    return J.recent_per_key(D.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "rank")


@query("incidents", "SELECT 'log' AS source, c_name AS player, NULL::DOUBLE AS margin FROM customer WHERE c_acctbal<0 UNION ALL SELECT 'native', s_name, NULL FROM supplier UNION ALL SELECT 'model', o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus='F'")
def q_incidents(spark, sf):
    return J.incidents(f(spark, sf, "SELECT 'log' AS source, c_name AS player FROM {customer} WHERE c_acctbal < 0"), f(spark, sf, "SELECT 'native' AS source, s_name AS player FROM {supplier}"),
                       f(spark, sf, "SELECT 'model' AS source, o_orderpriority AS player, o_totalprice AS margin FROM {orders} WHERE o_orderstatus = 'F'"))


CA, CB = "SELECT o_custkey AS c, o_orderpriority AS p FROM {orders} WHERE o_orderstatus = 'F'", "SELECT o_custkey AS c, o_orderpriority AS p FROM {orders} WHERE o_orderstatus = 'O'"


@query("set_diff", D.duck(f"{CA} EXCEPT {CB}"))
def q_diff(spark, sf):
    return J.set_diff(f(spark, sf, CA), f(spark, sf, CB))


@query("set_overlap", D.duck(f"{CA} INTERSECT {CB}"))
def q_overlap(spark, sf):
    return J.set_overlap(f(spark, sf, CA), f(spark, sf, CB))


@query("distinct_values", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def q_distinct(spark, sf):
    return J.distinct_values(D.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("search_findings", "SELECT doc_id FROM documents WHERE contains(lower(lang||' '||text), 'license')")
def q_search(spark, sf):
    d = D.table(spark, sf, "documents").selectExpr("doc_id", "lang AS name", "text AS json", "'trace' AS level")
    return J.search_findings(d, "LICENSE").select("doc_id")

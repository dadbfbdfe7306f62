"""Audit, admission and registry queries over orders, customers, line items, events and texts."""

from pyspark.sql import functions as F

from ..operators import admission as A
from . import driver as D
from .q_windows import r6
from .registry import query

R = D.duck_with

# --- capture audit: events as records, users as recordings -----------------------------------------------------------
AUDIT_OBS = ("session AS trial, session, ordinal AS arrival, CASE WHEN k = 14 AND session % 4 = 0 THEN ordinal + 1 ELSE ordinal END AS ordinal, concat('u', cast(session AS string)) AS player, "
             "CASE WHEN ordinal = 1 AND session % 9 <> 0 THEN 1 WHEN ordinal > 1 AND session % 8 = 1 AND k = 5 THEN 1 WHEN k >= 98 THEN 3 WHEN event_type = 'purchase' THEN 7 ELSE 11 END AS kind, "
             "CASE WHEN k = 77 AND session % 5 = 0 THEN cast('Infinity' AS double) ELSE value END AS x")
MANIFEST = ("SELECT trial_id, CASE WHEN trial_id % 2 = 0 THEN 'legit' ELSE 'cheat' END AS declared_label, CASE WHEN trial_id % 2 = 0 THEN 'none' ELSE 'timer' END AS module, "
            "CASE WHEN trial_id % 12 = 5 THEN 'failed' ELSE 'complete' END AS status, start_observed_ns, end_observed_ns, records + CASE WHEN trial_id % 10 = 3 THEN 1 ELSE 0 END AS records, "
            "cast(1 + trial_id % 3 AS bigint) AS chunks, trial_id + CASE WHEN trial_id % 14 = 6 THEN 1 ELSE 0 END AS session_id, concat('u', cast(trial_id AS string), CASE WHEN trial_id % 16 = 2 THEN 'x' ELSE '' END) AS player_uuid FROM {trials}")
CHUNKS = "SELECT trial_id AS trial, cast(1 + trial_id % 3 + CASE WHEN trial_id % 15 = 7 THEN 1 ELSE 0 END AS bigint) AS found FROM {trials}"
AUDIT_SQL = f"""WITH {D.EV_SQL}, {D.TRIALS_SQL}, o AS (SELECT {AUDIT_OBS} FROM ev), m AS ({MANIFEST.replace('{trials}', 'trials')}), ch AS ({CHUNKS.replace('{trials}', 'trials')}),
 l AS (SELECT *, lag(ordinal) OVER w AS po, lag(kind) OVER w AS pk FROM o WINDOW w AS (PARTITION BY trial ORDER BY arrival)),
 t AS (SELECT trial, count(*) AS events, arg_min(kind, arrival) AS k1, arg_min(player, arrival) AS p1, count(*) FILTER (kind=1) AS starts, count(*) FILTER (isinf(x)) AS nonfinite,
   count(*) FILTER (pk<>1 AND ordinal<>po+1) AS gaps, count(*) FILTER (kind=3) AS resets FROM l GROUP BY trial),
 a AS (SELECT m.*, t.*, found, CASE WHEN k1<>1 THEN 'no_start_first' WHEN starts>1 THEN 'several_starts' WHEN trial<>session_id THEN 'other_session'
   WHEN p1<>player_uuid THEN 'other_player' WHEN events<>records THEN 'records_off' WHEN found<>chunks THEN 'chunks_off'
   WHEN gaps+nonfinite>0 THEN 'broken_order gaps='||gaps||' nonfinite='||nonfinite END AS error FROM m JOIN t ON trial=trial_id JOIN ch USING (trial))"""


def audited(spark, sf):
    trials = D.trials(spark, sf)
    return A.audit_trials(D.numbered(spark, sf).selectExpr(*_split(AUDIT_OBS)), spark.sql(MANIFEST, trials=trials), spark.sql(CHUNKS, trials=trials), ("x",))


def _split(text):
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


@query("audit_trials", AUDIT_SQL + " SELECT trial_id, error IS NULL AS ok, events, error, resets FROM a")
def q_audit(spark, sf):
    return audited(spark, sf).select("trial_id", "ok", "events", "error", "resets")


@query("audit_summary", AUDIT_SQL + """ SELECT declared_label||':'||module AS class, round(sum((end_observed_ns-start_observed_ns)/1e9),3) AS seconds, (SELECT count(*) FROM a) AS trials,
  (SELECT count(*) FROM a WHERE status='complete') AS complete, (SELECT count(*) FROM a WHERE status='complete' AND error IS NULL) AS usable,
  (SELECT sum(events) FROM a WHERE status='complete')::BIGINT AS events, (SELECT count(*) FROM a WHERE status<>'complete' OR error IS NOT NULL) AS problems
  FROM a WHERE status='complete' AND error IS NULL GROUP BY 1""")
def q_audit_summary(spark, sf):
    return A.audit_summary(audited(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query("quality_gate", AUDIT_SQL + " SELECT trial_id, error IS NULL AND resets=0 AS ok, resets FROM a")
def q_gate(spark, sf):
    return A.quality_gate(audited(spark, sf)).select("trial_id", "ok", "resets")


PROFILES = "SELECT 'legit' AS role, p_brand AS client, p_size % 2 AS multiplier, 180 AS seconds FROM {part} GROUP BY p_brand, p_size % 2"
REUSE = ("SELECT trial_id, declared_label AS role, concat('Brand#', cast(trial_id % 55 AS string)) AS client, cast(trial_id % 2 AS int) AS multiplier, CASE WHEN trial_id % 3 = 0 THEN 60 ELSE 180 END AS seconds, status, ok FROM {reg_trials}")


@query("completed_conditions", D.duck(f"SELECT role, client, multiplier, seconds, min(trial_id) AS trial_id FROM ({REUSE}) JOIN ({PROFILES}) USING (role, client, multiplier, seconds) WHERE status='complete' AND ok GROUP BY ALL"))
def q_completed(spark, sf):
    return A.completed_conditions(D.frame(spark, sf, REUSE), D.frame(spark, sf, PROFILES))


JOBS = """SELECT concat('job-', cast(c_custkey AS string)) AS id, cast(800000000000 AS bigint) + c_custkey * 100000000 AS created_ms, CASE WHEN c_custkey % 6 = 0 THEN 'cancelled' ELSE 'planned' END AS status, '' AS detail,
  CASE WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'scripted' END AS input_source, c_custkey FROM {customer}"""
RESERVED = """SELECT j.id, j.created_ms, j.status, j.detail, m.client, m.network, m.input_source, m.script_family, m.behavior, m.label, m.route, m.purpose, m.configuration FROM ({jobs}) j
  JOIN {reg_metadata} m ON m.trial_id = j.c_custkey"""
WINS = "SELECT l_orderkey AS trial_id, l_linenumber AS ordinal FROM {lineitem} WHERE l_quantity > 10"
RESERVED_TEXT = RESERVED.replace("{jobs}", JOBS)
ADMIT_SQL = D.duck(f"""WITH t AS ({{reg_trials}}), d AS ({{reg_metadata}}), j AS ({RESERVED_TEXT}), w AS (SELECT trial_id, count(*) AS n FROM ({WINS}) GROUP BY 1),
 ad AS (SELECT t.trial_id, t.scenario, t.status, substr(sha256(player_uuid),1,24) AS player_group, coalesce(n,0) AS n_windows, CASE WHEN t.status<>'complete' THEN 'not_finalized'
  WHEN d.network IS NULL THEN 'missing_metadata' WHEN d.input_source='robot' THEN 'invalid_input_source' WHEN d.label<>t.declared_label THEN 'relabelled'
  WHEN d.behavior<>t.module OR (d.client<>t.client AND NOT (t.client='vanilla-auto' AND d.client='vanilla')) THEN 'declaration_mismatch' WHEN d.configuration<>t.setting THEN 'configuration_mismatch'
  WHEN d.purpose='validation' AND NOT coalesce(j.created_ms<=t.start_epoch_ms AND j.client=d.client AND j.network=d.network AND j.input_source=d.input_source AND j.script_family=d.script_family
    AND j.behavior=d.behavior AND j.label=d.label AND j.route=d.route AND j.purpose=d.purpose AND j.configuration=d.configuration,false) THEN 'not_reserved'
  WHEN d.input_source='scripted' AND d.script_family='' THEN 'missing_script_family' WHEN NOT t.ok THEN 'audit_failed' WHEN t.protocol<>47 THEN 'unsupported_protocol'
  WHEN coalesce(n,0)=0 THEN 'no_windows' END AS reason
 FROM t LEFT JOIN d USING (trial_id) LEFT JOIN j ON j.id=t.scenario LEFT JOIN w USING (trial_id))""")


def admitted(spark, sf):
    return A.admit(D.reg(spark, sf, "reg_trials"), D.reg(spark, sf, "reg_metadata"), D.frame(spark, sf, RESERVED_TEXT), D.frame(spark, sf, WINS))


@query("admit", ADMIT_SQL + " SELECT trial_id, player_group, n_windows, reason FROM ad")
def q_admit(spark, sf):
    return admitted(spark, sf).select("trial_id", "player_group", "n_windows", "reason")


@query("sync_jobs", ADMIT_SQL + D.duck(f""", dn AS (SELECT scenario, max({{'g':reason IS NULL,'t':trial_id,'r':reason}}) AS r FROM ad WHERE status='complete' GROUP BY 1), jb AS ({JOBS})""".replace("{'g'", "{{'g'").replace("'r':reason}", "'r':reason}}")).replace("{{", "{").replace("}}", "}")
       + " SELECT jb.id, CASE WHEN status<>'planned' OR r IS NULL THEN status WHEN r.g THEN 'admitted' ELSE 'rejected' END AS status, CASE WHEN status<>'planned' OR r IS NULL THEN detail WHEN r.g THEN CAST(r.t AS VARCHAR) ELSE r.r END AS detail FROM jb LEFT JOIN dn ON dn.scenario=jb.id")
def q_sync(spark, sf):
    return A.sync_jobs(D.frame(spark, sf, JOBS), D.reg(spark, sf, "reg_trials"), admitted(spark, sf).select("trial_id", "reason"))


# --- identities, upserts ---------------------------------------------------------------------------------------------
OLD = "SELECT o_orderkey AS id, o_orderstatus AS source_hash, o_orderpriority AS metadata_json, o_custkey FROM {orders} WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 1 THEN 'X' ELSE o_orderstatus END AS source_hash, o_orderpriority AS metadata_json, o_custkey FROM {orders}"


@query("immutable_changes", D.duck(f"""SELECT n.id, CASE WHEN e.id IS NULL THEN 'append' WHEN n.source_hash=e.source_hash AND n.metadata_json=e.metadata_json THEN 'keep' ELSE 'conflict' END AS action
  FROM ({NEW}) n LEFT JOIN ({OLD}) e USING (id)"""))
def q_immutable(spark, sf):
    return A.immutable_changes(D.frame(spark, sf, OLD), D.frame(spark, sf, NEW))


@query("insert_ignore", D.duck(f"SELECT id, source_hash FROM ({OLD}) UNION ALL SELECT id, source_hash FROM ({NEW}) WHERE id NOT IN (SELECT id FROM ({OLD}))"))
def q_insert_ignore(spark, sf):
    return A.insert_ignore(D.frame(spark, sf, OLD), D.frame(spark, sf, NEW), ["id"]).select("id", "source_hash")


@query("upsert_latest", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)=1")
def q_upsert(spark, sf):
    return A.upsert_latest(D.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


REVIEWS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'ann' END AS reviewer, CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' WHEN o_orderkey % 9 = 0 THEN 'maybe' ELSE 'reviewed' END AS outcome,
  CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN concat('/m/', cast(o_orderkey AS string)) ELSE '/e/v' END AS evidence, 'h' AS evidence_sha256 FROM {orders} WHERE o_totalprice > 150000"""


@query("apply_reviews", D.duck(f"""WITH j AS (SELECT s.id, s.review, s.reviewer, r.reviewer AS rr, outcome, evidence, evidence_sha256, CASE WHEN r.id IS NULL THEN NULL WHEN trim(r.reviewer)='' OR outcome='maybe' THEN 'invalid_reviewer_or_outcome'
   WHEN outcome='reviewed' AND evidence='' THEN 'missing_evidence' WHEN outcome='reviewed' AND evidence=manifest_path THEN 'evidence_not_independent' END AS reason FROM {{samples}} s LEFT JOIN ({REVIEWS}) r USING (id))
  SELECT id, CASE WHEN outcome IS NOT NULL AND reason IS NULL THEN outcome ELSE review END AS review, CASE WHEN outcome IS NOT NULL AND reason IS NULL THEN rr ELSE reviewer END AS reviewer,
   CASE WHEN outcome='reviewed' AND reason IS NULL THEN evidence_sha256 END AS evidence_sha256, reason FROM j"""))
def q_reviews(spark, sf):
    return A.apply_reviews(D.reg(spark, sf, "samples"), D.frame(spark, sf, REVIEWS))


SHEET = """SELECT o_orderkey AS trial_id, CASE WHEN o_orderkey % 4 = 0 THEN 'no' ELSE 'yes' END AS approved, CASE WHEN o_orderkey % 5 = 0 THEN 'cheat' ELSE 'legit' END AS verified_label,
  CASE WHEN o_orderkey % 6 = 0 THEN 'unreviewed' WHEN o_orderkey % 5 = 0 THEN 'enabled_confirmed' ELSE 'legit_control' END AS verification, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'video' END AS evidence FROM {orders}"""
SHEET_SQL = D.duck(f"""SELECT trial_id, verified_label, verification, CASE WHEN verification='unreviewed' OR trim(evidence)='' THEN 'review_incomplete'
  WHEN verified_label='legit' AND (module<>'none' OR verification<>'legit_control') THEN 'legit_disputed'
  WHEN verified_label='cheat' AND (module='none' OR verification='legit_control') THEN 'cheat_disputed' END AS error
  FROM {{reg_trials}} JOIN ({SHEET}) USING (trial_id) WHERE status='complete' AND approved='yes'""")


@query("apply_review_sheet", SHEET_SQL)
def q_sheet(spark, sf):
    return A.apply_review_sheet(D.reg(spark, sf, "reg_trials"), D.frame(spark, sf, SHEET))


@query("review_template", D.duck("SELECT trial_id, 'no' AS approved, declared_label AS verified_label, 'unreviewed' AS verification, '' AS evidence, '' AS notes FROM {reg_trials}"))
def q_template(spark, sf):
    return A.review_template(D.reg(spark, sf, "reg_trials"))


EXPORT = "SELECT l_orderkey AS trial, l_linenumber, c_name AS player_group FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey"


@query("export_report", D.duck(f"WITH s AS ({SHEET_SQL}) SELECT (SELECT count(*) FROM ({EXPORT})) AS windows, (SELECT count(DISTINCT player_group) FROM ({EXPORT})) AS players, (SELECT count(*) FROM s WHERE error IS NOT NULL) AS skipped, (SELECT count(*) FROM s WHERE error IS NULL) AS exported"))
def q_export(spark, sf):
    return A.export_report(D.frame(spark, sf, EXPORT), q_sheet(spark, sf))


@query("cohorts", "SELECT p_brand AS generator, p_type AS observer, p_size AS bridge, count(*) AS trials FROM part GROUP BY ALL")
def q_cohorts(spark, sf):
    return A.cohorts(D.frame(spark, sf, "SELECT p_brand AS generator, p_type AS observer, p_size AS bridge FROM {part}"))


# --- console lines derived from conversations ------------------------------------------------------------------------
LINES = """SELECT conv_id, turn, CASE cast(conv_id % 6 AS int) WHEN 0 THEN concat('[12:0', cast(turn % 10 AS string), ':00] [Server thread/INFO]: UUID of player P', cast(conv_id AS string), ' is 00000000-0000-0000-0000-', substr(concat('000000000000', cast(conv_id AS string)), -12))
   WHEN 1 THEN concat('[12:00:01 INFO]: [guard] BAN | P', cast(conv_id AS string), ' | ', role, ' | evidence=', role, cast(turn AS string))
   WHEN 2 THEN concat('[12:00:02 WARN]: [guard] SUSPICIOUS | P', cast(conv_id AS string), ' | ', role, ' | a | b')
   WHEN 3 THEN concat('[12:00:03 INFO]: P', cast(conv_id AS string), '[/1.2.3.4:5] logged in with entity id 7 at x')
   WHEN 4 THEN concat('[12:00:04 INFO]: P', cast(conv_id AS string), ' lost connection: bye') ELSE concat(role, ' ', cast(turn AS string)) END AS line FROM {conversations}"""


@query("parse_server_log", D.duck(f"""SELECT conv_id, turn, line, CASE WHEN conv_id%6=5 THEN '--:--:--' ELSE substr(line,2,8) END AS at, conv_id%6=2 AS warning,
  CASE conv_id%6 WHEN 0 THEN 'identity' WHEN 1 THEN 'banned' WHEN 2 THEN 'detected' WHEN 3 THEN 'login' WHEN 4 THEN 'leave' END AS event, CASE WHEN conv_id%6<5 THEN 'P'||conv_id END AS player,
  CASE conv_id%6 WHEN 0 THEN substr(line,-36) WHEN 1 THEN string_split(line,'evidence=')[2] WHEN 2 THEN string_split(line,' | ')[3] END AS detail FROM ({LINES})"""))
def q_log(spark, sf):
    raw = D.frame(spark, sf, LINES).withColumn("line", F.concat(F.lit("\x1b[31m"), "line", F.lit("\x07")))
    return A.parse_server_log(raw)


@query("dedup_findings", "SELECT count(*) AS n, count(DISTINCT json) AS distinct_json FROM (SELECT DISTINCT props AS json FROM events)")
def q_dedup(spark, sf):
    return A.dedup_findings(D.table(spark, sf, "events").selectExpr("props AS json")).agg(F.count("json").alias("n"), F.countDistinct("json").alias("distinct_json"))


IT = "SELECT o_orderkey AS id, o_orderpriority AS client, o_orderstatus AS generator, CASE WHEN o_orderstatus = 'F' THEN 'hacking' ELSE 'legit' END AS condition, o_custkey AS seed FROM {orders}"
IE = "SELECT l_orderkey AS trial_id, l_suppkey AS model_id FROM {lineitem} WHERE l_linenumber = 1"
IM = "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS active FROM {supplier}"


@query("import_active_trials", D.duck(f"""SELECT t.id, client, 'local-loopback' AS network, 'scripted' AS input_source, generator AS script_family, CASE WHEN condition='hacking' THEN 'timer' ELSE 'none' END AS behavior,
  CASE WHEN condition='hacking' THEN 'cheat' ELSE 'legit' END AS label, CAST(seed AS VARCHAR) AS route, 'development' AS purpose FROM ({IT}) t JOIN ({IE}) e ON t.id=trial_id JOIN ({IM}) m ON m.id=model_id WHERE active=1"""))
def q_import(spark, sf):
    return A.import_active_trials(D.frame(spark, sf, IT), D.frame(spark, sf, IE), D.frame(spark, sf, IM))


@query("registry_status", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("orders", "lineitem", "customer", "supplier", "part", "events")))
def q_status(spark, sf):
    return A.registry_status({t: D.table(spark, sf, t) for t in ("orders", "lineitem", "customer", "supplier", "part", "events")})


@query("audit_rows", """SELECT epoch_ms(o_orderdate) AS created_ms, 'sample.admit' AS operation, CAST(o_orderkey AS VARCHAR) AS subject, '{"cust":'||o_custkey||',"status":"'||o_orderstatus||'"}' AS detail_json FROM orders""")
def q_audit_rows(spark, sf):
    o = D.table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "cust", "o_orderstatus": "status"})
    return A.audit_rows(o, "sample.admit", "o_orderkey", ["status", "cust"], F.unix_millis(F.col("o_orderdate").cast("timestamp")))


REQUESTS = """SELECT concat('study-', cast(c_custkey AS string)) AS token, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE concat('P_', cast(c_custkey AS string)) END AS player, cast(c_custkey AS bigint) AS created_ms,
  CASE WHEN c_custkey % 5 = 0 THEN 'maybe' ELSE 'legit' END AS label, 'none' AS behavior, CASE WHEN c_custkey % 6 = 0 THEN 'a b' ELSE 'vanilla' END AS client, 'all-off' AS configuration,
  CASE WHEN c_custkey % 9 = 0 THEN 'robot' WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'scripted' END AS input_source, 'development' AS purpose, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE c_mktsegment END AS network,
  CASE WHEN c_custkey % 4 = 1 THEN '' ELSE 'f' END AS script_family FROM {customer}"""


@query("plan_collection", D.duck(f"""WITH r AS ({REQUESTS}), p AS (SELECT *, CASE WHEN NOT regexp_full_match(player,'[A-Za-z0-9_]{{{{1,16}}}}') THEN 'invalid_player' WHEN client='a b' THEN 'not_simple_identifiers' WHEN label='maybe' THEN 'invalid_label'
  WHEN input_source='robot' THEN 'invalid_input_source' WHEN trim(network)='' THEN 'invalid_purpose_or_network' WHEN input_source='scripted' AND script_family='' THEN 'missing_script_family' END AS reason FROM r)
  SELECT token AS id, player, created_ms, reason, 'capture start '||player||' '||label||' none '||client||' all-off '||token AS command, CASE WHEN reason IS NULL THEN 'planned' ELSE 'refused' END AS status FROM p""").replace("{{1,16}}", "{1,16}"))
def q_plan(spark, sf):
    return A.plan_collection(D.frame(spark, sf, REQUESTS))


PHASES = """SELECT o_custkey AS pair, CASE WHEN o_custkey % 2 = 0 THEN 'off' ELSE 'on' END AS condition, l_linenumber AS position, cast(2 + l_linenumber * CASE WHEN l_discount > 0.08 THEN 1 ELSE 0.5 END AS double) AS center,
  CASE WHEN l_quantity < 3 THEN o_custkey * 100 ELSE o_orderkey * 10 + l_linenumber END AS trial, l_tax < 0.07 AS usable FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"""
PLANS = "SELECT c_custkey AS pair FROM {customer}"
PHASE_SQL = D.duck(f"""WITH ph AS ({PHASES}), u AS (SELECT trial, count(*) AS n FROM ph GROUP BY 1), r AS (SELECT pair, condition, list(center ORDER BY position, center) AS centers, bool_and(usable) AS usable, max(n) AS most, count(DISTINCT trial) AS dt, count(*) AS c
  FROM ph JOIN u USING (trial) GROUP BY ALL)""")


def plans(spark, sf):
    return D.frame(spark, sf, PLANS).withColumn("distances", F.expr("array(2.5D, 3D, 3.5D)"))


@query("build_catalog", PHASE_SQL + " SELECT pair, condition, centers=[2.5,3,3.5] AS matches, usable, most>1 AS repeated, centers=[2.5,3,3.5] AND usable AND most=1 AS selected FROM r JOIN customer ON c_custkey=pair")
def q_catalog(spark, sf):
    return A.build_catalog(plans(spark, sf), D.frame(spark, sf, PHASES))


@query("complete_capture", PHASE_SQL + " SELECT c_custkey AS pair, coalesce(c=3 AND centers=[2.5,3,3.5] AND dt=c AND usable,false) AS complete FROM customer LEFT JOIN r ON c_custkey=pair")
def q_complete(spark, sf):
    return A.complete_capture(D.frame(spark, sf, PHASES), plans(spark, sf))


FINDINGS = """SELECT o_orderkey AS event, CASE WHEN o_orderkey % 4 = 0 THEN 'trace' WHEN o_orderkey % 4 = 1 THEN 'notice' ELSE 'suspicious' END AS level,
  CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN 'timer.baseline.v1' WHEN 1 THEN 'reach.stationary.v1' WHEN 2 THEN 'fastbreak.request.v1' WHEN 3 THEN 'autoclicker.cadence.v1' ELSE 'fly.airborne.v1' END AS check,
  concat('cust ', cast(o_custkey AS string)) AS player, o_orderpriority AS message, cast(o_custkey % 1000 AS string) AS number FROM {orders}"""


@query("route_findings", D.duck(f"""SELECT event, CASE WHEN level='trace' THEN 'evidence' WHEN "check"='timer.baseline.v1' THEN 'info' ELSE 'alert' END AS route, CASE WHEN level='trace' THEN NULL
  WHEN "check"='timer.baseline.v1' THEN 'Timer | '||player||' | rate=? | tail=? | '||message ELSE (CASE level WHEN 'suspicious' THEN 'SUSPICIOUS | ' ELSE 'FINDING | ' END)||player||' | '||
   CASE "check" WHEN 'reach.stationary.v1' THEN 'Reach | '||number||'.00 blocks / ? allowed | samples='||number WHEN 'fastbreak.request.v1' THEN 'FastBreak | ? ms / ? ms expected | samples='||number
    WHEN 'autoclicker.cadence.v1' THEN 'Autoclicker | ? attacks/s | regular timing | windows='||number ELSE "check"||' | '||message END END AS line FROM ({FINDINGS.replace(" AS check,", ' AS "check",')})"""))
def q_route(spark, sf):
    f = D.frame(spark, sf, FINDINGS).withColumn("evidence", F.expr("map('minimum_distance', number, 'samples', number)"))
    return A.route_findings(f).select("event", "route", "line")


@query("capture_problems", f"""WITH {D.EV_SQL}, {D.TRIALS_SQL}, o AS (SELECT session, ns, CASE WHEN event_type='purchase' THEN 7 WHEN event_type='click' THEN 9 WHEN k=99 THEN 3 ELSE 4 END AS kind, 't'||(k//50) AS target FROM ev),
 e AS (SELECT trial_id, trial_id%3 AS center, start_observed_ns+{D.DAY} AS t0, end_observed_ns-{D.DAY} AS t1, o.* FROM trials JOIN o ON session=trial_id),
 m AS (SELECT trial_id, min(center) AS center, min(t0) AS t0, min(t1) AS t1, count(*) FILTER (kind=3) AS resets, count(*) FILTER (kind=9 AND ns>=t0 AND ns<t1) AS swings, count(*) FILTER (kind=7 AND ns>=t0 AND ns<t1) AS attacks,
  count(*) FILTER (kind=7 AND ns>=t0 AND ns<t1 AND target<>'t0') AS wrong FROM e GROUP BY 1)
 SELECT trial_id, swings, attacks, wrong AS wrong_target, resets, round((t1-t0)/1e9,3) AS seconds, array_to_string(list_filter([CASE WHEN t1<=t0 THEN 'capture_too_short' END, CASE WHEN resets>0 THEN 'observation_reset_or_loss' END,
  CASE WHEN swings<12 THEN 'too_few_arm_swings' END, CASE WHEN wrong>0 THEN 'wrong_target' END, CASE WHEN center=0 AND attacks<12 THEN 'near_target_control_failed' END], lambda x: x IS NOT NULL),',') AS problems FROM m""")
def q_problems(spark, sf):
    obs = D.numbered(spark, sf).selectExpr("session AS trial", "ns", "CASE WHEN event_type='purchase' THEN 7 WHEN event_type='click' THEN 9 WHEN k=99 THEN 3 ELSE 4 END AS kind", "concat('t', cast(floor(k / 50) AS string)) AS target")
    trials = D.trials(spark, sf).selectExpr("*", "'t0' AS target", "trial_id % 3 AS center")
    return A.capture_problems(obs, trials, 0, 12, 12).withColumn("problems", F.concat_ws(",", "problems")).withColumn("seconds", F.round("seconds", 3))


SELECT_SQL = R("reg_trials", "samples", "sample_windows").replace(f"samples AS ({D.duck(D.REGISTRY['samples'])})", f"samples AS ({D.duck(D.REGISTRY['samples'])})") + """,
 c AS (SELECT sample_id, count(*) AS n, min(attacks) AS least, min(segment) AS s0, max(segment) AS s1 FROM sample_windows GROUP BY 1),
 sel AS (SELECT s.*, coalesce(n,0) AS windows, CASE WHEN label='legit' THEN 0 WHEN behavior='timer' THEN 1 END AS y, CASE WHEN CASE WHEN label='legit' THEN 0 WHEN behavior='timer' THEN 1 END IS NULL THEN 'unrelated_behavior'
   WHEN review<>'reviewed' THEN 'needs_review' WHEN label='legit' AND input_source<>'human' THEN 'negative_input_not_human' WHEN n IS NULL OR least<3 THEN 'insufficient_attacks_or_windows' WHEN s0<>s1 THEN 'observation_discontinuity'
   WHEN n<3 THEN 'too_few_consecutive_windows' END AS excluded FROM samples s LEFT JOIN c ON sample_id=id WHERE review<>'rejected')"""


def selected(spark, sf, scope="independent"):
    return A.select_samples(D.reg(spark, sf, "samples"), D.reg(spark, sf, "sample_windows"), D.SPEC, scope)


@query("select_samples", SELECT_SQL + " SELECT id, y, windows, excluded FROM sel")
def q_select(spark, sf):
    return selected(spark, sf).select("id", "y", "windows", "excluded")


@query("excluded_counts", SELECT_SQL + " SELECT excluded, count(*) AS samples FROM sel WHERE excluded IS NOT NULL GROUP BY 1")
def q_excluded(spark, sf):
    return A.excluded_counts(selected(spark, sf))

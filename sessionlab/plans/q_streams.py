"""Live operators over the driver tables: file streams run to their end, and batch twins."""

import uuid

from pyspark.sql import functions as F

from ..operators.scan import carry_here, cut, prev_row, scratch, slabs, step
from ..operators.relations import last_known
from ..operators import admission as A
from ..sources import captures as C, findings as L
from ..operators.detectors import DetectorConfig
from ..streaming import detect, live, stream
from . import driver as D
from .q_detectors import CLICK, CLICK_SQL, DAY_MS
from .q_windows import WINDOW_COLUMNS, r6, windows
from .registry import query


def run(df, mode="append"):
    """Run a stream to its end into a written table and read it back."""
    base = f"{scratch(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(base + "/out")


def live_obs(spark, sf):
    """The observation view as a file stream; it is written once, because ordinals need the whole table."""
    written = f"{scratch(spark)}/obs-{uuid.uuid4().hex}"
    obs = D.obs_events(spark, sf).withColumn("ts", F.timestamp_millis("epoch_ms"))
    obs.write.parquet(written)
    return spark.readStream.schema(obs.schema).parquet(written)


@query("stream_behavior_windows", f"WITH {D.WINDOW_SQL} SELECT {WINDOW_COLUMNS} FROM windows")
def q_stream_windows(spark, sf):
    out = run(stream.stream_behavior_windows(live_obs(spark, sf), D.SPAN, D.GUARD, D.GAP, D.QUEUE))
    return out.selectExpr(*[c.strip() for c in WINDOW_COLUMNS.replace("\n", " ").split(", ")])


MODEL = {"run": "r1", "detection": "timer.cadence", "mode": "enforce", "features": ["movement_pps", "attacks"], "coefficients": [1e6, 1.0], "intercept": -10.0, "threshold": 5.0,
         "minimum": [0.0, 0.0], "maximum": [4e-5, 8.0], "references": [2.0, 6.0, 9.0, 30.0], "minimum_attacks": 1, "tail_cutoff": 1.0, "consecutive_windows": 2}
PAUSE = 8 * D.DAY // 1_000_000
LIVE_SQL = D.WINDOW_SQL + f""",
 lw AS (SELECT w.*, o.ordinal AS event, o.epoch_ms FROM windows w JOIN (SELECT s.session, s.segment, (s.ns-s.start_ns-{D.GUARD})//{D.SPAN} AS nk, min(s.ordinal) AS ordinal FROM segs s WHERE kind=11 AND ns>=start_ns+{D.GUARD} GROUP BY ALL) f
    ON f.session=w.session AND f.segment=w.segment AND f.nk=w.k+1 JOIN obs o ON o.session=w.session AND o.ordinal=f.ordinal),
 sw AS (SELECT *, 1000000*movement_pps+attacks-10 AS margin, movement_pps>4e-5 OR attacks>8 AS outside, attacks<1 AS low FROM lw),
 l1 AS (SELECT *, max(CASE WHEN low THEN event END) OVER (PARTITION BY session ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_at FROM sw),
 l2 AS (SELECT *, lag({{'e':event,'t':epoch_ms,'s':segment,'x':outside}}) OVER (PARTITION BY session ORDER BY event) AS p FROM l1 WHERE NOT low),
 l3 AS (SELECT *, CASE WHEN p.s=segment AND epoch_ms>p.t AND epoch_ms-p.t<={PAUSE} AND NOT p.x AND p.e>coalesce(low_at,-1) THEN 0 ELSE 1 END AS fresh FROM l2),
 l4 AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY event) AS isl FROM l3),
 l5 AS (SELECT *, min(margin) OVER w AS sustained, count(*) OVER w=2 AS ready FROM l4 WINDOW w AS (PARTITION BY session,isl ORDER BY event ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
 l6 AS (SELECT *, sum(ready::INT) OVER (PARTITION BY session ORDER BY event)::BIGINT AS looks, (1.0::DOUBLE+(2>=sustained)::INT+(6>=sustained)::INT+(9>=sustained)::INT+(30>=sustained)::INT)/5 AS tail_p, ready AND sustained>5 AND NOT outside AS candidate FROM l5),
 dc AS (SELECT session, event, round(sustained,6) AS sustained, looks, round(tail_p,6) AS tail_p, candidate, outside, CASE WHEN outside THEN 'outside_training_support' WHEN candidate AND looks>0 AND tail_p<=1.0/(looks*(looks+1)) THEN 'pending'
   WHEN candidate THEN 'below_response_cutoff' ELSE 'observed' END AS action FROM l6)"""
SHOWN = ["session", "event", "sustained", "looks", "tail_p", "candidate", "outside", "action"]


@query("score_windows", f"WITH {LIVE_SQL} SELECT * FROM dc")
def q_score_windows(spark, sf):
    closed = cut(run(stream.stream_behavior_windows(live_obs(spark, sf), D.SPAN, D.GUARD, D.GAP, D.QUEUE)))
    return r6(live.score_windows(closed, MODEL, PAUSE, 20 * 86_400_000).select(*SHOWN))


@query("stream_score", f"WITH {LIVE_SQL} SELECT * FROM dc")
def q_stream_score(spark, sf):
    return r6(run(stream.stream_score(live_obs(spark, sf), [MODEL], D.SPAN, D.GUARD, D.GAP, D.QUEUE, PAUSE)).select(*SHOWN))


@query("write_decisions", f"WITH {LIVE_SQL} SELECT 'r1:'||session||':'||event||':timer.cadence' AS id, action FROM dc")
def q_write(spark, sf):
    base = f"{scratch(spark)}/decisions-{uuid.uuid4().hex}"
    decisions = stream.stream_score(live_obs(spark, sf), [MODEL], D.SPAN, D.GUARD, D.GAP, D.QUEUE, PAUSE)
    stream.write_decisions(decisions, base + "/log", base + "/state").awaitTermination()
    # the same rows arriving again change nothing
    stream.append_new(spark, spark.read.parquet(base + "/log"), base + "/log", ["id"], "epoch_ms")
    return spark.read.parquet(base + "/log").select("id", "action")


@query("decide_action", "SELECT event_id, CASE WHEN value>400 THEN 'outside_training_support' WHEN event_type='error' THEN 'pending' WHEN event_type='view' AND event_id%2=0 THEN 'shadow_candidate' WHEN event_type='view' THEN 'below_response_cutoff' ELSE 'observed' END AS action FROM events")
def q_action(spark, sf):
    return D.table(spark, sf, "events").select("event_id", live.decide_action(F.col("value") > 400, F.col("event_type") == "error", F.col("event_type") == "view", F.col("event_id") % 2 == 0).alias("action"))


def event_stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("player"), F.col("user_id").alias("session"), "event_id",
                    F.when(F.col("event_type") == "error", "suspicious").otherwise("trace").alias("level"), F.col("props").alias("json"))


@query("stream_player_counts", """WITH m AS (SELECT max(ts) AS m FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, 'u'||user_id AS player, count(*) AS records, count(*) FILTER (event_type='error') AS alerts FROM events, m
  GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, min(ts))+INTERVAL 1 DAY<=max(m)-INTERVAL 10 MINUTE""")
def q_player_counts(spark, sf):
    return run(stream.stream_player_counts(event_stream(spark, sf), "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_activity_sessions", """WITH e AS (SELECT user_id AS session, ts, CASE WHEN ts-lag(ts) OVER w<INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  i AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY ts) AS i FROM e) SELECT session, min(ts) AS start, count(*) AS events FROM i GROUP BY session, i HAVING max(ts)+INTERVAL 12 HOUR<=(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE""")
def q_activity(spark, sf):
    return run(stream.stream_activity_sessions(event_stream(spark, sf), "12 hours")).select("session", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("stream_dedup_findings", "SELECT count(*) AS n FROM (SELECT DISTINCT props FROM events)")
def q_stream_dedup(spark, sf):
    return run(A.dedup_findings(event_stream(spark, sf).withWatermark("ts", "60 days"))).agg(F.count("json").alias("n"))


@query("stream_match_acks", f"""WITH {D.view_sql('impulses')} SELECT i.session, i.token, i.ordinal AS impulse, a.ordinal AS ack FROM impulses i JOIN impulses a ON i.session=a.session AND i.token=a.token AND i.kind=12 AND a.kind=13
  AND a.epoch_ms BETWEEN i.epoch_ms AND i.epoch_ms+{2 * 86_400_000}""")
def q_stream_acks(spark, sf):
    written = f"{scratch(spark)}/imp-{uuid.uuid4().hex}"
    df = D.view(spark, sf, "impulses").filter("kind IN (12, 13)").withColumn("ts", F.timestamp_millis("epoch_ms"))
    df.write.parquet(written)
    s = lambda k: spark.readStream.schema(df.schema).parquet(written).filter(F.col("kind") == k)
    return run(stream.stream_match_acks(s(12), s(13), "2 days", "1 hour")).select("session", "token", "impulse", "ack")


# Windows of clicks, then the anchored streak over them, sample by sample.
LIVE_CLICK_SQL = f"""WITH RECURSIVE {CLICK_SQL},
sm AS (SELECT session, ordinal, ns, duration>={DAY_MS} AND cps>=0.000001 AND NOT quantized AND cv<=0.6 AND mad<=9e7 AS sus, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS rn FROM h),
walk AS (SELECT session, rn, ordinal, ns, CASE WHEN sus THEN ns END AS f_ns, CASE WHEN sus THEN ordinal END AS f_o, false AS hit, CAST(NULL AS BIGINT) AS first_sample FROM sm WHERE rn=1
 UNION ALL SELECT s.session, s.rn, s.ordinal, s.ns,
   CASE WHEN s.sus AND (w.f_ns IS NULL OR s.ns-w.f_ns>{20 * D.DAY}) THEN s.ns END, CASE WHEN s.sus AND (w.f_ns IS NULL OR s.ns-w.f_ns>{20 * D.DAY}) THEN s.ordinal END,
   s.sus AND coalesce(s.ns-w.f_ns<={20 * D.DAY},false), CASE WHEN s.sus AND s.ns-w.f_ns<={20 * D.DAY} THEN w.f_o END
  FROM walk w JOIN sm s ON s.session=w.session AND s.rn=w.rn+1)
SELECT session, ordinal, ns, 'autoclicker.cadence.v1' AS "check", first_sample FROM walk WHERE hit"""


@query("stream_detect", LIVE_CLICK_SQL)
def q_stream_detect(spark, sf):
    """The events come in two triggers, dealt by a hash: every session is out of order, and half of it is late by days."""
    base = f"{scratch(spark)}/detect-{uuid.uuid4().hex}"
    D.view(spark, sf, "combat").repartition(2, "event_id").write.parquet(base + "/in")
    obs = spark.readStream.schema(spark.read.parquet(base + "/in").schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    detect.stream_detect(obs, base, DetectorConfig(enabled=("autoclicker",), autoclicker=CLICK), "400 days", 400 * DAY_MS)
    return spark.read.parquet(base + "/findings").selectExpr("session", "ordinal", "ns", "check", "CAST(evidence.first_sample AS BIGINT) AS first_sample")


# --- order helpers ---------------------------------------------------------------------------------------------------

def ev_slabs(spark, sf):
    return slabs(D.numbered(spark, sf), F.floor(F.col("ordinal") / 16).cast("long"))


@query("prev_rows", f"WITH {D.EV_SQL}, l AS (SELECT *, value-lag(value) OVER (PARTITION BY session ORDER BY ordinal) AS d FROM ev) SELECT session, ordinal, round(d,6) AS d, round(d-lag(d) OVER (PARTITION BY session ORDER BY ordinal),6) AS dd FROM l")
def q_prev(spark, sf):
    one = step(ev_slabs(spark, sf), ["session"], ["ordinal"], p=prev_row(F.col("value"))).withColumn("d", F.col("value") - F.col("p"))
    two = step(one, ["session"], ["ordinal"], q=prev_row(F.col("d")))
    return two.selectExpr("session", "ordinal", "round(d, 6) AS d", "round(d - q, 6) AS dd")


@query("look_index", f"WITH {D.EV_SQL} SELECT session, ordinal, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS k FROM ev WHERE event_type='view'")
def q_look_index(spark, sf):
    from ..operators.scan import number_rows
    looks = D.numbered(spark, sf).filter("event_type = 'view'").select("session", "ordinal")
    return number_rows(looks, ["session"], ["ordinal"], F.floor(F.col("ordinal") / 16).cast("long"), "k")


@query("rolling", f"WITH {D.EV_SQL} SELECT session, ordinal, min(value) OVER (PARTITION BY session ORDER BY ns RANGE BETWEEN {D.DAY} PRECEDING AND CURRENT ROW) AS low, max(value) OVER (PARTITION BY session ORDER BY ns RANGE BETWEEN {D.DAY} PRECEDING AND CURRENT ROW) AS high FROM ev")
def q_rolling(spark, sf):
    from ..operators.scan import halo, sql
    need = halo(D.numbered(spark, sf).select("session", "ordinal", "ns", "value"), ["session"], "ns", 5 * D.DAY, back=D.DAY)
    return sql(f"""SELECT session, ordinal, low, high FROM (SELECT *, min(value) OVER w AS low, max(value) OVER w AS high FROM {{n}}
      WINDOW w AS (PARTITION BY session, _slab ORDER BY ns RANGE BETWEEN {D.DAY} PRECEDING AND CURRENT ROW)) WHERE _own""", n=need)


@query("carry_last", f"WITH {D.EV_SQL} SELECT session, ordinal, last_value(CASE WHEN k%4=0 THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal) AS held FROM ev")
def q_carry(spark, sf):
    return step(ev_slabs(spark, sf), ["session"], ["ordinal"], held=carry_here(F.expr("CASE WHEN k % 4 = 0 THEN value END"))).select("session", "ordinal", "held")


# --- sources: records encoded from the event table, decoded by the reader ---------------------------------------------

def encoded(spark, sf):
    """Ticks and impulse acknowledgements of every user as length-prefixed binary records, one chunk per user and day."""
    le = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * i, 2) for i in range(n)]))
    e = D.raw_events(spark, sf).withColumn("kind", F.when(F.col("event_type") == "view", 13).otherwise(4).cast("bigint"))
    magic = F.unhex(F.lit("46584143"))
    body = F.when(F.col("kind") == 13, le(F.col("k"), 8)).otherwise(F.unhex(F.lit("")))
    header = F.concat(magic, F.unhex(F.lit("0300")), le(F.col("kind"), 2), le(F.col("session"), 8), le(F.col("event_id"), 8), le(F.col("ns"), 8), le(F.col("epoch_ms"), 8), le(F.col("k"), 8))
    rec = e.select("session", F.floor(F.col("ns") / D.DAY).alias("day"), "event_id", F.concat(header, body).alias("r"))
    rec = rec.withColumn("r", F.concat(le(F.length("r").cast("bigint"), 4), "r"))
    chunk = rec.groupBy("session", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.hex("r").alias("h")))), lambda s: s["h"]), "").alias("h"))
    return chunk.select(F.col("session").cast("string").alias("trial"), F.concat_ws("/", "session", "day").alias("path"), F.unhex("h").alias("content"))


@query("decode_captures", "SELECT CAST(user_id AS VARCHAR) AS trial, event_id AS ordinal, CASE WHEN event_type='view' THEN 13 ELSE 4 END AS kind, epoch_us(ts)*1000 AS ns, CASE WHEN event_type='view' THEN CAST(json_extract(props,'$.k') AS BIGINT) END AS token FROM events")
def q_decode(spark, sf):
    return C.decode_chunks(encoded(spark, sf), zipped=False).filter("error IS NULL").select("trial", "ordinal", "kind", "ns", "token")


@query("hash_content", "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id%10=0 THEN 'changed' WHEN doc_id%7=0 THEN 'unexpected' END AS problem FROM documents WHERE doc_id%10=0 OR doc_id%7=0")
def q_hash(spark, sf):
    files = D.table(spark, sf, "documents").selectExpr("cast(doc_id AS string) AS path", "sha2(text, 256) AS sha256", "doc_id")
    catalog = files.filter("doc_id % 10 = 0 OR doc_id % 7 <> 0").selectExpr("path", "CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256 END AS sha256")
    return C.verify_hashes(files, catalog).join(files, "path").select("doc_id", "sha256", "problem")


@query("parse_findings", """SELECT event_id AS event, CASE WHEN event_id%10=0 THEN 'not_object' WHEN event_id%10=1 THEN 'missing_field' END AS error, CASE WHEN event_id%10>1 THEN event_type END AS message FROM events""")
def q_parse(spark, sf):
    e = D.table(spark, sf, "events")
    full = F.to_json(F.struct(F.lit("trace").alias("level"), F.lit("reach").alias("check"), F.col("user_id").cast("string").alias("player"), F.lit("s").alias("session"),
                              F.col("event_id").cast("string").alias("event"), F.when(F.col("event_id") % 10 != 1, F.col("event_type")).alias("message")))
    lines = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("oops "), "event_type")).otherwise(full).alias("value"))
    out = L.parse_findings(lines, keep=("event_id",)).filter("json IS NOT NULL")
    return out.select(F.col("event_id").alias("event"), F.regexp_replace("error", "an_", "").alias("error"),
                      F.when(F.col("error").isNull(), F.col("message")).alias("message")).distinct()

"""Detectors over the driver tables, with day-long windows."""

from pyspark.sql import functions as F

from ..operators import checks, detectors as X
from ..operators.budget import timer_budget
from ..operators.scan import cut
from ..operators.streaks import anchored_streak
from . import driver as D
from .q_windows import r6
from .registry import query

DAY_MS = 86_400_000
FAST = X.FastBreak(maximum_expected_ms=2e8, sample_window_ms=10.0 * DAY_MS, slab_ms=10 * DAY_MS, alert_after=2)
REACH = X.Reach(history_ms=2 * DAY_MS, maximum_frame_gap_ms=3.0 * DAY_MS, slab_ms=10 * DAY_MS, alert_after=2, sample_window_ms=8.0 * DAY_MS,
                maximum_ping_ms=90)
CLICK = X.AutoClicker(window_intervals=4, minimum_cps=0.000001, maximum_cv=0.6, maximum_mad_ms=9e7, minimum_window_ms=1.0 * DAY_MS,
                      maximum_gap_ms=5.0 * DAY_MS, slab_ms=10 * DAY_MS, alert_after=2, sample_window_ms=20.0 * DAY_MS)
MOVE = X.Movement(maximum_step_ms=2.0 * DAY_MS, grace_ms=DAY_MS, slab_ms=10 * DAY_MS, alert_after=2)
HIT = X.HitBoxes(history_ms=2 * DAY_MS, slack_ms=DAY_MS, frame_gap_ms=2 * DAY_MS, wait_ms=DAY_MS // 4, expire_ms=3 * DAY_MS, maximum_ping_ms=90, slab_ms=10 * DAY_MS, alert_after=2)
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

FAST_SQL = D.view_sql("digs") + f""",
a AS (SELECT *, sampled_ns-ns BETWEEN 0 AND 200000000 AS timely, available AND damage>0 AND damage<1 AS usable,
    ceil(1/damage)*50 AS expected FROM digs),
b AS (SELECT *, coalesce(kind=5 AND action=0 AND timely AND usable AND expected BETWEEN 250 AND 200000000,false) AS begins FROM a),
c AS (SELECT *, last_value(CASE WHEN begins THEN {{'o':ordinal,'ns':ns,'sn':sampled_ns,'p':packet,'b':batch,'bx':bx,'w':world,'st':state_key,'d':damage,'e':expected,'u':usable}} END IGNORE NULLS) OVER w AS s,
    max(CASE WHEN kind IN (5,10) THEN ordinal END) OVER w AS ended_at, max(CASE WHEN kind=4 THEN ordinal END) OVER w AS tick_o,
    max(CASE WHEN kind=4 THEN ns END) OVER w AS tick_ns
  FROM b WINDOW w AS (PARTITION BY session ORDER BY ordinal {EARLIER})),
d AS (SELECT *, bx<>s.bx AS moved, NOT coalesce(usable AND s.w=world AND s.st=state_key AND s.d=damage,false) AS differs FROM c),
e AS (SELECT *, max(CASE WHEN kind=6 AND (moved OR differs) THEN ordinal END) OVER (PARTITION BY session ORDER BY ordinal {EARLIER}) AS changed_at FROM d),
f AS (SELECT *, (ns-s.ns)/1e6 AS obs, (sampled_ns-s.sn)/1e6 AS samp, greatest(0,s.e*0.65-100) AS thr FROM e WHERE kind=5 AND action=2),
fb AS (SELECT session, ordinal, ns, s, obs, thr, CASE WHEN NOT timely THEN 'delayed_observation'
    WHEN s IS NULL OR ns-s.ns>200000000000000 OR ended_at>s.o OR coalesce(changed_at>s.o,false) OR coalesce(tick_o>s.o AND tick_ns-s.ns>200000000000000,false) THEN 'finish_without_start'
    WHEN moved OR packet<=s.p THEN 'mismatched_finish' WHEN differs THEN 'changed_context' WHEN batch<=s.b THEN 'same_or_invalid_read_batch'
    WHEN samp<0 OR obs>200000000 OR abs(obs-samp)>200 THEN 'uncertain_timing' WHEN obs<thr THEN 'early' ELSE 'normal' END AS verdict FROM f)
"""


@query("fastbreak_verdicts", f"""WITH {FAST_SQL} SELECT session, ordinal, ns, verdict,
  CASE WHEN verdict IN ('early','normal') THEN s.o END AS start_ordinal, round(CASE WHEN verdict IN ('early','normal') THEN obs END,6) AS observed_ms,
  CASE WHEN verdict IN ('early','normal') THEN s.e END AS expected_ms, round(CASE WHEN verdict IN ('early','normal') THEN thr END,6) AS threshold_ms FROM fb""")
def q_fastbreak(spark, sf):
    return r6(X.fastbreak_verdicts(D.view(spark, sf, "digs"), FAST))


@query("sliding_streak", f"""WITH {FAST_SQL},
op AS (SELECT *, s IS NOT NULL AND coalesce(ended_at<=s.o,true) AND NOT coalesce(changed_at>s.o,false) AND NOT coalesce(tick_o>s.o AND tick_ns-s.ns>200000000000000,false) AS pending FROM e),
s1 AS (SELECT session, ordinal, ns, verdict='early' AS sus FROM fb WHERE verdict<>'finish_without_start'
  UNION ALL SELECT session, ordinal, ns, false FROM op WHERE kind=5 AND action=1 OR kind=5 AND action=0 AND (NOT timely OR NOT begins OR pending)
    OR kind=6 AND pending AND (moved OR differs) OR kind=4 AND pending AND (ns<s.ns OR ns-s.ns>200000000000000)),
s2 AS (SELECT *, CASE WHEN NOT sus OR lag(sus) OVER w IS NOT TRUE OR ns-lag(ns) OVER w > {10 * D.DAY} THEN 1 ELSE 0 END AS cut FROM s1 WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
s3 AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY ordinal) AS isl FROM s2)
SELECT session, ordinal, ns, row_number() OVER (PARTITION BY session,isl ORDER BY ordinal) AS streak,
  row_number() OVER (PARTITION BY session,isl ORDER BY ordinal)%2=0 AS alert FROM s3 WHERE sus""")
def q_sliding(spark, sf):
    return X.fastbreak_alerts(X.fastbreak_verdicts(D.view(spark, sf, "digs"), FAST, resets=True), FAST)


def _env(names, rows):
    return ", ".join(f"min({n}) OVER {rows} AS {n}_lo, max({n}) OVER {rows} AS {n}_hi" for n in names)


BOX = "eye_x eye_y eye_z low_x low_y low_z high_x high_y high_z".split()
HIST, FGAP = 2 * D.DAY, 3 * D.DAY
# The oracle collects the frames of each attack by a range join instead of window frames.
REACH_SQL = D.view_sql("combat") + f""",
a AS (SELECT *, available AND ping<=90 AS usable, kind=7 AND coalesce(packet<=max(CASE WHEN kind=7 THEN packet END) OVER
    (PARTITION BY session ORDER BY ordinal {EARLIER}),false) AS stale, sampled_ns-ns<=100000000 AS timely FROM combat WHERE kind IN (7,8,10)),
b AS (SELECT *, coalesce(max(CASE WHEN kind=10 OR (kind=7 AND NOT stale AND NOT timely) THEN ordinal END) OVER (PARTITION BY session ORDER BY ordinal {EARLIER}),-1) AS wiped FROM a),
c AS (SELECT *, usable AS frame, lag({{'n':sampled_ns,'u':usable,'o':ordinal}}) OVER (PARTITION BY session,target ORDER BY ordinal) AS p
  FROM b WHERE kind=8 OR (kind=7 AND NOT stale AND timely)),
d AS (SELECT *, sum(CASE WHEN coalesce(frame AND p.u AND p.o>wiped AND sampled_ns-p.n BETWEEN 0 AND {FGAP},false) THEN 0 ELSE 1 END)
    OVER (PARTITION BY session,target ORDER BY ordinal) AS isl FROM c),
fr AS (SELECT *, lead(sampled_ns) OVER (PARTITION BY session,target,isl ORDER BY ordinal) AS nxt FROM d WHERE frame),
j AS (SELECT x.session, x.ordinal, count(*) AS n, min(f.sampled_ns) AS first_ns, {", ".join(f"min(f.{n}) AS {n}_lo, max(f.{n}) AS {n}_hi" for n in BOX)}
  FROM fr x JOIN fr f ON x.session=f.session AND x.target=f.target AND x.isl=f.isl AND f.ordinal<=x.ordinal
    AND (f.ordinal=x.ordinal OR f.nxt>x.sampled_ns-{HIST}) WHERE x.kind=7 GROUP BY ALL),
v AS (SELECT b.session, b.ordinal, b.ns, b.target, b.batch, CASE WHEN stale THEN 'duplicate_or_out_of_order_packet' WHEN NOT timely THEN 'delayed_snapshot'
    WHEN NOT usable THEN CASE WHEN available THEN 'unsupported_snapshot_or_latency' ELSE reason END
    WHEN n<4 OR n>64 OR sampled_ns-first_ns<{HIST} THEN 'history_warming'
    WHEN sqrt(pow(eye_x_hi-eye_x_lo,2)+pow(eye_y_hi-eye_y_lo,2)+pow(eye_z_hi-eye_z_lo,2))>0.03 OR sqrt(pow(low_x_hi-low_x_lo,2)+pow(low_y_hi-low_y_lo,2)+pow(low_z_hi-low_z_lo,2))>0.03 THEN 'moving_player_or_target' END AS skip,
    sqrt(pow(greatest(0,low_x_lo-0.13125-eye_x_hi,eye_x_lo-(high_x_hi+0.13125)),2)+pow(greatest(0,low_y_lo-0.13125-eye_y_hi,eye_y_lo-(high_y_hi+0.13125)),2)
      +pow(greatest(0,low_z_lo-0.13125-eye_z_hi,eye_z_lo-(high_z_hi+0.13125)),2)) AS distance
  FROM b LEFT JOIN j USING (session, ordinal) WHERE b.kind=7),
ve AS (SELECT v.*, (SELECT count(*) FROM combat t WHERE t.session=v.session AND t.kind=10 AND t.ordinal<v.ordinal) AS hops FROM v),
rv AS (SELECT *, skip IS NULL AND coalesce(batch<=max(CASE WHEN skip IS NULL THEN batch END) OVER (PARTITION BY session,hops ORDER BY ordinal {EARLIER}),false) AS late FROM ve)
"""


@query("reach_verdicts", f"""WITH {REACH_SQL} SELECT session, ordinal, ns, target, CASE WHEN late THEN 'same_or_invalid_read_batch' ELSE skip END AS skip,
  round(CASE WHEN skip IS NULL AND NOT late THEN distance END,6) AS distance, CASE WHEN skip IS NULL AND NOT late THEN distance>3.05 END AS suspicious FROM rv""")
def q_reach(spark, sf):
    return r6(X.reach_verdicts(D.view(spark, sf, "combat"), REACH))


CLICK_SQL = D.view_sql("combat") + f""",
a AS (SELECT *, coalesce(kind=7 AND available AND sampled_ns-ns<=100000000,false) AS usable FROM combat WHERE kind IN (4,7,10)),
b AS (SELECT *, last_value(CASE WHEN usable THEN {{'ns':ns,'o':ordinal,'p':packet,'b':batch,'s':sampled_ns}} END IGNORE NULLS) OVER w AS p,
    max(CASE WHEN NOT usable AND kind<>4 THEN ordinal END) OVER w AS broken FROM a WINDOW w AS (PARTITION BY session ORDER BY ordinal {EARLIER})),
c AS (SELECT *, (ns-p.ns)/1e6 AS dt, coalesce(p.o>coalesce(broken,-1) AND packet>p.p AND batch>p.b AND (ns-p.ns)/1e6 BETWEEN 1 AND {5 * DAY_MS}
    AND sampled_ns>=p.s AND abs((ns-p.ns)/1e6-(sampled_ns-p.s)/1e6)<=100,false) AS joined FROM b WHERE usable),
d AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ordinal) AS run FROM c),
e AS (SELECT *, (row_number() OVER (PARTITION BY session,run ORDER BY ordinal)-1)//4 AS part FROM d WHERE joined),
g AS (SELECT session, run, part, max(ordinal) AS ordinal, max(ns) AS ns, min(p.o) AS first_ordinal, sum(dt) AS duration, avg(dt) AS mean, stddev_pop(dt) AS sd,
    median(dt) AS center, list(dt) AS dts, avg(CASE WHEN abs(dt-round(dt/50)*50)<=2 THEN 1 ELSE 0 END)>=0.9 AS quantized FROM e GROUP BY ALL HAVING count(*)=4),
h AS (SELECT *, sd/mean AS cv, 1000/mean AS cps, (SELECT median(abs(u-center)) FROM (SELECT unnest(dts) AS u)) AS mad FROM g)
"""


@query("autoclicker_windows", f"""WITH {CLICK_SQL} SELECT session, ordinal, ns, first_ordinal, round(duration,3) AS duration, round(cps,9) AS cps, round(cv,6) AS cv,
  round(mad,3) AS mad, quantized, duration>={DAY_MS} AND cps>=0.000001 AND NOT quantized AND cv<=0.6 AND mad<=9e7 AS suspicious FROM h""")
def q_click(spark, sf):
    return X.autoclicker_windows(D.view(spark, sf, "combat"), CLICK).selectExpr(
        "session", "ordinal", "ns", "first_ordinal", "round(duration,3) AS duration", "round(cps,9) AS cps", "round(cv,6) AS cv",
        "round(mad,3) AS mad", "quantized", "suspicious")


MOVE_SQL = D.view_sql("motion") + f""",
a AS (SELECT *, coalesce(kind=11 AND available AND sampled_ns-ns<=100000000 AND has_pos,false) AS fits,
    kind=7 AND available AND sprint AND ping<=75 AND sampled_ns-ns<=100000000 AS hits,
    max(CASE WHEN kind IN (12,14) THEN ns END) OVER w AS dist, coalesce(max(CASE WHEN kind IN (12,14) THEN ordinal END) OVER w,-1) AS wiped
  FROM motion WHERE kind<>4 WINDOW w AS (PARTITION BY session ORDER BY ordinal {EARLIER})),
b AS (SELECT *, fits AND coalesce(ns-dist>={D.DAY},true) AS calm FROM a),
c AS (SELECT *, max(CASE WHEN calm THEN packet END) OVER (PARTITION BY session,wiped ORDER BY ordinal {EARLIER}) AS packets,
    last_value(CASE WHEN hits THEN {{'ns':ns,'o':ordinal}} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal {EARLIER}) AS hit FROM b),
d AS (SELECT *, calm AND coalesce(packet>packets,true) AS taken FROM c WHERE kind=11),
e AS (SELECT *, lag(d) OVER (PARTITION BY session ORDER BY ordinal) AS p FROM d),
f AS (SELECT *, x-p.x AS mx, y-p.y AS my, z-p.z AS mz, taken AND coalesce(p.taken AND p.ordinal>wiped,false) AS linked,
    coalesce(ns-p.ns BETWEEN 0 AND {2 * D.DAY},false) AS near FROM e),
g AS (SELECT *, lag({{'mx':mx,'my':my,'mz':mz,'ok':linked AND near}}) OVER (PARTITION BY session ORDER BY ordinal) AS o FROM f),
h AS (SELECT *, coalesce(linked AND near AND o.ok AND clear AND p.clear AND sqrt(mx*mx+mz*mz)<=3 AND abs(my)<=3 AND friction=p.friction,false) AS gated FROM g),
i AS (SELECT *, gated AND coalesce(batch>max(CASE WHEN gated THEN batch END) OVER (PARTITION BY session,wiped ORDER BY ordinal {EARLIER}),true) AS live FROM h),
m AS (SELECT *, NOT source AND NOT destination AS air,
    CASE WHEN row_number() OVER (PARTITION BY session,hit.o,live ORDER BY ordinal)=1 THEN hit.ns END AS hit_ns,
    CASE WHEN flat THEN 0.9100000262260437::DOUBLE*friction ELSE 0.9100000262260437::DOUBLE END AS drag,
    CASE WHEN flat THEN speed*1.3*0.16277136/pow(0.9100000262260437::DOUBLE*friction,3) ELSE 0.026::DOUBLE END AS accel FROM i)
"""
RULES = {
    "speed": ("flat OR air", "sqrt(pow(mx-o.mx*drag,2)+pow(mz-o.mz*drag,2))", "accel", "measured>bound+0.015"),
    "fly": ("air", "my", "(o.my-0.08)*0.9800000190734863::DOUBLE", "abs(measured-bound)>0.015"),
    "noslow": ("flat AND item AND p.item", "sqrt(pow(mx-o.mx*drag,2)+pow(mz-o.mz*drag,2))", "accel*sqrt(2)*0.2", "measured>bound+0.015"),
    "nofall": ("air AND my<-0.03 AND o.my<-0.03", "my", "0::DOUBLE", "ground"),
    "keepsprint": ("flat AND coalesce(ns-hit_ns BETWEEN 0 AND 150000000,false) AND p.sprint AND sprint AND NOT item",
                   "sqrt(pow(mx-o.mx*drag*0.6,2)+pow(mz-o.mz*drag*0.6,2))", "accel/1.3", "measured>bound+0.015"),
}


def _movement(kind):
    ok, measured, bound, bad = RULES[kind]
    text = f"""WITH {MOVE_SQL}, q AS (SELECT *, live AND coalesce({ok},false) AS eligible, {measured} AS measured, {bound} AS bound FROM m)
      SELECT session, ordinal, ns, eligible, round(CASE WHEN eligible THEN measured END,6) AS measured, round(CASE WHEN eligible THEN bound END,6) AS bound,
        CASE WHEN eligible THEN {bad} WHEN NOT taken OR (linked AND NOT gated) THEN false END AS suspicious FROM q"""

    @query(f"movement_{kind}", text)
    def run(spark, sf):
        return r6(X.movement_samples(D.view(spark, sf, "motion"), kind, MOVE))


for _kind in RULES:
    _movement(_kind)

WIDE = 0.13125 + 3.05 * 0.052335956242943835 + 0.03
# From the rules: which attacks count is walked one by one; the run of frames is found by its last break before the decision.
HIT_SQL = D.view_sql("combat") + f""",
ep AS (SELECT *, available AND ping<=90 AS valid, coalesce(max(CASE WHEN kind IN (1,2,3,10,14) THEN ordinal END) OVER (PARTITION BY session ORDER BY ordinal),-1) AS epoch FROM combat),
tm AS (SELECT session, epoch, ordinal, packet, batch, row_number() OVER (PARTITION BY session,epoch ORDER BY ordinal) AS rn FROM ep WHERE kind=7 AND sampled_ns-ns BETWEEN 0 AND 100000000),
wk AS (SELECT session, epoch, ordinal, rn, CASE WHEN packet>0 AND batch>0 THEN packet ELSE 0 END AS p, CASE WHEN packet>0 AND batch>0 THEN batch ELSE 0 END AS b, packet>0 AND batch>0 AS took FROM tm WHERE rn=1
 UNION ALL SELECT m.session, m.epoch, m.ordinal, m.rn, CASE WHEN m.packet>w.p AND m.batch>w.b THEN m.packet ELSE w.p END, CASE WHEN m.packet>w.p AND m.batch>w.b THEN m.batch ELSE w.b END,
   m.packet>w.p AND m.batch>w.b FROM wk w JOIN tm m ON m.session=w.session AND m.epoch=w.epoch AND m.rn=w.rn+1),
fr AS (SELECT *, lag({{'n':sampled_ns,'v':valid}}) OVER (PARTITION BY session,epoch,target ORDER BY ordinal) AS q
  FROM ep WHERE kind=8 OR (session,ordinal) IN (SELECT session,ordinal FROM wk WHERE took)),
bk AS (SELECT *, NOT coalesce(valid AND q.v AND sampled_ns-q.n BETWEEN 0 AND {2 * D.DAY},false) AS breaks FROM fr),
pn AS (SELECT f.*, (SELECT min(e.ordinal) FROM ep e WHERE e.session=f.session AND e.epoch=f.epoch AND e.kind IN (4,8) AND e.ordinal>f.ordinal AND e.ns>=f.ns+{D.DAY // 4}) AS de
  FROM fr f WHERE f.kind=7 AND f.valid AND greatest(0,f.low_x-0.13125-f.eye_x)<=3.05),
dc AS (SELECT a.*, (SELECT max(g.ordinal) FROM fr g WHERE g.session=a.session AND g.epoch=a.epoch AND g.target=a.target AND g.ordinal<=a.de) AS lo,
    (SELECT max(g.ordinal) FROM bk g WHERE g.session=a.session AND g.epoch=a.epoch AND g.target=a.target AND g.ordinal<=a.de AND g.breaks) AS st
  FROM pn a JOIN ep e ON e.session=a.session AND e.ordinal=a.de WHERE e.ns-a.ns<={3 * D.DAY}),
p AS (SELECT x.session, x.ordinal, x.ns, x.target, g.ordinal AS fo, g.sampled_ns AS fn, l.sampled_ns AS ln, lead(g.sampled_ns) OVER (PARTITION BY x.session,x.ordinal ORDER BY g.ordinal) AS nx,
    row_number() OVER (PARTITION BY x.session,x.ordinal ORDER BY g.ordinal DESC) AS age, sqrt(pow(x.eye_x-g.eye_x,2))<=0.03
      AND sqrt(pow(sin(radians(x.yaw))-sin(radians(g.yaw)),2)+pow(cos(radians(x.yaw))-cos(radians(g.yaw)),2))<=2*0.008726535498373935 AS stable,
    (CASE WHEN -sin(radians(g.yaw))>0 THEN (g.low_x-{WIDE}-g.eye_x)<=3.05*-sin(radians(g.yaw)) ELSE false END) AS hit
  FROM dc x JOIN fr l ON l.session=x.session AND l.ordinal=x.lo AND l.valid
  JOIN fr g ON x.session=g.session AND x.epoch=g.epoch AND x.target=g.target AND g.ordinal BETWEEN coalesce(x.st,-1) AND x.lo)
SELECT session, ordinal, min(ns) AS ns, min(target) AS target, count(*) AS frames, bool_and(stable) AS stable,
  CASE WHEN bool_and(stable) THEN bool_or(hit) END AS hit, CASE WHEN bool_and(stable) THEN NOT bool_or(hit) END AS suspicious
FROM p WHERE age<=48 AND (nx IS NULL OR ln-nx<={3 * D.DAY}) GROUP BY session, ordinal HAVING min(fn)<=min(ns)-{2 * D.DAY} AND max(ln)>=min(ns)+{D.DAY // 4}
"""


@query("hitbox_verdicts", f"WITH RECURSIVE {HIT_SQL}")
def q_hitbox(spark, sf):
    return X.hitbox_verdicts(D.view(spark, sf, "combat"), HIT)


# Anchored streaks are sequential: the SQL walks the samples of each session with a recursive query.
@query("anchored_streak", f"""WITH RECURSIVE {MOVE_SQL}, q AS (SELECT *, live AND coalesce(air,false) AS eligible, my AS measured, (o.my-0.08)*0.9800000190734863::DOUBLE AS bound FROM m),
sm AS (SELECT session, ordinal, ns, CASE WHEN eligible THEN abs(measured-bound)>0.015 ELSE false END AS sus,
    row_number() OVER (PARTITION BY session ORDER BY ordinal) AS rn FROM q WHERE eligible OR NOT taken OR (linked AND NOT gated)),
walk AS (SELECT session, rn, ordinal, ns, CASE WHEN sus THEN 1 ELSE 0 END AS c, CASE WHEN sus THEN ns END AS f_ns, CASE WHEN sus THEN ordinal END AS f_o, false AS hit, CAST(NULL AS BIGINT) AS first_sample FROM sm WHERE rn=1
 UNION ALL SELECT session, rn, ordinal, ns, CASE WHEN c1>=2 THEN 0 ELSE c1 END, CASE WHEN c1>=2 OR c1=0 THEN NULL ELSE g_ns END, CASE WHEN c1>=2 OR c1=0 THEN NULL ELSE g_o END, c1>=2, g_o
 FROM (SELECT sm.session, sm.rn, sm.ordinal, sm.ns, CASE WHEN NOT sm.sus THEN 0 WHEN w.f_ns IS NULL OR sm.ns-w.f_ns>{8 * D.DAY} THEN 1 ELSE w.c+1 END AS c1,
    CASE WHEN w.f_ns IS NULL OR sm.ns-w.f_ns>{8 * D.DAY} THEN sm.ns ELSE w.f_ns END AS g_ns, CASE WHEN w.f_ns IS NULL OR sm.ns-w.f_ns>{8 * D.DAY} THEN sm.ordinal ELSE w.f_o END AS g_o
   FROM walk w JOIN sm ON sm.session=w.session AND sm.rn=w.rn+1))
SELECT session, ordinal, ns, 2 AS samples, first_sample FROM walk WHERE hit""")
def q_anchored(spark, sf):
    samples = X.movement_samples(D.view(spark, sf, "motion"), "fly", MOVE).filter("suspicious IS NOT NULL")
    return anchored_streak(samples, 8.0 * DAY_MS, 2)


# The tick budget from its rules, one row at a time; times are nanoseconds. A row that can't be counted forgets everything.
TICKS = {"cost": 6 * 10**13, "credit": 3 * 10**13, "lead": 3 * 10**13, "warmup": 10**9, "sustain": 10**9, "least": 10**9, "gap": 3 * D.DAY}
BUDGET_SQL = f"""WITH RECURSIVE {D.OBS_SQL},
rows_in AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS rn,
    kind=11 AND coalesce(available AND world<>'' AND sampled_ns-ns BETWEEN 0 AND 100000000,false) AS usable FROM obs WHERE kind IN (1,2,3,10,11,14)),
walk AS (SELECT session, 0::BIGINT AS rn, 0::BIGINT AS ordinal, 0::BIGINT AS ns, 0::BIGINT AS last_packet, NULL::BIGINT AS last_ns, NULL::BIGINT AS ready, NULL::BIGINT AS started,
    NULL::BIGINT AS over, 0::BIGINT AS n, 0::BIGINT AS run, 0::BIGINT AS bal, 0::BIGINT AS paid, false AS alert FROM rows_in WHERE rn=1
 UNION ALL SELECT session, rn, ordinal, ns, CASE WHEN mode='forget' THEN 0 ELSE packet END, CASE WHEN mode<>'forget' THEN ns END,
    CASE mode WHEN 'forget' THEN NULL WHEN 'begin' THEN ns+{TICKS["warmup"]} ELSE ready END, CASE WHEN mode IN ('wait','count') THEN first_ns END,
    CASE WHEN mode='wait' THEN over WHEN mode='count' AND high AND NOT due THEN over1 END, CASE WHEN mode='wait' THEN n WHEN mode='count' THEN n+1 ELSE 0 END,
    CASE WHEN mode='wait' THEN run WHEN mode='count' AND high AND NOT due THEN run+1 ELSE 0 END,
    CASE mode WHEN 'forget' THEN 0 WHEN 'begin' THEN -{TICKS["credit"]} WHEN 'wait' THEN bal ELSE CASE WHEN high AND due THEN 0 ELSE b END END, b, mode='count' AND high AND due
 FROM (SELECT *, b>{TICKS["lead"]} AS high, n+1>=5 AND ns-first_ns>={TICKS["least"]} AND run+1>=2 AND ns-over1>={TICKS["sustain"]} AS due
  FROM (SELECT *, least({100 * TICKS["cost"]}, greatest(-{TICKS["credit"]}, bal-CASE WHEN started IS NULL THEN 0 ELSE ns-last_ns END)+{TICKS["cost"]}) AS b, coalesce(over,ns) AS over1,
     CASE WHEN mode='count' THEN coalesce(started,ns) ELSE started END AS first_ns
   FROM (SELECT r.session, r.rn, r.ordinal, r.ns, r.packet, w.last_ns, w.ready, w.started, w.over, w.n, w.run, w.bal,
      CASE WHEN NOT r.usable OR r.packet<=w.last_packet THEN 'forget' WHEN w.last_ns IS NULL OR r.ns<w.last_ns OR r.ns-w.last_ns>={TICKS["gap"]} THEN 'begin'
        WHEN r.ns<w.ready THEN 'wait' ELSE 'count' END AS mode
     FROM walk w JOIN rows_in r ON r.session=w.session AND r.rn=w.rn+1))))
SELECT session, ordinal, ns, paid/1e6::DOUBLE AS lead_ms, n AS counted, (ns-started)/1e6::DOUBLE AS elapsed_ms FROM walk WHERE alert"""


@query("timer_budget", BUDGET_SQL)
def q_budget(spark, sf):
    return timer_budget(D.obs_events(spark, sf), credit_ms=3e7, lead_ms=3e7, sustain_ms=1000, warmup_ms=1000, gap_ms=3.0 * DAY_MS,
                        cost_ms=6e7, least_packets=5, least_ms=1000, least_over=2)


# Impulse responses from their rules, one row at a time: a move keeps those of the ways so far, and those that begin at it, that explain it.
WAY = "STRUCT(vx DOUBLE, vy DOUBLE, vz DOUBLE, r DOUBLE)[]"
PUSH_SQL = f"""WITH RECURSIVE {D.view_sql("pushes")},
rows_in AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS rn,
    kind=11 AND coalesce(available AND world<>'' AND sampled_ns-ns BETWEEN 0 AND 100000000 AND has_pos AND clear,false) AS usable FROM pushes WHERE kind IN (1,2,3,7,10,11,12,13,14)),
walk AS (SELECT session, 0::BIGINT AS rn, 0::BIGINT AS ordinal, 0::BIGINT AS ns, 0::BIGINT AS last_packet, NULL::STRUCT(ns BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, world VARCHAR) AS last,
    {{'x':0::DOUBLE,'y':0::DOUBLE,'z':0::DOUBLE}} AS moved, NULL::STRUCT(token BIGINT, ns BIGINT, vx DOUBLE, vy DOUBLE, vz DOUBLE, additive BOOLEAN) AS push,
    NULL::BIGINT AS acked, 0::BIGINT AS n, []::{WAY} AS ways, false AS told, NULL::BIGINT AS token FROM rows_in WHERE rn=1
 UNION ALL SELECT session, rn, ordinal, ns, CASE mode WHEN 'forget' THEN 0 WHEN 'push' THEN last_packet WHEN 'ack' THEN last_packet ELSE packet END,
    CASE mode WHEN 'forget' THEN NULL WHEN 'push' THEN last WHEN 'ack' THEN last ELSE {{'ns':ns,'x':x,'y':y,'z':z,'world':world}} END,
    CASE mode WHEN 'forget' THEN {{'x':0::DOUBLE,'y':0::DOUBLE,'z':0::DOUBLE}} WHEN 'move' THEN step ELSE moved END,
    CASE WHEN mode='push' AND push IS NULL AND last IS NOT NULL AND token<>0 AND (abs(vy)>=0.1 OR sqrt(vx*vx+vz*vz)>=0.1) AND abs(vy)<=4 AND sqrt(vx*vx+vz*vz)<=4
        THEN {{'token':token,'ns':ns,'vx':vx,'vy':vy,'vz':vz,'additive':additive}} WHEN mode IN ('ack','first') OR live AND NOT bad AND NOT good THEN push END,
    CASE WHEN mode='ack' AND token=push.token AND ns-push.ns BETWEEN 0 AND 2000000000 THEN coalesce(acked,0) WHEN mode='ack' THEN acked WHEN live AND NOT bad AND NOT good THEN acked1 END,
    CASE WHEN mode='ack' THEN n WHEN live THEN n+1 ELSE 0 END,
    CASE WHEN mode='ack' THEN ways WHEN live THEN list_transform(fit, lambda v: {{'vx':v.vx*drag,'vy':(v.vy-0.08)*0.98::DOUBLE,'vz':v.vz*drag,'r':(v.r+accel)*drag}}) ELSE [] END::{WAY},
    mode='forget' OR mode='push' AND push IS NOT NULL OR bad OR good, CASE WHEN bad THEN push.token END
 FROM (SELECT *, live AND coalesce(acked1>2,false) AND len(fit)=0 AS bad, live AND coalesce(acked1>=8,false) AND len(fit)>0 AS good
  FROM (SELECT *, list_filter(list_concat(ways, CASE WHEN coalesce(acked1,0)>2 THEN [] WHEN source THEN [{{'vx':b_x,'vy':b_y,'vz':b_z,'r':0::DOUBLE}},{{'vx':b_x,'vy':jump,'vz':b_z,'r':0.2::DOUBLE}}]
       ELSE [{{'vx':b_x,'vy':b_y,'vz':b_z,'r':0::DOUBLE}}] END::{WAY}), lambda v: sqrt(pow(step.x-v.vx,2)+pow(step.z-v.vz,2))-v.r-accel<=0.025 AND abs(step.y-v.vy)<=0.025) AS fit
   FROM (SELECT *, coalesce(mode='move' AND push IS NOT NULL AND ns-last.ns BETWEEN 0 AND 150000000 AND world=last.world AND NOT destination AND ns-push.ns BETWEEN 0 AND 2000000000
        AND n<40 AND accel BETWEEN 0 AND 0.5,false) AS live, acked+1 AS acked1,
       push.vx+CASE WHEN push.additive THEN moved.x*drag ELSE 0 END AS b_x, push.vy+CASE WHEN push.additive THEN (moved.y-0.08)*0.98::DOUBLE ELSE 0 END AS b_y,
       push.vz+CASE WHEN push.additive THEN moved.z*drag ELSE 0 END AS b_z
    FROM (SELECT *, {{'x':x-last.x,'y':y-last.y,'z':z-last.z}} AS step, CASE WHEN source THEN 0.546::DOUBLE ELSE 0.91::DOUBLE END AS drag,
        CASE WHEN source THEN speed*1.3::DOUBLE*0.16277136::DOUBLE/pow(0.546::DOUBLE,3) ELSE 0.026::DOUBLE END AS accel,
        CASE WHEN kind=12 THEN 'push' WHEN kind=13 THEN 'ack' WHEN NOT usable OR packet<=last_packet THEN 'forget' WHEN last IS NULL THEN 'first' ELSE 'move' END AS mode
     FROM (SELECT r.*, w.last_packet, w.last, w.moved, w.push, w.acked, w.n, w.ways FROM walk w JOIN rows_in r ON r.session=w.session AND r.rn=w.rn+1))))))
SELECT session, ordinal, ns, token, token IS NOT NULL AS suspicious FROM walk WHERE told"""


@query("velocity_samples", PUSH_SQL)
def q_velocity(spark, sf):
    return X.velocity_samples(D.view(spark, sf, "pushes"))


@query("detect_all")
def q_detect_all(spark, sf):
    combat = cut(D.view(spark, sf, "combat"))
    cfg = X.DetectorConfig(enabled=("reach", "autoclicker", "hitboxes"), reach=REACH, autoclicker=CLICK, hitboxes=HIT)
    moving = X.DetectorConfig(enabled=("fly", "speed"), movement=MOVE)
    return checks.detect_all(combat, cfg).unionByName(checks.detect_all(cut(D.view(spark, sf, "motion")), moving))

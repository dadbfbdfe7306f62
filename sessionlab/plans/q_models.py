"""Groups, splits, scoring, calibration, evaluation, planning and stress queries."""

from pyspark.sql import functions as F

from ..functions.stats import fpr_upper
from ..operators import models as M, stress as T
from ..operators.scan import cut
from . import driver as D
from .q_registry import SELECT_SQL, selected
from .q_windows import r6, windows
from .registry import query


def f(spark, sf, text, **given):
    return D.frame(spark, sf, text, **given)


EDGES = "SELECT concat('u', cast(user_id AS string)) AS a, concat('s', cast(event_id % 97 AS string), event_type) AS b FROM {events}"


@query("components", "WITH RECURSIVE " + D.duck(f"""e AS ({EDGES}), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM b UNION SELECT b.b, r.c FROM r JOIN b ON b.a=r.node)
  SELECT node, min(c) AS component FROM r GROUP BY node"""))
def q_components(spark, sf):
    return M.components(f(spark, sf, EDGES))


@query("sample_groups", SELECT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, b0 AS (SELECT DISTINCT 'player:'||player_group AS a, 'script:'||script_family AS b FROM sel WHERE script_family<>'' AND id%60=1), b AS (SELECT a, b FROM b0 UNION SELECT b, a FROM b0),
  r AS (SELECT a AS node, a AS c FROM b UNION SELECT b.b, r.c FROM r JOIN b ON b.a=r.node), m AS (SELECT node, min(c) AS c FROM r GROUP BY 1)
  SELECT id, coalesce(c,'player:'||player_group) AS "group" FROM sel LEFT JOIN m ON node='player:'||player_group""")
def q_groups(spark, sf):
    s = selected(spark, sf).withColumn("opponent_groups", F.array().cast("array<string>"))
    s = s.withColumn("script_family", F.when(F.col("id") % 60 == 1, F.col("script_family")).otherwise(""))
    return M.sample_groups(s, "independent")


PILOT = SELECT_SQL + """, g AS (SELECT id, 'route:'||route AS g FROM sel), rk AS (SELECT g, row_number() OVER (ORDER BY sha256('"'||g||'"')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM g)),
  sp AS (SELECT id, g AS "group", CASE WHEN r<=greatest(1,n//4) THEN 'test' WHEN r<=2*greatest(1,n//4) THEN 'calibration' ELSE 'train' END AS split FROM g JOIN rk USING (g))"""


def pilot(spark, sf):
    s = cut(selected(spark, sf))
    return s, M.partition(s, M.sample_groups(s, "pilot"), "pilot")


@query("partition_pilot", PILOT + " SELECT * FROM sp")
def q_pilot(spark, sf):
    return pilot(spark, sf)[1]


@query("partition_independent", SELECT_SQL + """, g AS (SELECT player_group AS g, max(purpose='validation') AS held FROM sel GROUP BY 1), rk AS (SELECT g, row_number() OVER (ORDER BY sha256('"'||g||'"')) AS r, count(*) OVER () AS n FROM g WHERE NOT held)
  SELECT id, player_group AS "group", CASE WHEN r IS NULL THEN 'test' WHEN r<=greatest(1,n//3) THEN 'calibration' ELSE 'train' END AS split FROM sel LEFT JOIN rk ON g=player_group""")
def q_independent(spark, sf):
    s = cut(selected(spark, sf))
    return M.partition(s, s.selectExpr("id", "player_group AS `group`"), "independent")


ROWS = "SELECT o_orderkey AS trial, o_custkey % 9 AS seed, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice / 10000 AS movement_pps, o_totalprice / 20000 + o_orderkey % 7 AS sustained_pps, cast(o_custkey % 11 AS double) AS turn FROM {orders}"


@query("loso_folds", D.duck(f"""WITH r AS ({ROWS}), f AS (SELECT a.seed AS t, b.seed AS c FROM (SELECT DISTINCT seed FROM r) a JOIN (SELECT DISTINCT seed FROM r) b ON b.seed=(a.seed+1)%9)
  SELECT test_seed, role, count(*) AS n, sum(trial)::BIGINT AS trials FROM (SELECT t AS test_seed, trial, CASE WHEN seed=t THEN 'test' WHEN seed<>c THEN 'train' WHEN label=0 THEN 'calibration' END AS role FROM r JOIN f ON true) WHERE role IS NOT NULL GROUP BY ALL"""))
def q_loso(spark, sf):
    return M.loso_folds(f(spark, sf, ROWS)).groupBy("test_seed", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("trial").alias("trials"))


@query("forward_split", D.duck(f"WITH r AS ({ROWS}) SELECT trial, seed, CASE WHEN dense_rank() OVER (ORDER BY seed)-1>=greatest(2,(SELECT count(DISTINCT seed) FROM r)*2//3) THEN 'test' ELSE 'train' END AS split FROM r"))
def q_forward(spark, sf):
    return M.forward_split(f(spark, sf, ROWS)).select("trial", "seed", "split")


WEIGH = "SELECT w.sample_id, w.ordinal, w.movement_pps, w.attack_cv, s.`group`, s.y FROM {sample_windows} w JOIN {s} s ON s.id = w.sample_id"


def training(spark, sf):
    s = selected(spark, sf).filter("excluded IS NULL").selectExpr("id", "concat('route:', route) AS `group`", "y")
    return M.group_weights(f(spark, sf, WEIGH, s=s))


@query("group_weights", SELECT_SQL + """, w AS (SELECT sample_id, ordinal, route FROM sample_windows JOIN sel ON id=sample_id WHERE excluded IS NULL)
  SELECT route AS "group", count(*) AS windows, round(1.0*(SELECT count(*) FROM w)/(SELECT count(DISTINCT route) FROM w)/count(*),9)::DOUBLE AS weight FROM w GROUP BY route""")
def q_weights(spark, sf):
    return training(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("windows"), F.round(F.max("weight"), 9).alias("weight")).withColumn("group", F.expr("substring(`group`, 7)"))


def newton_sql(data, key="k"):
    """Newton's method for two features and a penalised intercept, per key, as a recursive query; the steps are solved by determinants.

    ``data`` gives k, y, w, a, b. Yields fits: k, coefficients ca, cb and the intercept c0.
    """
    return f"""nd AS ({data}), ns AS (SELECT k, sum(w*a)/sum(w) AS ma, sum(w*b)/sum(w) AS mb FROM nd GROUP BY k),
  nv AS (SELECT k, any_value(ma) AS ma, any_value(mb) AS mb, sqrt(sum(w*(a-ma)*(a-ma))/sum(w)) AS ra, sqrt(sum(w*(b-mb)*(b-mb))/sum(w)) AS rb FROM nd JOIN ns USING (k) GROUP BY k),
  nz AS (SELECT k, y::DOUBLE AS y, w::DOUBLE AS w, (a-ma)/CASE WHEN ra>0 THEN ra ELSE 1 END AS u, (b-mb)/CASE WHEN rb>0 THEN rb ELSE 1 END AS v FROM nd JOIN nv USING (k)),
  walk AS (SELECT k, 0 AS i, 0::DOUBLE AS p, 0::DOUBLE AS q, 0::DOUBLE AS r FROM nv
   UNION ALL SELECT k, i+1, p-(g1*(e*f-h*h)-g2*(c*f-d*h)+g3*(c*h-d*e))/det, q-(-g1*(c*f-d*h)+g2*(z*f-d*d)-g3*(z*h-c*d))/det, r-(g1*(c*h-d*e)-g2*(z*h-c*d)+g3*(z*e-c*c))/det
    FROM (SELECT *, z*(e*f-h*h)-c*(c*f-d*h)+d*(c*h-d*e) AS det FROM (SELECT k, i, p, q, r, sum(m*u)+p AS g1, sum(m*v)+q AS g2, sum(m)+r AS g3,
        sum(t*u*u)+1 AS z, sum(t*u*v) AS c, sum(t*u) AS d, sum(t*v*v)+1 AS e, sum(t*v) AS h, sum(t)+1 AS f
      FROM (SELECT *, w*(s-y) AS m, w*s*(1-s) AS t FROM (SELECT nz.*, i, p, q, r, 1/(1+exp(-(p*u+q*v+r))) AS s FROM walk JOIN nz USING (k) WHERE i<25)) GROUP BY k, i, p, q, r))),
  fits AS (SELECT k, p/CASE WHEN ra>0 THEN ra ELSE 1 END AS ca, q/CASE WHEN rb>0 THEN rb ELSE 1 END AS cb,
    r-p*ma/CASE WHEN ra>0 THEN ra ELSE 1 END-q*mb/CASE WHEN rb>0 THEN rb ELSE 1 END AS c0 FROM walk JOIN nv USING (k) WHERE i=25)"""


WEIGHED_SQL = """wd AS (SELECT route, y, movement_pps, attack_cv FROM sample_windows JOIN sel ON id=sample_id WHERE excluded IS NULL),
  gw AS (SELECT route, 1.0::DOUBLE*(SELECT count(*) FROM wd)/(SELECT count(DISTINCT route) FROM wd)/count(*) AS w FROM wd GROUP BY route)"""


@query("fit_logistic", SELECT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {WEIGHED_SQL}, {newton_sql("SELECT 1 AS k, y, w, movement_pps AS a, attack_cv AS b FROM wd JOIN gw USING (route)")}
  SELECT 'movement_pps' AS name, round(ca,6) AS value FROM fits UNION ALL SELECT 'attack_cv', round(cb,6) FROM fits UNION ALL SELECT 'intercept', round(c0,6) FROM fits""")
def q_fit(spark, sf):
    fits = M.fit_logistic_all(training(spark, sf), [], {"all": ["movement_pps", "attack_cv"]})
    return fits.selectExpr("stack(3, 'movement_pps', coefficients[0], 'attack_cv', coefficients[1], 'intercept', intercept) AS (name, value)").withColumn("value", F.round("value", 6))


FOLDS_SQL = """fr AS (SELECT t.seed AS k, r.label AS y, 1 AS w, movement_pps AS a, sustained_pps AS b FROM r JOIN (SELECT DISTINCT seed FROM r) t ON r.seed<>t.seed AND r.seed<>(t.seed+1)%9)"""


@query("fit_folds", D.duck(f"WITH RECURSIVE r AS ({ROWS}), {FOLDS_SQL}, {newton_sql('SELECT * FROM fr')} SELECT k AS test_seed, round(ca,6) AS first, round(cb,6) AS second, round(c0,6) AS intercept FROM fits"))
def q_fit_folds(spark, sf):
    train = M.loso_folds(f(spark, sf, ROWS)).filter("role = 'train'").withColumn("weight", F.lit(1.0))
    fits = M.fit_logistic_all(train, ["test_seed"], {"rate_only": ["movement_pps", "sustained_pps"]}, "label")
    return fits.selectExpr("test_seed", "round(coefficients[0], 6) AS first", "round(coefficients[1], 6) AS second", "round(intercept, 6) AS intercept")


RULE = {"features": ["movement_pps", "attack_cv"], "coefficients": [0.5, -10.0], "intercept": -1.0}
SCORED_SQL = PILOT + """, mg AS (SELECT sample_id, ordinal, 0.5*movement_pps-10*attack_cv-1 AS margin FROM (SELECT sample_id, ordinal, max(movement_pps) AS movement_pps, max(attack_cv) AS attack_cv FROM sample_windows GROUP BY ALL)),
  su AS (SELECT sample_id, max(h) AS score, count(*) AS windows FROM (SELECT *, CASE WHEN count(*) OVER w=3 THEN min(margin) OVER w END AS h FROM mg WINDOW w AS (PARTITION BY sample_id ORDER BY ordinal ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY 1),
  sc AS (SELECT sel.id, y AS label, sp."group", split, score FROM sel JOIN sp USING (id) JOIN su ON sample_id=id WHERE excluded IS NULL),
  rf AS (SELECT "group", max(score) AS score FROM sc WHERE split='calibration' AND label=0 GROUP BY 1)"""


def margins(spark, sf):
    w = D.reg(spark, sf, "sample_windows").groupBy("sample_id", "ordinal").agg(F.max("movement_pps").alias("movement_pps"), F.max("attack_cv").alias("attack_cv"))
    return M.score(w, RULE)


def scored(spark, sf):
    s, split = pilot(spark, sf)
    su = M.sustained(margins(spark, sf), 3, ["sample_id"], "ordinal")
    return cut(s.filter("excluded IS NULL").selectExpr("id", "y AS label").join(split, "id").join(su.withColumnRenamed("sample_id", "id"), "id"))


@query("score", SCORED_SQL + " SELECT sample_id, ordinal, round(margin,9) AS margin FROM mg")
def q_score(spark, sf):
    return margins(spark, sf).selectExpr("sample_id", "ordinal", "round(margin, 9) AS margin")


@query("sustained", SCORED_SQL + " SELECT sample_id, round(score,9) AS score, windows FROM su")
def q_sustained(spark, sf):
    return M.sustained(margins(spark, sf), 3, ["sample_id"], "ordinal").withColumn("score", F.round("score", 9))


@query("build_reference", SCORED_SQL + ' SELECT "group", round(score,9) AS score FROM rf')
def q_reference(spark, sf):
    return M.build_reference(scored(spark, sf)).withColumn("score", F.round("score", 9))


@query("calibrate", SCORED_SQL + " SELECT id, round(score,9) AS score, round(greatest(0,(SELECT max(score)-8 FROM rf)),9) AS threshold, score>greatest(0,(SELECT max(score)-8 FROM rf)) AS candidate FROM sc")
def q_calibrate(spark, sf):
    s = scored(spark, sf)
    return M.calibrate(s, M.build_reference(s).withColumn("score", F.col("score") - 8), 0.0).selectExpr("id", "round(score, 9) AS score", "round(threshold, 9) AS threshold", "candidate")


@query("tail_rank", """WITH r AS (SELECT l_extendedprice AS v FROM lineitem), s AS (SELECT o_orderkey, round(o_totalprice/4,0) AS score FROM orders),
  c AS (SELECT score, (SELECT count(*) FROM r WHERE v>=score) AS ge FROM (SELECT DISTINCT score FROM s)) SELECT o_orderkey, round((1.0+ge)/((SELECT count(*) FROM r)+1),9)::DOUBLE AS tail_p FROM s JOIN c USING (score)""")
def q_tail(spark, sf):
    s = D.table(spark, sf, "orders").selectExpr("o_orderkey", "round(o_totalprice / 4, 0) AS score")
    r = D.table(spark, sf, "lineitem").selectExpr("l_extendedprice AS score")
    return M.tail_rank(s, r).selectExpr("o_orderkey", "round(tail_p, 9) AS tail_p")


@query("support_bounds", "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_tax) AS min_l_tax, max(l_tax) AS max_l_tax FROM lineitem")
def q_bounds(spark, sf):
    return M.support_bounds(D.table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


PRED = "SELECT o_orderkey AS id, o_custkey % 50 AS `group`, o_custkey % 3 AS model, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, round(o_totalprice / 100, 0) AS score, o_totalprice > 250000 AS flagged FROM {orders}"
PRED_SQL = D.duck(f"WITH p AS ({PRED.replace('`', chr(34))}), c AS (SELECT model, count(*) FILTER (label=1 AND flagged) AS tp, count(*) FILTER (label=0 AND flagged) AS fp, count(*) FILTER (label=0 AND NOT flagged) AS tn, count(*) FILTER (label=1 AND NOT flagged) AS fn FROM p GROUP BY 1)")


@query("confusion", PRED_SQL + " SELECT *, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(fp/(fp+tn),6) AS false_positive_rate, round(fp/((fp+tn)*170/3600),6) AS false_flags_per_hour FROM c")
def q_confusion(spark, sf):
    return r6(M.confusion(f(spark, sf, PRED), ["model"]))


@query("group_failures", PRED_SQL + ' SELECT count(*) AS legit_groups, count(*) FILTER (fl) AS failed_groups FROM (SELECT "group", max(flagged AND score>4500) AS fl FROM p WHERE label=0 GROUP BY 1)')
def q_failures(spark, sf):
    return M.group_failures(f(spark, sf, PRED).withColumn("flagged", F.expr("flagged AND score > 4500")))


@query("fpr_upper", "SELECT o_custkey, count(*) AS n, round(1-pow(0.05,1.0/count(*)),9) AS zero_failures FROM orders GROUP BY 1")
def q_upper(spark, sf):
    g = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return g.select("o_custkey", "n", F.round(fpr_upper(F.lit(0), F.col("n")), 9).alias("zero_failures"))


# The bound by halving on the binomial tail, summed term by term.
UPPER_SQL = """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS k FROM orders GROUP BY 1),
  half AS (SELECT o_custkey, n, k, 0 AS i, 0::DOUBLE AS low, 1::DOUBLE AS high FROM g WHERE k<n
   UNION ALL SELECT o_custkey, n, k, i+1, CASE WHEN tail>0.05 THEN p ELSE low END, CASE WHEN tail>0.05 THEN high ELSE p END FROM (
    SELECT *, list_sum(list_transform(range(0,k+1), lambda j: exp(lgamma(n+1)-lgamma(j+1)-lgamma(n-j+1)+j*ln(p)+(n-j)*ln(1-p)))) AS tail FROM (SELECT *, (low+high)/2 AS p FROM half WHERE i<50)))
  SELECT o_custkey, n, k, round(p,9) AS upper FROM (SELECT o_custkey, n, k, (low+high)/2 AS p FROM half WHERE i=50 UNION ALL SELECT o_custkey, n, k, 1::DOUBLE FROM g WHERE k=n)"""


@query("fpr_upper_with_failures", UPPER_SQL)
def q_upper_failures(spark, sf):
    g = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return g.select("o_custkey", "n", "k", F.round(fpr_upper(F.col("k"), F.col("n")), 9).alias("upper"))


@query("ranking_metrics", PRED_SQL + """, v AS (SELECT score, count(*) FILTER (label=1) AS a, count(*) FILTER (label=0) AS b FROM p GROUP BY 1),
  w AS (SELECT *, sum(a) OVER (ORDER BY score DESC) AS ca, sum(b) OVER (ORDER BY score DESC) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v)
  SELECT round(sum(a*(tb-cb+b/2))/max(ta*tb),9) AS roc_auc, round(sum(a*ca/(ca+cb))/max(ta),9) AS average_precision FROM w""")
def q_ranking(spark, sf):
    return M.ranking_metrics(f(spark, sf, PRED)).selectExpr("round(roc_auc, 9) AS roc_auc", "round(average_precision, 9) AS average_precision")


PAIRS_SQL = D.duck(f"WITH r AS ({ROWS}), pr AS (SELECT seed, avg(movement_pps) FILTER (label=0) AS legit_pps, avg(movement_pps) FILTER (label=1) AS timer_pps FROM r GROUP BY 1)")


@query("paired_effect", PAIRS_SQL + " SELECT seed, round(legit_pps,6) AS legit_pps, round(timer_pps,6) AS timer_pps, round(timer_pps-legit_pps,6) AS delta_pps FROM pr")
def q_paired(spark, sf):
    return r6(M.paired_effect(f(spark, sf, ROWS)))


@query("sign_test", PAIRS_SQL + """, s AS (SELECT avg(timer_pps-legit_pps) AS m, count(*) FILTER (timer_pps>legit_pps) AS w, count(*) FILTER (timer_pps<>legit_pps) AS n FROM pr)
  SELECT round(m,6) AS mean_delta_pps, w::INT AS wins, n::INT AS n, round(least(1, 2*(SELECT sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1))) FROM range(20) t(i) WHERE i<=least(w,n-w))/pow(2,n)),9) AS sign_test_p FROM s""")
def q_sign(spark, sf):
    return M.paired_summary(M.paired_effect(f(spark, sf, ROWS))).selectExpr("round(mean_delta_pps, 6) AS mean_delta_pps", "wins", "n", "round(sign_test_p, 9) AS sign_test_p")


@query("fixed_rate_rule", D.duck(f"WITH r AS ({ROWS}) SELECT count(*) FILTER (label=1 AND sustained_pps>13) AS tp, count(*) FILTER (label=0 AND sustained_pps>13) AS fp, count(*) FILTER (label=0 AND NOT sustained_pps>13) AS tn, count(*) FILTER (label=1 AND NOT sustained_pps>13) AS fn FROM r"))
def q_fixed(spark, sf):
    return M.confusion(f(spark, sf, ROWS).withColumn("flagged", F.col("sustained_pps") > 13)).select("tp", "fp", "tn", "fn")


@query("compare_models")
def q_models(spark, sf):
    rows = f(spark, sf, ROWS.replace("% 9", "% 5"))
    out = M.compare_models(cut(rows), ["movement_pps", "sustained_pps", "turn"], ["movement_pps", "sustained_pps"], fixed_limit=13.0)
    return M.confusion(cut(out), ["model"])


@query("isolation_forest")
def q_forest(spark, sf):
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return M.isolation_forest(rows.filter("l_discount < 0.09"), rows, ["l_quantity", "l_extendedprice", "l_discount"])


REPORT = """SELECT c_custkey AS id, c_custkey % 2 = 0 AS reviewed, c_custkey % 3 = 0 AS days_disjoint, true AS matched_network_controls, c_custkey % 10 AS human_players, c_custkey % 5 AS days, 4 AS network_conditions, c_acctbal / 100 AS legit_hours,
  c_custkey % 7 <> 0 AS same_client_control, 0.005 AS fpr_upper_95, c_custkey / 1000 AS recall, c_custkey AS calibration_groups, 0 AS stress_fp, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS exposed FROM {customer}"""


@query("gate", D.duck(f"""WITH r AS ({REPORT}) SELECT id, array_to_string(list_filter([CASE WHEN NOT reviewed THEN 'labels have not all been independently reviewed' END, CASE WHEN NOT days_disjoint THEN 'validation days overlap development' END,
  CASE WHEN human_players<5 THEN 'human_players below requirement' END, CASE WHEN days<3 THEN 'days below requirement' END, CASE WHEN legit_hours<20 THEN 'legit_hours below requirement' END, CASE WHEN NOT same_client_control THEN 'same-client control missing' END,
  CASE WHEN recall<0.8 THEN 'held-out recall below policy' END, CASE WHEN 1/(calibration_groups+1)>0.005 THEN 'too few independent legitimate calibration groups' END, CASE WHEN exposed>0 THEN 'validation data previously exposed' END], lambda x: x IS NOT NULL),';') AS blockers FROM r"""))
def q_gate(spark, sf):
    return M.gate(f(spark, sf, REPORT), D.SPEC, "independent").select("id", F.concat_ws(";", "blockers").alias("blockers"))


HIST = "SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN 'test' ELSE 'train' END AS split, l_returnflag AS spec_hash, l_linestatus AS implementation FROM {lineitem}"


@query("prior_exposure", D.duck(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM ({HIST}) WHERE split='test' AND (spec_hash<>'A' OR implementation<>'F'))"))
def q_exposure(spark, sf):
    return M.prior_exposure(D.table(spark, sf, "orders").selectExpr("o_orderkey AS id"), f(spark, sf, HIST), "A", "F")


TTRIALS = """SELECT o_orderkey AS id, o_orderpriority AS source_sha256, o_custkey % 30 AS seed, CASE WHEN o_orderstatus = 'F' THEN 'hacking' WHEN o_orderstatus = 'O' THEN 'legit' ELSE 'control' END AS condition, 1 AS multiplier,
  round(o_totalprice / 10000, 3) AS score, o_totalprice / 100 AS excess_ms FROM {orders}"""


@query("timer_reference", D.duck(f"SELECT seed, max(score) AS score FROM ({TTRIALS}) WHERE condition<>'hacking' GROUP BY 1"))
def q_tref(spark, sf):
    return M.timer_reference(f(spark, sf, TTRIALS))


@query("publish_timer", D.duck(f"SELECT count(*) AS reference_count, round(1/(count(*)+1),9) AS minimum_tail, 0.001::DOUBLE AS alpha, 1 AS active FROM (SELECT DISTINCT seed FROM ({TTRIALS}) WHERE condition<>'hacking')"))
def q_publish(spark, sf):
    return M.publish_timer(f(spark, sf, TTRIALS)).selectExpr("CAST(reference_count AS BIGINT) AS reference_count", "round(minimum_tail, 9) AS minimum_tail", "alpha", "active")


EVAL_SQL = D.duck(f"""WITH t AS ({TTRIALS}), r AS (SELECT seed AS rs, max(score) AS rv FROM t WHERE condition<>'hacking' GROUP BY 1), e AS (SELECT id, condition, score, excess_ms, count(*) AS reference_count,
  (1.0+count(*) FILTER (rv>=score))/(count(*)+1) AS tail_p FROM t JOIN r ON rs<>seed GROUP BY id, condition, score, excess_ms), ev AS (SELECT *, tail_p<=0.05 AND score>=20.5 AND excess_ms>=1000 AS eligible FROM e)""")


@query("evaluate_timer", EVAL_SQL + " SELECT id, condition, reference_count, round(tail_p,9)::DOUBLE AS tail_p, eligible FROM ev")
def q_evaluate(spark, sf):
    return M.evaluate_timer(f(spark, sf, TTRIALS), 0.1).selectExpr("id", "condition", "CAST(reference_count AS BIGINT) AS reference_count", "round(tail_p, 9) AS tail_p", "eligible")


@query("timer_status", EVAL_SQL + " SELECT condition, count(*) AS trials, round(median(score),6) AS median_score, count(*) FILTER (eligible) AS eligible FROM ev GROUP BY 1")
def q_status(spark, sf):
    return r6(M.timer_status(M.evaluate_timer(f(spark, sf, TTRIALS), 0.1)))


@query("coverage_gaps", """WITH m AS (SELECT c_nationkey AS id, count(*) AS human_players, count(DISTINCT c_mktsegment) AS days FROM customer GROUP BY 1)
  SELECT rule, sum(observed) AS observed, sum(required) AS required, sum(missing) AS missing FROM (SELECT *, greatest(0,required-observed) AS missing FROM (
  SELECT 'human_players' AS rule, human_players::DOUBLE AS observed, 5::DOUBLE AS required FROM m UNION ALL SELECT 'days', days, 3 FROM m UNION ALL SELECT 'network_conditions', 2, 3 FROM m UNION ALL SELECT 'legit_hours', 1, 20 FROM m
  UNION ALL SELECT 'negative_test_groups', human_players, 299 FROM m UNION ALL SELECT 'legitimate_calibration_groups', human_players, 199 FROM m)) GROUP BY rule""")
def q_gaps(spark, sf):
    m = f(spark, sf, """SELECT c_nationkey AS id, count(*) AS human_players, count(DISTINCT c_mktsegment) AS days, 2 AS network_conditions, 1 AS legit_hours, count(*) AS negative_test_groups, count(*) AS legitimate_calibration_groups
      FROM {customer} GROUP BY c_nationkey""")
    return M.coverage_gaps(m, D.SPEC).groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("observed", "required", "missing")])


@query("plan_next", SELECT_SQL + """, pil AS (SELECT * FROM (SELECT *, CASE WHEN excluded IN ('needs_review','negative_input_not_human') THEN NULL ELSE excluded END AS ex0 FROM sel) WHERE ex0 IS NULL AND windows>=3
    AND id NOT IN (SELECT sample_id FROM c WHERE least<3 OR s0<>s1)), ind AS (SELECT * FROM sel WHERE excluded IS NULL),
  used AS (SELECT DISTINCT player_group FROM pil WHERE purpose='development'), days AS (SELECT DISTINCT day FROM pil WHERE purpose='development'),
  ha AS (SELECT * FROM ind WHERE purpose='validation'), di AS (SELECT * FROM ha WHERE player_group IN (SELECT player_group FROM used) OR day IN (SELECT day FROM days)), he AS (SELECT * FROM ha WHERE id NOT IN (SELECT id FROM di)),
  de AS (SELECT * FROM ind WHERE purpose='development'), rk AS (SELECT player_group AS g, row_number() OVER (ORDER BY sha256('"'||player_group||'"')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT player_group FROM de)),
  dd AS (SELECT de.*, r<=CASE WHEN n>=3 THEN greatest(1,n//3) ELSE 0 END AS cal FROM de JOIN rk ON g=player_group),
  fx AS (SELECT (SELECT count(*) FROM pil WHERE review<>'reviewed' AND (y=1 OR input_source='human')) AS nrev, (SELECT count(*) FROM (SELECT client,network FROM pil WHERE y=1 EXCEPT SELECT client,network FROM pil WHERE y=0)) AS nctl, (SELECT count(*) FROM di) AS ndirty,
   (SELECT count(DISTINCT player_group) FROM dd) AS dgr, (SELECT count(DISTINCT player_group) FROM dd WHERE cal AND y=0) AS cneg, (SELECT count(DISTINCT y) FROM dd WHERE cal) AS ccl, (SELECT count(DISTINCT y) FROM dd WHERE NOT cal) AS tcl,
   (SELECT count(DISTINCT player_group) FROM he WHERE y=0) AS hp, (SELECT count(DISTINCT day) FROM he) AS hd, (SELECT count(DISTINCT network) FROM he) AS hn, (SELECT coalesce(sum(windows),0)*30/3600 FROM he WHERE y=0) AS hh, (SELECT count(*) FROM he WHERE y=1) AS pos,
   (SELECT count(*) FROM (SELECT client,network FROM he WHERE y=1 EXCEPT SELECT client,network FROM he WHERE y=0)) AS hctl),
  fy AS (SELECT *, (hp<5)::INT+(hd<3)::INT+(hn<3)::INT+(hh<20)::INT+(hp<299)::INT+(cneg<199)::INT AS ngap FROM fx)
  SELECT 2 AS priority, 'matched_control' AS action, nctl AS n FROM fy WHERE nctl>0 UNION ALL SELECT 3, 'review', nrev FROM fy WHERE nrev>0 UNION ALL SELECT 4, 'development', dgr FROM fy WHERE dgr<3 OR ccl<2 OR tcl<2 OR cneg<199
  UNION ALL SELECT 5, 'replace_validation', ndirty FROM fy WHERE ndirty>0 UNION ALL SELECT 6, 'validation', ngap FROM fy WHERE ngap>0 OR hctl>0 OR pos=0""")
def q_plan(spark, sf):
    pilot_s = cut(selected(spark, sf, "pilot").filter("excluded IS NULL"))
    ind = cut(selected(spark, sf).filter("excluded IS NULL"))
    own = lambda s: s.selectExpr("id", "player_group AS `group`")
    none = spark.createDataFrame([], "id bigint")
    return M.plan_next(pilot_s, ind, own(ind), own(pilot_s.union(ind)).distinct(), none, none, D.SPEC)


# --- time transforms -------------------------------------------------------------------------------------------------

@query("batch_receive", f"WITH {D.OBS_SQL} SELECT session, ordinal, CASE WHEN kind IN (7,11) THEN ((ns+{D.H}-1)//{D.H})*{D.H} ELSE ns END AS ns, CASE WHEN kind IN (7,11) THEN ((ns+{D.H}-1)//{D.H})*{D.H} ELSE ns END + sampled_ns-ns AS sampled_ns FROM obs")
def q_batch(spark, sf):
    return T.batch_receive(D.obs_events(spark, sf), D.H).select("session", "ordinal", "ns", "sampled_ns")


@query("insert_pause", f"WITH {D.OBS_SQL}, z AS (SELECT *, first_value(ns) OVER (PARTITION BY session ORDER BY ordinal) AS f FROM obs) SELECT session, ordinal, ns+CASE WHEN kind IN (7,11) AND ns-f>={10 * D.DAY} THEN {D.H} ELSE 0 END AS ns FROM z")
def q_pause(spark, sf):
    return T.insert_pause(D.obs_events(spark, sf), 10 * D.DAY, D.H).select("session", "ordinal", "ns")


@query("perturb_moves", f"""WITH {D.OBS_SQL}, z AS (SELECT *, min(ns) FILTER (kind=11) OVER (PARTITION BY session) AS f FROM obs)
  SELECT session, ordinal, CASE WHEN kind=11 THEN f+((ns-f+{D.H}-1)//{D.H})*{D.H} ELSE ns END AS ns FROM z""")
def q_perturb(spark, sf):
    return T.perturb_moves(D.obs_events(spark, sf), "batch_100ms", D.H).select("session", "ordinal", "ns")


@query("run_scores", f"""WITH {D.WINDOW_SQL}, m AS (SELECT *, 1000000*movement_pps+attacks AS margin FROM windows WHERE attacks>=1),
  h AS (SELECT a.session, CASE WHEN count(*)=2 THEN min(b.margin) END AS s FROM m a JOIN m b ON a.session=b.session AND a.segment=b.segment AND b.k BETWEEN a.k-1 AND a.k GROUP BY a.session, a.segment, a.k)
  SELECT session, round(max(s),6) AS score FROM h GROUP BY session""")
def q_runs(spark, sf):
    return r6(T.run_scores(windows(spark, sf), {"features": ["movement_pps", "attacks"], "coefficients": [1e6, 1.0], "intercept": 0.0}, 2, 1))


@query("stress_eval")
def q_stress(spark, sf):
    obs = cut(D.obs_events(spark, sf))
    labels = obs.select("session").distinct().withColumn("label", F.col("session") % 2)
    return T.stress_eval(obs, labels, {"features": ["movement_pps"], "coefficients": [1.0], "intercept": 0.0}, 1.3e-5, 2, 0,
                         {"batch": (D.H, 0), "pause": (0, D.DAY)}, 10 * D.DAY, span_ns=D.SPAN, guard_ns=D.GUARD, gap_ns=D.GAP, queue_ns=D.QUEUE)

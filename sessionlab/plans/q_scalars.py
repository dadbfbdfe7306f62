"""Column helpers over events, embeddings and orders."""

from pyspark.sql import functions as F

from ..functions import columns as C
from . import driver as D
from .q_windows import r6
from .registry import query

EV = "WITH " + D.EV_SQL


def ev(spark, sf):
    return D.raw_events(spark, sf)


RAW = """WITH ev AS (SELECT user_id AS session, event_id, event_type, value, epoch_us(ts)*1000 AS ns, epoch_us(ts)//1000 AS epoch_ms,
  CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)"""


@query("angle_wrap", RAW + " SELECT event_id, round((((value-k*3.6+180)%360)+360)%360-180,6) AS turn FROM ev")
def q_angle(spark, sf):
    return r6(ev(spark, sf).select("event_id", C.angle_wrap(F.col("value") - F.col("k") * 3.6).alias("turn")))


@query("elapsed_ms", RAW + " SELECT event_id, CASE WHEN ns>=ns+(k-50)*1000 THEN (50-k)*1000/1e6 ELSE -1.0 END AS ms FROM ev")
def q_elapsed(spark, sf):
    return ev(spark, sf).select("event_id", C.elapsed_ms(F.col("ns"), F.col("ns") + (F.col("k") - 50) * 1000).alias("ms"))


def vectors(spark, sf):
    """Embedding slices as an eye, a direction and a box."""
    e = lambda i: F.col("embedding")[i].cast("double")
    lo = [F.least(e(3 + i), e(6 + i)).alias(f"l{i}") for i in range(3)]
    hi = [F.greatest(e(3 + i), e(6 + i)).alias(f"h{i}") for i in range(3)]
    return D.table(spark, sf, "embeddings").select("vec_id", *[(e(i) * 4).alias(f"e{i}") for i in range(3)], *lo, *hi,
                                                   *[(e(9 + i) * 90).alias(f"a{i}") for i in range(3)])


VEC = "WITH v AS (SELECT vec_id, " + ", ".join(
    [f"embedding[{i + 1}]::DOUBLE*4 AS e{i}" for i in range(3)]
    + [f"least(embedding[{4 + i}],embedding[{7 + i}])::DOUBLE AS l{i}, greatest(embedding[{4 + i}],embedding[{7 + i}])::DOUBLE AS h{i}" for i in range(3)]
    + [f"embedding[{10 + i}]::DOUBLE*90 AS a{i}" for i in range(3)]) + " FROM embeddings)"


def cols(p):
    return [F.col(f"{p}{i}") for i in range(3)]


@query("vector_lengths", VEC + " SELECT vec_id, round(sqrt(e0*e0+e2*e2),6) AS flat, round(sqrt(e0*e0+e1*e1+e2*e2),6) AS full_length FROM v")
def q_lengths(spark, sf):
    e = cols("e")
    return r6(vectors(spark, sf).select("vec_id", C.length2(e[0], e[2]).alias("flat"), C.length3(*e).alias("full_length")))


@query("finite_range", VEC + " SELECT vec_id, isfinite(e0) AND e0 BETWEEN -0.5 AND 0.5 AS fits, isfinite(e1/CASE WHEN vec_id%7=0 THEN 0 ELSE 1 END) IS TRUE AS finite FROM v")
def q_finite(spark, sf):
    e = cols("e")
    # a zero divisor gives infinity here, which must not count as finite
    risky = F.when(F.col("vec_id") % 7 == 0, F.lit(float("inf"))).otherwise(e[1])
    return vectors(spark, sf).select("vec_id", C.finite_in(e[0], -0.5, 0.5).alias("fits"), C.is_finite(risky).alias("finite"))


GAPS = "+".join(f"pow(greatest(0,(l{i}-0.13125)-e{i},e{i}-(h{i}+0.13125)),2)" for i in range(3))
BOXES = "+".join(f"pow(greatest(0,(l{i}-0.13125)-(e{i}+0.1),(e{i}-0.1)-(h{i}+0.13125)),2)" for i in range(3))


@query("box_distance", VEC + f" SELECT vec_id, round(sqrt({GAPS}),6) AS point_distance, round(sqrt({BOXES}),6) AS box_distance FROM v")
def q_boxes(spark, sf):
    e, lo, hi = cols("e"), cols("l"), cols("h")
    return r6(vectors(spark, sf).select(
        "vec_id", C.point_box(e, lo, hi, 0.13125).alias("point_distance"),
        C.box_gap([c - 0.1 for c in e], [c + 0.1 for c in e], lo, hi, 0.13125).alias("box_distance")))


@query("look_vector", VEC + """ SELECT vec_id, round(-sin(radians(a0))*cos(radians(a1)),6) AS dx, round(-sin(radians(a1)),6) AS dy,
  round(cos(radians(a0))*cos(radians(a1)),6) AS dz FROM v""")
def q_look(spark, sf):
    x, y, z = C.look_vector(F.col("a0"), F.col("a1"))
    return r6(vectors(spark, sf).select("vec_id", x.alias("dx"), y.alias("dy"), z.alias("dz")))


@query("ray_hits_box", VEC + """, d AS (SELECT *, -sin(radians(a0))*cos(radians(a1)) AS d0, -sin(radians(a1)) AS d1, cos(radians(a0))*cos(radians(a1)) AS d2 FROM v),
 t AS (SELECT vec_id, greatest(0, """ + ", ".join(f"least((l{i}-0.3-e{i})/d{i},(h{i}+0.3-e{i})/d{i})" for i in range(3)) + ") AS n, least(3.05, "
       + ", ".join(f"greatest((l{i}-0.3-e{i})/d{i},(h{i}+0.3-e{i})/d{i})" for i in range(3)) + ") AS f FROM d) SELECT vec_id, n<=f AS hit FROM t")
def q_ray(spark, sf):
    return vectors(spark, sf).select("vec_id", C.ray_hits_box(cols("e"), C.look_vector(F.col("a0"), F.col("a1")), cols("l"), cols("h"), 0.3).alias("hit"))


@query("three_decimals", "SELECT event_id, printf('%.3f', value/3) AS text FROM events")
def q_num3(spark, sf):
    return D.table(spark, sf, "events").select("event_id", C.num3(F.col("value") / 3).alias("text"))


@query("expected_mining_ms", RAW + " SELECT event_id, ceil(1/((k+1)/128.0::DOUBLE))*50 AS expected FROM ev")
def q_expected(spark, sf):
    return ev(spark, sf).select("event_id", C.expected_ms((F.col("k") + 1) / 128.0).alias("expected"))


@query("tick_aligned", "SELECT event_id, abs(value-round(value/50)*50)<=2 AS aligned FROM events")
def q_tick(spark, sf):
    return D.table(spark, sf, "events").select("event_id", C.tick_aligned(F.col("value")).alias("aligned"))


@query("alpha_spent", RAW + " SELECT event_id, round(0.001/((k+1)*(k+2)),12) AS alpha FROM ev")
def q_alpha(spark, sf):
    return ev(spark, sf).select("event_id", F.round(C.alpha_spent(0.001, F.col("k") + 1), 12).alias("alpha"))


@query("json_build_extract", RAW + """ SELECT event_id, '{"attacks":'||k||',"segment":'||session||'}' AS features, k AS attacks_back, event_type AS kind_back FROM ev""")
def q_json(spark, sf):
    built = ev(spark, sf).select("event_id", F.col("k").alias("attacks"), F.col("session").alias("segment"), "event_type").select(
        "event_id", C.features_json("segment", "attacks").alias("features"), C.evidence_map(kind=F.col("event_type")).alias("evidence"))
    return built.select("event_id", "features", F.from_json("features", "attacks bigint")["attacks"].alias("attacks_back"),
                        F.col("evidence")["kind"].alias("kind_back"))


@query("utc_day", RAW + " SELECT event_id, CAST(make_timestamp(epoch_ms*1000) AS DATE) AS day FROM ev")
def q_day(spark, sf):
    return ev(spark, sf).select("event_id", C.utc_day(F.col("epoch_ms")).alias("day"))


@query("label_maps", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cheat' WHEN 'O' THEN 'legit' END AS label,
  CASE WHEN o_orderkey%3=0 THEN 'vanilla' WHEN o_orderkey%3=1 THEN 'vape' ELSE 'other' END AS client FROM orders""")
def q_labels(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, "vanilla-auto").when(k == 1, "vape").otherwise("other")
    return D.table(spark, sf, "orders").select("o_orderkey", C.condition_label(F.when(s == "F", "hacking").when(s == "O", "control")).alias("label"),
                                               C.client_name(raw).alias("client"))


@query("clean_text", r"SELECT doc_id, regexp_replace(substr(text,1,60),'[^\x20-\x7e]','?','g')||CASE WHEN length(text)>60 THEN '...' ELSE '' END AS line FROM documents")
def q_clean(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", C.clean_text(F.col("text"), 60).alias("line"))


@query("formatted_numbers", """SELECT event_id, CASE WHEN k<0 THEN '?' ELSE printf('%.2f',v) END AS rate, CASE WHEN k<0 THEN '? ms' ELSE printf('%.0f ms',floor(v+0.5)) END AS ms FROM (
  SELECT event_id, value+0.13 AS v, CASE WHEN event_id%9=0 THEN -1 ELSE 1 END AS k FROM events)""")
def q_fmt(spark, sf):
    text = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise((F.col("value") + 0.13).cast("string"))
    return D.table(spark, sf, "events").select("event_id", C.fmt_rate(text).alias("rate"), C.fmt_ms(text).alias("ms"))


@query("group_keys", "SELECT c_custkey, substr(sha256(c_name),1,24) AS player, sha256('\"'||c_name||'\"') AS name_id FROM customer")
def q_groups(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", C.group_key(F.col("c_name")).alias("player"), C.text_identity(F.col("c_name")).alias("name_id"))


@query("hmac_group_keys", """SELECT c_custkey, substr(sha256(unhex('""" + bytes(b ^ 0x5C for b in b"k" * 32 + bytes(32)).hex() + """')||unhex(sha256(unhex('"""
       + bytes(b ^ 0x36 for b in b"k" * 32 + bytes(32)).hex() + """')||encode(c_name)))),1,24) AS player FROM customer""")
def q_hmac(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", C.hmac_group_key(F.col("c_name"), b"k" * 32).alias("player"))


@query("content_identity", """SELECT o_orderkey, sha256('{"client":"'||o_orderpriority||'","label":"'||o_orderstatus||'"}') AS id FROM orders""")
def q_identity(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("client")).select(
        "o_orderkey", C.identity("label", "client").alias("id"))

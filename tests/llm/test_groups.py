"""Centroid clustering, exact dedup and the source audit against plain versions, on odd rows and hot groups."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlab.llm.golomb_dedup import _bitmaps, _messages, exact_dedup, golomb, golomb_decoded, modulus_bits
from sessionlab.llm.pattern_tree import TERM, divergence, tree_nodes
from sessionlab.llm.vantage_point import Tree, centroid_clusters, cluster

# --- clustering


def plain_clusters(rows, k, rounds):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((int(((v - c) ** 2).sum()), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [sum(groups[i]) // len(groups[i]) if groups[i] else c for i, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0], ",".join(map(str, centroids[near(v)[1]]))) for i, v in kept]


@pytest.mark.parametrize("k,rounds", [(7, 3), (40, 5), (1, 2), (500, 1)])
def test_clusters(spark, k, rounds):
    draw = random.Random(k)
    # few different values: many ties of distance
    rows = [(i, [draw.choice([-1.0, -0.004, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(None)})
    got = centroid_clusters(df, k, rounds, 4).collect()
    want = plain_clusters(rows, k, rounds)
    assert sorted((r.vec_id or -1, r.cluster, r.distance, r.centroid_sha256) for r in got) == sorted((i or -1, c, d, hashlib.sha256(t.encode()).hexdigest()) for i, c, d, t in want)
    spread = collections.Counter()
    for _, c, d, _ in want:
        spread[c] += d
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in got} == {(c, spread[c], sum(spread.values())) for _, c, _, _ in want}


def test_clusters_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert centroid_clusters(empty).count() == 0
    twice = spark.createDataFrame([(1, [0.0, 1e30]), (1, [0.0, 1e30]), (2, [0.0, -1e30])], "vec_id long, embedding array<double>")
    found, centroids = cluster(twice, 40, 2, 2)
    assert found.count() == 3 and {r.distance for r in found.collect()} == {0} and centroids.max() == 1 << 27


def test_tree_meets_every_tie():
    draw = np.random.default_rng(5)
    for n in (1, 2, 5, 60):
        points, asked = draw.integers(-2, 3, (n, 3)), draw.integers(-3, 4, (500, 3))
        who, d = Tree(points).nearest(asked)
        all_ = ((asked[:, None] - points[None]) ** 2).sum(2)
        assert (d == all_.min(1)).all() and (who == all_.argmin(1)).all()


# --- exact dedup


@pytest.mark.parametrize("n,span", [(1, 1 << 40), (1000, 1 << 30), (1000, 1000), (1000, 4096), (3, 1 << 62)])
def test_golomb_round_trip(n, span):
    draw = random.Random(n)
    values = np.array(sorted(draw.sample(range(min(span, 1 << 60)), n)), np.int64)
    shift = modulus_bits(span, n)
    gaps = np.diff(values, prepend=-1) - 1
    code = golomb(gaps, shift)
    assert (golomb_decoded(code, n, shift) == gaps).all()
    assert len(code) * 8 <= n * (np.log2(span / n) + 2.6) + 24


def test_owner_answers_each_message():
    width = 20
    draw = random.Random(2)
    held = {s: [draw.randrange(1 << 24) if draw.random() < 0.7 else draw.randrange(50) for _ in range(400)] for s in range(5)}
    sent = pa.concat_tables([_messages(pa.table({"sender": pa.array([s] * len(v), pa.int64()), "fp": pa.array(v, pa.int64())}), width) for s, v in held.items()])
    times = collections.Counter(x for v in held.values() for x in v)
    for owner in set(sent["owner"].to_pylist()):
        answer = _bitmaps(sent.filter(pa.compute.equal(sent["owner"], owner)))
        for sender, bits in zip(answer["sender"].to_pylist(), answer["bits"].to_pylist()):
            own = sorted({x for x in held[sender] if x >> width == owner})
            assert np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).tolist() == [int(times[x] > 1) for x in own]


@pytest.mark.parametrize("spare_bits,owner_rows", [(12, 1 << 22), (-6, 1 << 22), (12, 7)])
def test_exact_dedup(spark, spare_bits, owner_rows):
    """Also with fingerprints so short that most suspects are no copies, and with many owners."""
    draw = random.Random(4)
    rows = [(i, draw.choice(["same", "Same", "same ", f"text {draw.randrange(300)}", "é" * draw.randrange(4)])) for i in draw.sample(range(-2000, 2000), 900)]
    rows += [(5000, None), (5001, ""), (5002, "long " * 400_000), (5003, "long " * 400_000), (None, "only here"), (None, "same"), (None, "twice"), (None, "twice"), (7000, "again"), (7000, "again"), (7000, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumns({"fp": F.lit("x"), "place": F.lit(1), "sender": F.lit(2), "kept": F.lit(3)})
    got = exact_dedup(df, owner_rows, spare_bits).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (sorted(ids, key=lambda i: (i is not None, i)), max((i for i in ids if i is not None), default=None)) for t, ids in groups.items()}
    found = collections.defaultdict(list)
    for r in got:
        found[r.text_sha256].append(r)
    assert len(got) == len(rows) and found.keys() == want.keys()
    for digest, (ids, keep) in want.items():
        assert sorted((r.doc_id for r in found[digest]), key=lambda i: (i is not None, i)) == ids
        assert {(r.keep_id, r.group_size) for r in found[digest]} == {(keep, len(ids))}
        assert [r.doc_id for r in found[digest] if r.kept] == [keep]
    assert exact_dedup(df.limit(0)).count() == 0


def test_one_text_in_every_row(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', CAST(id AS STRING)) AS text")
    got = exact_dedup(df)
    assert got.where("kept").count() == 5000 - 1666 and got.where("group_size = 1667 AND keep_id = 4998").count() == 1667


# --- source divergence


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = collections.defaultdict(collections.Counter)
        for _, source, terms in mine:
            count[source].update(t for t in terms if t in kept)
            count[None].update(t for t in terms if t in kept)
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source in share.keys() - {None}:
            pair = [(b, sum(f(share[source][t], share[b][t]) for t in kept)) for b in share.keys() - {None, source}]
            term = [(t, f(share[source][t], share[None][t])) for t in kept if count[source][t] and share[source][t] > share[None][t]]
            for part, items in (("pair", pair), ("term", term)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, source, part, item, value, rank))
    return out


def test_divergence(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "naïve", "x", "X", "語"]
    rows = [(" ".join(draw.choice(words[: draw.randrange(2, 46)]) + draw.choice(["", ".", "1"]) for _ in range(draw.randrange(30))), draw.choice(["en", "fr"]), f"s{draw.randrange(9)}") for _ in range(400)]
    rows += [(None, "en", "empty"), ("", "zz", None), ("word " * 3, "zz", "a"), ("lone", None, None), ("w1 " * 200_000, "fr", "s1"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "a": F.lit(2), "v": F.lit(3), "value": F.lit(4)})
    got = [tuple(r) for r in divergence(df, 5, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 5, 4)
    assert divergence(df.limit(0)).count() == 0


def test_tree_shares_paths():
    """Three rows a-b-c, a-b, a-d: the node b is met once, for two rows."""
    lengths, name = np.array([3, 2, 2]), np.array([1, 2, 3, 1, 2, 1, 4])
    # sorted rows: a-b, a-b-c, a-d
    lengths, name = np.array([2, 3, 2]), np.array([1, 2, 1, 2, 3, 1, 4])
    found = [tuple(map(int, t)) for part in tree_nodes(lengths, (name, name * 0), np.zeros(3, int), np.array([5, 7, 1])) for t in zip(*part)]
    assert sorted((int(name[a]), int(name[b]), n) for a, b, n in found) == [(1, 2, 12), (1, 3, 7), (1, 4, 1), (2, 3, 7)]

import random

from pyspark.sql import functions as F

from sessionlab.operators import scan as X
from sessionlab.operators.streaks import anchored_streak, sliding_streak


def rows(seed, n=120, keys=3):
    rng = random.Random(seed)
    out = []
    for k in range(keys):
        for o in range(rng.randint(1, n)):
            out.append((k, o, rng.randint(0, 9) if rng.random() < 0.6 else None))
    rng.shuffle(out)
    return out


def test_steps_equal_a_plain_loop(spark):
    data = rows(3)
    df = X.slabs(spark.createDataFrame(data, "k int, o bigint, v int"), F.floor(F.col("o") / 7).cast("long"))
    out = X.step(df, ["k"], ["o"], p=X.prev_row(F.col("v")), c=X.carry(F.col("v")), h=X.carry_here(F.col("v")), s=X.running_sum(F.coalesce("v", F.lit(0))), m=X.running_max(F.col("v")))
    got = {(r.k, r.o): (r.p, r.c, r.h, r.s, r.m) for r in out.collect()}
    want = {}
    for k in {r[0] for r in data}:
        prev = last = top = None
        total = 0
        for _, o, v in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            total += v or 0
            here = v if v is not None else last
            want[(k, o)] = (prev, last, here, total, top)
            prev, last = v, here
            top = v if top is None else top if v is None else max(top, v)
    assert got == want


def test_numbering_is_gap_free(spark):
    data = [(k, t) for k in range(3) for t in random.Random(k).sample(range(1000), 50)]
    out = X.number_rows(spark.createDataFrame(data, "k int, t bigint"), ["k"], ["t"], F.floor(F.col("t") / 100).cast("long"), "n")
    for k in range(3):
        assert [r.n for r in out.filter(F.col("k") == k).orderBy("t").collect()] == list(range(1, 51))


def test_halo_gives_every_row_its_past(spark):
    data = [(1, t) for t in random.Random(1).sample(range(0, 2000), 300)]
    need = X.halo(spark.createDataFrame(data, "k int, t bigint"), ["k"], "t", 100, back=35)
    out = X.sql("SELECT t, n FROM (SELECT *, count(*) OVER (PARTITION BY k, _slab ORDER BY t RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS n FROM {n}) WHERE _own", n=need).collect()
    times = [t for _, t in data]
    assert {r.t: r.n for r in out} == {t: sum(t - 35 <= u <= t for u in times) for t in times}


def test_streaks_equal_a_plain_loop(spark):
    rng = random.Random(5)
    data, want_a, want_s = [], set(), set()
    for s in range(3):
        ns, count, first, run, last = 0, 0, None, 0, None
        for o in range(200):
            ns += rng.randint(1, 8) * 10**6
            bad = rng.random() < 0.7
            data.append((s, o, ns, bad))
            if not bad:
                count, first, run, last = 0, None, 0, None
                continue
            if first is None or ns - first > 20 * 10**6:
                count, first = 0, ns
            count += 1
            if count == 3:
                want_a.add((s, o))
                count, first = 0, None
            run = 0 if last is not None and ns - last > 6 * 10**6 else run
            run, last = run + 1, ns
            if run == 3:
                want_s.add((s, o))
                run = 0
    df = spark.createDataFrame(data, "session bigint, ordinal bigint, ns bigint, suspicious boolean")
    assert {(r.session, r.ordinal) for r in anchored_streak(df, 20, 3, rows=16).collect()} == want_a
    assert {(r.session, r.ordinal) for r in sliding_streak(df, 6, 3, rows=16).filter("alert").collect()} == want_s

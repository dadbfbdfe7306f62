"""The tick budget against its rules applied row by row, over slabs so short that alerts cross them."""

import random

import pytest
from build import MS, event, frame

from sessionlab import schemas as S
from sessionlab.operators.budget import timer_budget


def plain(events):
    out = []
    for session in sorted({e["session"] for e in events}):
        s = {}
        for e in sorted((e for e in events if e["session"] == session), key=lambda e: e["ordinal"]):
            ns = e["ns"]
            if e["kind"] not in (S.MOVE, S.CORRECTION, S.TELEPORT, S.SESSION_START):
                continue
            if e["kind"] != S.MOVE or not e["available"] or not 0 <= e["sampled_ns"] - ns <= 100 * MS or e["packet"] <= s.get("packet", 0):
                s = {}
                continue
            if "last" not in s or not 0 <= ns - s["last"] < 750 * MS:
                s = dict(packet=e["packet"], last=ns, ready=ns + 1000 * MS, balance=-250 * MS, n=0, run=[])
                continue
            passed, s["packet"], s["last"] = ns - s["last"], e["packet"], ns
            if ns < s["ready"]:
                continue
            if "begun" not in s:
                s["begun"], passed = ns, 0
            s["balance"] = min(5000 * MS, max(-250 * MS, s["balance"] - passed) + 50 * MS)
            s["n"] += 1
            s["run"] = s["run"] + [ns] if s["balance"] > 250 * MS else []
            if s["n"] >= 40 and ns - s["begun"] >= 2000 * MS and len(s["run"]) >= 8 and ns - s["run"][0] >= 500 * MS:
                out.append((session, e["ordinal"], ns, s["balance"] / 1e6, s["n"], (ns - s["begun"]) / 1e6))
                s["balance"], s["run"] = 0, []
    return out


def hasty(seed, n=1500, sessions=4):
    """Sessions of different speed, the second without any break, with stale packets in runs, gaps, steps back and resets."""
    rng, out = random.Random(seed), []
    for s in range(1, sessions + 1):
        ns, packet, falling, mean = 0, 0, False, (50, 30, 44, 36)[s - 1]
        for o in range(1, n + 1):
            odd = s != 2 and rng.random() < 0.004
            ns += (rng.choice([900, -40]) if odd else rng.choice([mean - 15, mean, mean, mean + 15])) * MS
            falling = s != 2 and rng.random() < (0.6 if falling else 0.004)
            packet += rng.randint(-2, 0) if falling else rng.randint(1, 3)
            kind = S.MOVE if s == 2 else rng.choices([S.MOVE, S.ATTACK, S.CORRECTION, S.TELEPORT], [95, 4, 0.2, 0.1])[0]
            out.append(event(s, o, ns, kind, packet=packet, sampled_ns=ns + (200 * MS if s != 2 and rng.random() < 0.001 else 5)))
    return out


@pytest.mark.parametrize("rows", [40, 65536])
def test_budget_equals_its_rules(spark, rows):
    events = hasty(5)
    want = plain(events)
    assert len({w[0] for w in want}) >= 3 and sum(w[0] == 2 for w in want) > 10
    assert sorted(map(tuple, timer_budget(frame(spark, events), rows=rows).collect())) == want


def test_budget_forgets_unusable_rows_and_takes_empty_tables(spark):
    assert timer_budget(frame(spark, [event(1, 1, 0, S.MOVE)]).limit(0)).count() == 0
    events = [event(1, i + 1, i * 25 * MS, S.MOVE, available=None if i % 100 == 99 else True, packet=None if i % 70 == 69 else i + 1) for i in range(600)]
    got = timer_budget(frame(spark, events), rows=64).count()
    for e in events:
        e["available"], e["packet"] = e["available"] or False, e["packet"] or 0
    assert got == len(plain(events))


def test_no_window_of_the_budget_holds_a_session(spark):
    # a session without a break is cut: no slab has more moves than it may
    from sessionlab.operators.budget import budget_moves, budget_units
    events = [e for e in hasty(5) if e["session"] == 2]
    units = budget_units(budget_moves(frame(spark, events)), 1000 * MS, 750 * MS, 40)
    sizes = units.selectExpr("unit", "floor(at / 40) AS slab").groupBy("unit", "slab").count().collect()
    assert len({r.unit for r in sizes}) == 1 and len(sizes) > 30 and max(r["count"] for r in sizes) <= 40

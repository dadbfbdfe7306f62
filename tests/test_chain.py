"""Chains of hops over slabs, and what is built on them, against plain loops."""

import random

import pytest

from build import MS, frame, messy
from sessionlab import schemas as S
from sessionlab.operators.scan import chain
from sessionlab.operators.streaks import anchored_streaks
from sessionlab.operators.timer import timer_episodes


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_chain(spark, rows):
    """One key holds most rows; hops may be longer than a slab."""
    draw = random.Random(rows)
    hops = {k: [draw.choice([1, 1, 2, 3, 19]) for _ in range(n)] for k, n in ((1, 500), (2, 1), (3, 40))}
    df = spark.createDataFrame([(k, f"s{k % 2}", i + 1, h) for k, hs in hops.items() for i, h in enumerate(hs)], "k bigint, name string, at bigint, hop bigint")
    got = {k: set() for k in hops}
    for r in chain(df, ["k", "name"], "at", "hop", rows).filter("_on").collect():
        got[r.k].add(r["at"])
    for k, hs in hops.items():
        want, at = set(), 0
        while at < len(hs):
            want.add(at + 1)
            at += hs[at]
        assert got[k] == want
    assert chain(df.limit(0), ["k"], "at", "hop", rows).count() == 0


def plain_alerts(samples, window, needed):
    """Alerts of one session and check: the anchored window, sample by sample."""
    held, out = [], []
    for ordinal, ns, bad in samples:
        if not bad:
            held = []
            continue
        held.append((ordinal, ns))
        while not 0 <= held[-1][1] - held[0][1] <= window:
            held = held[next(i for i, (_, t) in enumerate(held) if not 0 <= t - held[0][1] <= window):]
        if len(held) == needed:
            out.append((ordinal, ns, needed, held[0][0]))
            held = []
    return out


@pytest.mark.parametrize("rows", [3, 65536])
def test_streaks_of_several_checks(spark, rows):
    draw, data, want = random.Random(3), [], set()
    for session in range(4):
        for check, window, needed in (("a", 100, 3), ("b", 40, 2), ("c", 1000, 1), ("d", 200, 5)):
            ns, samples = 0, []
            for o in range(1, draw.choice([5, 120])):
                ns += draw.choice([5, 20, 30, -10 if draw.random() < 0.2 else 60])
                samples.append((o, ns, draw.random() < 0.85))
            data += [(session, check, o, t, bad, window, needed) for o, t, bad in samples]
            want |= {(session, check, *a) for a in plain_alerts(samples, window, needed)}
    df = spark.createDataFrame(data, "session bigint, check string, ordinal bigint, ns bigint, suspicious boolean, window_ns bigint, needed int")
    got = anchored_streaks(df, ["session", "check"], 5, rows)
    assert {tuple(r) for r in got.select("session", "check", "ordinal", "ns", "samples", "first_sample").collect()} == want


def segments_by_hand(events):
    """Receive times of the moves of each segment, by session."""
    out = {}
    for e in events:
        segments, state = out.setdefault(e["session"], ([], {"last": None, "packet": None}))
        if e["kind"] in (S.CORRECTION, S.SESSION_START) or e["kind"] == S.MOVE and e["sampled_ns"] - e["ns"] > 100 * MS:
            state.update(last=None, packet=None)
        elif e["kind"] == S.MOVE:
            if state["packet"] is not None and e["packet"] <= state["packet"]:
                state.update(last=None, packet=None)
                continue
            if state["last"] is None or not 0 <= e["ns"] - state["last"] < 750 * MS:
                segments.append([])
            segments[-1].append(e["ns"])
            state.update(last=e["ns"], packet=e["packet"])
    return {k: v[0] for k, v in out.items()}


@pytest.mark.parametrize("rows", [16, 65536])
def test_episodes_equal_the_fold(spark, rows):
    """Divided into slabs of 16 rows, a session gives the episodes that one pass in order gives."""
    events = messy(11, 1500)
    got = {(r.session, r.start_ns, r.end_ns, tuple(r.counts)) for r in timer_episodes(frame(spark, events), 300 * MS, 3, 300 * MS, rows=rows).collect()}
    want = set()
    for session, moves in segments_by_hand(events).items():
        for segment in moves:
            at = 0
            while True:
                start = segment[at]
                end = next((i for i in range(at + 1, len(segment)) if segment[i] >= start + 1200 * MS), None)
                if end is None:
                    break
                counts = [sum(start + 300 * MS * (b + 1) <= t < start + 300 * MS * (b + 2) for t in segment[at:end]) for b in range(3)]
                want.add((session, start, segment[end], tuple(counts)))
                at = end
    assert got == want and len(want) > 20

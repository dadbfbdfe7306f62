import pandas as pd
import pytest

from build import MS, event, frame, messy, moves
from sessionlab import schemas as S
from sessionlab.operators.features import attack_features, dataset_windows
from sessionlab.operators.models import tail_rank
from sessionlab.operators.segments import segment_obs
from sessionlab.operators.stress import batch_receive, perturb_moves
from sessionlab.operators.budget import timer_budget
from sessionlab.operators.timer import assess_episodes, score_episodes, timer_episodes
from sessionlab.operators.windows import behavior_windows
from sessionlab.streaming.stream import LiveWindows

ARGS = (800 * MS, 100 * MS, 750 * MS, 100 * MS)
SHOWN = ["session", "segment", "k", "start_ns", *S.BEHAVIOR_FEATURES]


def by_hand(events, args=ARGS, step=17):
    """Windows of the live form, fed a few events at a time."""
    frames, out = pd.DataFrame(events), []
    for session, mine in frames.groupby("session", sort=False):
        machine = LiveWindows(*args)
        for at in range(0, len(mine), step):
            out += machine.feed(mine.iloc[at : at + step].reset_index(drop=True)).assign(session=session).to_dict("records")
    return sorted(tuple(round(w[c], 7) for c in SHOWN) for w in out)


def test_the_live_form_does_not_depend_on_batches():
    assert by_hand(messy(5), step=1) == by_hand(messy(5), step=7) == by_hand(messy(5), step=10_000)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sql_windows_equal_the_state_machine(spark, seed):
    events = messy(seed)
    got = behavior_windows(frame(spark, events), *ARGS, rows=16).select(*SHOWN).collect()
    want = by_hand(events)
    assert len(want) > 3
    assert sorted(tuple(round(v, 7) for v in r) for r in got) == want


def test_segments_do_not_depend_on_the_slab_size(spark):
    obs = frame(spark, messy(11))
    small, large = (sorted(tuple(r) for r in segment_obs(obs, rows=n).filter("kind = 11").collect()) for n in (8, 100_000))
    assert small == large and len(small) > 500


def test_a_pause_restarts_the_window(spark):
    got = behavior_windows(frame(spark, moves(1500, pause_at=400))).collect()
    assert len(got) == 1 and got[0].movement_pps == 20


def test_one_episode(spark):
    ep = timer_episodes(frame(spark, moves(3601)), rows=500).collect()
    assert [(e.packets, e.score, e.first_window_ns) for e in ep] == [(3400, 20.0, 5_000_000_000)]
    broken = moves(3601)
    broken[2000]["available"] = False
    assert timer_episodes(frame(spark, broken)).count() == 0


def test_score_needs_three_high_buckets(spark):
    def score(counts):
        df = spark.createDataFrame([(1, 0, counts, 1)], "session bigint, start_ns bigint, counts array<bigint>, end_ns bigint")
        return score_episodes(df, 5_000 * MS, 34, 5_000 * MS).first().score
    assert score([100] * 10 + [200] + [100] * 23) == 20
    assert score([100] * 10 + [107] * 3 + [100] * 21) == pytest.approx(21.4)


def test_tail_and_spending(spark):
    ep = spark.createDataFrame([(1, 0, 21.4, 3638, 11900.0), (1, 9, 21.4, 3638, 11900.0), (2, 0, 21.4, 3638, 500.0)], "session bigint, start_ns bigint, score double, packets bigint, excess_ms double")
    few = spark.createDataFrame([(20.0,)] * 9, "score double")
    assert {r.reason for r in assess_episodes(ep, few).collect()} == {"insufficient_reference"}
    many = spark.createDataFrame([(20.0,)] * 1999, "score double")
    got = {(r.session, r.episode): r.eligible for r in assess_episodes(ep, many).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False}
    ranks = tail_rank(spark.createDataFrame([(1, 21.4), (2, 20.0), (3, None)], "id int, score double"), few)
    assert {r.id: r.tail_p for r in ranks.collect()} == {1: 0.1, 2: 1.0, 3: None}


@pytest.mark.parametrize("speed,found", [(1.0, False), (1.07, True), (1.5, True)])
def test_tick_budget(spark, speed, found):
    assert (timer_budget(frame(spark, moves(900, 50 / speed)), rows=100).count() > 0) == found


def test_attack_cadence(spark):
    regular = [event(1, i + 1, i * 100 * MS, S.ATTACK) for i in range(100)]
    r = attack_features(frame(spark, regular), rows=16).first()
    assert (r.eligible, r.interval_cv, r.interval_entropy_bits, r.repeat_within_1ms) == (True, 0, 0, 1)
    stuck = [event(1, i + 1, 5, S.ATTACK) for i in range(100)]
    assert attack_features(frame(spark, stuck)).first().reason == "batched_or_unordered"


def test_transforms_keep_the_snapshot_age(spark):
    obs = frame(spark, [event(1, i + 1, i * 50 * MS + 7 * MS, S.MOVE, sampled_ns=i * 50 * MS + 7 * MS + 100) for i in range(6)])
    a = batch_receive(obs, 100 * MS).orderBy("ordinal").collect()
    assert all(r.ns % (100 * MS) == 0 and r.sampled_ns - r.ns == 100 for r in a)
    b = perturb_moves(obs, "batch_100ms").orderBy("ordinal").collect()
    assert b[1].ns == b[2].ns == 107 * MS and all(r.sampled_ns - r.ns == 100 for r in b)


def test_dataset_windows_drop_boundaries(spark):
    events = moves(900)
    trials = spark.createDataFrame([("1", 0, 45_000 * MS, 5000)], "trial_id string, start_observed_ns bigint, end_observed_ns bigint, guard_ms bigint")
    assert dataset_windows(frame(spark, events), trials).count() == 7
    events[300]["kind"] = S.CORRECTION
    assert dataset_windows(frame(spark, events), trials).count() == 6


@pytest.mark.parametrize("shift", [0, 1_234_567])
def test_cadence_does_not_depend_on_where_pauses_lie(spark, shift):
    beats = [t * 1000 + (900_000 if t >= 120 else 0) + shift for t in range(240)]
    obs = spark.createDataFrame([("a", i, b * MS, 7) for i, b in enumerate(beats)], "trial string, ordinal bigint, ns bigint, kind int")
    wide, narrow = (attack_features(obs, rows=n).first() for n in (65536, 7))
    assert wide.interval_cv == pytest.approx(narrow.interval_cv) and wide.interval_cv > 10
    assert (wide.attacks, wide.repeat_within_1ms) == (240, pytest.approx(236 / 238))

"""Live detectors over disordered, repeated and late deliveries, against the batch form on the same events."""

import random

from build import MS, event, frame
from pyspark.sql import Row
from pyspark.sql.types import LongType, StructField, StructType
from sessionlab import schemas as S
from sessionlab.operators import checks
from sessionlab.operators.detectors import DetectorConfig
from sessionlab.streaming import detect

EPOCH = 1_700_000_000_000


def session(number, seed):
    """A player who breaks rules now and then: far attacks, early digs, fast clicks, quick ticks, odd motion."""
    draw, out, ns, o = random.Random(seed), [], 0, 1
    out.append(event(number, 1, 0, S.SESSION_START, player=f"p{number}", protocol=47, model=10808, epoch_ms=EPOCH))
    y = 200.0

    def add(kind, step, **more):
        nonlocal ns, o
        ns, o = ns + int(step * MS), o + 1
        out.append(event(number, o, ns, kind, player=f"p{number}", epoch_ms=EPOCH + ns // MS, **more))

    for _ in range(3):
        for i in range(60):
            box = dict(eye_x=0.0, eye_y=1.0, eye_z=0.0, low_x=3.6, low_y=0.0, low_z=-0.3, high_x=4.2, high_y=2.0, high_z=0.3, target="t", target_id=5, yaw=draw.choice([-90.0, 90.0]))
            add(S.ATTACK if i % 10 == 9 else S.COMBAT, 50, **box)
        for _ in range(4):
            for action in (0, 2):
                add(S.DIG, 200, action=action, bx=1, by=2, bz=3, state_key="s", damage=0.05)
        for i in range(130):
            add(S.ATTACK, 77 if draw.random() < 0.995 else 600, target="u", target_id=6)
        for i in range(80):
            y -= 0.5 if i % 20 else 0
            add(S.MOVE, 25, x=i * 1.1, y=y, flat=False, source=False, destination=False)
        add(draw.choice([S.TICK, S.RESET, S.TELEPORT]), 50)
    add(S.SESSION_END, 50)
    return out


def found(df):
    return sorted((r.session, r.ordinal, r.ns, r.epoch_ms, r.player, r.check, tuple(sorted(r.evidence.items()))) for r in df.collect())


def test_disordered_triggers_equal_the_batch(spark, tmp_path):
    """Two triggers; each event comes in the trigger of its time or the one after, some twice; some ordinals never."""
    draw = random.Random(1)
    events = [e for n in (1, 2) for e in session(n, 10 + n)]
    lost = {(e["session"], e["ordinal"]) for e in events if draw.random() < 0.004 and e["kind"] not in (S.SESSION_START, S.SESSION_END)}
    events = [e for e in events if (e["session"], e["ordinal"]) not in lost]
    length = max(e["ns"] for e in events) + 1
    # another session's late tick moves the watermark past everything
    last = [event(9, n, n * 10 * length, S.TICK, epoch_ms=EPOCH + n * 10 * length // MS) for n in (1, 2)]
    parts = [[], [], last[:1], last[1:]]
    for e in events:
        part = min(1, e["ns"] * 2 // length + (draw.random() < 0.2))
        parts[part].append(e)
        if draw.random() < 0.1:
            parts[min(1, part + 1)].append(e)
    cfg = DetectorConfig(enabled=("fastbreak", "reach", "autoclicker", "fly", "nofall", "hitboxes", "velocity", "timer"))
    folder = str(tmp_path)
    for i, part in enumerate(parts):
        draw.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live = spark.readStream.schema(frame(spark, []).schema).parquet(f"{folder}/in")
        detect.stream_detect(live, folder, cfg, delay=f"{length // MS} milliseconds")
    got = found(spark.read.parquet(f"{folder}/findings").filter("session < 9"))
    want = found(checks.detect_all(frame(spark, events + last), cfg).filter("session < 9"))
    assert len({w[5] for w in want}) >= 5 and len(lost) > 0
    assert got == want


def test_gate_and_gaps(spark):
    """Only the modelled client is judged, and a gap of ordinals resets like a boundary."""
    rows = [*session(1, 5), *[dict(e, session=2, protocol=5 if e["kind"] == S.SESSION_START else None) for e in session(1, 5)]]
    seen = checks.admitted(frame(spark, rows + rows[:40]))
    assert seen.count() == len(session(1, 5)) + sum(e["kind"] in (1, 2, 3) for e in session(1, 5))
    gap = checks.admitted(frame(spark, [e for e in session(1, 5) if e["ordinal"] not in (10, 11)]))
    assert [(r.ordinal, r.kind) for r in gap.filter("ordinal BETWEEN 9 AND 12").orderBy("ordinal").collect()][1:2] == [(11, S.RESET)]


class Store:
    """The states of one key, and how often they are called."""

    def __init__(self):
        self.calls, self.timers, self.states, self.mark = 0, set(), {}, 0

    def state(self, name, *schema):
        self.states[name] = {}
        return State(self, self.states[name])

    getMapState = getListState = getValueState = state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


class State:
    def __init__(self, store, kept):
        self.store, self.kept = store, kept

    def __getattribute__(self, name):
        if name not in ("store", "kept"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept.get("")

    def update(self, value):
        self.kept[""] = value

    put = update

    def clear(self):
        self.kept.clear()

    def containsKey(self, key):
        return key in self.kept

    def getValue(self, key):
        return self.kept[key]

    def updateValue(self, key, value):
        self.kept[key] = value

    def removeKey(self, key):
        self.kept.pop(key, None)

    def iterator(self):
        return iter(self.kept.items())


FIELDS = ("session", "ordinal", "ns", "epoch_ms", "kind")


def ordered(store):
    order = detect.InOrder(StructType([StructField(f, LongType()) for f in FIELDS]), 100, 0, 10_000_000)
    order.init(store)

    def brought(*ordinals):
        return [r.ordinal for r in order.handleInputRows((1,), iter([Row("ts", *FIELDS)(None, 1, o, o, 10 * o, S.TICK) for o in ordinals]), store) if r.fresh]

    def passed(mark):
        store.mark, out = mark, []
        for at in sorted(t for t in store.timers if t <= mark):
            out += [r.ordinal for r in order.handleExpiredTimer((1,), store, None) if r.fresh]
            store.timers.remove(at)
        return out

    return brought, passed


def test_late_events_go_through_state_in_blocks():
    """Half of a session comes late: the calls of the state store go with blocks and triggers, not with events."""
    store, draw = Store(), random.Random(3)
    brought, _ = ordered(store)
    first = [o for o in range(1, 4001) if draw.random() < 0.5 and o != 1]
    rest = sorted({*range(1, 4001)} - {*first})
    draw.shuffle(first)
    draw.shuffle(rest)
    assert brought(*first) == [] and brought(*first[:50]) == []
    assert brought(*rest, *first[50:90]) == [*range(1, 4001)]
    assert store.calls < 150 and not store.states["held"] and brought(*first[:100]) == []


def test_the_watermark_passes_gaps_one_by_one():
    store = Store()
    brought, passed = ordered(store)
    assert brought(*range(700, 1, -1)) == [] and len(store.timers) == 1
    assert brought(*range(702, 1500), 2) == []
    assert passed(20) == [] and passed(21) == [*range(2, 701)]
    assert passed(7_000) == [] and passed(7_021) == [*range(702, 1500)] and not store.states["held"]
    assert brought(1, 701, 1500) == [1500]
    assert passed(10_000_000 + 15_000) == [] and not any(store.states.values())


def test_only_columns_that_checks_read_go_through_state(spark):
    live = spark.readStream.format("rate").load().selectExpr("value AS session", "value AS ordinal", "value AS ns", "value AS epoch_ms", "7 AS kind", "value AS packet", "value AS unread", "timestamp AS ts")
    columns = lambda *names: detect.in_order(live, checks.registry(DetectorConfig(enabled=names))).columns
    with detect.typed_state(spark):
        assert "packet" in columns("autoclicker") and "unread" not in columns("autoclicker") and "unread" in columns("autoclicker", "reach")

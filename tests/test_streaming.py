import pytest

from build import MS, event, frame, messy
from sessionlab import schemas as S
from sessionlab.operators import detectors as X
from sessionlab.operators.segments import ordinal_guard
from sessionlab.operators.streaks import anchored_streak
from sessionlab.streaming import stream
from test_windows import ARGS, SHOWN, by_hand


def test_windows_across_triggers_equal_the_batch(spark, tmp_path):
    events = [e for e in messy(7)]
    events.sort(key=lambda e: e["ordinal"])
    obs = frame(spark, events)
    for part in range(3):
        obs.filter(f"ordinal > {part * 134} AND ordinal <= {(part + 1) * 134}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
        out = stream.stream_behavior_windows(live, *ARGS)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(round(v, 7) for v in r) for r in spark.read.parquet(str(tmp_path / "out")).select(*SHOWN).collect())
    assert got == by_hand(events)


def test_a_replayed_trigger_adds_no_decision(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, x int")
    for _ in range(2):
        stream.append_new(spark, rows, str(tmp_path / "log"), ["id"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_a_trigger_reads_only_its_days_of_the_log(spark, tmp_path):
    log, day = tmp_path / "log", 86_400_000
    def add(*rows):
        stream.append_new(spark, spark.createDataFrame(list(rows), "id string, t bigint"), str(log), ["id"], "t")
    add(("a", 5), ("b", day + 5), ("c", None))
    add(("b", day + 5), ("d", day + 6), ("c", None), ("d", day + 6))
    assert sorted(tuple(r) for r in spark.read.parquet(str(log)).select("id", "day").collect()) == [("a", 0), ("b", 1), ("c", -1), ("d", 1)]
    for f in (log / "day=0").glob("*.parquet"):  # nothing of the first day can be read any more
        f.write_bytes(b"broken")
    add(("b", day + 5), ("e", day + 7), ("f", 2 * day))
    add()
    later = spark.read.option("basePath", str(log)).parquet(str(log / "day=1"), str(log / "day=2"))
    assert sorted(r.id for r in later.collect()) == ["b", "d", "e", "f"]


def test_delivery_order_rules(spark):
    rows = [(1, 1, 1), (1, 2, 2), (1, 4, 3), (1, 4, 4), (1, 3, 5), (1, 5, 6)]
    got = ordinal_guard(spark.createDataFrame(rows, "session bigint, ordinal bigint, arrival bigint"), rows=2).orderBy("arrival").collect()
    assert [(r.drop, r.reset_before) for r in got] == [(False, False), (False, False), (False, True), (True, True), (True, True), (False, False)]


def knocked(share, ack=True):
    """Falling in clear air with an acknowledged horizontal push every 40 moves; ``share`` of it shows."""
    out, o, t, x, y, vx, vy = [], 0, 0, 0.0, 500.0, 0.0, 0.0
    for i in range(170):
        if i % 40 == 20:
            o += 1
            out.append(event(1, o, t + MS, S.IMPULSE, token=i, vx=1.0, vy=vy, vz=0.0, additive=False))
            if ack:
                o += 1
                out.append(event(1, o, t + 2 * MS, S.IMPULSE_ACK, token=i))
            vx = 1.0 * share
        else:
            vx, vy = vx * 0.91, (vy - 0.08) * 0.98
        x, y, t, o = x + vx, y + vy, t + 50 * MS, o + 1
        out.append(event(1, o, t, S.MOVE, x=x, y=y, source=False, destination=False, flat=False))
    return out


@pytest.mark.parametrize("share,ack,found", [(1.0, True, False), (0.3, True, True), (0.3, False, False)])
def test_impulse_response(spark, share, ack, found):
    v = X.velocity_samples(frame(spark, knocked(share, ack)))
    assert (anchored_streak(v, 15000, 3).count() > 0) == found

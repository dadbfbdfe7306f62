"""Live detectors: the checks of ``operators.checks`` over a stream that may be late, repeated and out of order.

Two streaming queries with typed state, and a table of samples between them:

* ``in_order`` holds back events until those before them have come (or the watermark says they won't), drops repeats and
  late ones, and hands on each run of a session with the bounded past its checks look at. That past is state: no log is
  read again. ``write_samples`` runs the checks' DataFrame form over such a run and writes the samples of its new events
  under the number of the trigger, so a replayed trigger replaces its own.
* ``follow`` keeps, per session and check, what outlives any bounded past (streak windows, runs of click intervals, the
  tick balance) and turns samples into findings. It ignores ordinals it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter
from statistics import fmean, median, pstdev

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from .. import schemas as S
from ..operators.budget import BUDGET
from ..operators.checks import BOUNDS, FINDING, Check, admitted, registry, samples
from ..operators.detectors import AutoClicker, DetectorConfig
from ..operators.folds import BudgetFold
from ..operators.scan import cut


class InOrder(StatefulProcessor):
    """Per session: ``held`` events that wait for earlier ones, in blocks of ordinals, the ``recent`` ones that checks may still
    look at, and the ``place`` reached: last ordinal handed on, newest time, and the time up to which events are settled (their
    samples do not depend on later events any more). ``due`` is the timer of the earliest held event.

    A call of the state store costs as much as many rows, so blocks and runs go through it, not single events.
    """

    BLOCK = 256

    def __init__(self, schema: StructType, back_ns: int, ahead_ns: int, ttl_ms: int):
        self.schema, self.back, self.ahead, self.ttl = schema, back_ns, ahead_ns, ttl_ms
        self.names = schema.names
        self.o, self.t, self.e, self.k = (self.names.index(n) for n in ("ordinal", "ns", "epoch_ms", "kind"))

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block bigint", StructType([StructField("events", ArrayType(self.schema))]))
        self.recent = handle.getListState("recent", self.schema)
        self.place = handle.getValueState("place", "ordinal bigint, newest bigint, settled bigint, epoch_ms bigint")
        self.due = handle.getValueState("due", "epoch_ms bigint")
        self.given, self.taken = Row(*self.names, "fresh", "settles"), None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = self.place.get()
        last = place[0] if place else 0
        new = {}
        for row in rows:
            if self.taken is None:
                self.taken = itemgetter(*(row.__fields__.index(n) for n in self.names))
            event = self.taken(row)
            if event[self.o] > last:
                new.setdefault(event[self.o], event)
        blocks, changed, waiting = {}, set(), self.held.exists()

        def block(ordinal: int) -> dict[int, tuple]:
            n = ordinal // self.BLOCK
            if n not in blocks:
                blocks[n] = self._events(self.held.getValue((n,))) if waiting and self.held.containsKey((n,)) else {}
            return blocks[n]

        ready = []
        while True:
            kept = block(last + 1).pop(last + 1, None)
            if kept is not None:
                changed.add((last + 1) // self.BLOCK)
            event = new.pop(last + 1, None) if kept is None else kept
            if event is None:
                break
            last += 1
            ready.append(event)
        late = {o: event for o, event in new.items() if o > last and o not in block(o)}
        for ordinal, event in late.items():
            block(ordinal)[ordinal] = event
            changed.add(ordinal // self.BLOCK)
        for n in changed:
            self._hold(n, blocks[n])
        if late:
            self._await(min(event[self.e] for event in late.values()), timerValues.getCurrentWatermarkInMs())
        yield from self._hand_on(ready, place, timerValues)

    def _events(self, value: tuple) -> dict[int, tuple]:
        return {event[self.o]: tuple(event) for event in value[0]}

    def _hold(self, n: int, events: dict[int, tuple]) -> None:
        if events:
            self.held.updateValue((n,), (list(events.values()),))
        else:
            self.held.removeKey((n,))

    def _await(self, earliest: int, mark: int) -> None:
        """A timer for the earliest held event is enough: when it ends, the next is set."""
        at, due = max(earliest, mark) + 1, self.due.get()
        if not due or due[0] <= mark or at < due[0]:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The watermark passed a held event: what is missing before it will not come. Or the session has been idle for long."""
        place = self.place.get()
        mark = timerValues.getCurrentWatermarkInMs()
        blocks = {k[0]: self._events(value) for k, value in self.held.iterator()}
        held = {o: event for events in blocks.values() for o, event in events.items()}
        last = due = max((o for o, event in held.items() if event[self.e] < mark), default=0)
        while due and last + 1 in held:
            last += 1
        ready = [held.pop(o) for o in sorted(held) if o <= last]
        for n, events in blocks.items():
            rest = {o: event for o, event in events.items() if o > last}
            if len(rest) < len(events):
                self._hold(n, rest)
        if held:
            self._await(min(event[self.e] for event in held.values()), mark)
        yield from self._hand_on(ready, place, timerValues)
        if not ready and not held and place and place[3] + self.ttl <= mark:
            yield from self._settle_rest(place)
            self.recent.clear()
            self.place.clear()
            self.due.clear()

    def _hand_on(self, ready: list[tuple], place, timerValues) -> Iterator[Row]:
        if not ready:
            return
        o, t, e, k = self.o, self.t, self.e, self.k
        past = [tuple(r) for r in self.recent.get()] if place and self.recent.exists() else []
        newest = max([place[1]] if place else [], default=None)
        newest = max([r[t] for r in ready] + ([] if newest is None else [newest]))
        before = place[2] if place else -(1 << 62)
        settled = (1 << 62) if ready[-1][k] == S.SESSION_END else newest - self.ahead
        for row in past:
            yield self._row(row, False, before < row[t] <= settled)
        for row in ready:
            yield self._row(row, True, row[t] <= settled)
        epoch = max(r[e] for r in ready)
        if ready[-1][k] == S.SESSION_END:
            settled = newest  # what a reopened session sends comes after
        rest = [r for r in past + ready if r[t] >= newest - self.back - self.ahead]
        self.recent.put(rest or ready[-1:])
        self.place.update((ready[-1][o], newest, max(settled, before), epoch))
        self.handle.registerTimer(max(epoch, timerValues.getCurrentWatermarkInMs()) + self.ttl)

    def _settle_rest(self, place) -> Iterator[Row]:
        """An idle session ends: events that waited for what follows them are judged by what there is."""
        for row in self.recent.get():
            yield self._row(tuple(row), False, row[self.t] > place[2])

    def _row(self, row: tuple, fresh: bool, settles: bool) -> Row:
        return self.given(*row, fresh, settles)

    def close(self) -> None:
        pass


# What admission and findings read of every event.
EVENT = ("session", "ordinal", "ns", "epoch_ms", "kind", "protocol", "model", "server_tick", "player")


def in_order(obs: DataFrame, checks: dict[str, Check], delay: str = "10 seconds", ttl_ms: int = 3_600_000) -> DataFrame:
    """Observations by session in ordinal order, each trigger's new ones (``fresh``) after the past their checks look at.

    Where every check states the columns it reads, only these go through state.
    ``settles``: from now on nothing can change the event's samples. A missing ordinal is waited for until the watermark
    passes an event behind it.
    """
    named = checks and all(c.reads for c in checks.values())
    read = {*EVENT, *(r for c in checks.values() for r in c.reads)}
    kept = obs.select([c for c in obs.columns if c != "ts" and (c in read or not named)])
    schema = StructType([StructField(f.name, f.dataType) for f in kept.schema])
    back, ahead = (max((getattr(c, n) for c in checks.values()), default=0) for n in ("back_ns", "ahead_ns"))
    out = StructType([*schema.fields, StructField("fresh", BooleanType()), StructField("settles", BooleanType())])
    timed = kept.filter("session > 0 AND ordinal > 0").withColumn("ts", F.timestamp_millis("epoch_ms")).withWatermark("ts", delay)
    return timed.groupBy("session").transformWithState(InOrder(schema, back, ahead, ttl_ms), out, "Append", "EventTime")


def trigger_samples(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The samples of the new events among a trigger's rows, for ``follow``; a boundary is a sample of every check that clears it."""
    checks = registry(cfg)
    seen = cut(admitted(rows.drop("fresh", "settles")))
    marks = rows.select("session", "ordinal", "fresh", "settles")
    who = seen.select("session", "ordinal", "epoch_ms", *[(F.col(c) if c in seen.columns else F.lit(None)).cast(t).alias(c) for c, t in (("server_tick", "bigint"), ("player", "string"))])
    # the reset that stands for a gap goes with the event behind it
    jumps = seen.join(rows.select("session", "ordinal"), ["session", "ordinal"], "left_anti").select("session", "ordinal")
    marks = marks.unionByName(jumps.join(marks.withColumn("ordinal", F.col("ordinal") - 1), ["session", "ordinal"]))
    ends = seen.filter(F.col("kind").isin(*BOUNDS)).select("session", "ordinal", "ns", F.lit(False).alias("suspicious"), F.lit(True).alias("boundary"))
    out = []
    for key, taken in samples(seen, cfg).items():
        if checks[key].memory not in ("sliding", "budget"):
            taken = taken.unionByName(ends, allowMissingColumns=True)
        extra = [(F.col(c) if c in taken.columns else F.lit(None)).cast(t).alias(c) for c, t in (("value", "double"), ("packet", "bigint"), ("boundary", "boolean"))]
        due = "settles" if checks[key].ahead_ns else "fresh"
        out.append(taken.select("session", F.lit(key).alias("check"), "ordinal", "ns", "suspicious", *extra).join(marks.filter(due).select("session", "ordinal"), ["session", "ordinal"], "left_semi"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.join(who, ["session", "ordinal"], "left")


SAMPLES = ("session bigint, ordinal bigint, check string, ns bigint, suspicious boolean, value double, packet bigint, boundary boolean, "
           "epoch_ms bigint, server_tick bigint, player string")


def write_samples(obs: DataFrame, path: str, checkpoint: str, cfg: DetectorConfig, delay: str = "10 seconds", ttl_ms: int = 3_600_000, **trigger):
    """Start the first query: samples of every trigger under ``path``."""

    def on_batch(batch: DataFrame, number: int) -> None:
        rows = cut(batch)
        if not rows.isEmpty():
            trigger_samples(rows, cfg).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    ordered = in_order(obs, registry(cfg), delay, ttl_ms)
    return ordered.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class Follow(StatefulProcessor):
    """Per (session, check): the last ordinal seen and the memory of the check, typed by what the check remembers."""

    def __init__(self, cfg: DetectorConfig, ttl_ms: int):
        self.cfg, self.ttl = cfg, ttl_ms

    def init(self, handle) -> None:
        self.handle, self.checks = handle, registry(self.cfg)
        self.last = handle.getValueState("last", "epoch_ms bigint")
        self.seen = handle.getValueState("seen", "ordinal bigint")
        self.window = handle.getListState("window", "ordinal bigint, ns bigint")
        self.run = handle.getValueState("run", "n bigint, ns bigint")
        self.steps = handle.getListState("steps", "dt double")
        self.budget = handle.getValueState("budget", "open boolean, last_ns bigint, last_packet bigint, ready double, begun bigint, counted bigint, balance double, over array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        session, name = key
        seen = self.seen.get()
        ordered = {}
        for row in rows:
            if not seen or row["ordinal"] > seen[0]:
                ordered.setdefault((row["ordinal"], not row["boundary"]), row)
        ordered = [ordered[k] for k in sorted(ordered)]
        if not ordered:
            return
        check = self.checks[name]
        alerts = {"anchored": self.anchored, "sliding": self.sliding, "cadence": self.cadence, "budget": self.balance}[check.memory](ordered, check)
        for row, evidence in alerts:
            yield Row(session=session, ordinal=row["ordinal"], ns=row["ns"], epoch_ms=row["epoch_ms"], server_tick=row["server_tick"], player=row["player"],
                      level="suspicious", check=check.name, message=check.message, evidence={k: str(v) for k, v in evidence.items()})
        self.seen.update((ordered[-1]["ordinal"],))
        epoch = max([r["epoch_ms"] for r in ordered if r["epoch_ms"] is not None] + [timerValues.getCurrentWatermarkInMs()])
        self.last.update((epoch,))
        self.handle.registerTimer(epoch + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[0] + self.ttl <= timerValues.getCurrentWatermarkInMs():
            for state in (self.seen, self.window, self.run, self.steps, self.budget, self.last):
                state.clear()
        return iter([])

    def anchored(self, rows: list, check: Check) -> Iterator[tuple]:
        held, span = [tuple(r) for r in self.window.get()] if self.window.exists() else [], int(check.window_ms * 1e6)
        for row in rows:
            if not row["suspicious"]:
                held = []
                continue
            held.append((row["ordinal"], row["ns"]))
            while not 0 <= held[-1][1] - held[0][1] <= span:
                held = held[next(i for i, (_, ns) in enumerate(held) if not 0 <= ns - held[0][1] <= span) :]
            if len(held) == check.needed:
                yield row, {"samples": check.needed, "first_sample": held[0][0]}
                held = []
        self.window.put(held) if held else self.window.clear()

    def sliding(self, rows: list, check: Check) -> Iterator[tuple]:
        n, before = self.run.get() or (0, None)
        for row in rows:
            linked = before is not None and 0 <= row["ns"] - before <= int(check.window_ms * 1e6)
            n, before = (n * linked + 1 if row["suspicious"] else 0), row["ns"]
            if row["suspicious"] and n % check.needed == 0:
                yield row, {"samples": n}
        self.run.update((n, before))

    def cadence(self, rows: list, check: Check) -> Iterator[tuple]:
        """Windows of joined intervals become the samples of an anchored streak."""
        cfg, dts, judged = self.cfg.autoclicker, [r[0] for r in self.steps.get()] if self.steps.exists() else [], []
        for row in rows:
            if row["boundary"]:
                judged.append({**row.asDict(), "suspicious": False})
                dts = []
            elif not row["suspicious"]:
                dts = []
            else:
                dts.append(row["value"])
                if len(dts) == cfg.window_intervals:
                    judged.append({**row.asDict(), "suspicious": regular(dts, cfg)})
                    dts = []
        self.steps.put([(d,) for d in dts]) if dts else self.steps.clear()
        yield from self.anchored(judged, check)

    def balance(self, rows: list, check: Check) -> Iterator[tuple]:
        fold, held, unit = BudgetFold(**BUDGET), self.budget.get(), []
        if held and held[0]:
            fold.last = None if held[1] is None else (held[1], held[2])
            if held[3] is not None:
                fold.ready, fold.begun, fold.count, fold.balance, fold.over = held[3], held[4], held[5], held[6], list(held[7])
        by_ordinal = {r["ordinal"]: r for r in rows}

        def done() -> Iterator[tuple]:
            if unit:
                for alert in fold.feed(pd.DataFrame({c: np.array([r[c] for r in unit], np.int64) for c in ("ns", "packet", "ordinal")})):
                    yield by_ordinal[alert["ordinal"]], {"counted": alert["counted"]}
                unit.clear()

        for row in rows:
            if row["suspicious"]:
                unit.append(row)
            else:
                yield from done()
                fold = BudgetFold(**BUDGET)
        yield from done()
        begun = hasattr(fold, "ready")
        self.budget.update((True, *(map(int, fold.last) if fold.last else (None, None)), float(fold.ready) if begun else None, fold.begun if begun else None,
                            int(fold.count) if begun else None, float(fold.balance) if begun else None, [int(x) for x in fold.over] if begun else []))

    def close(self) -> None:
        pass


def regular(dts: list[float], cfg: AutoClicker) -> bool:
    """Whether a window of intervals is as regular as no hand is; clicks on the tick grid say nothing."""
    mean, duration, center = fmean(dts), sum(dts), median(dts)
    aligned = fmean(abs(d - np.floor(d / cfg.tick_ms + 0.5) * cfg.tick_ms) <= 2 for d in dts)
    spread = median(abs(d - center) for d in dts)
    return bool(duration >= cfg.minimum_window_ms and 1000 / mean >= cfg.minimum_cps and aligned < 0.9 and pstdev(dts) / mean <= cfg.maximum_cv and spread <= cfg.maximum_mad_ms)


def follow(taken: DataFrame, cfg: DetectorConfig, ttl_ms: int = 86_400_000) -> DataFrame:
    """Findings of a stream of samples. A sample may be ttl_ms late; state that has had none for ttl_ms is dropped."""
    timed = taken.withColumn("ts", F.timestamp_millis("epoch_ms")).withWatermark("ts", f"{ttl_ms} milliseconds")
    return timed.groupBy("session", "check").transformWithState(Follow(cfg, ttl_ms), FINDING, "Append", "EventTime")


def stream_detect(obs: DataFrame, folder: str, cfg: DetectorConfig = DetectorConfig(), delay: str = "10 seconds", ttl_ms: int = 3_600_000, **trigger):
    """Run both queries over what is there and end: samples, findings and checkpoints lie under ``folder``.

    For a live stream start ``write_samples`` and ``follow`` on their own, inside ``typed_state``.
    """
    spark = obs.sparkSession
    with typed_state(spark):
        write_samples(obs, f"{folder}/samples", f"{folder}/state-samples", cfg, delay, ttl_ms, **trigger).awaitTermination()
        taken = spark.readStream.schema(SAMPLES).option("recursiveFileLookup", "true").parquet(f"{folder}/samples")
        (follow(taken, cfg).writeStream.format("parquet").option("path", f"{folder}/findings").option("checkpointLocation", f"{folder}/state-findings")
         .trigger(**trigger or {"availableNow": True}).start().awaitTermination())


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that list and map state need."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)

"""Structured Streaming forms of the windows, the live scoring and the counts; the detectors are in ``detect``."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas as S
from ..operators.segments import BOUNDARY_KINDS
from ..operators.window_fold import WindowRuns

WINDOW_DDL = ("session bigint, event bigint, epoch_ms bigint, segment bigint, k bigint, start_ns bigint, movement_pps double, movement_cv double, "
              "attack_pps double, attack_cv double, attack_repeat double, ground_fraction double, turn_mean double, attacks double")
DECISION_DDL = "id string, session bigint, event bigint, epoch_ms bigint, detection string, sustained double, tail_p double, looks bigint, candidate boolean, outside boolean, action string"
NEEDED = ["session", "ordinal", "ns", "epoch_ms", "kind", "packet", "sampled_ns", "available", "world", "yaw", "has_look", "ground"]


class LiveWindows:
    """Delivery-order rules, snapshot rules and the windows of one session."""

    def __init__(self, span_ns, guard_ns, gap_ns, queue_ns):
        self.runs, self.queue, self.seen, self.broken = WindowRuns(span_ns, guard_ns, gap_ns), queue_ns, None, False

    def feed(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Windows closed by events in delivery order, each with the ordinal and time of the event that closed it."""
        ordinal, kind = pdf["ordinal"].to_numpy(), pdf["kind"].to_numpy()
        top = np.maximum.accumulate(ordinal if self.seen is None else np.maximum(ordinal, self.seen))
        before = np.concatenate([[ordinal[0] - 1 if self.seen is None else self.seen], top[:-1]])
        self.seen = int(top[-1])
        late, observed = ordinal <= before, np.isin(kind, (S.ATTACK, S.MOVE))
        lag = (pdf["sampled_ns"] - pdf["ns"]).to_numpy()
        sound = pdf["available"].to_numpy(bool) & (pdf["world"].fillna("") != "").to_numpy() & (lag >= 0) & (lag <= self.queue)
        breaks = (ordinal != before + 1) | np.isin(kind, list(BOUNDARY_KINDS)) | (observed & ~sound)
        used = observed & sound & ~late
        # a break that falls between two used events shows at the later one
        breaks_so_far = np.cumsum(breaks)[used]
        cut = np.diff(np.concatenate([[-int(self.broken)], breaks_so_far])) > 0
        self.broken = bool(breaks.any() and (not used.any() or breaks_so_far[-1] < breaks.sum())) or (self.broken and not used.any())
        rows = pdf[used].reset_index(drop=True)
        windows = pd.DataFrame(self.runs.feed(rows, cut))
        if len(windows):
            by = windows.pop("by").to_numpy()
            windows = windows.assign(event=rows["ordinal"].to_numpy()[by], epoch_ms=rows["epoch_ms"].to_numpy()[by])
        return windows


class LiveScore:
    """Decisions of one deployed model over the windows of one session, as ``live.score_windows`` defines them.

    Windows that follow each other closely form an island; the state is the end of the island at hand.
    """

    def __init__(self, model, gap_ms):
        self.model, self.gap = model, gap_ms
        self.held, self.looks = np.zeros(0), 0  # margins of the island's last windows
        self.end = None  # segment and time of its last window, or nothing where the next one starts afresh

    def feed(self, windows: pd.DataFrame, session: int) -> list[dict]:
        m, n = self.model, self.model["consecutive_windows"]
        low = (windows["attacks"] < m["minimum_attacks"]).to_numpy()
        values = windows[list(m["features"])].to_numpy(float)
        outside = ((values < np.array(m["minimum"])) | (values > np.array(m["maximum"]))).any(axis=1)
        margins = m["intercept"] + values @ np.array(m["coefficients"], float)
        references = np.sort(np.array(m["references"], float))
        out = []
        for i, (segment, epoch, event) in enumerate(zip(windows["segment"].tolist(), windows["epoch_ms"].tolist(), windows["event"].tolist())):
            if low[i]:
                self.end = None
                continue
            linked = self.end is not None and self.end[0] == segment and 0 < epoch - self.end[1] <= self.gap
            self.held = np.append(self.held if linked else [], margins[i])[-n:]
            self.end = None if outside[i] else (segment, epoch)
            sustained, ready = float(self.held.min()), len(self.held) == n
            self.looks += ready
            above = len(references) - int(np.searchsorted(references, sustained))
            tail = (1 + above) / (1 + len(references))
            candidate = ready and sustained > m["threshold"] and not outside[i]
            allowed = m["tail_cutoff"] / (self.looks * (self.looks + 1)) if self.looks else 0.0
            states = (("outside_training_support", outside[i]), ("pending", candidate and m["mode"] == "enforce" and tail <= allowed),
                      ("shadow_candidate", candidate and m["mode"] == "shadow"), ("below_response_cutoff", candidate), ("observed", True))
            out.append({"id": f"{m['run']}:{session}:{event}:{m['detection']}", "event": event, "epoch_ms": epoch, "detection": m["detection"], "sustained": sustained, "tail_p": tail,
                        "looks": self.looks, "candidate": bool(candidate), "outside": bool(outside[i]), "action": next(name for name, holds in states if holds)})
        return out


def _stateful(obs: DataFrame, make, ddl: str, ttl_ms: int, delay: str = "1 hour") -> DataFrame:
    """One pickled state per session, dropped on session end or ``ttl_ms`` of event time after its last event.

    Within a trigger the events of a session are put in ordinal order; across triggers the ordinal rules decide.
    """
    names = [f.name for f in S._fields(ddl)]

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        machine = pickle.loads(state.get[0]) if state.exists else make()
        pdf = pd.concat(list(frames)).sort_values("ordinal", kind="stable")
        rows = machine.feed(pdf, key[0])
        if (pdf["kind"] == S.SESSION_END).any() and pdf["kind"].iloc[-1] == S.SESSION_END:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(machine),))
            state.setTimeoutTimestamp(max(int(pdf["epoch_ms"].max()), state.getCurrentWatermarkMs()) + ttl_ms)
        if len(rows):
            yield pd.DataFrame(rows).assign(session=key[0])[names]

    timed = obs.withColumn("ts", F.timestamp_millis("epoch_ms")).withWatermark("ts", delay)
    return timed.groupBy("session").applyInPandasWithState(run, ddl, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_behavior_windows(obs: DataFrame, span_ns: int = 30_000_000_000, guard_ns: int = 5_000_000_000, gap_ns: int = 750_000_000,
                            queue_ns: int = 100_000_000, ttl_ms: int = 86_400_000) -> DataFrame:
    """Closed windows of a live observation stream."""
    return _stateful(obs.select(*NEEDED), lambda: _Windowed(span_ns, guard_ns, gap_ns, queue_ns), WINDOW_DDL, ttl_ms)


class _Windowed(LiveWindows):
    def feed(self, pdf, session):
        return super().feed(pdf)


class _Scored:
    def __init__(self, window_args, models, gap_ms):
        self.windows, self.scores = LiveWindows(*window_args), [LiveScore(m, gap_ms) for m in models]

    def feed(self, pdf, session):
        closed = self.windows.feed(pdf)
        return [d for s in self.scores for d in s.feed(closed, session)] if len(closed) else []


def stream_score(obs: DataFrame, models: list[dict], span_ns: int = 30_000_000_000, guard_ns: int = 5_000_000_000, gap_ns: int = 750_000_000,
                 queue_ns: int = 100_000_000, pause_ms: int = 45_000, ttl_ms: int = 86_400_000) -> DataFrame:
    """Decisions of the deployed models, one per scored window."""
    active = [m for m in models if m["mode"] != "disabled"]
    return _stateful(obs.select(*NEEDED), lambda: _Scored((span_ns, guard_ns, gap_ns, queue_ns), active, pause_ms), DECISION_DDL, ttl_ms)


DAY_MS = 86_400_000


def append_new(spark, rows: DataFrame, path: str, keys: list[str], at: str | None = None) -> None:
    """Insert-or-ignore into a Parquet log: a replayed trigger adds nothing.

    ``at`` is a time in milliseconds that belongs to the keys: equal keys, equal time. The log then lies in folders of a day,
    and only those of the days that ``rows`` has are listed and read, so a trigger costs the same however old the log is.
    Without it (or where it is null) there is one folder. The rows are computed once, as their state may be.
    """
    day = F.lit(-1) if at is None else F.coalesce(F.floor(F.col(at) / DAY_MS), F.lit(-1))
    fresh = rows.drop("day").withColumn("day", day.cast("int")).dropDuplicates(keys).persist()
    try:
        folders = [f"{path}/day={d}" for (d,) in fresh.select("day").distinct().orderBy("day").collect()]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        known = [f for f in folders if (p := jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(conf).exists(p)]
        if known:
            log = spark.read.schema(fresh.schema).option("basePath", path).parquet(*known)
            new = fresh.join(log.select(*keys), keys, "left_anti")
        else:
            new = fresh
        new.write.mode("append").partitionBy("day").parquet(path)
    finally:
        fresh.unpersist()


def write_decisions(decisions: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("id",), at: str = "epoch_ms", **trigger):
    """Start the decision sink; ``trigger`` goes to ``DataStreamWriter.trigger``."""
    sink = lambda batch, _: append_new(batch.sparkSession, batch, path, list(keys), at)
    return decisions.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def stream_player_counts(findings: DataFrame, every: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Findings and alerts per player and time window."""
    w = F.window("ts", every)
    return (findings.withWatermark("ts", delay).groupBy(w, "player").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("level") == "suspicious").alias("alerts"))
            .select(F.col("window.start").alias("start"), "player", "records", "alerts"))


def stream_activity_sessions(obs: DataFrame, gap: str = "45 seconds", delay: str = "10 minutes") -> DataFrame:
    """Session windows of activity that end after ``gap`` without events."""
    w = F.session_window("ts", gap)
    return (obs.withWatermark("ts", delay).groupBy(w, "session").agg(F.count(F.lit(1)).alias("events"))
            .select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"))


def stream_match_acks(impulses: DataFrame, acks: DataFrame, limit: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Impulses and acknowledgements of one token within the limit, as a watermarked interval join.

    A token that is acknowledged twice appears twice; the sink keeps the first by (session, impulse).
    """
    i = impulses.withWatermark("ts", delay).select("session", "token", F.col("ordinal").alias("impulse"), F.col("ts").alias("sent"))
    a = acks.withWatermark("ts", delay).select(F.col("session").alias("a_session"), F.col("token").alias("a_token"), F.col("ordinal").alias("ack"), F.col("ts").alias("acked"))
    return i.join(a, F.expr(f"session = a_session AND token = a_token AND acked BETWEEN sent AND sent + INTERVAL {limit}")).select("session", "token", "impulse", "ack", "sent", "acked")

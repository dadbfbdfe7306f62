"""Sequential state machines, fed in order with bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class RowFold:
    """A state whose ``accept(row)`` returns the rows to emit."""

    def feed(self, pdf: pd.DataFrame) -> list[dict]:
        return [item for row in pdf.to_dict("records") for item in self.accept(row)]


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], factory: Callable, schema: str) -> DataFrame:
    """Run ``factory()`` per key over rows sorted by ``order``; ``feed`` gets one run of a key at a time.

    Rows stream through the task in Arrow batches, so a long key costs time in one task but never
    memory.  Keys should be units between certain resets, which keeps a dominant session divisible.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches):
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            ids = list(zip(*[pdf[k].tolist() for k in keys]))
            starts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)]
            out = []
            for a, b in zip(starts, starts[1:]):
                if ids[a] != key:
                    key, state = ids[a], factory()
                fixed = dict(zip(keys, key))
                out += [{**fixed, **item} for item in state.feed(pdf.iloc[a:b])]
            if out:
                yield pd.DataFrame(out, columns=names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


class Streak:
    """Runs of suspicious rows in windows that begin at their first row: an alert at each ``needed``-th row of one."""

    def __init__(self, window_ms: float, needed: int):
        self.window_ns, self.needed = int(window_ms * 1e6), needed
        self.ns, self.ordinal = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the window at hand

    def feed(self, pdf: pd.DataFrame) -> list[dict]:
        ns, ordinal = np.append(self.ns, pdf["ns"].to_numpy()), np.append(self.ordinal, pdf["ordinal"].to_numpy())
        at, out = 0, []
        while at < len(ns):
            since = ns[at : at + self.needed] - ns[at]
            outside = np.flatnonzero((since < 0) | (since > self.window_ns))
            if len(outside):
                at += int(outside[0])
            elif len(since) < self.needed:
                break
            else:
                hit = at + self.needed - 1
                out.append({"ordinal": int(ordinal[hit]), "ns": int(ns[hit]), "samples": self.needed, "first_sample": int(ordinal[at])})
                at += self.needed
        self.ns, self.ordinal = ns[at:], ordinal[at:]
        return out


class SegmentFold(RowFold):
    """Segments of valid moves and attacks between two hard resets, one event at a time."""

    def __init__(self, gap_ns: int):
        self.gap = gap_ns
        self.last = self.packet = self.opened = None

    def accept(self, row):
        before = self.last
        if row["kind"] == 11:
            if self.packet is not None and row["packet"] <= self.packet:
                self.last = self.packet = self.opened = None
                return []
            if before is None or not 0 <= row["ns"] - before < self.gap:
                self.opened, before = (row["ordinal"], row["ns"]), None
            self.last, self.packet = row["ns"], row["packet"]
        if self.opened is None:
            return []
        kept = {c: row[c] for c in ("ordinal", "ns", "kind", "yaw", "has_look", "ground")}
        return [{**kept, "prev_ns": before, "last_ns": self.last, "segment": self.opened[0], "start_ns": self.opened[1]}]


class EpisodeFold:
    """Guard, then ``buckets`` equal buckets; the move that ends an episode starts the next."""

    def __init__(self, bucket_ns: int, buckets: int, guard_ns: int, gap_ns: int):
        self.bucket, self.buckets, self.guard, self.gap = bucket_ns, buckets, guard_ns, gap_ns
        self.clear()

    def clear(self):
        self.start = self.last = self.packet = None
        self.counts = np.zeros(self.buckets, dtype=np.int64)

    def feed(self, pdf):
        ns, packet = pdf["ns"].to_numpy(), pdf["packet"].to_numpy()
        out = []
        ok = np.ones(len(ns), dtype=bool)
        step = np.diff(ns)
        ok[1:] = (np.diff(packet) > 0) & (step >= 0) & (step < self.gap)
        edges = [0, *np.flatnonzero(~ok[1:]) + 1, len(ns)]
        for a, b in zip(edges, edges[1:]):
            a = self._join(ns[a], packet[a], a, b)
            while a < b:
                a = self._fill(ns, packet, a, b, out)
        return out

    def _join(self, ns, packet, a, b):
        """First move of a smooth run against the state; returns where the run really begins."""
        if self.packet is not None and packet <= self.packet:
            self.clear()
            return a + 1
        if self.last is not None and not 0 <= ns - self.last < self.gap:
            self.clear()
        return a

    def _fill(self, ns, packet, a, b, out):
        if self.start is None:
            self.start = ns[a]
        end = self.start + self.guard + self.bucket * self.buckets
        stop = a + int(np.searchsorted(ns[a:b], end))
        slot = (ns[a:stop] - self.start - self.guard) // self.bucket
        slot = slot[slot >= 0]
        counts = self.counts + np.bincount(slot, minlength=self.buckets)
        self.counts = counts
        if stop > a:
            self.last, self.packet = ns[stop - 1], packet[stop - 1]
        if stop < b:
            out.append({"start_ns": int(self.start), "counts": counts.tolist(), "end_ns": int(ns[stop])})
            self.start, self.last, self.packet = ns[stop], ns[stop], packet[stop]
            self.counts = np.zeros(self.buckets, dtype=np.int64)
            return stop + 1
        return b


def clamped_sums(start: float, steps: np.ndarray, low: float, high: float) -> np.ndarray:
    """x -> clip(x + step, low, high) applied step by step from ``start``: all values, by composing pairs of such maps."""
    add, lo, hi = steps.astype(float), np.full(len(steps), low), np.full(len(steps), high)
    width = 1
    while width < len(steps):
        a, l, h = add[width:], lo[width:], hi[width:]
        lo[width:], hi[width:] = np.clip(lo[:-width] + a, l, h), np.clip(hi[:-width] + a, l, h)
        add[width:] = add[:-width] + a
        width *= 2
    return np.clip(start + add, lo, hi)


class BudgetFold:
    """Client tick budget of usable moves: each pays ``cost``, time refunds, and both are clamped.

    Rows fall into smooth runs; inside one the balance is a clamped sum, and an alert is the first row whose balance has
    stayed over the lead for long enough. After an alert the balance starts again from nothing.
    """

    def __init__(self, credit_ms, lead_ms, sustain_ms, warmup_ms, gap_ms, cost_ms, least_packets, least_ms, least_over):
        self.credit, self.lead, self.cost = credit_ms, lead_ms, cost_ms
        self.sustain, self.warmup, self.gap = sustain_ms * 1e6, warmup_ms * 1e6, gap_ms * 1e6
        self.least_packets, self.least_ns, self.least_over = least_packets, least_ms * 1e6, least_over
        self.last = None  # ns and packet of the last row, or nothing after a packet that did not grow

    def _begin(self, ns: int) -> None:
        self.ready, self.begun, self.count = ns + self.warmup, None, 0
        self.balance, self.over = -self.credit, []  # over: times of the rows over the lead so far

    def feed(self, pdf: pd.DataFrame) -> list[dict]:
        ns, packet, ordinal = (pdf[c].to_numpy() for c in ("ns", "packet", "ordinal"))
        out: list[dict] = []
        at = 0
        while at < len(ns):
            if self.last is None:
                self._begin(int(ns[at]))
                self.last = int(ns[at]), int(packet[at])
                at += 1
                continue
            steps = np.diff(np.append(self.last[0], ns[at:]))
            stale = np.diff(np.append(self.last[1], packet[at:])) <= 0
            odd = np.flatnonzero(stale | (steps < 0) | (steps >= self.gap))
            end = at + int(odd[0]) if len(odd) else len(ns)
            self._run(ns[at:end], steps[: end - at] / 1e6, ordinal[at:end], out)
            if end > at:
                self.last = int(ns[end - 1]), int(packet[end - 1])
            if len(odd):
                if stale[odd[0]]:
                    self.last = None
                else:
                    self._begin(int(ns[end]))
                    self.last = int(ns[end]), int(packet[end])
                end += 1
            at = end
        return out

    def _run(self, ns, passed, ordinal, out) -> None:
        counted = int(np.searchsorted(ns, self.ready))
        ns, passed, ordinal = ns[counted:], passed[counted:].copy(), ordinal[counted:]
        if not len(ns):
            return
        if self.begun is None:
            self.begun, passed[0] = int(ns[0]), 0.0
        while len(ns):
            balance = clamped_sums(self.balance, self.cost - passed, self.cost - self.credit, 100 * self.cost)
            place = np.arange(len(ns))
            under = np.maximum.accumulate(np.where(balance > self.lead, -1, place))  # last row that was not over
            held = under < 0  # since before these rows
            first = np.where(held & (len(self.over) > 0), self.over[0] if self.over else 0, ns[np.minimum(under + 1, len(ns) - 1)])
            run = np.where(held, place + 1 + len(self.over), place - under)
            due = (balance > self.lead) & (self.count + place + 1 >= self.least_packets) & (ns - self.begun >= self.least_ns) & (run >= self.least_over) & (ns - first >= self.sustain)
            hits = np.flatnonzero(due)
            if not len(hits):
                self.count += len(ns)
                self.balance = float(balance[-1])
                self.over = (self.over if held[-1] else []) + ns[int(under[-1]) + 1 :].tolist()
                self.over = self.over[:1] + self.over[1:][-self.least_over :]
                return
            i = int(hits[0])
            self.count += i + 1
            out.append({"ordinal": int(ordinal[i]), "ns": int(ns[i]), "lead_ms": float(balance[i]), "counted": self.count, "elapsed_ms": (int(ns[i]) - self.begun) / 1e6})
            self.balance, self.over = 0.0, []
            ns, passed, ordinal = ns[i + 1 :], passed[i + 1 :], ordinal[i + 1 :]

"""The client tick budget: every move pays for one tick, time refunds, and the balance is clamped at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scan import carry, carry_here, cut, ordinal_slab, prev_row, running_sum, settle, slabs, sql, step

#: The budget's settings.
BUDGET = {"credit_ms": 250, "lead_ms": 250, "sustain_ms": 500, "warmup_ms": 1000, "gap_ms": 750, "cost_ms": 50, "least_packets": 40, "least_ms": 2000, "least_over": 8}
#: The balance never exceeds this many ticks.
MOST_TICKS = 100
FAR = 1 << 60


def budget_moves(obs: DataFrame, queue_ms: float = 100) -> DataFrame:
    """Moves and what ends a budget, with whether the row can be counted."""
    return obs.filter("kind IN (1,2,3,10,11,14)").selectExpr(
        "session", "ordinal", "ns", "kind", "packet",
        f"kind = 11 AND coalesce(available AND world <> '' AND packet > 0 AND sampled_ns - ns BETWEEN 0 AND {int(queue_ms * 1e6)}, false) AS usable")


def budget_units(moves: DataFrame, warmup_ns: int, gap_ns: int, rows: int) -> DataFrame:
    """Counted moves (session, unit, at, ordinal, ns, passed): a unit starts where the budget certainly starts anew.

    That is after a row that can't be counted, a packet number that does not grow, a step back in time or a long gap. A
    stale packet is forgotten with all else, so that the next row is taken whatever its number: in a run of rows that do
    not grow, every other one is stale.
    """
    seen = step(slabs(moves, ordinal_slab(rows=rows)), ["session"], ["ordinal"], p=prev_row(F.struct("usable", "packet", "ns")), at=running_sum(F.lit(1)))
    seen = seen.withColumn("at", F.col("at").cast("long")).withColumn("drops", F.expr("usable AND coalesce(p.usable AND packet <= p.packet, false)"))
    known = step(seen, ["session"], ["ordinal"], grown=carry(F.expr("CASE WHEN NOT drops THEN at END")))
    told = known.withColumn("stale", F.expr("drops AND (at - grown) % 2 = 1")).withColumn(
        "begins", F.expr(f"usable AND NOT stale AND NOT coalesce(p.usable AND (at - 1 - grown) % 2 = 0 AND ns - p.ns >= 0 AND ns - p.ns < {gap_ns}, false)"))
    begun = step(told, ["session"], ["ordinal"], unit=carry_here(F.expr("CASE WHEN begins THEN struct(at, ns) END")))
    counted = begun.filter(f"usable AND NOT stale AND NOT begins AND ns >= unit.ns + {warmup_ns}")
    return counted.selectExpr("session", "unit.at AS unit", "at", "ordinal", "ns",
                              f"CASE WHEN at - 1 = unit.at OR p.ns < unit.ns + {warmup_ns} THEN 0L ELSE ns - p.ns END AS passed")


def timer_budget(obs: DataFrame, queue_ms: float = 100, rows: int = 65536, **settings: float) -> DataFrame:
    """Alerts: the balance has stayed over the lead for long enough; after an alert it starts again from nothing.

    A unit may be as long as a session, so it is dealt in slabs of ``rows`` moves. Clamped sums compose: what a slab does
    to a balance is one (add, low, high), and composing these gives the balance every slab starts with while there is no
    alert. An alert restarts the balance, so slabs that were started with something else than the one before ended with are
    done again (``scan.settle``); both ways meet as soon as a clamp or an alert coincides. Rows with nothing to count give
    no alert.
    """
    s = BUDGET | settings
    ns = {k: int(round(v * 1e6)) for k, v in s.items() if k.endswith("_ms")}
    low, high = ns["cost_ms"] - ns["credit_ms"], MOST_TICKS * ns["cost_ms"]
    units = budget_units(budget_moves(obs, queue_ms), ns["warmup_ms"], ns["gap_ms"], rows)
    key = ["session", "unit", "slab"]
    packs = cut(units.withColumn("slab", F.floor(F.col("at") / rows).cast("long")).groupBy(*key)
                .agg(F.array_sort(F.collect_list(F.struct("at", "ordinal", "ns", "passed"))).alias("moves")))
    pay, clip = f"{ns['cost_ms']}L - x.passed", f"least({high}L, greatest({low}L, {{}}))"
    ends = settle(_starts(packs, pay, clip, ns["credit_ms"]), ["session", "unit"], lambda starts: _done(packs, starts, pay, clip, ns, s))
    return (ends.select("session", "begun", F.explode("alerts").alias("a"))
            .selectExpr("session", "a.ordinal", "a.ns", "a.lead / 1e6D AS lead_ms", "a.counted", "(a.ns - begun) / 1e6D AS elapsed_ms"))


def _starts(packs: DataFrame, pay: str, clip: str, credit: int) -> DataFrame:
    """What each slab starts with if nothing alerts before it."""
    maps = packs.selectExpr("session", "unit", "slab", "moves[0].at AS at", "moves[0].ns AS ns", f"""
      aggregate(moves, named_struct('add', 0L, 'low', {-FAR}L, 'high', {FAR}L), (m, x) -> named_struct(
        'add', m.add + {pay}, 'low', {clip.format(f'm.low + {pay}')}, 'high', {clip.format(f'm.high + {pay}')})) AS map""")
    return sql(f"""
      WITH listed AS (SELECT session, unit, min(at) AS first_at, min(ns) AS begun, array_sort(collect_list(struct(slab, map))) AS maps
        FROM {{maps}} GROUP BY session, unit),
      composed AS (SELECT session, unit, first_at, begun, aggregate(maps,
          named_struct('balance', {-credit}L, 'all', CAST(array() AS array<struct<slab: bigint, balance: bigint>>)),
          (s, m) -> named_struct('balance', least(m.map.high, greatest(m.map.low, s.balance + m.map.add)),
            'all', array_append(s.all, named_struct('slab', m.slab, 'balance', s.balance)))).all AS starts FROM listed)
      SELECT session, unit, e.slab, first_at, begun, named_struct('balance', e.balance, 'over', CAST(NULL AS bigint), 'run', 0L) AS starts
      FROM composed LATERAL VIEW explode(starts) t AS e""", maps=maps)


def _done(packs: DataFrame, starts: DataFrame, pay: str, clip: str, ns: dict[str, int], s: dict) -> DataFrame:
    """Slabs with their alerts and what they end with: balance, when it got over the lead, and for how many rows (as far as that counts)."""
    balance = clip.format(f"s.balance + {pay}")
    over, run, count = "coalesce(s.over, x.ns)", f"least(s.run + 1L, {s['least_over']}L)", "x.at - first_at + 1"
    due = (f"{count} >= {s['least_packets']} AND x.ns - begun >= {ns['least_ms']} AND {run} >= {s['least_over']} AND x.ns - {over} >= {ns['sustain_ms']}")
    state = "named_struct('balance', {}, 'over', {}, 'run', {}, 'alerts', {})"
    nothing = "CAST(NULL AS bigint)"
    alert = f"named_struct('ordinal', x.ordinal, 'ns', x.ns, 'lead', {balance}, 'counted', {count})"
    none = "CAST(array() AS array<struct<ordinal: bigint, ns: bigint, lead: bigint, counted: bigint>>)"
    return (packs.join(starts.withColumnsRenamed({k: f"_{k}" for k in ("session", "unit", "slab")}),
                       F.expr("session <=> _session AND unit = _unit AND slab = _slab"))
            .selectExpr("session", "unit", "slab", "first_at", "begun", "starts", f"""
      aggregate(moves, {state.format('starts.balance', 'starts.over', 'starts.run', none)}, (s, x) -> CASE
        WHEN {balance} <= {ns['lead_ms']} THEN {state.format(balance, nothing, '0L', 's.alerts')}
        WHEN {due} THEN {state.format('0L', nothing, '0L', f'array_append(s.alerts, {alert})')}
        ELSE {state.format(balance, over, run, 's.alerts')} END) AS done""")
            .selectExpr("session", "unit", "slab", "first_at", "begun", "starts", "named_struct('balance', done.balance, 'over', done.over, 'run', done.run) AS ends", "done.alerts AS alerts"))

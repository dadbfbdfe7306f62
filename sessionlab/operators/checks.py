"""The detector contract: what a check reads, how far it looks, what it samples, and when samples become a finding.

A check is a row of ``registry``. The same rows drive the batch form (``detect_all``) and the live form
(``streaming.detect``): both admit observations by the same rules, take the samples of all checks over the same frame, and
let repeated suspicious samples of a (session, check) raise findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from .budget import budget_moves, timer_budget
from .detectors import (DetectorConfig, autoclicker_steps, autoclicker_windows, fastbreak_verdicts, hitbox_verdicts, movement_rule, movement_steps, MOVEMENT_RULES,
                        PUSH_MOVES, PUSH_NS, PUSH_STEP_NS,
                        reach_verdicts, velocity_samples)
from .scan import carry_here, cut, ordinal_slab, prev_row, slabs, step
from .segments import MS, model_gate
from .streaks import anchored_streaks, sliding_streaks

FINDING = "session bigint, ordinal bigint, ns bigint, epoch_ms bigint, server_tick bigint, player string, level string, check string, message string, evidence map<string,string>"


@dataclass(frozen=True)
class Check:
    """kinds: what it reads. back_ns, ahead_ns: how far the sample of an event depends on others. samples: from admitted
    observations to (session, ordinal, ns, suspicious, and for some memories a value or packet). memory: what is
    remembered beyond that reach: ``anchored`` or ``sliding`` streaks, ``cadence`` (windows of intervals, then a streak) or
    ``budget`` (the tick balance itself). reads: the columns samples read beyond those of every event; not stated, all."""

    name: str
    message: str
    kinds: tuple[int, ...]
    back_ns: int
    samples: Callable[[DataFrame], DataFrame]
    window_ms: float = 10_000
    needed: int = 3
    memory: str = "anchored"
    ahead_ns: int = 0
    reads: tuple[str, ...] = ()


BOUNDS = (S.SESSION_START, S.SESSION_END, S.RESET)
MOVED = (*BOUNDS, S.ATTACK, S.TELEPORT, S.MOVE, S.IMPULSE, S.CORRECTION)
# The names that findings carry.
NAMES = {"fastbreak": "fastbreak.request.v1", "reach": "reach.stationary.v1", "autoclicker": "autoclicker.cadence.v1", "speed": "speed.plain.v1", "fly": "fly.airborne.v1",
         "noslow": "noslow.item_input.v1", "nofall": "nofall.ground_claim.v1", "keepsprint": "keepsprint.attack_retention.v1", "hitboxes": "hitboxes.stable_ray.v1",
         "velocity": "velocity.response.v1", "timer": "timer.budget.v1"}
MESSAGES = {"fastbreak": "repeated_early_completion_requests", "reach": "repeated_out_of_range_attack_requests", "autoclicker": "repeated_regular_attack_cadence",
            "hitboxes": "repeated_stable_aim_target_box_misses", "velocity": "repeated_unexplained_impulse_response", "timer": "sustained_excess_client_tick_budget"}


def registry(cfg: DetectorConfig) -> dict[str, Check]:
    """The enabled checks. The movement rules share one gated scan, so theirs take its steps."""
    fast, reach, click, move, hit, push = cfg.fastbreak, cfg.reach, cfg.autoclicker, cfg.movement, cfg.hitboxes, cfg.velocity
    own = lambda df: df.filter("suspicious IS NOT NULL")
    early = lambda o: fastbreak_verdicts(o, fast, resets=True).filter("verdict <> 'finish_without_start'").selectExpr("session", "ordinal", "ns", "verdict = 'early' AS suspicious")
    checks = {
        "fastbreak": Check(NAMES["fastbreak"], MESSAGES["fastbreak"], (*BOUNDS, S.TICK, S.DIG, S.MINING, S.TELEPORT), int(fast.maximum_expected_ms) * MS, early, fast.sample_window_ms, fast.alert_after, "sliding"),
        "reach": Check(NAMES["reach"], MESSAGES["reach"], (*BOUNDS, S.ATTACK, S.COMBAT, S.TELEPORT), reach.history_ms * MS + int((reach.maximum_frame_gap_ms + reach.maximum_queue_ms) * MS),
                       lambda o: own(reach_verdicts(o, reach)), reach.sample_window_ms, reach.alert_after),
        "autoclicker": Check(NAMES["autoclicker"], MESSAGES["autoclicker"], (*BOUNDS, S.TICK, S.ATTACK, S.TELEPORT, S.CORRECTION), int(click.maximum_gap_ms * MS),
                             lambda o: autoclicker_steps(o, click).selectExpr("session", "ordinal", "ns", "joined AS suspicious", "dt AS value"), click.sample_window_ms, click.alert_after, "cadence",
                             reads=("packet", "batch", "sampled_ns", "available", "world")),
        "hitboxes": Check(NAMES["hitboxes"], MESSAGES["hitboxes"], (*BOUNDS, S.TICK, S.ATTACK, S.COMBAT, S.TELEPORT, S.CORRECTION), (hit.history_ms + hit.slack_ms + hit.frame_gap_ms) * MS + hit.maximum_queue_ms * MS,
                          lambda o: own(hitbox_verdicts(o, hit)), 10_000, hit.alert_after, ahead_ns=(hit.expire_ms + hit.maximum_queue_ms) * MS),
        "velocity": Check(NAMES["velocity"], MESSAGES["velocity"], (*MOVED, S.IMPULSE_ACK), PUSH_NS + PUSH_MOVES * PUSH_STEP_NS, lambda o: own(velocity_samples(o, push)), 15_000, push.alert_after),
        "timer": Check(NAMES["timer"], MESSAGES["timer"], (*BOUNDS, S.TELEPORT, S.MOVE, S.CORRECTION), 0, lambda o: budget_moves(o).selectExpr("session", "ordinal", "ns", "usable AS suspicious", "packet"), memory="budget"),
    }
    for rule in MOVEMENT_RULES:
        checks[rule] = Check(NAMES[rule], "repeated_movement_model_contradiction", MOVED, move.grace_ms * MS + int(4 * move.maximum_step_ms * MS),
                             lambda steps, rule=rule: own(movement_rule(steps, rule, move)), 10_000, move.alert_after)
    return {k: checks[k] for k in cfg.enabled}


def admitted(obs: DataFrame, rows: int = 65536) -> DataFrame:
    """The observations that checks may see, in capture order.

    Ordinals and sessions are positive; of rows with one ordinal one stays. Where ordinals jump, a reset comes just before.
    Where the frame carries ``protocol`` and ``model``, they hold from a session start on, and events of other clients than
    the modelled one are left out (their boundaries stay).
    """
    kept = obs.filter("session > 0 AND ordinal > 0").dropDuplicates(["session", "ordinal"])
    gate = "protocol" in obs.columns and "model" in obs.columns
    carried = {"_before": prev_row(F.col("ordinal"))} | ({"_who": carry_here(F.expr(f"CASE WHEN kind = {S.SESSION_START} THEN struct(protocol, model) END"))} if gate else {})
    framed = step(slabs(kept, ordinal_slab(rows=rows)), ["session"], ["ordinal"], **carried)
    known = framed.filter(model_gate(F.col("_who.protocol"), F.col("_who.model")) | F.col("kind").isin(*BOUNDS)) if gate else framed
    jumps = framed.filter("ordinal > _before + 1").withColumns({"ordinal": F.col("ordinal") - 1, "kind": F.lit(S.RESET).cast(obs.schema["kind"].dataType)})
    return known.select(*obs.columns).unionByName(jumps.select(*obs.columns))


def samples(seen: DataFrame, cfg: DetectorConfig) -> dict[str, DataFrame]:
    """The samples of every enabled check over admitted observations (a table: it is read by each)."""
    checks = registry(cfg)
    out, steps = {}, None
    for key, check in checks.items():
        frame = seen.filter(F.col("kind").isin(*check.kinds))
        if key in MOVEMENT_RULES:
            steps = cut(movement_steps(frame, cfg.movement)) if steps is None else steps
            frame = steps
        out[key] = check.samples(frame)
    return out


def detect_all(obs: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Findings of every enabled check as FINDING rows. Streaks of all checks are followed in one pass by (session, check)."""
    checks = registry(cfg)
    seen = cut(admitted(obs))
    found = samples(seen, cfg)
    ends = seen.filter(F.col("kind").isin(*BOUNDS)).select("session", "ordinal", "ns", F.lit(False).alias("suspicious"))
    bounded = {"anchored": [], "sliding": []}
    alerts = []
    for key, check in checks.items():
        taken = found[key]
        if check.memory == "budget":
            alerts.append(timer_budget(seen).select("session", F.lit(key).alias("check"), "ordinal", "ns", F.create_map(F.lit("counted"), F.col("counted").cast("string")).alias("evidence")))
            continue
        if check.memory == "cadence":
            taken = autoclicker_windows(seen, cfg.autoclicker)
        if check.memory != "sliding":  # the sliding check has the boundaries among its resets
            taken = taken.select("session", "ordinal", "ns", "suspicious").unionByName(ends)
        named = taken.select("session", F.lit(key).alias("check"), "ordinal", "ns", "suspicious", F.lit(int(check.window_ms * 1e6)).alias("window_ns"), F.lit(check.needed).alias("needed"))
        bounded["sliding" if check.memory == "sliding" else "anchored"].append(named)
    both = ["session", "check"]
    if bounded["anchored"]:
        hits = anchored_streaks(reduce(DataFrame.unionByName, bounded["anchored"]), both, max(c.needed for c in checks.values()))
        alerts.append(hits.selectExpr(*both, "ordinal", "ns", "map('samples', CAST(samples AS STRING), 'first_sample', CAST(first_sample AS STRING)) AS evidence"))
    if bounded["sliding"]:
        hits = sliding_streaks(reduce(DataFrame.unionByName, bounded["sliding"]), both).filter("alert")
        alerts.append(hits.selectExpr(*both, "ordinal", "ns", "map('samples', CAST(streak AS STRING)) AS evidence"))
    return findings(reduce(DataFrame.unionByName, alerts), seen, cfg)


def findings(alerts: DataFrame, seen: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Alerts (session, check, ordinal, ns, evidence) with names, and with whom and when from the observation they fell on."""
    told = [F.struct(F.lit(key).alias("check"), F.lit(c.name).alias("name"), F.lit(c.message).alias("message")) for key, c in registry(cfg).items()]
    who = seen.select("session", "ordinal", *[(F.col(c) if c in seen.columns else F.lit(None)).cast(t).alias(c) for c, t in (("epoch_ms", "bigint"), ("server_tick", "bigint"), ("player", "string"))])
    named = alerts.withColumn("_told", F.filter(F.array(*told), lambda t: t["check"] == F.col("check"))[0])
    return named.join(who, ["session", "ordinal"], "left").select(
        "session", "ordinal", "ns", "epoch_ms", "server_tick", "player", F.lit("suspicious").alias("level"), F.col("_told.name").alias("check"), F.col("_told.message").alias("message"), "evidence")

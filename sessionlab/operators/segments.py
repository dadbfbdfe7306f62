"""Session ordering and segmentation under reset rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import schemas as S
from .folds import SegmentFold, fold_sorted
from .scan import SLAB, carry_here, cut, ordinal_slab, prev_row, running_max, running_sum, slabs, step

BOUNDARY_KINDS = [S.SESSION_START, S.SESSION_END, S.RESET, S.TELEPORT, S.CORRECTION]
MS = 1_000_000
KEY, ORDER = ["session"], ["ordinal"]


def snapshot_valid(limit_ns: int) -> Column:
    """Snapshot taken with the event: available, in a known world, 0..limit ns old (both ends count)."""
    age = F.col("sampled_ns") - F.col("ns")
    ok = F.col("available") & (F.col("world") != "") & age.between(0, limit_ns)
    return F.coalesce(ok, F.lit(False))


def model_gate(protocol: Column, model: Column) -> Column:
    return F.coalesce((protocol == 47) & (model == 10808), F.lit(False))


def with_identity(obs: DataFrame, rows: int = 65536) -> DataFrame:
    """Carry the identity of the latest session start to every later event of the session."""
    started = F.when(F.col("kind") == S.SESSION_START, F.struct("player", "protocol", "model"))
    out = step(slabs(obs.withColumn("_start", started), ordinal_slab(rows=rows)),
               KEY, ORDER, _who=carry_here(F.col("_start")))
    kept = [c for c in obs.columns if c not in ("player", "protocol", "model")]
    return (out.select(*kept, F.col("_who.player").alias("player"), F.col("_who.protocol").alias("protocol"),
                       F.col("_who.model").alias("model"))
            .withColumn("supported", model_gate(F.col("protocol"), F.col("model"))))


def ordinal_guard(obs: DataFrame, arrival: str = "arrival", rows: int = 65536) -> DataFrame:
    """Delivery-order rules: what to drop and where per-session state starts afresh.

    An ordinal at or below the last accepted one is dropped and resets the state; a jump resets
    before the event is used.  The last accepted ordinal is the largest seen so far, because
    every event above it is accepted.  ``arrival`` is the delivery position in the session.
    """
    valid = (F.col("ordinal") > 0) & (F.col("session") > 0)
    framed = slabs(obs.filter(valid), ordinal_slab(arrival, rows))
    out = step(framed, KEY, [arrival], last_accepted=running_max(F.col("ordinal")))
    late = F.coalesce(F.col("ordinal") <= F.col("last_accepted"), F.lit(False))
    jump = F.coalesce(F.col("ordinal") > F.col("last_accepted") + 1, F.lit(False))
    return out.select(*obs.columns, "last_accepted", late.alias("drop"), (late | jump).alias("reset_before"))


def lifecycle_findings(guarded: DataFrame) -> DataFrame:
    """Trace rows for opened and closed sessions, jumps, discarded events and explicit resets."""
    text = (
        F.when(F.col("drop"), "event_discarded")
        .when(F.col("reset_before"), "ordinal_gap_reset")
        .when(F.col("kind") == S.SESSION_START, "session_opened")
        .when(F.col("kind") == S.SESSION_END, "session_closed")
        .when(F.col("kind") == S.RESET, "session_reset")
    )
    return (guarded.withColumn("message", text).filter("message is not null")
            .select("session", "ordinal", F.lit("trace").alias("level"), F.lit("engine").alias("check"), "message"))


def segmented(obs: DataFrame, gap_ns: int = 750 * MS, queue_ns: int = 100 * MS, rows: int = 65536,
              attacks: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cut each session into segments of trustworthy moves; attacks keep their delivery position.

    A segment starts at the first move after a reset.  Resets: boundary kinds, an invalid snapshot,
    a packet number that does not grow (the event is dropped as well) and a receive-time gap or
    regression (the event is kept and opens the next segment).  After a dropped move the packet
    memory is empty, so in a run of non-growing packets every second move is dropped.

    Everything is decided inside a slab except the link of its first move (the head) to the move
    before; that link, and the segment a slab starts in, come from one summary row per slab.

    Returns valid moves and attacks with ``segment`` (ordinal of the opening move), ``start_ns``,
    ``prev_ns`` (previous move of the segment), ``last_ns`` (latest move so far), ``inside`` (kept and
    in a segment) and ``stretch`` (ordinal of the last boundary or invalid snapshot).  The second frame
    lists the unclear stretches: a slab's head does not raise the packet number there, and only a fold
    gives the drops that follow.
    """
    kind = F.col("kind")
    valid = kind.isin(S.ATTACK, S.MOVE) & snapshot_valid(queue_ns)
    used = [*BOUNDARY_KINDS, S.MOVE] + ([S.ATTACK] if attacks else [])
    base = obs.filter(kind.isin(*used)).select(
        "session", "ordinal", "ns", "kind", "packet", "yaw", "has_look", "ground",
        ((kind == S.MOVE) & valid).alias("_move"), (~valid).alias("_hard"),
    )
    move, hard, ordinal, ns = F.col("_move"), F.col("_hard"), F.col("ordinal"), F.col("ns")
    w = W.partitionBy("session", SLAB).orderBy("ordinal")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    here = w.rowsBetween(W.unboundedPreceding, 0)
    no = F.lit(False)

    def last(value, frame):
        return F.last(value, ignorenulls=True).over(frame)

    local = cut(
        slabs(base, ordinal_slab(rows=rows))
        .withColumn("_prev", last(F.when(move, F.struct("ns", "packet", "ordinal")), before))
        .withColumn("_hard_at", last(F.when(hard, ordinal), before))
        .withColumn("_n", F.sum(move.cast("long")).over(here))
        .withColumn("_linked", move & F.coalesce(F.col("_prev.ordinal") > F.coalesce("_hard_at", F.lit(-1)), no))
        .withColumn("_head", move & F.col("_prev").isNull() & F.col("_hard_at").isNull())
        .withColumn("_bad", F.col("_linked") & (F.col("packet") <= F.col("_prev.packet")))
        .withColumn("_run", F.col("_n") - F.coalesce(last(F.when(move & ~F.col("_bad"), F.col("_n")), before), F.lit(0)) - 1)
        .withColumn("_drop", F.col("_bad") & (F.col("_run") % 2 == 0))
        .withColumn("_open", move & ~F.col("_drop") & ~F.col("_head") & (
            ~F.col("_linked") | (F.col("_run") % 2 == 1) | (ns < F.col("_prev.ns")) | (ns - F.col("_prev.ns") >= gap_ns)))
        .withColumn("_seg", last(F.when(F.col("_open"), F.struct("ordinal", "ns")), here))
        .withColumn("_cut_at", last(F.when(hard | F.col("_drop"), ordinal), here))
        .withColumn("_last", last(F.when(move & ~F.col("_drop"), ns), here))
        .withColumn("_head_at", F.max(F.when(F.col("_head"), ordinal)).over(here))
        .select("session", SLAB, "ordinal", "ns", "kind", "packet", "yaw", "has_look", "ground",
                "_move", "_hard", "_prev", "_hard_at", "_head", "_head_at", "_drop", "_open", "_seg", "_cut_at", "_last")
    )
    over = W.partitionBy("session").orderBy(SLAB)
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    totals = local.groupBy("session", SLAB).agg(
        F.max_by(F.struct("ns", "packet", "ordinal", F.col("_drop").alias("drop")), F.when(move, ordinal)).alias("lm"),
        F.max(F.when(hard, ordinal)).alias("lh"),
        F.min(F.when(F.col("_head"), F.struct("ordinal", "ns", "packet"))).alias("head"),
        F.max(F.col("_seg")).alias("lo"), F.max("_cut_at").alias("lc"), F.max_by("_last", ordinal).alias("lk"))
    linked = F.coalesce(F.col("pm.ordinal") > F.coalesce("ph", F.lit(-1)), no)
    jump = F.coalesce(F.col("pm.drop") | (F.col("head.ns") < F.col("pm.ns")) | (F.col("head.ns") - F.col("pm.ns") >= gap_ns), no)
    state = (
        totals.withColumn("pm", F.last("lm", ignorenulls=True).over(earlier))
        .withColumn("ph", F.max("lh").over(earlier))
        .withColumn("head_linked", F.col("head").isNotNull() & linked)
        .withColumn("head_bad", F.col("head_linked") & (F.col("head.packet") <= F.col("pm.packet")))
        .withColumn("head_open", F.col("head").isNotNull() & (~linked | jump))
        .withColumn("head_seg", F.when(F.col("head_open"), F.struct(F.col("head.ordinal").alias("ordinal"), F.col("head.ns").alias("ns"))))
        .withColumn("in_seg", F.last(F.coalesce("lo", "head_seg"), ignorenulls=True).over(earlier))
        .withColumn("in_cut", F.max("lc").over(earlier))
        .withColumn("in_last", F.last("lk", ignorenulls=True).over(earlier))
        .select(F.col("session").alias("_js"), F.col(SLAB).alias("_jb"), "pm", "ph", "head_bad", "head_open",
                "head_seg", "in_seg", "in_cut", "in_last")
    )
    joined = local.filter(~hard).join(state, (F.col("session") == F.col("_js")) & (F.col(SLAB) == F.col("_jb")))
    opens = F.col("_open") | (F.col("_head") & F.col("head_open"))
    seg = F.coalesce("_seg", F.when(F.col("_head_at").isNotNull(), F.col("head_seg")), "in_seg")
    ended = F.coalesce("_cut_at", "in_cut", F.lit(-1))
    inside = (seg["ordinal"] > ended) & ((move & ~F.col("_drop")) | (kind == S.ATTACK))
    unclear = state.filter("head_bad").select(F.col("_js").alias("session"), F.coalesce("ph", F.lit(-1)).alias("stretch")).distinct()
    rows_out = joined.select(
        "session", "ordinal", "ns", "kind", "packet", "yaw", "has_look", "ground",
        F.when(~opens, F.coalesce("_prev", F.struct("pm.ns", "pm.packet", "pm.ordinal"))["ns"]).alias("prev_ns"),
        F.coalesce("_last", "in_last").alias("last_ns"),
        F.coalesce("_hard_at", "ph", F.lit(-1)).alias("stretch"),
        seg["ordinal"].alias("segment"), seg["ns"].alias("start_ns"),
        F.coalesce(inside, no).alias("inside"))
    return rows_out, unclear


def segment_obs(obs: DataFrame, gap_ns: int = 750 * MS, queue_ns: int = 100 * MS, rows: int = 65536) -> DataFrame:
    """Only the rows of ``segmented`` that belong to a segment; unclear stretches are folded."""
    rows_in, unclear = segmented(obs, gap_ns, queue_ns, rows)
    columns = ["session", "ordinal", "ns", "kind", "yaw", "has_look", "ground", "prev_ns", "last_ns", "segment", "start_ns"]
    plain = rows_in.filter("inside")
    if not unclear.limit(1).count():
        return plain.select(*columns)
    unclear = cut(unclear)
    folded = fold_sorted(rows_in.join(unclear, ["session", "stretch"], "left_semi"), ["session", "stretch"], ORDER, lambda: SegmentFold(gap_ns),
                         "session bigint, ordinal bigint, ns bigint, kind int, yaw double, has_look boolean, ground boolean, prev_ns bigint, last_ns bigint, segment bigint, start_ns bigint")
    return plain.join(unclear, ["session", "stretch"], "left_anti").select(*columns).unionByName(folded)


def clip_guard(obs: DataFrame, trials: DataFrame) -> DataFrame:
    """Keep events inside ``[start+guard, end-guard)`` of their trial.

    The trial table grows with the recordings, so the join is left to the size-checked planner choice.
    """
    guard = F.coalesce(F.col("guard_ms"), F.lit(5000)) * MS
    bounds = trials.select(F.col("trial_id").alias("trial"), (F.col("start_observed_ns") + guard).alias("clip_start"),
                           (F.col("end_observed_ns") - guard).alias("clip_stop"))
    return obs.join(bounds, "trial").filter((F.col("ns") >= F.col("clip_start")) & (F.col("ns") < F.col("clip_stop")))


def activity_islands(df: DataFrame, keys: list[str], order: list[str], at: str, gap, slab: Column) -> DataFrame:
    """Island number per key: a new island starts when the step in ``at`` exceeds ``gap``."""
    framed = step(slabs(df, slab), keys, order, _before=prev_row(F.col(at)))
    new = (F.col("_before").isNull() | (F.col(at) - F.col("_before") > gap)).cast("long")
    return step(framed.withColumn("_new", new), keys, order, island=running_sum(F.col("_new"))).drop("_before", "_new", SLAB)

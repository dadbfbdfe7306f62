"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def angle_wrap(d: Column) -> Column:
    """Signed difference in [-180, 180); the modulo floors."""
    return F.pmod(d + 180, F.lit(360.0)) - 180


def elapsed_ms(end: Column, start: Column) -> Column:
    return F.when(end >= start, (end - start) / 1e6).otherwise(F.lit(-1.0))


def length2(x: Column, z: Column) -> Column:
    return F.sqrt(x * x + z * z)


def length3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def finite_in(x: Column, low: float, high: float) -> Column:
    return is_finite(x) & x.between(low, high)


def axis_gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0.0), b_low - a_high, a_low - b_high)


def box_gap(a_low, a_high, b_low, b_high, pad: float) -> Column:
    """Distance between two boxes given as (x, y, z) column triples; ``b`` is padded."""
    gaps = [axis_gap(al, ah, bl - pad, bh + pad) for al, ah, bl, bh in zip(a_low, a_high, b_low, b_high)]
    return length3(*gaps)


def point_box(point, low, high, pad: float) -> Column:
    return box_gap(point, point, low, high, pad)


def look_vector(yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(yaw), F.radians(pitch)
    return -F.sin(a) * F.cos(b), -F.sin(b), F.cos(a) * F.cos(b)


def ray_hits_box(eye, direction, low, high, pad: float, far: float = 3.05) -> Column:
    """Slab test of a ray of length ``far`` against a padded box."""
    enter, leave, parallel_ok = [F.lit(0.0)], [F.lit(far)], F.lit(True)
    for e, d, lo, hi in zip(eye, direction, low, high):
        lo, hi = lo - pad, hi + pad
        parallel = F.abs(d) < 1e-10
        safe = F.when(parallel, F.lit(None).cast("double")).otherwise(d)
        a, b = (lo - e) / safe, (hi - e) / safe
        enter.append(F.least(a, b))
        leave.append(F.greatest(a, b))
        parallel_ok = parallel_ok & (~parallel | e.between(lo, hi))
    # greatest/least skip NULLs, so an axis parallel to the ray adds no bound
    return parallel_ok & (F.greatest(*enter) <= F.least(*leave))


def num3(x: Column) -> Column:
    """Three decimals without grouping; a tie of the shortest decimal form rounds up."""
    return F.format_string("%.3f", x)


def expected_ms(damage: Column) -> Column:
    return F.ceil(F.lit(1.0) / damage).cast("double") * 50.0


def tick_aligned(x: Column) -> Column:
    return F.abs(x - F.floor(x / 50 + 0.5) * 50) <= 2


def alpha_spent(alpha: Column | float, k: Column) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return alpha / (k * (k + 1))


def utc_day(epoch_ms: Column) -> Column:
    """UTC date of an epoch-millisecond value, whatever the session time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch_ms / F.lit(86400000)).cast("int"))


# Product names of older recordings and what they are called now.
CLIENT_ALIASES = {"vanilla-auto": "vanilla", "vape-auto": "vape"}


def client_name(c: Column) -> Column:
    pairs = [F.lit(v) for kv in CLIENT_ALIASES.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)


def condition_label(condition: Column) -> Column:
    return F.when(condition == "hacking", "cheat").when(condition.isin("legit", "control"), "legit")


def clean_text(s: Column, limit: int) -> Column:
    """The first ``limit`` characters as printable ASCII, with an ellipsis when cut."""
    safe = F.regexp_replace(F.substring(s, 1, limit), "[^\\x20-\\x7e]", "?")
    return F.when(F.length(s) > limit, F.concat(safe, F.lit("..."))).otherwise(safe)


def _number(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(finite_in(x, 0.0, 1e9), x)


def fmt_rate(text: Column) -> Column:
    """Two decimals of a number kept as text; ``?`` when absent or out of range."""
    x = _number(text)
    return F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise(F.lit("?"))


def fmt_ms(text: Column) -> Column:
    x = F.when(F.length(text) <= 32, _number(text))
    return F.when(x.isNotNull(), F.format_string("%.0f ms", x)).otherwise(F.lit("? ms"))


def features_json(*names: str) -> Column:
    """JSON object with sorted keys, as stored with a window."""
    return F.to_json(F.struct(*sorted(names)))


def evidence_map(**values: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))


def group_key(identifier: Column) -> Column:
    return F.substring(F.sha2(identifier, 256), 1, 24)


def hmac_group_key(identifier: Column, key: bytes) -> Column:
    """HMAC-SHA256 from its definition, in JVM expressions; 24 hex digits are kept."""
    block = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(identifier, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, digest), 256), 1, 24)


def identity(*fields: str) -> Column:
    """SHA-256 of the canonical JSON object (sorted keys, no spaces) of the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def text_identity(s: Column) -> Column:
    """The same for one plain string."""
    return F.sha2(F.concat(F.lit('"'), s, F.lit('"')), 256)

"""Small statistics: binomial bounds and tests."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function from 1 on: Stirling's series ten places higher."""
    y = x + 10
    lower = reduce(lambda p, i: p * (x + i), range(1, 10), x)
    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) - F.log(lower)


def fpr_upper(k: Column, n: Column, level: float = 0.95) -> Column:
    """One-sided Clopper-Pearson upper bound of a rate with ``k`` failures in ``n`` (null without trials).

    The chance of at most k failures is an incomplete beta function of q = 1 - rate, a power times a continued fraction;
    60 halvings of [0, (n - k) / (n + 1)] find where it is 1 - level (at the right end it is over a third). The fraction is
    taken to a depth that grows with the square root of n.
    """
    n, k = n.cast("double"), k.cast("double")
    a, b = n - k, k + 1
    # 1 / (1 + c1 / (1 + c2 / ...)); the coefficients without q, the deepest first
    depth = (60 + 8 * F.ceil(F.sqrt(n))).cast("int")

    def coefficient(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        return F.when(j % 2 == 0, m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)))

    known = F.struct(F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), coefficient).alias("c"), (log_gamma(n + 1) - log_gamma(a + 1) - log_gamma(b)).alias("log"))

    def at_most(q: Column, of: Column) -> Column:
        return F.exp(of["log"] + a * F.log(q) + b * F.log1p(-q)) / F.aggregate(of["c"], F.lit(1.0), lambda below, c: 1 + c * q / below)

    def halve(s: Column, of: Column) -> Column:
        q = (s["low"] + s["high"]) / 2
        return F.when(at_most(q, of) < 1 - level, F.struct(q.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), q.alias("high")))

    span = F.struct(F.lit(0.0).alias("low"), (a / (n + 1)).alias("high"))
    found = F.transform(F.array(known), lambda of: F.aggregate(F.sequence(F.lit(1), F.lit(60)), span, lambda s, _: halve(s, of), lambda s: 1 - (s["low"] + s["high"]) / 2))[0]
    return F.when(n <= 0, F.lit(None)).when(k >= n, F.lit(1.0)).when(k == 0, 1 - F.pow(F.lit(1 - level), 1 / n)).otherwise(found)


def sign_test_p(wins: str, n: str) -> str:
    """SQL text of the two-sided sign test: twice the smaller binomial tail at one half, at most 1."""
    tail = (f"aggregate(sequence(1, greatest(1, least({wins}, {n} - {wins}))), struct(1D AS term, 1D AS total), "
            f"(a, i) -> CASE WHEN i > least({wins}, {n} - {wins}) THEN a ELSE struct(a.term * ({n} - i + 1) / i AS term, a.total + a.term * ({n} - i + 1) / i AS total) END, a -> a.total)")
    return f"CASE WHEN {n} = 0 THEN 1D ELSE least(1D, 2 * {tail} * pow(0.5D, {n})) END"

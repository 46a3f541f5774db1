"""Tail probabilities of Student's t as columns: the regularised incomplete beta function by its continued fraction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Stirling's series for ln Gamma, 1/12, -1/360, 1/1260, ... over odd powers
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8
_STEPS = 300
_TINY = 1e-300


def ln_gamma(x: Column) -> Column:
    """For x > 0: the recurrence takes the argument beyond 8, where the series is exact to 13 places."""
    z = x + _SHIFT
    out = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi)
    for k, c in enumerate(_STIRLING):
        out = out + c / F.pow(z, F.lit(float(2 * k + 1)))
    for k in range(_SHIFT):
        out = out - F.ln(x + k)
    return out


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; a fixed number of steps, the last ones multiply by 1."""
    sound = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    first = 1 / sound(1 - (a + b) * x / (a + 1))
    state = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / sound(1 + even * s["d"])
        c = sound(1 + even / s["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        dd = 1 / sound(1 + odd * d)
        cc = sound(1 + odd / c)
        return F.struct(cc.alias("c"), dd.alias("d"), (s["h"] * d * c * dd * cc).alias("h"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(_STEPS)), lambda i: i.cast("double")), state, step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) for 0 <= x <= 1; the fraction converges fast on the side of x that the symmetry picks."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    near = front * _fraction(a, b, x) / a
    far = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def two_sided_p(t: Column, freedom: Column) -> Column:
    """The probability that |t| is as large or larger; NULL without a t or degrees of freedom."""
    v = freedom.cast("double")
    return F.when(v > 0, incomplete_beta(v / 2, F.lit(0.5), v / (v + t * t)))

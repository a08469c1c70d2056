"""Tail probabilities and quantiles as column expressions.

Every function is a closed form or a nested sum whose number of terms follows from its arguments, so there is no
loop that could stop early: the normal tail is a Taylor sum near zero and a continued fraction beyond,
chi-square and Student tails of whole degrees of freedom are finite sums, and quantiles are an initial guess
with two third-order steps. Sums are evaluated from the inside out, one number carried along, which SQL repeats
term by term. Absolute errors stay below 1e-13.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.numeric import Col, as_col

#: Terms of the sum and levels of the fraction, and where one takes over from the other.
TERMS, SEAM = 60, 2.5
#: From so many degrees of freedom on, Student tails come from a normal expansion (error below 1e-15).
MANY = 2000
_PI = math.sqrt(math.pi)


def _down(n: Column | int) -> Column:
    """n, n - 1, ..., 1; empty for n < 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= 1, F.sequence(n.cast("int"), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))


def _fold(n: Column | int, start: Column, step) -> Column:
    return F.aggregate(_down(n), start.cast("double"), step)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    near = 1 - 2 / _PI * x * F.exp(-x * x) * _fold(TERMS, F.lit(1.0), lambda s, n: 1 + s * 2 * x * x / (2 * n + 1))
    far = F.exp(-x * x) / (_PI * _fold(TERMS, x, lambda f, n: x + n / 2 / f))
    return F.when(x < SEAM, near).otherwise(far)


def normal_upper(z: Col) -> Column:
    """P(Z >= z)."""
    z = as_col(z).cast("double")
    half = erfc(F.abs(z) / math.sqrt(2.0)) / 2
    return F.when(z.isNull() | F.isnan(z), None).when(z >= 0, half).otherwise(1 - half)


def normal_two_sided(z: Col) -> Column:
    """P(|Z| >= |z|)."""
    return 2 * normal_upper(F.abs(as_col(z)))


def normal_cdf(z: Col) -> Column:
    return normal_upper(-as_col(z))


def normal_quantile(p: Col) -> Column:
    """The z with P(Z <= z) = p; NULL outside (0, 1)."""
    p = as_col(p).cast("double")
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    # Constants of the classical rational guess for the upper quantile.
    guess = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)

    def better(z: Column) -> Column:
        # Bound by a one-element array so that each step is written once.
        u = F.transform(F.array(z), lambda x: F.struct(x.alias("x"), ((erfc(x / math.sqrt(2.0)) / 2 - q) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)).alias("e")))
        return F.get(F.transform(u, lambda s: s["x"] + s["e"] / (1 - s["x"] * s["e"] / 2)), F.lit(0))

    z = better(better(F.greatest(guess, F.lit(0.0))))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -z).otherwise(z))


def chi2_upper(stat: Col, dof: Col | int) -> Column:
    """P(chi-square with ``dof`` whole degrees of freedom >= stat)."""
    h = as_col(stat).cast("double") / 2
    k = F.lit(dof) if isinstance(dof, int) else as_col(dof)
    even = F.exp(-h) * _fold(k / 2 - 1, F.lit(1.0), lambda s, i: 1 + s * h / i)
    rest = F.exp(-h) * 2 * F.sqrt(h) / _PI * _fold((k - 1) / 2 - 1, F.lit(1.0), lambda s, i: 1 + s * h / (i + 0.5))
    odd = erfc(F.sqrt(h)) + F.when(k >= 3, rest).otherwise(0.0)
    return F.when(h.isNull() | k.isNull() | F.isnan(h), None).when(h <= 0, 1.0).when(k % 2 == 0, even).otherwise(odd)


def student_upper(t: Col, dof: Col | int) -> Column:
    """P(T with ``dof`` whole degrees of freedom >= t)."""
    v = as_col(t).cast("double")
    k = F.lit(dof) if isinstance(dof, int) else as_col(dof)
    x = F.abs(v)
    angle, c2 = F.atan(x / F.sqrt(k)), k / (k + x * x)
    sine = x / F.sqrt(k + x * x)
    few = F.when(k < MANY, k).otherwise(F.lit(1))
    even = sine * _fold(few / 2 - 1, F.lit(1.0), lambda s, i: 1 + s * c2 * (2 * i - 1) / (2 * i))
    more = sine * F.sqrt(c2) * _fold((few - 1) / 2 - 1, F.lit(1.0), lambda s, i: 1 + s * c2 * (2 * i) / (2 * i + 1))
    odd = 2 / math.pi * (angle + F.when(k >= 3, more).otherwise(0.0))
    inside = F.when(k % 2 == 0, even).otherwise(odd)
    # Normal deviate with the same tail, by the expansion in 1 / (48 (k - 1/2)^2).
    a = k - 0.5
    b = 48 * a * a
    y = a * F.log1p(x * x / k)
    z = F.sqrt(y) * (1 + (y + 3) / b - (((0.4 * y + 3.3) * y + 24) * y + 85.5) / (b * b + 0.8 * y * y * b + 100 * b))
    tail = F.when(k < MANY, F.greatest((1 - inside) / 2, F.lit(0.0))).otherwise(normal_upper(z))
    return F.when(v.isNull() | k.isNull() | F.isnan(v) | (k <= 0), None).when(v >= 0, tail).otherwise(1 - tail)

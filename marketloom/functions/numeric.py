"""Guarded arithmetic, ranks and moment expressions built from Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Col = Column | str

#: Below this spread a series counts as constant (fixed value of the metric definitions).
FLAT = 1e-15


def as_col(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Col) -> Column:
    """NULL instead of NaN or an infinity."""
    x = as_col(value).cast("double")
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(~bad, x)


def safe_divide(
    num: Col, den: Col, epsilon: float = 0.0, fallback: float | None = None
) -> Column:
    """``num / den``; a denominator within ``epsilon`` of zero gives ``fallback``."""
    n, d = as_col(num), as_col(den)
    small = F.abs(d) <= F.lit(float(epsilon))
    miss = F.lit(fallback).cast("double")
    return F.when(n.isNull() | d.isNull(), None).when(small, miss).otherwise(F.try_divide(n, d))


def clip(value: Col, low: Col | float, high: Col | float) -> Column:
    """Bound ``value``; NULL stays NULL although least/greatest skip NULLs."""
    x = as_col(value)
    lo = F.lit(low) if isinstance(low, (int, float)) else as_col(low)
    hi = F.lit(high) if isinstance(high, (int, float)) else as_col(high)
    return F.when(x.isNotNull(), F.least(hi, F.greatest(lo, x)))


def positive_ratio(num: Col, den: Col) -> Column:
    """``num / den`` where both sides are above zero, else NULL."""
    n, d = as_col(num), as_col(den)
    return F.when((n > 0) & (d > 0), F.try_divide(n, d))


def average_rank(value: Col, partition: Sequence[Col]) -> Column:
    """Rank with ties averaged; NULLs take no rank and do not move others.

    Rows below plus one (``rank``) and rows up to the last peer (a RANGE count) are
    taken over one window specification, so a single sort serves both.
    """
    x = as_col(value)
    w = Window.partitionBy(*[as_col(p) for p in partition]).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / F.lit(2.0))


def correlation(left: Col, right: Col) -> Column:
    """Aggregate Pearson correlation over rows where both sides are present.

    NULL when one side is flat; ``F.corr`` raises there in ANSI mode.
    """
    x0, y0 = as_col(left), as_col(right)
    both = x0.isNotNull() & y0.isNotNull()
    x, y = F.when(both, x0), F.when(both, y0)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when(
        (sx > FLAT) & (sy > FLAT), clip(F.try_divide(F.covar_pop(x, y), sx * sy), -1.0, 1.0)
    )


def mean_over_std(value: Col) -> Column:
    """mean / sample std with a flat guard: 0 for a flat or single-row series."""
    x = as_col(value)
    sd = F.stddev_samp(x)
    return F.when(F.count(x) == 0, None).otherwise(
        F.when(sd > FLAT, F.try_divide(F.avg(x), sd)).otherwise(F.lit(0.0))
    )


def weighted_mean(value: Col, weight: Col) -> Column:
    """Σvw/Σw over rows with a value and a positive weight; no mass gives NULL."""
    v, w = as_col(value), as_col(weight)
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))

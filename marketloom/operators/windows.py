"""Windows over time, per asset.

A rolling value needs every row of its frame: it is NULL on short prefixes and when any
input in the frame is NULL. Partitions are bars of one asset (or asset and session), whose
size the calendar bounds; raw ticks go through ``operators.chunks`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.numeric import FLAT, Col, as_col, positive_ratio


def along(by: Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    keys = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*by).orderBy(*keys)


def lagged(value: Col, n: int, by: Sequence[str], order: str) -> Column:
    return F.lag(as_col(value), n).over(along(by, order))


def simple_return(value: Col, width: int, by: Sequence[str], order: str) -> Column:
    """Return across ``width`` bars, that is over ``width - 1`` steps; both ends positive."""
    return positive_ratio(value, lagged(value, width - 1, by, order)) - 1


def log_return(value: Col, width: int, by: Sequence[str], order: str) -> Column:
    return F.log(positive_ratio(value, lagged(value, width - 1, by, order)))


def frame(width: int, by: Sequence[str], order: str) -> WindowSpec:
    return along(by, order).rowsBetween(-(width - 1), 0)


def gated(agg: Column, value: Col, width: int, by: Sequence[str], order: str) -> Column:
    """``agg`` over the frame, only where all ``width`` inputs are present."""
    f = frame(width, by, order)
    return F.when(F.count(as_col(value)).over(f) == width, agg.over(f))


def rolling_mean(value: Col, width: int, by: Sequence[str], order: str) -> Column:
    return gated(F.avg(as_col(value)), value, width, by, order)


def rolling_std(value: Col, width: int, by: Sequence[str], order: str) -> Column:
    """Population standard deviation."""
    return gated(F.stddev_pop(as_col(value)), value, width, by, order)


def rolling_min(value: Col, width: int, by: Sequence[str], order: str) -> Column:
    return gated(F.min(as_col(value)), value, width, by, order)


def rolling_max(value: Col, width: int, by: Sequence[str], order: str) -> Column:
    return gated(F.max(as_col(value)), value, width, by, order)


def rolling_median(value: Col, width: int, by: Sequence[str], order: str, minimum: int, lag: int = 0) -> Column:
    """Median of up to ``width`` rows ending ``lag`` rows back, from ``minimum`` values on.

    ``median`` takes no row frame, so the bounded frame is collected and sorted.
    """
    w = along(by, order).rowsBetween(-(width - 1) - lag, -lag)
    arr = F.sort_array(F.collect_list(as_col(value)).over(w))
    n = F.size(arr)
    low = F.element_at(arr, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(arr, F.floor((n + 2) / 2).cast("int"))
    return F.when(n >= max(minimum, 1), (low + high) / 2)


def window_reason(complete: Col, width: int, by: Sequence[str], order: str, value: Col | None = None) -> Column:
    """Why a rolling value is missing: history, then an incomplete bar, then the number."""
    have = F.count(F.lit(1)).over(frame(width, by, order))
    whole = F.min(as_col(complete).cast("int")).over(frame(width, by, order))
    out = F.when(have < width, "INSUFFICIENT_HISTORY").when(whole == 0, "INCOMPLETE_BAR")
    if value is not None:
        out = out.when(as_col(value).isNull(), "NUMERIC_UNAVAILABLE")
    return out


def forward_return(
    value: Col, horizon: int, by: Sequence[str], order: str, before: Column | None = None, log: bool = False
) -> Column:
    """Return over the next ``horizon`` bars; NULL when the target is at or past ``before``."""
    w = along(by, order)
    ratio = positive_ratio(F.lead(as_col(value), horizon).over(w), value)
    out = F.log(ratio) if log else ratio - 1
    if before is None:
        return out
    return F.when(F.lead(F.col(order), horizon).over(w) < before, out)


def rolling_performance(df: DataFrame, ret: str, width: int, annual: float, by: Sequence[str], order: str) -> DataFrame:
    """Rolling compound return, volatility and Sharpe; prefixes use what they have."""
    f = frame(width, by, order)
    root = annual**0.5
    sd = F.coalesce(F.stddev_samp(ret).over(f), F.lit(0.0))
    return df.withColumns(
        {
            "window_rows": F.count(ret).over(f),
            "window_return": F.product(F.col(ret) + 1).over(f) - 1,
            "window_vol": sd * root,
            "window_sharpe": F.when(sd > FLAT, F.avg(ret).over(f) / sd * root).otherwise(0.0),
        }
    )


def nav_and_drawdown(df: DataFrame, ret: str, by: Sequence[str], order: str, from_one: bool = False) -> DataFrame:
    """Compounded NAV, running peak and drawdown; the peak starts at the first NAV or at 1."""
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("nav", F.product(F.col(ret) + 1).over(w))
    peak = F.max("nav").over(w)
    out = out.withColumn("peak", F.greatest(peak, F.lit(1.0)) if from_one else peak)
    return out.withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def stepped(df: DataFrame, width: int, step: int, by: Sequence[str], order: str) -> DataFrame:
    """Keep full-window endpoints every ``step`` rows, and always the last row."""
    w = along(by, order)
    d = df.withColumns({"_rn": F.row_number().over(w), "_nx": F.lead(F.col(order)).over(w)})
    keep = (F.col("_rn") >= width) & (((F.col("_rn") - width) % step == 0) | F.col("_nx").isNull())
    return d.where(keep).drop("_rn", "_nx")


def volume_surprise(volume: Col, width: int, by: Sequence[str], order: str) -> tuple[Column, Column]:
    """Last volume against the mean of the ``width - 1`` before it, and its reason."""
    ref = along(by, order).rowsBetween(-(width - 1), -1)
    full = F.count(as_col(volume)).over(ref) == width - 1
    mean = F.when(full, F.avg(as_col(volume)).over(ref))
    value = F.when(mean > 0, as_col(volume) / mean - 1)
    return value, F.when(mean <= 0, "ZERO_REFERENCE_VOLUME").when(value.isNull(), "INSUFFICIENT_HISTORY")


def close_location() -> Column:
    spread = F.col("high") - F.col("low")
    return F.when(spread <= FLAT, F.lit(0.0)).otherwise(F.try_divide(F.col("close") - F.col("low"), spread) - 0.5)


def range_mean(width: int, by: Sequence[str], order: str) -> Column:
    return rolling_mean(F.try_divide(F.col("high") - F.col("low"), F.col("close")), width, by, order)


def trailing_sessions(df: DataFrame, by: Sequence[str], session: str, width: int, value: str, name: str) -> DataFrame:
    """Mean of ``value`` over the last ``width`` distinct sessions, the current included.

    Sessions collapse to sums first; the window then runs on one row per session.
    """
    per = df.groupBy(*by, session).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    f = Window.partitionBy(*by).orderBy(session).rowsBetween(-(width - 1), 0)
    per = per.withColumn(name, F.try_divide(F.sum("_s").over(f), F.sum("_c").over(f)))
    return per.select(*by, session, name)

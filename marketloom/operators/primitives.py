"""The vocabulary of primitive candidates, computed together on one panel of bars.

A candidate is a kind and a window of bars. All of them are columns over one (asset, session) layout, so the
panel is shuffled and sorted once however many candidates there are, and only the result is a long table. A
session bounds the rows of a partition; how many bars came before it is a running total over session counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import positive_ratio
from marketloom.operators import windows

# The kinds in their order, each with its shortest and longest window.
KINDS = {
    "reversal": (2, 13),
    "momentum": (2, 13),
    "range_mean": (1, 13),
    "return_volatility": (2, 13),
    "volume_surprise": (2, 13),
    "close_location": (1, 1),
}


@dataclass(frozen=True)
class Primitive:
    kind: str
    window: int

    def __post_init__(self) -> None:
        low, high = KINDS[self.kind]
        if not low <= self.window <= high:
            raise ValueError(f"{self.kind}: window {self.window} outside {low}..{high}")

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.window:02d}"


def vocabulary() -> list[Primitive]:
    """Every kind with every window it allows, in order."""
    return [Primitive(kind, w) for kind, (low, high) in KINDS.items() for w in range(low, high + 1)]


def _within(last: str, width: int) -> Column:
    """Whether the last bar marked by ``last`` (a position in the session, 0 for none) lies in the window."""
    return (F.col(last) > 0) & (F.col("_p") - F.col(last) < width)


def _base(p: Primitive, by: Sequence[str], ts: str) -> tuple[str, Column] | None:
    """The one window expression that a candidate needs; reversal and momentum share theirs."""
    w, along = p.window, windows.along(by, ts)
    if p.kind in ("momentum", "reversal"):
        return f"_close{w}", F.lag("close", w - 1).over(along)
    if p.kind == "range_mean":
        return f"_range{w}", F.avg("_rg").over(along.rowsBetween(1 - w, 0))
    if p.kind == "return_volatility":
        return f"_dev{w}", F.stddev_pop("_lr").over(along.rowsBetween(2 - w, 0))
    if p.kind == "volume_surprise":
        return f"_mean{w}", F.avg("volume").over(along.rowsBetween(1 - w, -1))
    return None


def _value(p: Primitive) -> Column:
    w = p.window
    if p.kind in ("momentum", "reversal"):
        ratio = positive_ratio("close", F.col(f"_close{w}"))
        return ratio - 1 if p.kind == "momentum" else 1 - ratio
    if p.kind == "range_mean":
        return F.when(~_within("_no_rg", w), F.col(f"_range{w}"))
    if p.kind == "return_volatility":
        return F.when(~_within("_no_lr", w - 1), F.col(f"_dev{w}"))
    if p.kind == "volume_surprise":
        return F.when(~_within("_no_volume", w) & (F.col(f"_mean{w}") > 0), F.col("volume") / F.col(f"_mean{w}") - 1)
    return windows.close_location()


def candidate_values(
    panel: DataFrame, candidates: Sequence[Primitive], keep: Sequence[str],
    asset: str = "asset", session: str = "session_date", ts: str = "ts", complete: str = "is_complete",
) -> DataFrame:
    """One row per bar and candidate: ``keep``, candidate, value and, where it is missing, the reason.

    A window takes the asset's last bars. The first of these that holds is the reason: fewer bars exist
    (INSUFFICIENT_HISTORY), some belong to an earlier session (CROSS_SESSION_WINDOW), some are incomplete or of
    unknown state (INCOMPLETE_BAR), the volumes before the bar have no positive mean (ZERO_REFERENCE_VOLUME), an
    input is missing or not positive where it must be (NUMERIC_UNAVAILABLE). ``keep`` must not name a column that
    starts with an underscore. One row per asset and ``ts``; an empty panel gives no rows.
    """
    by = [asset, session]
    counts = panel.groupBy(*by).agg(F.count("*").alias("_c"), F.min(ts).alias("_t"))
    earlier = Window.partitionBy(asset).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(asset).alias("_a"), F.col(session).alias("_s"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_prior"))
    so_far = windows.along(by, ts).rowsBetween(Window.unboundedPreceding, 0)
    spread = F.try_divide(F.col("high") - F.col("low"), F.col("close"))
    d = panel.withColumns({"_p": F.count("*").over(so_far), "_lr": windows.log_return("close", 2, by, ts), "_rg": spread})
    marks = {"_bad": ~F.coalesce(F.col(complete), F.lit(False)), "_no_rg": F.col("_rg").isNull(), "_no_lr": F.col("_lr").isNull(), "_no_volume": F.col("volume").isNull()}
    d = d.withColumns({k: F.coalesce(F.max(F.when(c, F.col("_p"))).over(so_far), F.lit(0)) for k, c in marks.items()}
                      | dict(filter(None, (_base(p, by, ts) for p in candidates))))
    d = d.join(counts, d[asset].eqNullSafe(F.col("_a")) & d[session].eqNullSafe(F.col("_s")))
    cells = []
    for p in candidates:
        value = _value(p)
        reason = (
            F.when(F.col("_p") + F.col("_prior") < p.window, "INSUFFICIENT_HISTORY").when(F.col("_p") < p.window, "CROSS_SESSION_WINDOW")
            .when(_within("_bad", p.window), "INCOMPLETE_BAR"))
        if p.kind == "volume_surprise":
            reason = reason.when(~_within("_no_volume", p.window) & (F.col(f"_mean{p.window}") <= 0), "ZERO_REFERENCE_VOLUME")
        cells.append(F.struct(F.lit(p.name).alias("candidate"), value.alias("value"), reason.alias("reason")))
    out = d.select(*keep, F.inline(F.array(*cells)))
    missing = F.col("value").isNull() | F.isnan("value")
    out = out.withColumn("reason", F.coalesce("reason", F.when(missing, "NUMERIC_UNAVAILABLE")))
    return out.withColumn("value", F.when(F.col("reason").isNull(), F.col("value")))

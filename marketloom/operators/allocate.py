"""Weights over factors from released history only.

History rows: candidate, session, value. A decision at a session uses earlier sessions
whose outcome is available; weights fall back to equal, never to cash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import FLAT, average_rank, correlation, weighted_mean


def session_index(df: DataFrame, session: str) -> DataFrame:
    return df.select(session).distinct().withColumn("_i", F.row_number().over(Window.orderBy(session)))


def trailing_quality(history: DataFrame, session: str, value: str, lookback: int, minimum: int) -> DataFrame:
    """Mean over the previous ``lookback`` sessions (the current one excluded) per candidate."""
    h = history.join(session_index(history, session), session)
    w = Window.partitionBy("candidate").orderBy("_i").rangeBetween(-lookback, -1)
    q = F.when(F.count(value).over(w) >= minimum, F.avg(value).over(w))
    return h.withColumn("quality", q).drop("_i")


def positive_or_equal(df: DataFrame, by: Sequence[str], quality: str, weight: str = "weight") -> DataFrame:
    """max(q, 0) normalized; without positive mass every member gets 1/N."""
    w = Window.partitionBy(*by)
    pos = F.greatest(F.coalesce(F.col(quality), F.lit(0.0)), F.lit(0.0))
    d = df.withColumn("_q", pos).withColumn("_mass", F.sum("_q").over(w))
    d = d.withColumn("fallback", ~(F.col("_mass") > 0))
    return d.withColumn(weight, F.when(F.col("fallback"), F.lit(1.0) / F.count("*").over(w)).otherwise(F.col("_q") / F.col("_mass"))).drop("_q", "_mass")


def rolling_allocator(history: DataFrame, session: str, value: str, lookback: int, minimum: int) -> DataFrame:
    q = trailing_quality(history, session, value, lookback, minimum)
    return positive_or_equal(q, [session], "quality")


def regime_allocator(history: DataFrame, probabilities: DataFrame, session: str, value: str, lookback: int, minimum: int) -> DataFrame:
    """State-wise trailing quality, normalized per state, mixed by current probabilities.

    probabilities: session, state, p.
    """
    h = history.join(session_index(history, session), session).join(probabilities, session)
    w = Window.partitionBy("candidate", "state").orderBy("_i").rangeBetween(-lookback, -1)
    ok = F.col(value).isNotNull() & (F.col("p") > 0)
    num = F.sum(F.when(ok, F.col(value) * F.col("p"))).over(w)
    mass = F.sum(F.when(ok, F.col("p"))).over(w)
    seen = F.count(F.when(ok, F.lit(1))).over(w)
    h = h.withColumn("quality", F.when((mass > 1e-12) & (seen >= minimum), num / mass))
    s = positive_or_equal(h, [session, "state"], "quality", "part")
    return s.groupBy(session, "candidate").agg(
        F.sum(F.col("p") * F.col("part")).alias("weight"), F.count_if(F.col("fallback") & (F.col("p") > 0)).alias("failed_states"))


def ridge_meta(examples: DataFrame, by: Sequence[str], x1: str, x2: str, y: str, alpha: float, minimum: int) -> DataFrame:
    """Non-negative ridge on two standardized features, solved from sums.

    With two features the active sets are few: both, either one, or none.
    """
    d = examples.where(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"), F.stddev_pop(x1).alias("s1"), F.stddev_pop(x2).alias("s2"),
        F.covar_pop(x1, x2).alias("_c12"), F.covar_pop(x1, y).alias("_c1y"), F.covar_pop(x2, y).alias("_c2y"))
    n = F.col("n")
    s1, s2 = (F.when(F.col(c) > FLAT, F.col(c)).otherwise(1.0) for c in ("s1", "s2"))
    g = g.withColumns({"s1": s1, "s2": s2})
    a12 = n * F.col("_c12") / (F.col("s1") * F.col("s2"))
    b1, b2 = n * F.col("_c1y") / F.col("s1"), n * F.col("_c2y") / F.col("s2")
    d0 = n + alpha
    det = d0 * d0 - a12 * a12
    u1, u2 = (d0 * b1 - a12 * b2) / det, (d0 * b2 - a12 * b1) / det
    both = (u1 >= 0) & (u2 >= 0)
    only1, only2 = F.greatest(b1, F.lit(0.0)), F.greatest(b2, F.lit(0.0))
    first = only1 >= only2
    zero = F.lit(0.0)
    c1 = F.when(both, u1).when(first, only1 / d0).otherwise(zero)
    c2 = F.when(both, u2).when(first, zero).otherwise(only2 / d0)
    short = n < minimum
    return g.select(*by, "n", "m1", "m2", "s1", "s2", F.when(short, 0.0).otherwise(c1).alias("coef1"), F.when(short, 0.0).otherwise(c2).alias("coef2"),
                    F.when(short, 0.0).otherwise(F.col("my")).alias("intercept"), F.when(short, "INSUFFICIENT_SAMPLES").alias("reason"))


def weight_metrics(weights: DataFrame, by: Sequence[str], session: str, fallback: Column) -> DataFrame:
    """Mean concentration, mean turnover and fallback sessions of a weight series."""
    from marketloom.operators.cross import turnover

    per = weights.groupBy(*by, session).agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.max(fallback.cast("int")).alias("fb"))
    t = turnover(weights, session, "candidate", "weight", by)
    return per.join(t, [*by, session]).groupBy(*by).agg(
        F.count("*").alias("sessions"), F.avg("hhi").alias("concentration"), F.avg("turnover").alias("mean_turnover"), F.sum("fb").alias("fallbacks"))


def conditional_change(equity: DataFrame, probabilities: DataFrame, by: Sequence[str], session: str, value: str) -> DataFrame:
    """Relative change of equity per state, weighted by the probability known before it."""
    w = Window.partitionBy(*by).orderBy(session)
    e = equity.withColumns({"_chg": F.col(value) / F.lag(value).over(w) - 1, session: F.lag(session).over(w), "_now": F.col(session)})
    j = e.where(F.col(session).isNotNull()).join(probabilities, session)
    return j.groupBy(*by, "state").agg(weighted_mean("_chg", "p").alias("mean_change"), F.count("_chg").alias("intervals"))


def completed_session(signals: DataFrame, by: Sequence[str], session: str, slot: str, asset: str, signal: str, price: str, horizon: int, minimum: int) -> DataFrame:
    """Mean rank IC of a session's decisions whose outcome lies inside the session."""
    out = signals.select(*by, session, asset, (F.col(slot) - horizon).alias(slot), F.col(price).alias("_t"))
    j = signals.join(out, [*by, session, asset, slot], "left").withColumn("_y", F.col("_t") / F.col(price) - 1)
    part = [*by, session, slot]
    d = j.where(F.col(signal).isNotNull() & F.col("_y").isNotNull())
    d = d.select(*part, average_rank(signal, part).alias("a"), average_rank("_y", part).alias("b"))
    ic = d.groupBy(*part).agg(F.count("*").alias("n"), correlation("a", "b").alias("ic")).where(F.col("n") >= minimum)
    return ic.groupBy(*by, session).agg(F.count("ic").alias("decisions"), F.avg("ic").alias("session_ic"))

"""Cross-sections: windows over the assets present at one timestamp.

A panel holds one row per (timestamp, asset) after resampling, so a partition is bounded by
the asset universe, however long the history grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import FLAT, Col, as_col, average_rank, clip
from marketloom.functions.solve import solve_normal
from marketloom.settings import cut_lineage


def over(by: Sequence[str]):
    return Window.partitionBy(*by)


def breadth(value: Col, by: Sequence[str]) -> Column:
    return F.count(as_col(value)).over(over(by))


def percentile_rank(value: Col, by: Sequence[str], minimum: int = 2) -> Column:
    """Average rank scaled to [0, 1]; narrow cross-sections give NULL."""
    n = breadth(value, by)
    return F.when(n >= max(minimum, 2), (average_rank(value, by) - 1) / (n - 1))


def zscore_population(value: Col, by: Sequence[str], minimum: int = 2) -> Column:
    x, w = as_col(value), over(by)
    sd = F.stddev_pop(x).over(w)
    return F.when((F.count(x).over(w) >= minimum) & (sd > FLAT), (x - F.avg(x).over(w)) / sd)


def zscore_sample(value: Col, by: Sequence[str]) -> Column:
    """A flat cross-section scores 0, a single asset gives NULL."""
    x, w = as_col(value), over(by)
    sd = F.stddev_samp(x).over(w)
    flat = F.when(x.isNotNull(), F.lit(0.0))
    return F.when(F.count(x).over(w) >= 2, F.when(sd > FLAT, (x - F.avg(x).over(w)) / sd).otherwise(flat))


def winsorized(value: Col, by: Sequence[str], low: float, high: float) -> Column:
    x, w = as_col(value), over(by)
    return clip(x, F.percentile(x, F.lit(low)).over(w), F.percentile(x, F.lit(high)).over(w))


def regime_gate(df: DataFrame, regimes: DataFrame, allowed: Sequence[str], value: str, ts: str) -> DataFrame:
    """Keep values only in allowed regimes known by then; others carry a reason.

    regimes: ts, regime, known_at (at most one row per ts).
    """
    j = df.join(regimes, ts, "left")
    known = F.col("regime").isNotNull() & (F.col("known_at") <= F.col(ts))
    ok = known & F.col("regime").isin(list(allowed))
    return j.withColumn("gated", F.when(ok, F.col(value))).withColumn(
        "reason", F.when(~known | F.col("regime").isNull(), "REGIME_UNAVAILABLE").when(~ok, "REGIME_EXCLUDED")
    ).drop("regime", "known_at")


def neutralized(value: Col, exposure: Col, by: Sequence[str]) -> Column:
    """Residual of a one-factor regression with intercept inside the cross-section."""
    w = over(by)
    both = as_col(value).isNotNull() & as_col(exposure).isNotNull()
    y, x = F.when(both, as_col(value)), F.when(both, as_col(exposure))
    var = F.var_pop(x).over(w)
    slope = F.try_divide(F.covar_pop(y, x).over(w), var)
    return F.when(
        (F.count(y).over(w) > 2) & (var > FLAT), y - F.avg(y).over(w) - slope * (x - F.avg(x).over(w))
    )


def neutralized_many(df: DataFrame, value: str, exposures: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Residual on several exposures with intercept, by the normal equations of each cross-section.

    The moments are one aggregate that combines before its shuffle; a small elimination gives the coefficients
    and every row looks up those of its cross-section. Exposures that others span get coefficient 0, which
    leaves residuals as they are. NULL where an input is missing or rows don't exceed exposures by two.
    """
    whole = F.col(value).isNotNull()
    for x in exposures:
        whole = whole & F.col(x).isNotNull()
    y, *xs = (F.when(whole, F.col(c).cast("double")) for c in (value, *exposures))
    k = len(xs)
    moments = [F.covar_pop(xs[i], xs[j]).alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)]
    g = df.groupBy(*by).agg(
        F.count(y).alias("_n"), F.avg(y).alias("_m"), *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(y, x).alias(f"_r{i}") for i, x in enumerate(xs)], *moments)
    square = [[F.col(f"_c{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]
    g = g.withColumn("_b", solve_normal(square, [F.col(f"_r{i}") for i in range(k)]))
    g = g.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_n", "_m", "_b", *[f"_m{i}" for i in range(k)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(F.col(f"_k{i}"))
    j = df.join(g, same, "left")
    resid = F.col(value) - F.col("_m")
    for i, x in enumerate(exposures):
        resid = resid - F.get("_b", F.lit(i)) * (F.col(x) - F.col(f"_m{i}"))
    return j.select(*df.columns, F.when(whole & (F.col("_n") > k + 1), resid).alias(name))


def volatility_scaled(value: Col, vol: Col, floor: float) -> Column:
    v = as_col(vol)
    return F.when(v >= 0, as_col(value) / F.greatest(v, F.lit(float(floor))))


def rank_weights(df: DataFrame, value: str, by: Sequence[str], name: str = "weight") -> DataFrame:
    """Centred ranks scaled to gross 1; an all-tied cross-section weighs 0."""
    w = over(by)
    d = df.withColumn("_rk", average_rank(value, by))
    d = d.withColumn("_c", F.col("_rk") - F.avg("_rk").over(w))
    gross = F.sum(F.abs("_c")).over(w)
    weight = F.when(F.col("_c").isNotNull(), F.when(gross > FLAT, F.col("_c") / gross).otherwise(0.0))
    return d.withColumn(name, weight).drop("_rk", "_c")


def rank_signal(value: Col, by: Sequence[str]) -> Column:
    """Average rank on [-1, 1]."""
    n = breadth(value, by)
    return F.when(n >= 2, (average_rank(value, by) - 1) / (n - 1) * 2 - 1)


def bucket_floor(value: Col, tie: str, by: Sequence[str], q: int) -> Column:
    """Quantile bucket by the floor rule (remainders spread over buckets)."""
    x = as_col(value)
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last(), tie)
    pos = F.floor((F.row_number().over(w) - 1) * q / breadth(x, by))
    return F.when(x.isNotNull(), F.least(F.lit(q - 1), pos))


def bucket_even(value: Col, tie: str, by: Sequence[str], q: int) -> Column:
    """Quantile bucket by the array-split rule (first buckets take the remainder)."""
    x = as_col(value)
    w = Window.partitionBy(*by, x.isNull()).orderBy(x, tie)
    return F.when(x.isNotNull(), F.ntile(q).over(w) - 1)


def spread_and_monotonicity(df: DataFrame, by: Sequence[str], bucket: str, label: str, q: int, ranked: bool) -> DataFrame:
    """Top minus bottom bucket mean and the monotonicity of bucket means.

    A period counts only when every bucket has a realized mean.
    """
    from marketloom.functions.numeric import correlation

    m = df.where(F.col(bucket).isNotNull()).groupBy(*by, bucket).agg(F.avg(label).alias("m"))
    m = m.where(F.col("m").isNotNull())
    if ranked:
        m = m.withColumn("_y", average_rank("m", by))
    else:
        m = m.withColumn("_y", F.col("m"))
    g = m.groupBy(*by).agg(
        F.count("*").alias("_n"),
        (F.sum(F.when(F.col(bucket) == q - 1, F.col("m"))) - F.sum(F.when(F.col(bucket) == 0, F.col("m")))).alias("spread"),
        F.coalesce(correlation(F.col(bucket).cast("double"), "_y"), F.lit(0.0)).alias("monotonicity"),
    )
    return g.where(F.col("_n") == q).drop("_n")


def turnover(
    df: DataFrame, ts: str, asset: str, weight: str, by: Sequence[str] = (), reset: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    """One-way turnover between consecutive weight vectors of each portfolio.

    Periods are indexed first. A weight then counts in its own period (entered or changed)
    and once more, as an exit, in the next period when the asset is absent there: two
    sparse contributions instead of a dense grid. ``reset`` restarts from zero.

    The weights are read three times, so they are written once unless already ``stored``.
    """
    group = [*by, *reset]
    if not stored:
        df = cut_lineage(df.select(*group, ts, asset, weight), "weights")
    order = Window.partitionBy(*group).orderBy(ts) if group else Window.orderBy(ts)
    idx = df.select(*group, ts).distinct().withColumn("_i", F.row_number().over(order))
    d = df.join(idx, [*group, ts])
    per_asset = Window.partitionBy(*group, asset).orderBy("_i")
    d = d.withColumns({"_pi": F.lag("_i").over(per_asset), "_pw": F.lag(weight).over(per_asset), "_ni": F.lead("_i").over(per_asset)})
    prev = F.when(F.col("_pi") == F.col("_i") - 1, F.col("_pw")).otherwise(F.lit(0.0))
    moved = F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - F.coalesce(prev, F.lit(0.0)))
    gone = F.when(F.col("_ni").isNull() | (F.col("_ni") > F.col("_i") + 1), F.abs(F.col(weight)))
    parts = F.array(
        F.struct(F.col("_i").alias("i"), moved.alias("v")), F.struct((F.col("_i") + 1).alias("i"), F.coalesce(gone, F.lit(0.0)).alias("v"))
    )
    s = d.select(*group, F.explode(parts).alias("p")).groupBy(*group, F.col("p.i").alias("_i")).agg((F.sum("p.v") * 0.5).alias("turnover"))
    return idx.join(s, [*group, "_i"], "left").drop("_i")


def top_positive(df: DataFrame, by: Sequence[str], score: str, asset: str, k: int, minimum: int) -> DataFrame:
    """Equal weights on up to ``k`` best positive scores where breadth suffices."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), asset)
    d = df.withColumns({"_n": breadth(score, by), "_r": F.row_number().over(w)})
    pick = d.where((F.col("_n") >= minimum) & (F.col("_r") <= k) & (F.col(score) > 0)).drop("_n", "_r")
    return pick.withColumn("weight", F.lit(1.0) / F.count("*").over(over(by)))


def combine_signals(df: DataFrame, weights: DataFrame, by: Sequence[str], member: str, value: str) -> DataFrame:
    """Σ weight x signal over members; the support must be common already."""
    return df.join(weights, member).groupBy(*by).agg(F.sum(F.col("weight") * F.col(value)).alias("combined"), F.count("*").alias("members"))


def rank_with_seeds(df: DataFrame, order: Sequence[Column], seed: Column, limit: int, by: Sequence[str]) -> DataFrame:
    """Top ``limit`` per group; seeds displace the lowest others, then natural order ranks."""
    first = Window.partitionBy(*by).orderBy(seed.desc(), *order)
    d = df.withColumn("_s", F.row_number().over(first)).where(F.col("_s") <= limit).drop("_s")
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ensemble(df: DataFrame, members: DataFrame, by: Sequence[str], asset: str, low: float, high: float, count: int) -> DataFrame:
    """Direction-signed, weighted sum of winsorized sample z-scores on common support.

    df: by, asset, member, value; members: member, weight, direction.
    """
    from marketloom.operators.joins import common_support

    d = common_support(df, [*by, asset], "member", count)
    part = [*by, "member"]
    d = d.withColumn("_w", winsorized("value", part, low, high)).withColumn("_z", zscore_sample("_w", part))
    d = d.join(members, "member")
    return d.groupBy(*by, asset).agg(F.sum(F.col("weight") * F.col("direction") * F.col("_z")).alias("score"))

"""Dependence-aware tests, resampling, multiplicity and overfitting.

Inputs are metric series (one row per period), already aggregated from the data: a series
is bounded by the calendar, and the number of series by the candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import tails
from marketloom.functions.numeric import FLAT, average_rank
from marketloom.operators.chunks import CHUNK, matches, ranged


def _over(by: Sequence[str], order: str | None = None):
    w = Window.partitionBy(*by)
    return w.orderBy(order) if order else w


def long_run_variance(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """n, mean, variance and Bartlett long-run variance per series (divisor n throughout)."""
    w = _over(by, order)
    d = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(_over(by)))
    d = d.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    sums = [F.sum(f"_l{k}").alias(f"_s{k}") for k in range(1, lags + 1)]
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *sums)
    top = F.least(F.lit(lags), F.col("n") - 1)
    total = F.col("_s0")
    for k in range(1, lags + 1):
        bartlett = F.greatest(1 - F.lit(k) / (top + 1), F.lit(0.0))
        total = total + bartlett * F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) * 2
    return g.select(*by, "n", "mean", (F.col("_s0") / F.col("n")).alias("variance"), F.greatest(total / F.col("n"), F.lit(0.0)).alias("lrv"))


def newey_west(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int, pvalues: bool = True) -> DataFrame:
    """HAC t-statistic of the mean and its two-sided normal p-value."""
    d = long_run_variance(df, by, order, value, lags)
    se = F.sqrt(F.col("lrv") / F.col("n"))
    ok = (F.col("n") >= 2) & (se > FLAT)
    d = d.withColumn("t_stat", F.when(ok, F.col("mean") / se).otherwise(0.0))
    if pvalues:
        d = d.withColumn("p_value", F.when(ok, tails.normal_two_sided("t_stat")).otherwise(1.0))
    return d.drop("variance", "lrv")


def draw_start(seed: int, draw: Column, block: Column, n: Column) -> Column:
    """Deterministic block start in 0..n-1 from an MD5 of (seed, draw, block)."""
    text = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def block_bootstrap(df: DataFrame, by: Sequence[str], order: str, value: str, draws: int, block: int, seed: int) -> DataFrame:
    """Circular block bootstrap of the mean: p-value and 95% interval per series.

    Block sums are prepared once per start, so a draw costs one lookup per block rather
    than one per observation. Series shorter than the block use one block of their length.
    """
    w = Window.partitionBy(*by).orderBy(order)
    s = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).alias("_x"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.count("*").over(_over(by)).alias("n")
    )
    s = s.withColumn("_len", F.least(F.lit(block), F.col("n")))
    twice = s.withColumn("_j", F.explode(F.array(F.col("i"), F.col("i") + F.col("n"))))
    ahead = Window.partitionBy(*by).orderBy("_j").rowsBetween(0, block - 1)
    blocks = F.ceil(F.col("n") / F.col("_len"))
    rest = F.col("n") - (blocks - 1) * F.col("_len")
    vals = F.collect_list("_x").over(ahead)

    def total(length: Column) -> Column:
        return F.aggregate(F.slice(vals, F.lit(1), length.cast("int")), F.lit(0.0), lambda a, x: a + x)

    starts = twice.withColumns({"_full": total(F.col("_len")), "_rest": total(rest)}).where(F.col("_j") < F.col("n"))
    starts = starts.select(*by, F.col("_j").alias("start"), "_full", "_rest")
    heads = s.groupBy(*by).agg(F.max("n").alias("n"), F.avg("_x").alias("mean"), F.max("_len").alias("_len"))
    plan = heads.withColumn("blocks", F.ceil(F.col("n") / F.col("_len")))
    plan = plan.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    plan = plan.withColumn("b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("blocks"))))
    plan = plan.withColumn("start", draw_start(seed, F.col("draw"), F.col("b"), F.col("n")))
    part = plan.join(starts, [*by, "start"])
    piece = F.when(F.col("b") == F.col("blocks"), F.col("_rest")).otherwise(F.col("_full"))
    means = part.groupBy(*by, "draw").agg((F.sum(piece) / F.max("n")).alias("m"), F.max("mean").alias("mean"), F.max("n").alias("n"))
    hit = F.abs(F.col("m") - F.col("mean")) >= F.abs(F.col("mean"))
    return means.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        ((F.count_if(hit) + 1) / F.lit(draws + 1.0)).alias("p_value"),
        F.percentile("m", F.lit(0.025)).alias("low"),
        F.percentile("m", F.lit(0.975)).alias("high"),
    )


def session_bootstrap(df: DataFrame, by: Sequence[str], session: str, value: str, draws: int, block: int, seed: int) -> DataFrame:
    """Bars within a session are not independent draws: sessions are averaged first."""
    per = df.groupBy(*by, session).agg(F.avg(value).alias("_m"))
    return block_bootstrap(per, by, session, "_m", draws, block, seed)


def adjust_pvalues(df: DataFrame, family: Sequence[str], key: str, p: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg per family, which may hold more trials than one task should.

    Each range of (family, p, key) has its own row numbers and running extremes, read from either end; one row for
    each range carries counts and extremes to the others.
    """
    part = [*family, CHUNK]
    d = ranged(df.where(F.col(p).isNotNull()), family, [p, key])
    every, along = _over(family), _over(family, CHUNK)
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), _over(family).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    up, down = _over(part).orderBy(p, key), _over(part).orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    sizes = d.groupBy(*part).agg(F.count("*").alias("_c"))
    sizes = sizes.select(*part, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"), F.sum("_c").over(every).alias("_m"))
    d = matches(d.withColumn("_r", F.row_number().over(up)), sizes, family).withColumn("_r", F.col("_r") + F.col("_base"))
    d = d.withColumns({"_holm": (F.col("_m") - F.col("_r") + 1) * F.col(p), "_bh": F.col("_m") * F.col(p) / F.col("_r")})
    tops = d.groupBy(*part).agg(F.max("_holm").alias("_t"), F.min("_bh").alias("_b"))
    tops = tops.select(*part, F.max("_t").over(earlier).alias("_top"), F.min("_b").over(later).alias("_bottom"))
    d = d.withColumns({"_holm": F.max("_holm").over(up.rowsBetween(Window.unboundedPreceding, 0)), "_bh": F.min("_bh").over(down)})
    one = F.lit(1.0)
    return matches(d, tops, family).select(
        *df.columns,
        F.least(one, F.col(p) * F.col("_m")).alias("bonferroni"),
        F.least(one, F.greatest("_holm", "_top")).alias("holm"),
        F.least(one, "_bh", "_bottom").alias("bh"),
    )


def one_sided_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Student-t test that the mean exceeds zero."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    t = F.when((F.col("n") > 1) & (F.col("_sd") > FLAT), F.col("mean") / (F.col("_sd") / F.sqrt("n")))
    g = g.withColumn("t_stat", t)
    return g.withColumn("p_value", F.coalesce(tails.student_upper("t_stat", F.col("n") - 1), F.when(F.col("mean") > 0, 0.0).otherwise(1.0))).drop("_sd")


def sharpe(df: DataFrame, by: Sequence[str], value: str, annual: float = 1.0) -> DataFrame:
    sd = F.stddev_samp(value)
    flat = F.when(F.avg(value) > 0, float("inf")).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.when(sd > 0, F.avg(value) / sd * annual**0.5).otherwise(flat).alias("sharpe")
    )


def deflated_sharpe(df: DataFrame, family: Sequence[str], trial: str, value: str) -> DataFrame:
    """Probability that each trial's Sharpe beats the best expected by chance.

    Moments come from one grouping; the expected maximum uses the variance of all trial
    Sharpes of the family.
    """
    g = df.groupBy(*family, trial).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"),
    )
    n = F.col("n")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6) + 3
    g = g.withColumns({"sharpe": F.col("mean") / F.col("sd"), "skew": skew, "kurt": kurt})
    fam = Window.partitionBy(*family)
    g = g.withColumns({"trials": F.count("*").over(fam), "_v": F.var_samp("sharpe").over(fam)})
    euler = 0.5772156649015329
    k = F.col("trials").cast("double")
    first = tails.normal_quantile(1 - 1 / k)
    second = tails.normal_quantile(1 - 1 / (k * 2.718281828459045))
    best = F.when(k > 1, F.sqrt("_v") * ((1 - euler) * first + euler * second)).otherwise(0.0)
    g = g.withColumn("benchmark", best)
    den = F.greatest(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe"), F.lit(2.220446049250313e-16))
    g = g.withColumn("_z", (F.col("sharpe") - F.col("benchmark")) * F.sqrt(n - 1) / F.sqrt(den))
    return g.withColumn("probability", tails.normal_cdf("_z")).drop("_g1", "_g2", "_v", "_z")


def overfitting(df: DataFrame, family: Sequence[str], trial: str, order: str, value: str, blocks: int) -> DataFrame:
    """Probability of backtest overfitting by symmetric cross-validation.

    Each (trial, block) shrinks to n, sum and sum of squares once; every split then adds
    block moments. Splits are a literal list, so nothing is joined or rescanned.
    """
    periods = df.select(*family, order).distinct()
    w = Window.partitionBy(*family).orderBy(order)
    cut = periods.withColumn("block", F.ntile(blocks).over(w) - 1)
    x = F.col(value)
    mom = df.join(cut, [*family, order]).groupBy(*family, trial, "block").agg(
        F.count(value).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    masks = [sum(1 << b for b in c) for c in combinations(range(blocks), blocks // 2) if 0 in c]
    d = mom.withColumn("split", F.explode(F.array(*[F.lit(m) for m in masks])))
    inside = F.expr("shiftright(split, cast(block as int)) & 1") == 1

    def metric(cond: Column) -> Column:
        n, s, q = (F.sum(F.when(cond, F.col(c))) for c in ("n", "s", "q"))
        sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
        return F.when(sd > 0, s / n / sd).otherwise(0.0)

    g = d.groupBy(*family, "split", trial).agg(metric(inside).alias("is_m"), metric(~inside).alias("os_m"))
    part = [*family, "split"]
    g = g.withColumns({"_rank": average_rank("os_m", part), "_k": F.count("*").over(Window.partitionBy(*part))})
    best = g.groupBy(*part).agg(F.min_by(F.struct("_rank", "_k"), F.struct(-F.col("is_m"), F.col(trial))).alias("b"))
    frac = (F.col("b._rank") - 0.5) / F.col("b._k")
    eps = F.lit(0.5) / F.col("b._k")
    omega = F.least(1 - eps, F.greatest(eps, frac))
    best = best.withColumn("logit", F.log(omega / (1 - omega)))
    return best.groupBy(*family).agg(
        F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"))


def reality_check(df: DataFrame, family: Sequence[str], trial: str, order: str, value: str, draws: int, block: int, seed: int) -> DataFrame:
    """White's test of the best mean in a family; all trials share each draw's blocks."""
    w = Window.partitionBy(*family, trial).orderBy(order)
    fam = [*family, trial]
    s = df.select(*fam, F.col(value).alias("_x"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.count("*").over(_over(fam)).alias("n"), F.avg(value).over(_over(fam)).alias("_m"))
    s = s.withColumn("_c", F.col("_x") - F.col("_m"))
    twice = s.withColumn("_j", F.explode(F.array(F.col("i"), F.col("i") + F.col("n"))))
    vals = F.collect_list("_c").over(Window.partitionBy(*fam).orderBy("_j").rowsBetween(0, block - 1))
    rest = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block

    def total(length: Column) -> Column:
        return F.aggregate(F.slice(vals, F.lit(1), length.cast("int")), F.lit(0.0), lambda a, x: a + x)

    starts = twice.withColumns({"_full": total(F.lit(block)), "_rest": total(rest)}).where(F.col("_j") < F.col("n"))
    starts = starts.select(*fam, F.col("_j").alias("start"), "n", "_full", "_rest")
    n = s.groupBy(*family).agg(F.max("n").alias("n"))
    plan = n.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    plan = plan.withColumn("b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("blocks"))))
    plan = plan.withColumn("start", draw_start(seed, F.col("draw"), F.col("b"), F.col("n"))).drop("n")
    piece = F.when(F.col("b") == F.col("blocks"), F.col("_rest")).otherwise(F.col("_full"))
    m = plan.join(starts, [*family, "start"]).groupBy(*family, "draw", trial).agg((F.sum(piece) / F.sqrt(F.max("n"))).alias("z"))
    top = m.groupBy(*family, "draw").agg(F.max("z").alias("z"))
    seen = s.groupBy(*fam).agg((F.sqrt(F.max("n")) * F.max("_m")).alias("o")).groupBy(*family).agg(F.max("o").alias("observed"))
    return top.join(seen, list(family)).groupBy(*family).agg(
        F.max("observed").alias("observed"), ((F.count_if(F.col("z") >= F.col("observed")) + 1) / F.lit(draws + 1.0)).alias("p_value"))


def autocorrelation(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """Autocorrelations and the Ljung-Box statistic per series."""
    w = _over(by, order)
    d = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(_over(by)))
    d = d.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s"), *[F.sum(f"_l{k}").alias(f"_s{k}") for k in range(1, lags + 1)])
    rho = {f"rho{k}": F.when(F.col("_s") > 0, F.col(f"_s{k}") / F.col("_s")) for k in range(1, lags + 1)}
    g = g.withColumns(rho)
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        q = q + F.col(f"rho{k}") * F.col(f"rho{k}") / (F.col("n") - k)
    return g.select(*by, "n", *rho, (F.col("n") * (F.col("n") + 2) * q).alias("q_stat"))


def ljung_box(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    a = autocorrelation(df, by, order, value, lags)
    return a.withColumn("p_value", tails.chi2_upper("q_stat", lags))


def describe_returns(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """HAC mean test, effective sample size and worst drawdown; a missing day blocks."""
    from marketloom.operators.windows import nav_and_drawdown

    v = long_run_variance(df, by, order, value, lags)
    dd = nav_and_drawdown(df.where(F.col(value).isNotNull()), value, by, order, from_one=True).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
    gaps = df.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("missing"))
    d = v.join(dd, list(by)).join(gaps, list(by))
    ok = F.col("missing") == 0
    return d.select(
        *by, "n", "missing", F.when(ok, F.col("mean")).alias("mean"),
        F.when(ok, F.try_divide(F.col("mean"), F.sqrt(F.col("lrv") / F.col("n")))).alias("t_stat"),
        F.when(ok, F.try_divide(F.col("n") * F.col("variance"), F.col("lrv"))).alias("effective_n"),
        F.when(ok, F.col("max_drawdown")).alias("max_drawdown"),
    )


def family_verdict(df: DataFrame, family: Sequence[str], trial: str, order: str, value: str, draws: int, block: int, seed: int, blocks: int) -> DataFrame:
    """Multiplicity, deflation, overfitting and reality check joined per trial."""
    p = adjust_pvalues(one_sided_mean(df, [*family, trial], value), family, trial, "p_value")
    d = deflated_sharpe(df, family, trial, value).select(*family, trial, "probability")
    o = overfitting(df, family, trial, order, value, blocks).select(*family, "pbo")
    r = reality_check(df, family, trial, order, value, draws, block, seed).select(*family, F.col("p_value").alias("reality_p"))
    from marketloom.operators.quality import certify

    j = p.join(d, [*family, trial]).join(o, list(family)).join(r, list(family))
    return certify(j, [(F.col("holm") > 0.05, "MULTIPLICITY"), (F.col("probability") < 0.95, "DEFLATED_SHARPE"),
                       (F.col("pbo") > 0.5, "OVERFITTING"), (F.col("reality_p") > 0.05, "REALITY_CHECK")])

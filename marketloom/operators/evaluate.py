"""Scoring of factor values against forward labels.

Observations are long: candidate, timestamp, asset, value, label. Cross-sections are
partitions by (candidate, timestamp), bounded by the universe; everything after them is a
grouping that combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import FLAT, average_rank, correlation, mean_over_std, reasons
from marketloom.operators import cross
from marketloom.settings import cut_lineage


def observations(panel: DataFrame, features: Sequence[str], keep: Sequence[str], name: str = "candidate") -> DataFrame:
    """Wide panel to one row per candidate; each feature may carry ``<feature>_reason``."""
    cells = [
        F.struct(
            F.lit(f).alias(name),
            F.col(f).cast("double").alias("value"),
            (F.col(f"{f}_reason") if f"{f}_reason" in panel.columns else F.lit(None).cast("string")).alias("reason"),
        )
        for f in features
    ]
    return panel.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")


def rank_ic(obs: DataFrame, by: Sequence[str], value: str, label: str, minimum: int = 2) -> DataFrame:
    """Rank correlation per group; ranks are taken on jointly available assets.

    Labels are ranked last and lead the product, so that moments are summed along the labels as in the SQL: a
    correlation of zero then keeps the same sign of its rounding in every run, on which hit rates depend.
    """
    d = obs.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    d = d.select(*by, label, average_rank(value, by).alias("_a"))
    d = d.select(*by, "_a", average_rank(label, by).alias("_b"))
    g = d.groupBy(*by).agg(F.count("*").alias("breadth"), correlation("_b", "_a").alias("rank_ic"))
    return g.where(F.col("breadth") >= minimum)


def pearson_ic(obs: DataFrame, by: Sequence[str], value: str, label: str, low: float, high: float, minimum: int = 2) -> DataFrame:
    """Correlation of the winsorized value with the label per group."""
    d = obs.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    d = d.withColumn("_v", cross.winsorized(value, by, low, high))
    g = d.groupBy(*by).agg(F.count("*").alias("breadth"), correlation("_v", label).alias("ic"))
    return g.where(F.col("breadth") >= minimum)


def ic_summary(ic: DataFrame, by: Sequence[str], value: str = "rank_ic", minimum: int = 1) -> DataFrame:
    g = ic.groupBy(*by).agg(
        F.count(value).alias("periods"), F.avg(value).alias("ic_mean"), mean_over_std(value).alias("icir")
    )
    return g.where(F.col("periods") >= minimum)


def ic_decay(obs: DataFrame, by: Sequence[str], value: str, labels: Sequence[str], ts: str, minimum: int = 2) -> DataFrame:
    """Mean rank IC per label column; labels become rows, so all horizons share the job."""
    cells = [F.struct(F.lit(c).alias("label_name"), F.col(c).alias("label")) for c in labels]
    d = obs.select(*by, ts, value, F.explode(F.array(*cells)).alias("_l")).select(*by, ts, value, "_l.*")
    ic = rank_ic(d, [*by, ts, "label_name"], value, "label", minimum)
    return ic_summary(ic, [*by, "label_name"])


def quantile_portfolios(obs: DataFrame, by: Sequence[str], ts: str, asset: str, value: str, label: str, q: int, minimum: int) -> DataFrame:
    """Bucket means, spread and long/short weights of the periods that count.

    A period counts when breadth suffices and every member has a realized label; others
    are dropped before turnover, so they do not move the previous weights.
    """
    part = [*by, ts]
    d = obs.where(F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(*part))
    k = F.count(label).over(Window.partitionBy(*part))
    d = d.withColumns({"_n": n, "_k": k, "bucket": cross.bucket_even(value, asset, part, q)})
    d = d.where((F.col("_n") >= max(minimum, q)) & (F.col("_n") == F.col("_k")))
    size = F.count("*").over(Window.partitionBy(*part, "bucket"))
    sign = F.when(F.col("bucket") == q - 1, 0.5).when(F.col("bucket") == 0, -0.5).otherwise(0.0)
    return d.withColumn("weight", sign / size).drop("_n", "_k")


def quantile_diagnostics(obs: DataFrame, by: Sequence[str], ts: str, asset: str, value: str, label: str, q: int, minimum: int, annual: float) -> DataFrame:
    p = cut_lineage(quantile_portfolios(obs, by, ts, asset, value, label, q, minimum), "portfolios")
    m = p.groupBy(*by, ts, "bucket").agg(F.avg(label).alias("m"))
    per = m.groupBy(*by, ts).agg(
        (F.sum(F.when(F.col("bucket") == q - 1, F.col("m"))) - F.sum(F.when(F.col("bucket") == 0, F.col("m")))).alias("spread")
    )
    t = cross.turnover(p.where("weight <> 0"), ts, asset, "weight", by, stored=True)
    return per.join(t, [*by, ts]).groupBy(*by).agg(
        F.count("*").alias("periods"),
        F.avg("spread").alias("long_short_mean"),
        (mean_over_std("spread") * annual**0.5).alias("long_short_sharpe"),
        F.avg("turnover").alias("mean_turnover"),
    )


def coverage(obs: DataFrame, by: Sequence[str], value: str, eligible: Column) -> DataFrame:
    return obs.groupBy(*by).agg(
        F.count_if(eligible).alias("eligible"),
        F.count_if(eligible & F.col(value).isNotNull()).alias("covered"),
        F.try_divide(F.count_if(eligible & F.col(value).isNotNull()), F.count_if(eligible)).alias("coverage"),
    )


def candidate_status(obs: DataFrame, value: str, label: str, cross_session: Column, minimum: int, ts: str = "ts", complete: Column | None = None) -> DataFrame:
    """Status of each (candidate, timestamp).

    BOUNDARY: every label crosses the session. PARTIAL_LABEL: some labels of the slice are
    missing, decided once per timestamp and applied to every candidate.
    """
    whole = F.lit(True) if complete is None else complete
    per_ts = obs.where(whole).groupBy(ts, "candidate").agg(
        F.count("*").alias("assets"),
        F.count(label).alias("labelled"),
        F.count_if(cross_session).alias("crossing"),
        F.count(F.when(F.col(label).isNotNull(), F.col(value))).alias("usable"),
    )
    slice_ = Window.partitionBy(ts)  # one row a candidate; a join would compute the observations twice
    d = per_ts.where(F.col(ts).isNotNull()).withColumns({f"_{c[0]}": F.max(c).over(slice_) for c in ("assets", "labelled")} | {"_x": F.max("crossing").over(slice_)})
    status = (
        F.when(F.col("_x") == F.col("_a"), "BOUNDARY")
        .when(F.col("_l") < F.col("_a"), "PARTIAL_LABEL")
        .when(F.col("usable") < minimum, "INSUFFICIENT_BREADTH")
        .otherwise("AVAILABLE")
    )
    return d.select("candidate", ts, "assets", "labelled", "usable", status.alias("status"))


def train_direction(ic: DataFrame, by: Sequence[str], train: Column, value: str = "rank_ic") -> DataFrame:
    """+1 or -1 from the mean over training rows; zero counts as +1."""
    m = ic.where(train).groupBy(*by).agg(F.avg(value).alias("train_mean"))
    return m.withColumn("direction", F.when(F.col("train_mean") >= 0, 1).otherwise(-1))


def fold_summary(ic: DataFrame, directions: DataFrame, by: Sequence[str], fold: str, value: str = "rank_ic") -> DataFrame:
    signed = F.col(value) * F.col("direction")
    return ic.join(directions, list(by)).groupBy(*by, fold).agg(
        F.count(value).alias("periods"), F.avg(signed).alias("signed_mean"), mean_over_std(signed).alias("signed_icir"),
        F.avg((signed > 0).cast("double")).alias("hit_rate"),
    )


def pooled_by_regime(metric: DataFrame, regimes: DataFrame, ts: str, by: Sequence[str], value: str) -> DataFrame:
    """Metrics of timestamps that have a regime, pooled per regime."""
    d = metric.join(regimes.where("regime IS NOT NULL"), ts)
    return d.groupBy(*by, "regime").agg(F.count(value).alias("periods"), F.avg(value).alias("mean"), mean_over_std(value).alias("ratio"))


def robustness(means: DataFrame, by: Sequence[str], slices: Sequence[str], gate: float) -> DataFrame:
    """Share of slices whose direction-signed mean is positive; a missing mean blocks."""
    want = F.array(*[F.lit(s) for s in slices])
    d = means.where(F.array_contains(want, F.col("slice")))
    g = d.groupBy(*by).agg(F.count("mean").alias("_n"), F.avg((F.col("mean") > 0).cast("double")).alias("_share"))
    blocked = F.col("_n") < len(slices)
    share = F.when(blocked, F.lit(0.0)).otherwise(F.col("_share"))
    return g.select(*by, blocked.alias("blocked"), share.alias("positive_share"), (share >= gate).alias("robust"))


# --- portfolios of one factor ---------------------------------------------------------


def trial_trace(obs: DataFrame, by: Sequence[str], ts: str, asset: str, value: str, label: str, cost_bps: float) -> DataFrame:
    """Gross and net return, turnover and breadth per period from centred rank weights.

    A timestamp without any label is a boundary and leaves the previous weights alone.
    """
    part = [*by, ts]
    has = F.count(label).over(Window.partitionBy(*part))
    d = obs.where(F.col(value).isNotNull()).withColumn("_h", has).where("_h > 0")
    w = cut_lineage(cross.rank_weights(d, value, part).select(*part, asset, label, "weight"), "weights")
    per = w.groupBy(*part).agg(
        F.count("*").alias("breadth"),
        F.sum(F.col("weight") * F.col(label)).alias("gross"),
        F.count_if(F.col(label).isNull() & (F.col("weight") != 0)).alias("missing_labels"),
    )
    t = cross.turnover(w, ts, asset, "weight", by, stored=True)
    d = per.join(t, part)
    cost = F.col("turnover") * 2 * cost_bps / 10000
    return d.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))


def return_summary(df: DataFrame, by: Sequence[str], ret: str, order: str, annual: float) -> DataFrame:
    """Compound return, annualized mean, volatility, Sharpe and worst drawdown from 1."""
    from marketloom.operators.windows import nav_and_drawdown

    d = nav_and_drawdown(df, ret, by, order, from_one=True)
    sd = F.stddev_samp(ret)
    return d.groupBy(*by).agg(
        F.count(ret).alias("periods"),
        (F.product(F.col(ret) + 1) - 1).alias("total_return"),
        (F.avg(ret) * annual).alias("annual_mean"),
        (sd * annual**0.5).alias("annual_vol"),
        F.when(sd > FLAT, F.avg(ret) / sd * annual**0.5).otherwise(0.0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )


def novelty(manual: DataFrame, programmatic: DataFrame, agent: DataFrame, key: str) -> DataFrame:
    """Sizes, overlaps and how many agent candidates are new: membership flags per id."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(key).distinct().select(key, *[F.lit(n == name).alias(n) for n in ("manual", "programmatic", "agent")])

    u = flag(manual, "manual").unionByName(flag(programmatic, "programmatic")).unionByName(flag(agent, "agent"))
    m = u.groupBy(key).agg(*[F.max(c).alias(c) for c in ("manual", "programmatic", "agent")])
    a, p, g = F.col("manual"), F.col("programmatic"), F.col("agent")
    return m.agg(
        F.count_if(a).alias("manual"), F.count_if(p).alias("programmatic"), F.count_if(g).alias("agent"),
        F.count_if(g & a).alias("agent_and_manual"), F.count_if(g & p).alias("agent_and_programmatic"),
        F.count_if(g & ~a & ~p).alias("agent_new"),
    )


def gate_candidates(report: DataFrame, thresholds: dict[str, tuple[str, float, str]], turnover_penalty: float) -> DataFrame:
    """Reason codes of failed checks and a score that is 0 after any failure.

    thresholds: column -> (">=" or "<=", bound, code).
    """
    rules = []
    for column, (sense, bound, code) in thresholds.items():
        ok = F.col(column) >= bound if sense == ">=" else F.col(column) <= bound
        rules.append((~F.coalesce(ok, F.lit(False)), code))
    d = report.withColumn("codes", reasons(*rules))
    score = (
        F.greatest(F.col("icir"), F.lit(1e-12)) * F.col("positive_share") * F.col("direction_share")
        * (F.greatest(F.col("monotonicity"), F.lit(0.0)) * 0.5 + 0.5) * F.sqrt(F.greatest(F.col("coverage"), F.lit(1e-12)))
        * (1 - F.col("q_value") * 0.5) / (1 + turnover_penalty * F.col("turnover"))
    )
    passed = F.size("codes") == 0
    return d.withColumn("passed", passed).withColumn("score", F.when(passed, score).otherwise(0.0))


def greedy_selection(scores: DataFrame, rho: DataFrame, family: str, limit: int, max_rho: float, power: float = 1.0) -> DataFrame:
    """Best-first selection skipping candidates close to one already chosen, for all families at once.

    A round takes the best open candidate of every family (equal scores: the smaller name) and drops it and
    its near ones by joins; only the open table shrinks from round to round, and ``limit`` bounds the rounds.
    scores: family, candidate, score (one row a candidate); rho: family, factor_a, factor_b, rho in either order.
    Returns family, candidate, score, weight (share of score ** power), place.
    """
    close = rho.where(F.abs("rho") > max_rho)
    near = close.select(family, "factor_a", "factor_b").union(close.select(family, "factor_b", "factor_a")).distinct()
    near = cut_lineage(near.toDF(family, "candidate", "other"), "near")
    live = cut_lineage(scores.where(F.col("score") > 0).select(family, "candidate", "score"), "open")
    chosen = []
    for place in range(1, limit + 1):
        best = live.groupBy(family).agg(F.min_by(F.struct("candidate", "score"), F.struct(-F.col("score"), F.col("candidate"))).alias("b"))
        best = cut_lineage(best.select(family, "b.*", F.lit(place).cast("long").alias("place")), "chosen")
        chosen.append(best)
        gone = best.select(family, "candidate").union(near.join(best, [family, "candidate"]).select(family, "other"))
        live = cut_lineage(live.join(gone, [family, "candidate"], "left_anti"), "open")
        if live.isEmpty():
            break
    out = chosen[0]
    for more in chosen[1:]:
        out = out.union(more)
    mass = F.pow(F.greatest("score", F.lit(1e-12)), F.lit(power))
    return out.withColumn("weight", mass / F.sum(mass).over(Window.partitionBy(family))).select(family, "candidate", "score", "weight", "place")


def slot_accounting(runs: DataFrame, arm: str, identity: str, order: str, valid: Column) -> DataFrame:
    """Accepted, invalid and duplicate trials per arm; failures stay in the denominator."""
    first = runs.where(valid).groupBy(arm, identity).agg(F.count("*").alias("n"))
    ok = first.groupBy(arm).agg(F.count("*").alias("accepted"), F.sum(F.col("n") - 1).alias("duplicate"))
    total = runs.groupBy(arm).agg(F.count("*").alias("slots"), F.count_if(~valid).alias("invalid"))
    zero = F.lit(0).cast("bigint")
    return total.join(ok, arm, "left").select(
        arm, "slots", "invalid", F.coalesce("accepted", zero).alias("accepted"), F.coalesce("duplicate", zero).alias("duplicate"),
        F.try_divide(F.coalesce("accepted", zero), F.col("slots")).alias("accept_rate"))


def metric_series(ic: DataFrame, keys: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Period metrics as narrow rows (kind, metric, value)."""
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, kind in metrics.items()]
    return ic.select(*keys, F.explode(F.array(*cells)).alias("_m")).select(*keys, "_m.*").where("value IS NOT NULL")

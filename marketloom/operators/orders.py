"""Set-based order, cost, exposure and corporate-action rules over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import Col, as_col, reasons
from marketloom.operators.chunks import asof_backward

# Fixed values of the rule set: lots, minimums and fee rates.
LOT = 100
STAR_MINIMUM = 200
COMMISSION_RATE = 0.0003
COMMISSION_MINIMUM = 5.0
STAMP_SELL_RATE = 0.0005
TRANSFER_RATE = 0.00001
HANDLING_RATE = 0.0000341
HANDLING_RATE_BSE = 0.000125
REGULATORY_RATE = 0.00002


def board(symbol: Col, venue: Col) -> Column:
    """Board of a code family; unknown venues give NULL."""
    s, v = as_col(symbol), as_col(venue)
    return (
        F.when((v == "SSE") & s.rlike("^68[89]"), "SSE_STAR").when(v == "SSE", "SSE_MAIN")
        .when((v == "SZSE") & s.rlike("^30[012]"), "SZSE_CHINEXT").when(v == "SZSE", "SZSE_MAIN").when(v == "BSE", "BSE")
    )


def buy_lots(board_: Col, requested: Col) -> Column:
    """Executable buy quantity: whole lots, or single units above a board minimum."""
    b, q = as_col(board_), F.floor(as_col(requested) + 1e-12)
    return (
        F.when(as_col(requested) <= 0, F.lit(0)).when(b == "SSE_STAR", F.when(q >= STAR_MINIMUM, q).otherwise(0))
        .when(b == "BSE", F.when(q >= LOT, q).otherwise(0)).otherwise(F.floor(q / LOT) * LOT)
    ).cast("bigint")


def sell_lots(board_: Col, requested: Col, sellable: Col) -> Column:
    """Executable sell quantity; the odd remainder of a position may go out with it."""
    b, have = as_col(board_), as_col(sellable)
    q = F.least(F.floor(as_col(requested) + 1e-12), have)
    odd = have % LOT
    whole = F.floor(q / LOT) * LOT
    with_odd = F.when((odd > 0) & (q >= odd), odd + F.floor((q - odd) / LOT) * LOT)
    return (
        F.when((as_col(requested) <= 0) | (have <= 0) | (q <= 0), F.lit(0)).when(q >= have, have)
        .when(b == "SSE_STAR", F.when(q >= STAR_MINIMUM, q).otherwise(0)).when(b == "BSE", F.when(q >= LOT, q).otherwise(0))
        .otherwise(F.greatest(whole, F.coalesce(with_odd, whole)))
    ).cast("bigint")


def fees(side: Col, notional: Col, board_: Col, pass_through: bool = False) -> dict[str, Column]:
    """Fee components of a trade; a zero notional costs nothing."""
    s, n, b = as_col(side), as_col(notional), as_col(board_)
    zero = F.lit(0.0)

    def charged(c: Column) -> Column:
        return F.when(n > 0, c).otherwise(zero)

    handling = F.when(b == "BSE", n * HANDLING_RATE_BSE).otherwise(n * HANDLING_RATE)
    return {
        "commission": charged(F.greatest(F.lit(COMMISSION_MINIMUM), n * COMMISSION_RATE)),
        "stamp_duty": charged(F.when(s == "SELL", n * STAMP_SELL_RATE).otherwise(zero)),
        "transfer": charged(n * TRANSFER_RATE),
        "handling": charged(handling if pass_through else zero),
        "regulatory": charged(n * REGULATORY_RATE if pass_through else zero),
    }


def impact_fills(df: DataFrame, participation: float, base_bps: float, impact_bps: float, commission_bps: float) -> DataFrame:
    """Orders joined to bars: capped quantity, square-root impact price and costs.

    Columns: side, quantity, volume, close. Rejected orders keep a reason.
    """
    v = F.col("volume")
    qty = F.least(F.col("quantity"), v * participation)
    why = F.when(F.col("close").isNull(), "MISSING_BAR").when(v <= 0, "NON_POSITIVE_VOLUME").when(qty <= 0, "ZERO_QUANTITY")
    d = df.withColumn("reason", why).withColumn("fill_quantity", F.when(F.col("reason").isNull(), qty))
    bps = F.lit(base_bps) + F.sqrt(F.col("fill_quantity") / v) * impact_bps
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    d = d.withColumn("fill_price", F.col("close") * (1 + sign * bps / 10000))
    return d.withColumns(
        {
            "commission": F.abs(F.col("fill_price") * F.col("fill_quantity")) * commission_bps / 10000,
            "slippage": F.abs(F.col("fill_price") - F.col("close")) * F.col("fill_quantity"),
        }
    )


def plan_orders(targets: DataFrame, positions: DataFrame, cash: DataFrame, account: str, min_notional: float, precision: int) -> DataFrame:
    """Target weights and positions to orders, one pass for all accounts.

    targets: account, asset, weight; positions: account, asset, quantity, price (marks for
    every relevant asset come with either side); cash: account, cash.
    """
    nav = positions.groupBy(account).agg(F.sum(F.col("quantity") * F.col("price")).alias("_h")).join(cash, account, "full_outer")
    nav = nav.select(account, (F.coalesce("_h", F.lit(0.0)) + F.coalesce("cash", F.lit(0.0))).alias("nav"))
    t = targets.select(account, "asset", "weight", F.col("price").alias("_pt"))
    j = positions.join(t, [account, "asset"], "full_outer").join(nav, account)
    px = F.coalesce("price", "_pt")
    delta = F.coalesce("weight", F.lit(0.0)) * F.col("nav") - F.coalesce("quantity", F.lit(0.0)) * px
    d = j.select(account, "asset", px.alias("reference_price"), delta.alias("delta_value"))
    d = d.where((F.abs("delta_value") >= min_notional) & (F.abs("delta_value") > 1e-12))
    d = d.withColumn("quantity", F.round(F.abs(F.col("delta_value") / F.col("reference_price")), precision)).where("quantity > 0")
    return d.withColumn("side", F.when(F.col("delta_value") > 0, "BUY").otherwise("SELL"))


def exposure_limits(weights: DataFrame, by: Sequence[str], group: str, gross: float, single: float, per_group: float, tolerance: float = 1e-9) -> DataFrame:
    """Gross, largest and group exposure per as-of with violation codes."""
    g = weights.groupBy(*by, group).agg(F.sum(F.abs("weight")).alias("_g"), F.max(F.abs("weight")).alias("_m"))
    d = g.groupBy(*by).agg(F.sum("_g").alias("gross"), F.max("_m").alias("largest"), F.max("_g").alias("largest_group"))
    return d.withColumn(
        "violations",
        reasons(
            (F.col("gross") > gross + tolerance, "MAX_GROSS_EXPOSURE"),
            (F.col("largest") > single + tolerance, "MAX_ABS_WEIGHT"),
            (F.col("largest_group") > per_group + tolerance, "MAX_GROUP_EXPOSURE"),
        ),
    )


def paired(target: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two weight vectors side by side over the union of their assets."""
    a = target.select(*by, "asset", F.col("weight").alias("t"))
    b = current.select(*by, "asset", F.col("weight").alias("c"))
    j = a.join(b, [*by, "asset"], "full_outer")
    return j.select(*by, "asset", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("c", F.lit(0.0)).alias("c"))


def rebalance_decision(pairs: DataFrame, by: Sequence[str], force: float, least: float, drift: float) -> DataFrame:
    gap = F.abs(F.col("t") - F.col("c"))
    d = pairs.groupBy(*by).agg((F.sum(gap) * 0.5).alias("turnover"), F.max(gap).alias("max_drift"))
    why = F.when(F.col("turnover") >= force, "force_turnover").when(
        (F.col("turnover") >= least) & (F.col("max_drift") >= drift), "weight_drift"
    )
    return d.withColumn("reason", why).withColumn("rebalance", F.col("reason").isNotNull())


def stress(weights: DataFrame, shocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Return of every book under every scenario, with the assets that have no shock there.

    shocks: scenario, asset, shock. Scenarios are the declared ones, so a book none of whose
    assets has a shock still shows, with all of them missing. The scenario list is one row.
    """
    declared = shocks.agg(F.array_sort(F.collect_set("scenario")).alias("_all"))
    every = weights.crossJoin(declared).withColumn("scenario", F.explode("_all")).drop("_all")
    j = every.join(shocks, ["scenario", "asset"], "left")
    total = F.sum(F.col("weight") * F.coalesce("shock", F.lit(0.0)))
    return j.groupBy(*by, "scenario").agg(total.alias("scenario_return"), F.count_if(F.col("shock").isNull()).alias("missing_shocks"))


def compare_books(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest gap, half L1 distance and cosine of two weight vectors."""
    tt, cc = F.sum(F.col("t") * F.col("t")), F.sum(F.col("c") * F.col("c"))
    cos = F.when((tt == 0) & (cc == 0), 1.0).when((tt == 0) | (cc == 0), 0.0).otherwise(F.sum(F.col("t") * F.col("c")) / F.sqrt(tt * cc))
    gap = F.abs(F.col("t") - F.col("c"))
    return pairs.groupBy(*by).agg(F.max(gap).alias("max_gap"), (F.sum(gap) * 0.5).alias("distance"), cos.alias("cosine"))


def shortfall(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Half of asset gaps plus the cash gap, cash being what the weights leave over."""
    gap = F.sum(F.abs(F.col("t") - F.col("c")))
    cash = F.abs(F.sum(F.col("c")) - F.sum(F.col("t")))
    return pairs.groupBy(*by).agg(((gap + cash) * 0.5).alias("shortfall"))


def apply_actions(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Splits and dividends on holdings of many accounts.

    positions: account, asset, quantity, mark; actions: asset, effective_at, kind, ratio,
    amount. Splits compound in time order, each dividend pays on the quantity then held.
    """
    w = Window.partitionBy("asset").orderBy("effective_at", "kind")
    factor = F.when(F.col("kind") == "SPLIT", F.col("ratio")).otherwise(1.0)
    a = actions.withColumn("_before", F.coalesce(F.product(factor).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    g = a.groupBy("asset").agg(
        F.product(factor).alias("_ratio"), F.sum(F.when(F.col("kind") == "DIVIDEND", F.col("amount") * F.col("_before")).otherwise(0.0)).alias("_pay"))
    j = positions.join(g, "asset", "left")
    ratio, pay = F.coalesce("_ratio", F.lit(1.0)), F.coalesce("_pay", F.lit(0.0))
    return j.select("account", "asset", (F.col("quantity") * ratio).alias("quantity"), (F.col("mark") / ratio).alias("mark"), (F.col("quantity") * pay).alias("cash"))


def split_adjusted(bars: DataFrame, splits: DataFrame, asof: str) -> DataFrame:
    """Close adjusted by the factors of later splits known at ``asof``.

    The running products go over the few splits of an asset; a bar looks up the last split at
    or before it, whose product covers all later ones, or else takes the product of all. Bars at the
    split time already trade on the new basis.
    """
    known = splits.where(F.col("available_at") <= F.lit(asof).cast("date"))
    s = known.groupBy("asset", F.col("effective_at").alias("at")).agg(F.product(1 / F.col("ratio")).alias("f"))
    later = Window.partitionBy("asset").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("later", F.coalesce(F.product("f").over(later), F.lit(1.0)))
    whole = s.groupBy("asset").agg(F.product("f").alias("whole"))
    d = asof_backward(bars.select("asset", "ts", "close"), s, ["asset"], "ts", "at", ["later"]).join(whole, "asset", "left")
    d = d.withColumn("factor", F.coalesce("later", "whole", F.lit(1.0)))
    return d.select("asset", "ts", "close", "factor", (F.col("close") * F.col("factor")).alias("adjusted_close"))


def admissible(df: DataFrame, max_age: float, max_delay: float, allow_replay: bool = False, allow_delayed: bool = False) -> DataFrame:
    """Freshness verdict per event; rejected events stay, only acting on them is blocked.

    Columns: timing, source_delay, age_seconds.
    """
    t = F.col("timing")
    codes = reasons(
        ((t == "replay") & F.lit(not allow_replay), "timing:replay_not_allowed"),
        ((t == "delayed") & F.lit(not allow_delayed), "timing:delayed_not_allowed"),
        (t == "unknown", "timing:unknown_not_allowed"),
        (F.col("source_delay") > max_delay, "freshness:source_delay_exceeded"),
        (F.greatest(F.col("age_seconds"), F.lit(0.0)) > max_age, "freshness:event_age_exceeded"),
    )
    d = df.withColumn("codes", codes)
    return d.withColumn("allowed", F.size("codes") == 0)

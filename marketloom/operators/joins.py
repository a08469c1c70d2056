"""Point-in-time, interval, label and reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import reasons
from marketloom.operators.chunks import asof_backward
from marketloom.operators.ordering import latest


def snapshot_at(df: DataFrame, asof: str, clock: str = "available_at") -> DataFrame:
    """Latest row per asset known at ``asof`` (ties on the clock are visible)."""
    known = df.where(F.col(clock) <= F.lit(asof).cast("timestamp"))
    return latest(known, ["asset"], [clock])


def snapshots(
    requests: DataFrame, bars: DataFrame, payload: Sequence[str],
    asof: str = "asof", clock: str = "available_at",
) -> DataFrame:
    """Point-in-time rows for many (asset, asof) requests; misses carry a reason."""
    out = asof_backward(requests, bars, ["asset"], asof, clock, payload)
    return out.withColumn("reason", F.when(F.col("matched_ts").isNull(), "NO_ROW_AVAILABLE"))


def execution_quotes(requests: DataFrame, bars: DataFrame, price: str) -> DataFrame:
    """Executable price as of each request on the clock that belongs to the price."""
    clock = {"open": "event_time", "close": "available_at"}[price]
    return snapshots(requests, bars, [price], clock=clock)


def session_lookup(requests: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exactly the requested session, never an older one; one status per request.

    bars: keys, close, volume, up_limit, down_limit (one row per key).
    """
    j = requests.join(bars.withColumn("_hit", F.lit(True)), list(keys), "left")
    status = (
        F.when(F.col("_hit").isNull(), "NO_SESSION_DATA")
        .when(F.col("volume") <= 0, "SUSPENDED")
        .when(F.col("close").isNull() | (F.col("close") <= 0), "INVALID_PRICE")
        .when(F.col("up_limit").isNull() | F.col("down_limit").isNull(), "LIMITS_UNAVAILABLE")
        .otherwise("TRADABLE")
    )
    return j.withColumn("status", status).drop("_hit")


def close_marks(requests: DataFrame, bars: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Close of the session; without a positive close the previous mark is kept."""
    j = requests.join(bars.select(*keys, F.col("close").alias("_c")), list(keys), "left").join(
        previous.select("asset", F.col("mark").alias("_p")), "asset", "left"
    )
    fresh = F.col("_c") > 0
    return j.select(
        *requests.columns,
        F.when(fresh, F.col("_c")).otherwise(F.col("_p")).alias("mark"),
        F.coalesce(~fresh, F.lit(True)).alias("carried"),
    )


def same_session_label(
    bars: DataFrame, horizon: int, by: Sequence[str], slot: str, price: str, ratio: str = "fwd"
) -> DataFrame:
    """Forward return to exactly ``horizon`` slots later in the same session.

    The join key holds the slot, so one busy asset spreads over all its slots.
    """
    target = bars.select(*by, (F.col(slot) - horizon).alias(slot), F.col(price).alias("_t"))
    j = bars.join(target, [*by, slot], "left")
    value = F.when((F.col(price) > 0) & (F.col("_t") > 0), F.col("_t") / F.col(price) - 1)
    why = F.when(F.col("_t").isNull(), "TARGET_MISSING").when(value.isNull(), "INVALID_PRICE")
    return j.withColumn(ratio, value).withColumn(f"{ratio}_reason", why).drop("_t")


def attach_labels(bars: DataFrame, labels: DataFrame, keys: Sequence[str], price: str, anchor: str) -> DataFrame:
    """Bars with the label whose source minute ends where the bar ends, and the anchor gap."""
    j = bars.join(labels, list(keys), "left")
    gap = F.abs(F.col(price) - F.col(anchor))
    return j.withColumn("anchor_gap", gap).withColumn("anchor_ok", F.coalesce(gap <= 1e-12 * F.abs(F.col(price)), F.lit(False)))


def tag_folds(df: DataFrame, folds: DataFrame, date: str, how: str = "inner") -> DataFrame:
    """Attach each fold whose [start, end) holds the date.

    Folds are exploded to days: an equi-join replaces the range condition.
    """
    days = folds.withColumn(date, F.explode(F.expr("sequence(start, date_sub(end, 1))"))).drop("start", "end")
    return df.join(days, date, how)


def without(df: DataFrame, banned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULL-safe anti join: NULL keys match NULL keys."""
    b = banned.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return df.join(b, cond, "left_anti")


def scheduled_universe(requests: DataFrame, schedule: DataFrame) -> DataFrame:
    """Members in force on each request date.

    schedule: effective_at, asset. A version holds until the next effective date; the
    dates of the schedule are found by an as-of lookup, the members by an equi-join.
    """
    versions = schedule.select("effective_at").distinct().withColumn("_all", F.lit(1))
    hit = asof_backward(
        requests.select("request_date").distinct().withColumn("_all", F.lit(1)), versions.withColumn("eff", F.col("effective_at")),
        ["_all"], "request_date", "effective_at", ["eff"],
    )
    j = hit.select("request_date", F.col("eff").alias("effective_at")).join(schedule, "effective_at", "left")
    return j.select("request_date", "effective_at", "asset",
                    F.when(F.col("effective_at").isNull(), "BEFORE_FIRST_SCHEDULE").alias("reason"))


def listing_eligibility(requests: DataFrame, master: DataFrame, placeholder: str = "1970-01-01") -> DataFrame:
    """Is the asset listed on ``day``? The delisting day itself still counts."""
    j = requests.join(master.withColumn("_m", F.lit(True)), "asset", "left")
    ph = F.lit(placeholder).cast("date")
    why = (
        F.when(F.col("_m").isNull(), "UNKNOWN_ASSET")
        .when(F.col("list_date").isNull() | (F.col("list_date") == ph), "LIST_DATE_UNKNOWN")
        .when(F.col("day") < F.col("list_date"), "NOT_YET_LISTED")
        .when(F.col("day") > F.col("delist_date"), "DELISTED")
    )
    return j.withColumn("reason", F.coalesce(why, F.lit("ELIGIBLE"))).withColumn(
        "eligible", F.col("reason") == "ELIGIBLE"
    ).drop("_m", "list_date", "delist_date")


def interval_status(df: DataFrame, periods: DataFrame, by: str, day: str, partitions: int | None = None, year: str | None = None) -> DataFrame:
    """Rows with the statuses whose [start_date, end_date] covers the day; open ends allowed.

    Both sides are bucketed by year, so the equi-join key includes the year. Periods spread over
    the years that the days really span, which a one-row side brings, so no end date is assumed.
    Only periods of keys that have days are spread. ``partitions`` sets into how many parts both sides go by key
    and year, and ``year`` keeps the year under that name, so that a grouping by it needs no other shuffle.
    """
    span = df.agg(F.year(F.min(day)).alias("_low"), F.year(F.max(day)).alias("_high"))
    first = F.greatest(F.year("start_date"), F.col("_low"))
    last = F.least(F.coalesce(F.year("end_date"), F.col("_high")), F.col("_high"))
    known = periods.join(df.select(by).distinct(), by, "left_semi").crossJoin(span).where(first <= last)
    spread = known.withColumn("_y", F.explode(F.sequence(first, last))).drop("_low", "_high")
    rows = df.withColumn("_y", F.year(day))
    if partitions:
        rows, spread = rows.repartition(partitions, by, "_y"), spread.repartition(partitions, by, "_y")
    j = rows.join(spread, [by, "_y"])
    inside = (F.col(day) >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col(day) <= F.col("end_date")))
    return j.where(inside).withColumnRenamed("_y", year) if year else j.where(inside).drop("_y")


def common_support(df: DataFrame, keys: Sequence[str], member: str, members: int) -> DataFrame:
    """Rows of keys that carry a value for every one of ``members`` members.

    One shuffle by key and one read: the members present are a set of at most ``members`` names beside every row of
    a key. Keys that hold a NULL drop out, as they do in a join.
    """
    present = F.collect_set(F.when(F.col("value").isNotNull(), F.col(member))).over(Window.partitionBy(*keys))
    d = df.dropna(subset=list(keys)).withColumn("_n", F.size(present))
    return d.where(F.col("_n") == members).drop("_n")


def reconcile_positions(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], tolerances: dict[str, float]) -> DataFrame:
    """Issues between two books: quantity is critical, marks only warn.

    Both sides: keys, quantity, mark. A side that lacks the key counts as zero quantity.
    """
    a = ours.select(*keys, F.col("quantity").alias("qa"), F.col("mark").alias("ma"))
    b = theirs.select(*keys, F.col("quantity").alias("qb"), F.col("mark").alias("mb"))
    j = a.join(b, list(keys), "full_outer")
    dq = F.abs(F.coalesce("qa", F.lit(0.0)) - F.coalesce("qb", F.lit(0.0)))
    dm = F.abs(F.col("ma") - F.col("mb"))
    j = j.withColumn("quantity_gap", dq).withColumn("mark_gap", dm)
    j = j.withColumn(
        "issues",
        reasons(
            (F.col("quantity_gap") > tolerances["quantity"], "POSITION_MISMATCH"),
            ((F.col("quantity_gap") <= tolerances["quantity"]) & (F.col("mark_gap") > tolerances["mark"]), "MARK_MISMATCH"),
        ),
    )
    level = F.when(F.array_contains("issues", "POSITION_MISMATCH"), "CRITICAL").when(F.size("issues") > 0, "WARNING")
    state = F.when(F.col("qa").isNull() | F.col("qb").isNull(), "UNKNOWN").when(F.size("issues") > 0, "DRIFT").otherwise("CONSISTENT")
    return j.select(*keys, "quantity_gap", "mark_gap", "issues", F.coalesce(level, F.lit("NONE")).alias("severity"), state.alias("state"))


def liquidity_audit(legs: DataFrame, bars: DataFrame, keys: Sequence[str], trade: str, limit: float) -> DataFrame:
    """Participation of trade legs in the bar they hit, rolled up per trade.

    A missing bar is counted, never filled; a zero-volume bar is over the limit; the
    capacity multiple is NULL as soon as one leg has no bar.
    """
    j = legs.join(bars.select(*keys, F.col("volume").alias("_v"), F.lit(True).alias("_hit")), list(keys), "left")
    size = F.abs(F.col("shares"))
    part = F.when(F.col("_v") > 0, size / F.col("_v"))
    over = F.col("_hit").isNotNull() & ((F.col("_v") <= 0) | (part > limit))
    room = F.when(F.col("_v") > 0, F.col("_v") * limit / size).when(F.col("_v") <= 0, F.lit(0.0))
    g = j.groupBy(trade).agg(
        F.count("*").alias("legs"),
        F.count_if(F.col("_hit").isNull()).alias("missing_bars"),
        F.count_if(over).alias("over_limit"),
        F.max(part).alias("max_participation"),
        F.min(room).alias("_room"),
    )
    return g.withColumn("capacity", F.when(F.col("missing_bars") == 0, F.col("_room"))).drop("_room")


def attribution(positions: DataFrame, fills: DataFrame, decisions: DataFrame, keys: Sequence[str], by: Sequence[str], order: str) -> DataFrame:
    """Profit per (fold, session, asset): change of value less outflow less fees.

    positions: market_value; fills: outflow, fees; decisions: target. One row per key.
    """
    j = positions.join(fills, list(keys), "full_outer").join(decisions, list(keys), "full_outer")
    zero = F.lit(0.0)
    w = Window.partitionBy(*by).orderBy(order)
    now = F.coalesce("market_value", zero)
    j = j.withColumn("mv", now).withColumn("mv_prev", F.coalesce(F.lag("mv").over(w), zero))
    pnl = F.col("mv") - F.col("mv_prev") - F.coalesce("outflow", zero) - F.coalesce("fees", zero)
    return j.select(*keys, "mv", "mv_prev", pnl.alias("pnl"), F.col("target").isNotNull().alias("decided"))

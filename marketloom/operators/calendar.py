"""Exchange calendar: sessions, session offsets, dense grids and executable clocks.

The sessions table is small by nature (one row per trading day) and still passes a row
check before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def from_rows(rows: DataFrame, regular_minutes: int) -> DataFrame:
    """Calendar with minutes per session and the half-day flag; rows out of order show.

    rows: session_date, open_at, close_at.
    """
    minutes = F.expr("timestampdiff(MINUTE, open_at, close_at)")
    w = Window.partitionBy(F.year("session_date")).orderBy("session_date")
    return rows.withColumn("minutes", minutes).select(
        "session_date",
        "open_at",
        "close_at",
        "minutes",
        (F.col("minutes") < regular_minutes).alias("is_half_day"),
        F.coalesce(F.col("open_at") > F.lag("close_at").over(w), F.lit(True)).alias("in_order"),
    )


def clip_sessions(sessions: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """Sessions that can touch ``[start, end)``: local dates widened by one day."""
    lo = F.date_sub(F.to_date(F.from_utc_timestamp(F.lit(start).cast("timestamp"), zone)), 1)
    hi = F.date_add(F.to_date(F.from_utc_timestamp(F.lit(end).cast("timestamp"), zone)), 1)
    return sessions.where(F.col("session_date").between(lo, hi))


def sessionize(df: DataFrame, sessions: DataFrame, zone: str = "UTC", ts: str = "ts") -> DataFrame:
    """Add session_date, session_type, is_regular_session and the minute since the open."""
    local = F.to_date(F.from_utc_timestamp(ts, zone))
    cal = sessions.select("session_date", "open_at", "close_at")
    j = df.withColumn("session_date", local).join(cal, "session_date", "left")
    regular = (F.col(ts) >= F.col("open_at")) & (F.col(ts) < F.col("close_at"))
    kind = (
        F.when(F.col("open_at").isNull(), "outside_calendar").when(regular, "regular").otherwise("outside_regular")
    )
    j = j.withColumn("session_type", kind).withColumn(
        "is_regular_session", F.col("session_type") == "regular"
    )
    minute = F.when(F.col("is_regular_session"), F.expr(f"timestampdiff(MINUTE, open_at, {ts})"))
    return j.withColumn("minute", minute)


def session_filter(df: DataFrame, policy: str) -> DataFrame:
    """``regular`` keeps regular rows, ``all_observed`` keeps everything."""
    if policy == "regular":
        return df.where("is_regular_session")
    if policy == "all_observed":
        return df
    raise ValueError(f"session policy {policy} has no declared bounds")


def session_grid(assets: DataFrame, sessions: DataFrame, slots: int | Column) -> DataFrame:
    """assets x sessions x slots: the days between the first and last session are exploded and matched."""
    n = F.lit(slots) if isinstance(slots, int) else slots
    span = sessions.agg(F.min("session_date").alias("_a"), F.max("session_date").alias("_b"))
    return (
        assets.select("asset").crossJoin(span).select("asset", F.explode(F.sequence("_a", "_b")).alias("session_date"))
        .join(sessions, "session_date")
        .select("asset", "session_date", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("slot"))
    )


def pad(bars: DataFrame, grid: DataFrame, keys: Sequence[str], complete: Column) -> DataFrame:
    """Bars on the dense grid; absent cells keep NULL prices and count as incomplete."""
    j = grid.join(bars.withColumn("is_complete", complete), list(keys), "left")
    return j.withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))


def shared_timestamps(df: DataFrame, clock: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Timestamps on ``clock`` (in ``[start, end)`` where given) at which every asset of ``df`` appears."""
    d = df if start is None else df.where(F.col(clock) >= F.lit(start).cast("timestamp"))
    d = d if end is None else d.where(F.col(clock) < F.lit(end).cast("timestamp"))
    members = df.agg(F.count_distinct("asset").alias("_members"))
    return (
        d.select(clock, "asset").distinct().groupBy(clock).agg(F.count("*").alias("n"))
        .crossJoin(members).where("n = _members").select(F.col(clock).alias("ts"))
    )


def execution_timestamps(df: DataFrame, price: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The open trades at event time, the close when available; extremes never trade."""
    clocks = {"open": "event_time", "close": "available_at"}
    if price not in clocks:
        raise ValueError(f"{price} is not executable")
    return shared_timestamps(df, clocks[price], start, end)


def next_open(df: DataFrame, sessions: DataFrame, ts: str = "ts") -> DataFrame:
    """Session membership and the first open at or after each row.

    The next open of a date depends only on the row's own day and the day after its
    close, so it is prepared per calendar day and found by an equi-join on the date. Rows
    before the first session, however early, wait for its open; rows after the last have none.
    """
    span = sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"), F.min("open_at").alias("_first"))
    days = span.select(F.explode(F.expr("sequence(a, b)")).alias("day"))
    every = days.join(sessions.select(F.col("session_date").alias("day"), "open_at", "close_at"), "day", "left")
    # One row per calendar day: this window sees thousands of rows at most.
    ahead = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    every = every.withColumn("later_open", F.first("open_at", ignorenulls=True).over(ahead))
    j = df.withColumn("day", F.to_date(ts)).join(every, "day", "left").crossJoin(span.select("_first"))
    t = F.col(ts)
    upcoming = F.when(t <= F.col("_first"), F.col("_first")).when(t <= F.col("open_at"), F.col("open_at")).otherwise(F.col("later_open"))
    return j.withColumn(
        "in_session", F.coalesce((t >= F.col("open_at")) & (t < F.col("close_at")), F.lit(False))
    ).withColumn("next_open", upcoming).drop("day", "open_at", "close_at", "later_open", "_first")


def indivisible_sessions(sessions: DataFrame, interval: int) -> DataFrame:
    """Sessions whose regular minutes do not divide by the interval; must be empty."""
    minutes = F.expr("timestampdiff(MINUTE, open_at, close_at)")
    return sessions.withColumn("minutes", minutes).where(F.col("minutes") % interval != 0).select("session_date", "minutes")

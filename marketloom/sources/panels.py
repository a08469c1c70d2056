"""Adapters from the provided tables to ticks, bars and panels.

Raw rows shrink by partially aggregated groupings (which no hot asset can overload)
into bars keyed by (asset, time); row windows run only on those bars, whose partitions
are bounded by the calendar or by the asset universe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_HOUR, CLOSE_HOUR, HALF_DAY_CLOSE = 9, 17, 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: asset, ts, price, size, plus the source columns."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("asset"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        "event_id",
        "user_id",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC sessions 09:00-17:00 for each day from the first to the last tick; Fridays close at 13:00."""
    span = ticks(spark, sf_dir).agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    day = span.select(F.explode(F.sequence("a", "b")).alias("session_date"))
    half = F.dayofweek("session_date") == 6
    midnight = F.col("session_date").cast("timestamp")
    return day.select(
        "session_date",
        (midnight + F.expr(f"INTERVAL {OPEN_HOUR} HOURS")).alias("open_at"),
        F.when(half, midnight + F.expr(f"INTERVAL {HALF_DAY_CLOSE} HOURS"))
        .otherwise(midnight + F.expr(f"INTERVAL {CLOSE_HOUR} HOURS"))
        .alias("close_at"),
        half.alias("is_half_day"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular-session base bars of 60 minutes; ``slot`` counts hours since the open."""
    t = ticks(spark, sf_dir)
    closes = F.when(F.dayofweek("ts") == 6, HALF_DAY_CLOSE).otherwise(CLOSE_HOUR)
    t = t.where((F.hour("ts") >= OPEN_HOUR) & (F.hour("ts") < closes))
    return t.groupBy(
        "asset",
        F.to_date("ts").alias("session_date"),
        (F.hour("ts") - OPEN_HOUR).alias("slot"),
    ).agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.sum("size").cast("double").alias("volume"),
        F.count("*").alias("n"),
    )


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as unchecked vendor bars per supplier and day.

    Keys repeat with equal and with conflicting content, some rows break the OHLC
    order and some volumes are negative, so the quality operators have real work.
    """
    li = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("asset"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        px.alias("open"),
        (px * (F.lit(1) + F.col("l_tax"))).alias("high"),
        (px * (F.lit(1) - F.col("l_tax"))).alias("low"),
        (px * (F.lit(1) - F.col("l_discount"))).alias("close"),
        (F.col("l_quantity") - F.lit(2)).alias("volume"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand-day bars: mean unit price, extremes and shipped quantity.

    The part side joins by Catalyst's own size check (broadcast below the threshold).
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        li.select("l_partkey", F.to_date("l_shipdate").alias("d"), px.alias("px"), "l_quantity")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("asset"), "d")
        .agg(
            F.round(F.avg("px"), 8).alias("px"),
            F.max("px").alias("hi"),
            F.min("px").alias("lo"),
            F.sum("l_quantity").alias("vol"),
            F.count("*").alias("n"),
        )
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand-week bars; a week with three or more trading days is complete."""
    return (
        daily(spark, sf_dir)
        .groupBy("asset", F.to_date(F.date_trunc("week", "d")).alias("wk"))
        .agg(
            F.min_by("px", "d").alias("open"),
            F.max("hi").alias("high"),
            F.min("lo").alias("low"),
            F.max_by("px", "d").alias("close"),
            F.sum("vol").alias("volume"),
            F.count("*").alias("days"),
        )
        .select(
            "asset",
            "wk",
            F.year("wk").alias("yr"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            "days",
            (F.col("days") >= 3).alias("is_complete"),
        )
    )

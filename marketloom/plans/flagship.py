"""The flagship: weekly bars to momentum, forward label, rank IC and its ICIR."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import average_rank, correlation, mean_over_std
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS, pub
from marketloom.sources.panels import weekly

MOMENTUM = PANELS + """,
mom AS (
  SELECT asset, wk, close / lag(close) OVER a - 1 AS f, lead(close) OVER a / close - 1 AS y
  FROM weekly WINDOW a AS (PARTITION BY asset ORDER BY wk)),
ranked AS (
  SELECT wk,
         (rank() OVER (PARTITION BY wk ORDER BY f) + count(*) OVER (PARTITION BY wk ORDER BY f)) / 2.0 AS rf,
         (rank() OVER (PARTITION BY wk ORDER BY y) + count(*) OVER (PARTITION BY wk ORDER BY y)) / 2.0 AS ry
  FROM mom WHERE f IS NOT NULL AND y IS NOT NULL),
ic AS (
  SELECT wk, count(*) AS breadth, covar_pop(rf, ry) / nullif(stddev_pop(rf) * stddev_pop(ry), 0) AS rank_ic
  FROM ranked GROUP BY wk HAVING count(*) >= 5)
"""


def momentum_ic(spark, sf_dir):
    a = Window.partitionBy("asset").orderBy("wk")
    m = weekly(spark, sf_dir).select(
        "asset",
        "wk",
        (F.col("close") / F.lag("close").over(a) - 1).alias("f"),
        (F.lead("close").over(a) / F.col("close") - 1).alias("y"),
    )
    m = m.where(F.col("f").isNotNull() & F.col("y").isNotNull())
    m = m.select("wk", average_rank("f", ["wk"]).alias("rf"), average_rank("y", ["wk"]).alias("ry"))
    return (
        m.groupBy("wk")
        .agg(F.count("*").alias("breadth"), correlation("rf", "ry").alias("rank_ic"))
        .where("breadth >= 5")
    )


@query("flagship_weekly_rank_ic", pub(MOMENTUM + "SELECT * FROM ic", "rank_ic", "wk"))
def flagship_weekly_rank_ic(spark, sf_dir):
    return published(momentum_ic(spark, sf_dir))


@query(
    "flagship_icir",
    pub(
        MOMENTUM + "SELECT count(*) AS weeks, avg(rank_ic) AS ic_mean, "
        "avg(rank_ic) / stddev_samp(rank_ic) AS icir FROM ic",
        "ic_mean icir",
    ),
)
def flagship_icir(spark, sf_dir):
    return published(
        momentum_ic(spark, sf_dir).agg(
            F.count("*").alias("weeks"),
            F.avg("rank_ic").alias("ic_mean"),
            mean_over_std("rank_ic").alias("icir"),
        )
    )

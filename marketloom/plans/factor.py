"""Queries over declarative factors and user features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import factors as fa
from marketloom.operators.userfn import FeatureSpec, with_feature
from marketloom.plans.panel import STATE, market_state
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS
from marketloom.sources.panels import weekly

WIN = "WINDOW a AS (PARTITION BY asset, yr ORDER BY wk)"


def fr(n: int, extra: str = "") -> str:
    return f"(PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def masked(expr: str, need: int) -> str:
    """SQL of the mask after each level: enough history and only complete bars."""
    return f"CASE WHEN count(*) OVER {fr(need)} = {need} AND bool_and(is_complete) OVER {fr(need)} THEN {expr} END"


def winsor_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(quantile_cont({x}, 0.95) OVER t, greatest(quantile_cont({x}, 0.05) OVER t, {x})) END"


BASE = PANELS + f""",
l1 AS (SELECT *, {masked('close / lag(close, 3) OVER a - 1', 4)} AS r4, {masked('close / lag(close, 1) OVER a - 1', 2)} AS r2, {masked('close / lag(close, 2) OVER a - 1', 3)} AS r3,
  CASE WHEN is_complete THEN close END AS c1, {masked(f'avg(volume) OVER {fr(8)}', 8)} AS mv, {masked(f'max(high) OVER {fr(8)}', 8)} AS hh, {masked(f'min(low) OVER {fr(8)}', 8)} AS ll FROM weekly {WIN}),
l2 AS (SELECT *, CASE WHEN count(r2) OVER {fr(8)} = 8 THEN {masked(f'stddev_pop(r2) OVER {fr(8)}', 9)} END AS sd, CASE WHEN is_complete AND mv > 1e-12 THEN volume / mv END AS rv FROM l1),
l3 AS (SELECT *, CASE WHEN sd > 1e-12 AND {masked('1', 9)} = 1 THEN r4 / sd END AS vsm, CASE WHEN {masked('1', 8)} = 1 THEN -r3 * rv END AS vcr,
  CASE WHEN {masked('1', 8)} = 1 AND hh - ll > 1e-12 THEN ((c1 - ll) / (hh - ll) - 0.5) * rv END AS vrl FROM l2),
l4 AS (SELECT *, {winsor_sql('vsm')} AS wa, {winsor_sql('vcr')} AS wb, {winsor_sql('vrl')} AS wc FROM l3 WINDOW t AS (PARTITION BY wk)),
l5 AS (SELECT asset, wk, yr, close,
  CASE WHEN count(wa) OVER t >= 2 THEN (wa - avg(wa) OVER t) / nullif(stddev_pop(wa) OVER t, 0) END AS f1,
  CASE WHEN wb IS NOT NULL AND count(wb) OVER t >= 2 THEN ((rank() OVER (PARTITION BY wk ORDER BY wb) + count(wb) OVER (PARTITION BY wk ORDER BY wb)) / 2.0 - 1) / (count(wb) OVER t - 1) END AS f2,
  CASE WHEN count(wc) OVER t >= 2 THEN (wc - avg(wc) OVER t) / nullif(stddev_pop(wc) OVER t, 0) END AS f3 FROM l4 WINDOW t AS (PARTITION BY wk))
"""


def catalog_panel(spark, sf, reasons=False):
    w = weekly(spark, sf)
    out = fa.with_factors(w, fa.catalog(), "asset", "yr", "wk", reasons=reasons)
    names = dict(zip(fa.catalog(), ("f1", "f2", "f3")))
    return out.withColumnsRenamed(names)


@query("udf03_factor_catalog", BASE + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(f1, 6) + 0.0 AS f1, round(f2, 6) + 0.0 AS f2, round(f3, 6) + 0.0 AS f3 FROM l5")
def udf03(spark, sf):
    return published(catalog_panel(spark, sf).select("asset", "wk", "f1", "f2", "f3"))


@query("udf02_factor_expression", PANELS + f""",
z AS (SELECT asset, wk, {masked('close - lag(close, 2) OVER a', 3)} AS d, {masked(f'avg(close) OVER {fr(4)}', 4)} AS m,
  count(*) OVER {fr(4)} AS have, bool_and(is_complete) OVER {fr(4)} AS whole FROM weekly {WIN})
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN have = 4 AND whole THEN greatest(-0.5, least(0.5, d / m)) END, 6) + 0.0 AS v,
  CASE WHEN have < 4 THEN 'INSUFFICIENT_HISTORY' WHEN NOT whole THEN 'INCOMPLETE_BAR' WHEN abs(m) <= 1e-12 THEN 'NUMERIC_UNAVAILABLE' END AS v_reason FROM z""")
def udf02(spark, sf):
    close = fa.field("close")
    f = fa.clipped(fa.divide(close - fa.lag(close, 2), fa.mean(close, 4)), -0.5, 0.5)
    out = fa.with_factors(weekly(spark, sf), {"v": f}, "asset", "yr", "wk")
    return published(out.select("asset", "wk", "v", "v_reason"))


@query("udf02b_gated_factor", STATE + f""",
z AS (SELECT asset, wk, state, {masked('ln(close / lag(close, 1) OVER a)', 2)} AS r, count(*) OVER {fr(2)} AS have, bool_and(is_complete) OVER {fr(2)} AS whole FROM weekly LEFT JOIN state USING (wk, yr) {WIN})
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN state IN ('UP_LOW', 'UP_HIGH') THEN r END, 6) + 0.0 AS v,
  CASE WHEN have < 2 THEN 'INSUFFICIENT_HISTORY' WHEN NOT whole THEN 'INCOMPLETE_BAR' WHEN state IS NULL OR state NOT IN ('UP_LOW', 'UP_HIGH') THEN 'REGIME_EXCLUDED' END AS v_reason FROM z""")
def udf02b(spark, sf):
    w = weekly(spark, sf).join(market_state(spark, sf).withColumnRenamed("state", "regime"), ["wk", "yr"], "left")
    f = fa.gate(fa.logret(fa.field("close"), 2), ["UP_LOW", "UP_HIGH"])
    return published(fa.with_factors(w, {"v": f}, "asset", "yr", "wk").select("asset", "wk", "v", "v_reason"))


def weighted_gap(block: np.ndarray) -> np.ndarray:
    """Volume-weighted mean close of the window against the last close."""
    close, volume = block[:, :, 0], block[:, :, 1]
    return close[:, -1] / ((close * volume).sum(axis=1) / volume.sum(axis=1)) - 1.0


@query("udf01_user_feature", PANELS + f"""SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN count(*) OVER {fr(6)} = 6 THEN close / (sum(close * volume) OVER {fr(6)} / sum(volume) OVER {fr(6)}) - 1 END, 6) + 0.0 AS gap FROM weekly""")
def udf01(spark, sf):
    spec = FeatureSpec("gap", ("close", "volume"), 6, weighted_gap)
    return published(with_feature(weekly(spark, sf), spec, ["asset", "yr"], "wk").select("asset", "wk", "gap"))


FNW = PANELS + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, "


@query("fn01_arithmetic_nodes", FNW + "round(-(close - open) * 2 + 1, 8) + 0.0 AS v FROM weekly WHERE is_complete")
def fn01(spark, sf):
    close, open_ = fa.field("close"), fa.field("open")
    f = -(close - open_) * fa.const(2.0)
    out = fa.with_factors(weekly(spark, sf), {"v": f}, "asset", "yr", "wk", reasons=False).where("is_complete")
    return published(out.select("asset", "wk", (F.col("v") + 1).alias("v")), 8)


@query("fn02_safe_divide", FNW + "round(CASE WHEN abs(high - low) <= 1000 THEN -1 ELSE (close - low) / (high - low) END, 6) + 0.0 AS v FROM weekly WHERE is_complete")
def fn02(spark, sf):
    low = fa.field("low")
    f = fa.divide(fa.field("close") - low, fa.field("high") - low, 1000.0, -1.0)
    out = fa.with_factors(weekly(spark, sf), {"v": f}, "asset", "yr", "wk", reasons=False).where("is_complete")
    return published(out.select("asset", "wk", "v"))


@query("fn03_clip", FNW + "round(least(12000, greatest(3000, close)), 8) AS v FROM weekly WHERE is_complete")
def fn03(spark, sf):
    out = fa.with_factors(weekly(spark, sf), {"v": fa.clipped(fa.field("close"), 3000.0, 12000.0)}, "asset", "yr", "wk", reasons=False)
    return published(out.where("is_complete").select("asset", "wk", "v"), 8)


@query("fn04_input_constant", FNW + "volume AS v, 2.5::DOUBLE AS k FROM weekly WHERE is_complete")
def fn04(spark, sf):
    out = fa.with_factors(weekly(spark, sf), {"v": fa.field("volume"), "k": fa.const(2.5)}, "asset", "yr", "wk", reasons=False)
    return published(out.where("is_complete").select("asset", "wk", "v", "k"))

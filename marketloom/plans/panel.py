"""Queries over resampling, time windows and cross-sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import average_rank, weighted_mean
from marketloom.operators import cross as xs
from marketloom.operators import resample as rs
from marketloom.operators import windows as win
from marketloom.plans.market import GRID, dense
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS, pub
from marketloom.sources.panels import daily, hourly, table, ticks, weekly

BARS = "round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume"


@query("agg01_session_bars", pub(PANELS + """SELECT asset, session_date, slot // 2 AS bucket, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low, arg_max(close, slot) AS close,
  sum(volume) AS volume, count(*) AS rows, slot // 2 * 2 AS bar_start, (slot // 2 + 1) * 2 AS bar_end, count(*) / 2 AS coverage, count(*) = 2 AS is_complete FROM hourly GROUP BY 1, 2, 3, slot // 2""", dates="session_date"))
def agg01(spark, sf):
    return published(rs.session_bars(hourly(spark, sf), 2), None)


MULTI = PANELS + """,
multi AS (SELECT asset, session_date, CAST(width AS BIGINT) AS width, slot // width AS bucket, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low, arg_max(close, slot) AS close,
  sum(volume) AS volume, count(*) AS rows, count(*) = width AS is_complete FROM hourly, (SELECT unnest([1, 2, 4]) AS width) AS w GROUP BY asset, session_date, width, slot // width)"""


@query("agg02_multi_interval", pub(MULTI + "SELECT * FROM multi", dates="session_date"))
def agg02(spark, sf):
    return published(rs.multi_interval(hourly(spark, sf), [1, 2, 4]), None)


@query("agg03_slices", MULTI + """, l AS (SELECT asset, session_date, CAST(h AS BIGINT) AS horizon, slot // 2 AS bucket, max(high) AS y FROM hourly, (SELECT unnest([2, 4]) AS h) AS hh GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM multi WHERE is_complete)
SELECT 'base' AS slice, b.asset, strftime(b.session_date, '%Y-%m-%d') AS session_date, b.bucket, b.close, l.y FROM b LEFT JOIN l ON b.asset = l.asset AND b.session_date = l.session_date AND b.bucket = l.bucket AND l.horizon = 2 WHERE width = 2
UNION ALL SELECT 'long', b.asset, strftime(b.session_date, '%Y-%m-%d'), b.bucket, b.close, l.y FROM b LEFT JOIN l ON b.asset = l.asset AND b.session_date = l.session_date AND b.bucket = l.bucket AND l.horizon = 4 WHERE width = 4""")
def agg03(spark, sf):
    h = hourly(spark, sf)
    b = rs.multi_interval(h, [1, 2, 4]).where("is_complete")
    lab = h.withColumn("horizon", F.explode(F.array(F.lit(2), F.lit(4)))).groupBy("asset", "session_date", "horizon", F.floor(F.col("slot") / 2).alias("bucket")).agg(F.max("high").alias("y"))
    out = rs.slices(b, lab, {"base": (2, 2), "long": (4, 4)}, ["asset", "session_date", "bucket"])
    return published(out.select("slice", "asset", "session_date", "bucket", "close", "y"), None)


@query("agg04_annual_panel", PANELS + """, b AS (SELECT asset, session_date, slot // 2 AS bucket, arg_max(close, slot) AS close, count(*) = 2 AS is_complete FROM hourly GROUP BY 1, 2, 3),
l AS (SELECT s.asset, s.session_date, s.slot // 2 AS bucket, t.close / s.close - 1 AS y FROM hourly AS s JOIN hourly AS t ON s.asset = t.asset AND s.session_date = t.session_date AND t.slot = s.slot + 2 WHERE (s.slot + 1) % 2 = 0)
SELECT CAST(year(b.session_date) AS BIGINT) AS yr, b.asset, strftime(b.session_date, '%Y-%m-%d') AS session_date, b.bucket, b.close, is_complete, round(y, 6) + 0.0 AS y FROM b LEFT JOIN l ON b.asset = l.asset AND b.session_date = l.session_date AND b.bucket = l.bucket""")
def agg04(spark, sf):
    """Bars with the label of their last minute, written and read back by year."""
    from marketloom.operators.joins import same_session_label
    from marketloom.settings import shared_dir

    h = hourly(spark, sf)
    b = rs.session_bars(h, 2).select("asset", "session_date", "bucket", "close", "is_complete")
    lab = same_session_label(h, 2, ["asset", "session_date"], "slot", "close", "y").where("(slot + 1) % 2 = 0")
    lab = lab.select("asset", "session_date", F.floor(F.col("slot") / 2).alias("bucket"), "y")
    out = b.join(lab, ["asset", "session_date", "bucket"], "left").withColumn("yr", F.year("session_date"))
    path = shared_dir(spark, "annual")
    out.write.partitionBy("yr").parquet(path)
    return published(spark.read.parquet(path))


@query("agg05_liquidity_profile", PANELS + """, d AS (SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice * l_quantity) AS t, max(l_extendedprice) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT asset, count(*) AS days, round(median(t), 4) AS median_turnover, round(median(p), 4) AS median_price FROM d GROUP BY 1""")
def agg05(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    d = li.select(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
    return published(rs.liquidity_profile(d, "asset", "d", "l_extendedprice", "l_quantity", "l_extendedprice"), 4)


@query("agg06_session_endpoints", PANELS + """, g AS (SELECT asset, session_date, count(*) AS rows, arg_min(open, slot) AS o, arg_max(close, slot) AS c, min(slot) AS a, max(slot) AS b FROM hourly GROUP BY 1, 2)
SELECT asset, strftime(session_date, '%Y-%m-%d') AS session_date, rows, CASE WHEN a <= 0 AND b >= 7 AND rows >= 7 THEN o END AS first_open, CASE WHEN a <= 0 AND b >= 7 AND rows >= 7 THEN c END AS last_close FROM g""")
def agg06(spark, sf):
    return published(rs.session_endpoints(hourly(spark, sf), ["asset", "session_date"], "slot", 0, 7, 7), None)


@query("agg07_exact_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.10), 4) AS q10, round(quantile_cont(l_extendedprice, 0.50), 4) AS q50, round(quantile_cont(l_extendedprice, 0.90), 4) AS q90 FROM lineitem GROUP BY 1")
def agg07(spark, sf):
    return published(rs.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9]), 4)


RETS = PANELS + """,
rets AS (SELECT asset, wk, yr, close / lag(close) OVER (PARTITION BY asset ORDER BY wk) - 1 AS r0, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY wk)) / 20 AS r FROM weekly)"""


def returns(spark, sf):
    """Weekly returns; ``r`` is a damped log return that compounds to sane levels."""
    w = Window.partitionBy("asset").orderBy("wk")
    p = F.lag("close").over(w)
    return weekly(spark, sf).select("asset", "wk", "yr", (F.col("close") / p - 1).alias("r0"), (F.log(F.col("close") / p) / 20).alias("r"))


@query("agg08_compounded_months", RETS + "SELECT asset, strftime(date_trunc('month', wk), '%Y-%m-%d') AS month, round(product(1 + r) - 1, 6) + 0.0 AS period_return, count(r) AS periods FROM rets WHERE r IS NOT NULL GROUP BY 1, 2")
def agg08(spark, sf):
    r = returns(spark, sf).where("r IS NOT NULL").withColumn("month", F.trunc("wk", "month"))
    return published(rs.compounded(r, ["asset", "month"], "r"))


@query("agg09_order_funnel", """SELECT l_returnflag, count(*) FILTER (l_quantity > 0) AS desired, count(*) FILTER (l_quantity >= 10) AS executable, count(*) FILTER (l_quantity >= 10 AND l_linestatus = 'F') AS filled,
  round(sum(l_tax), 4) AS l_tax, round(sum(l_discount), 4) AS l_discount FROM lineitem GROUP BY 1""")
def agg09(spark, sf):
    big = F.col("l_quantity") >= 10
    stages = {"desired": F.col("l_quantity") > 0, "executable": big, "filled": big & (F.col("l_linestatus") == "F")}
    return published(rs.funnel(table(spark, sf, "lineitem"), ["l_returnflag"], stages, ["l_tax", "l_discount"]), 4)


@query("agg09b_reason_histogram", """SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity < 10 THEN 'LOT_SMALL' END, CASE WHEN l_discount > 0.08 THEN 'PRICE_LIMIT' END, CASE WHEN l_tax = 0 THEN 'DATA_GAP' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) AS z GROUP BY 1""")
def agg09b(spark, sf):
    from marketloom.functions.numeric import reasons

    codes = reasons((F.col("l_quantity") < 10, "LOT_SMALL"), (F.col("l_discount") > 0.08, "PRICE_LIMIT"), (F.col("l_tax") == 0, "DATA_GAP"))
    return rs.reason_histogram(table(spark, sf, "lineitem").select(codes.alias("codes")), "codes")


@query("agg10_heat_map", PANELS + "SELECT asset, yr, round(avg(close / open - 1), 6) + 0.0 AS mean, count(*) AS n FROM weekly GROUP BY 1, 2")
def agg10(spark, sf):
    w = weekly(spark, sf).withColumn("ret", F.col("close") / F.col("open") - 1)
    return published(rs.heat_map(w, [F.col("asset"), F.col("yr")], "ret"))


@query("agg10b_heat_map_totals", PANELS + "SELECT coalesce(asset, 'ALL') AS asset, coalesce(CAST(yr AS VARCHAR), 'ALL') AS yr, round(avg(close / open - 1), 6) + 0.0 AS mean, count(*) AS n FROM weekly GROUP BY CUBE (weekly.asset, weekly.yr)")
def agg10b(spark, sf):
    w = weekly(spark, sf).withColumn("ret", F.col("close") / F.col("open") - 1)
    out = rs.heat_map(w, [F.col("asset"), F.col("yr")], "ret", totals=True)
    return published(out.withColumns({"asset": F.coalesce("asset", F.lit("ALL")), "yr": F.coalesce(F.col("yr").cast("string"), F.lit("ALL"))}))


@query("agg11_dimensions", """SELECT 'o_orderstatus' AS dimension, o_orderstatus AS member, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def agg11(spark, sf):
    return rs.dimensions(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg12_fold_rollup", PANELS + """, f AS (SELECT asset, yr, CASE WHEN count(*) > 40 THEN avg(close / open - 1) END AS m FROM weekly WHERE is_complete GROUP BY 1, 2)
SELECT asset, round(avg(m), 6) + 0.0 AS mean, round(min(m), 6) + 0.0 AS worst, round(max(m), 6) + 0.0 AS best, count(*) AS folds, count(m) AS valid_folds FROM f GROUP BY 1""")
def agg12(spark, sf):
    w = weekly(spark, sf).where("is_complete")
    f = w.groupBy("asset", "yr").agg(F.when(F.count("*") > 40, F.avg(F.col("close") / F.col("open") - 1)).alias("m"))
    return published(rs.fold_rollup(f, ["asset"], "m", F.col("m").isNotNull()))


@query("agg13_weighted_mean", "SELECT c_nationkey::BIGINT AS c_nationkey, round(sum(c_acctbal * c_custkey) FILTER (c_custkey > 10) / sum(c_custkey) FILTER (c_custkey > 10), 4) AS wm FROM customer GROUP BY 1")
def agg13(spark, sf):
    w = F.when(F.col("c_custkey") > 10, F.col("c_custkey")).otherwise(0)
    return published(table(spark, sf, "customer").groupBy("c_nationkey").agg(weighted_mean("c_acctbal", w).alias("wm")), 4)


@query("agg14_session_summary", RETS + """, s AS (SELECT *, r IS NULL AS unresolved FROM rets)
SELECT asset, count(*) FILTER (NOT unresolved) AS resolved, count(*) FILTER (unresolved) AS unresolved, CASE WHEN count(*) FILTER (unresolved AND wk >= '1995-02-01') = 0 THEN round(product(1 + r) - 1, 6) + 0.0 END AS full_return FROM s GROUP BY 1""")
def agg14(spark, sf):
    bad = F.col("r").isNull()
    out = returns(spark, sf).groupBy("asset").agg(
        F.count_if(~bad).alias("resolved"), F.count_if(bad).alias("unresolved"),
        F.when(F.count_if(bad & (F.col("wk") >= "1995-02-01")) == 0, F.product(F.col("r") + 1) - 1).alias("full_return"))
    return published(out)


@query("agg15_pooled_mean", RETS + """SELECT asset, CASE WHEN month(wk) <= 6 THEN 'h1' ELSE 'h2' END AS regime, round(-avg(r0), 6) + 0.0 AS pooled, count(*) AS n, count(DISTINCT yr) AS sessions FROM rets WHERE r0 IS NOT NULL GROUP BY 1, 2""")
def agg15(spark, sf):
    r = returns(spark, sf).where("r0 IS NOT NULL").withColumn("regime", F.when(F.month("wk") <= 6, "h1").otherwise("h2"))
    # Year-level partials first: counting distinct years needs no expansion of the rows.
    y = r.groupBy("asset", "regime", "yr").agg(F.sum("r0").alias("s"), F.count("*").alias("c"))
    out = y.groupBy("asset", "regime").agg((-F.sum("s") / F.sum("c")).alias("pooled"), F.sum("c").alias("n"), F.count("*").alias("sessions"))
    return published(out)


@query("agg16_weighted_fill", "SELECT l_suppkey, l_returnflag, sum(l_quantity) AS quantity, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS vwap FROM lineitem GROUP BY 1, 2")
def agg16(spark, sf):
    return published(rs.weighted_fill(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", "l_extendedprice"), 4)


@query("agg17_catalog_rollup", """WITH v AS (SELECT o_custkey AS program_id, max((o_orderkey, o_orderstatus <> 'P')) AS x FROM orders WHERE o_totalprice > 350000 GROUP BY 1),
p AS (SELECT c_custkey AS program_id FROM customer WHERE c_acctbal > 0), r AS (SELECT c_custkey AS program_id, c_mktsegment AS status FROM customer WHERE c_acctbal > 6000),
j AS (SELECT coalesce(p.program_id, v.program_id) AS program_id, p.program_id AS pp, (SELECT max(o_orderkey) FROM orders WHERE o_totalprice > 350000 AND o_custkey = v.program_id) AS evidence_id FROM p FULL JOIN v ON p.program_id = v.program_id)
SELECT j.program_id, CAST(coalesce(evidence_id, -1) AS BIGINT) AS evidence_id, r.status, CASE WHEN pp IS NULL THEN 'UNMATCHED_VALIDATION' WHEN evidence_id IS NULL THEN 'NOT_VALIDATED'
  WHEN NOT (SELECT bool_or(o_orderstatus <> 'P') FROM orders WHERE o_orderkey = evidence_id) THEN 'VALIDATION_FAILED' WHEN r.status IS NULL THEN 'READY_FOR_RESERVE' ELSE 'RESERVE_USED' END AS stage FROM j LEFT JOIN r ON j.program_id = r.program_id""")
def agg17(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    programs = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("program_id"))
    val = o.where("o_totalprice > 350000").select(F.col("o_custkey").alias("program_id"), F.col("o_orderkey").alias("evidence_id"), (F.col("o_orderstatus") != "P").alias("passed"))
    res = c.where("c_acctbal > 6000").select(F.col("c_custkey").alias("program_id"), F.col("c_mktsegment").alias("status"))
    return rs.catalog_rollup(programs, val, res).withColumn("evidence_id", F.coalesce("evidence_id", F.lit(-1).cast("bigint")))


@query("agg18_run_summary", """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS blocked, count(*) FILTER (event_type = 'purchase') AS outputs,
  round(count(*) FILTER (event_type = 'error') / count(*), 6) AS blocked_rate, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS outputs_rate FROM events GROUP BY 1""")
def agg18(spark, sf):
    flags = {"blocked": F.col("event_type") == "error", "outputs": F.col("event_type") == "purchase"}
    return published(rs.run_summary(table(spark, sf, "events"), ["user_id"], flags))


# --- windows over time ----------------------------------------------------------------

A = "(PARTITION BY asset ORDER BY wk)"
Y = "(PARTITION BY asset, yr ORDER BY wk)"
BY, ORD = ["asset", "yr"], "wk"


def wk_sql(expr: str, name: str, extra: str = "", digits: int = 6) -> str:
    return PANELS + f"SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round({expr}, {digits}) + 0.0 AS {name}{extra} FROM weekly"


def wk_out(spark, sf, col, name, digits=6, **extra):
    w = weekly(spark, sf).select("asset", "wk", col.alias(name), *[c.alias(n) for n, c in extra.items()])
    return published(w, digits)


@query("win01_lag", wk_sql(f"lag(close, 3) OVER {Y}", "v", digits=8))
def win01(spark, sf):
    return wk_out(spark, sf, win.lagged("close", 3, BY, ORD), "v", 8)


@query("win02_simple_return", wk_sql(f"close / lag(close, 4) OVER {Y} - 1", "v"))
def win02(spark, sf):
    return wk_out(spark, sf, win.simple_return("close", 5, BY, ORD), "v")


@query("win03_log_return", wk_sql(f"ln(close / lag(close, 4) OVER {Y})", "v"))
def win03(spark, sf):
    return wk_out(spark, sf, win.log_return("close", 5, BY, ORD), "v")


def roll_sql(fn: str) -> str:
    f = "(PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    return wk_sql(f"CASE WHEN count(close) OVER {f} = 6 THEN {fn}(close) OVER {f} END", "v")


@query("win04_rolling_mean", roll_sql("avg"))
def win04(spark, sf):
    return wk_out(spark, sf, win.rolling_mean("close", 6, BY, ORD), "v")


@query("win05_rolling_std", roll_sql("stddev_pop"))
def win05(spark, sf):
    return wk_out(spark, sf, win.rolling_std("close", 6, BY, ORD), "v")


@query("win06_rolling_min_max", PANELS + """SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, CASE WHEN count(*) OVER f = 6 THEN round(min(close) OVER f, 8) END AS lo, CASE WHEN count(*) OVER f = 6 THEN round(max(close) OVER f, 8) END AS hi
FROM weekly WINDOW f AS (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def win06(spark, sf):
    return wk_out(spark, sf, win.rolling_min("close", 6, BY, ORD), "lo", 8, hi=win.rolling_max("close", 6, BY, ORD))


@query("win07_window_reason", PANELS + """SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, CASE WHEN count(*) OVER f < 4 THEN 'INSUFFICIENT_HISTORY' WHEN NOT bool_and(is_complete) OVER f THEN 'INCOMPLETE_BAR' END AS reason
FROM weekly WINDOW f AS (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def win07(spark, sf):
    return wk_out(spark, sf, win.window_reason("is_complete", 4, BY, ORD), "reason")


@query("win08_named_features", PANELS + f"""SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(ln(close / lag(close) OVER a), 6) + 0.0 AS log_ret, round(power(close / lag(close) OVER a - 1, 2), 6) + 0.0 AS sq_ret,
  round(CASE WHEN volume > 0 AND lag(volume) OVER a > 0 THEN volume / lag(volume) OVER a - 1 END, 6) + 0.0 AS vol_change FROM weekly WINDOW a AS {A}""")
def win08(spark, sf):
    r = win.simple_return("close", 2, ["asset"], ORD)
    return wk_out(spark, sf, win.log_return("close", 2, ["asset"], ORD), "log_ret", sq_ret=r * r, vol_change=win.simple_return("volume", 2, ["asset"], ORD))


@query("win09_forward_labels", PANELS + f"""SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN lead(wk, 3) OVER a < make_date(yr + 1, 1, 1) THEN lead(close, 3) OVER a / close - 1 END, 6) + 0.0 AS fwd,
  round(CASE WHEN lead(wk, 3) OVER a < make_date(yr + 1, 1, 1) THEN ln(lead(close, 3) OVER a / close) END, 6) + 0.0 AS fwd_log FROM weekly WINDOW a AS {A}""")
def win09(spark, sf):
    """Labels stop at the end of the split (here: the year)."""
    edge = F.make_date(F.col("yr") + 1, F.lit(1), F.lit(1))
    return wk_out(spark, sf, win.forward_return("close", 3, ["asset"], ORD, edge), "fwd", fwd_log=win.forward_return("close", 3, ["asset"], ORD, edge, log=True))


@query("win10_rolling_performance", pub(RETS + """, x AS (SELECT * FROM rets WHERE r IS NOT NULL), z AS (SELECT asset, wk, count(r) OVER f AS window_rows, product(1 + r) OVER f - 1 AS window_return,
  coalesce(stddev_samp(r) OVER f, 0) AS sd, avg(r) OVER f AS m FROM x WINDOW f AS (PARTITION BY asset ORDER BY wk ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT asset, wk, window_rows, window_return, sd * sqrt(52) AS window_vol, CASE WHEN sd > 1e-15 THEN m / sd * sqrt(52) ELSE 0 END AS window_sharpe FROM z""", "window_return window_vol window_sharpe", "wk"))
def win10(spark, sf):
    r = returns(spark, sf).where("r IS NOT NULL").select("asset", "wk", "r")
    return published(win.rolling_performance(r, "r", 13, 52.0, ["asset"], "wk").drop("r"))


@query("win11_nav_drawdown", pub(RETS + """, n AS (SELECT asset, wk, product(1 + r) OVER (PARTITION BY asset ORDER BY wk) AS nav FROM rets WHERE r IS NOT NULL),
p AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY asset ORDER BY wk)) AS peak FROM n) SELECT asset, wk, nav, peak, nav / peak - 1 AS drawdown FROM p""", "nav peak drawdown", "wk"))
def win11(spark, sf):
    r = returns(spark, sf).where("r IS NOT NULL").select("asset", "wk", "r")
    return published(win.nav_and_drawdown(r, "r", ["asset"], "wk", from_one=True).drop("r"))


@query("win12_stepped_ic", PANELS + """, z AS (SELECT asset, wk, CASE WHEN count(*) OVER f = 8 THEN avg(close / open - 1) OVER f END AS v, row_number() OVER (PARTITION BY asset ORDER BY wk) AS rn, count(*) OVER (PARTITION BY asset) AS n
  FROM weekly WINDOW f AS (PARTITION BY asset ORDER BY wk ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(v, 6) + 0.0 AS v FROM z WHERE rn >= 8 AND ((rn - 8) % 5 = 0 OR rn = n)""")
def win12(spark, sf):
    w = weekly(spark, sf).withColumn("x", F.col("close") / F.col("open") - 1)
    w = w.select("asset", "wk", win.rolling_mean("x", 8, ["asset"], "wk").alias("v"))
    return published(win.stepped(w, 8, 5, ["asset"], "wk"))


STATE = PANELS + """,
mkt AS (SELECT wk, yr, avg(close / open - 1) AS r FROM weekly GROUP BY 1, 2),
roll AS (SELECT wk, yr, CASE WHEN count(r) OVER f = 8 THEN avg(r) OVER f END AS dir, CASE WHEN count(r) OVER f = 8 THEN stddev_pop(r) OVER f END AS vol FROM mkt WINDOW f AS (ORDER BY wk ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
lagd AS (SELECT wk, yr, lag(dir) OVER (ORDER BY wk) AS dir, lag(vol) OVER (ORDER BY wk) AS vol FROM roll),
cut AS (SELECT median(vol) AS t FROM lagd WHERE yr <= 1997),
state AS (SELECT wk, yr, CASE WHEN dir IS NULL THEN NULL WHEN dir >= 0 AND vol >= t THEN 'UP_HIGH' WHEN dir >= 0 THEN 'UP_LOW' WHEN vol >= t THEN 'DOWN_HIGH' ELSE 'DOWN_LOW' END AS state FROM lagd, cut)
"""


def market_state(spark, sf):
    """Direction x volatility state known before the week; threshold from training years.

    The market series has one row per week, so its ordered window is calendar-bounded.
    """
    m = weekly(spark, sf).groupBy("wk", "yr").agg(F.avg(F.col("close") / F.col("open") - 1).alias("r")).withColumn("market", F.lit("all"))
    m = m.withColumns({"dir": win.rolling_mean("r", 8, ["market"], "wk"), "vol": win.rolling_std("r", 8, ["market"], "wk")})
    w = Window.partitionBy("market").orderBy("wk")
    m = m.withColumns({"dir": F.lag("dir").over(w), "vol": F.lag("vol").over(w)})
    m = m.withColumn("t", F.median(F.when(F.col("yr") <= 1997, F.col("vol"))).over(Window.partitionBy("market")))
    up, high = F.col("dir") >= 0, F.col("vol") >= F.col("t")
    state = F.when(F.col("dir").isNull(), None).when(up & high, "UP_HIGH").when(up, "UP_LOW").when(high, "DOWN_HIGH").otherwise("DOWN_LOW")
    return m.select("wk", "yr", state.alias("state"))


@query("win13_market_state", STATE + "SELECT strftime(wk, '%Y-%m-%d') AS wk, yr, state FROM state")
def win13(spark, sf):
    return published(market_state(spark, sf))


@query("win14_slot_activity", GRID + """, z AS (SELECT asset, session_date, slot, volume, list_sort(list(volume) FILTER (volume IS NOT NULL) OVER f) AS a FROM dense WINDOW f AS (PARTITION BY asset, slot ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT asset, strftime(session_date, '%Y-%m-%d') AS session_date, slot, round(CASE WHEN len(a) = 5 AND a[3] > 0 THEN volume / a[3] END, 6) AS ratio FROM z""")
def win14(spark, sf):
    """Volume against the median of the same slot in five prior sessions; gaps give NULL."""
    d = dense(spark, sf)
    base = win.rolling_median("volume", 5, ["asset", "slot"], "session_date", 5, lag=1)
    return published(d.select("asset", "session_date", "slot", F.when(base > 0, F.col("volume") / base).alias("ratio")))


@query("win15_liquidity_eligibility", PANELS + """, z AS (SELECT asset, d, vol, px, list_sort(list(vol) OVER f) AS a, row_number() OVER (PARTITION BY asset ORDER BY d) AS listed FROM daily WINDOW f AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN len(a) >= 10 THEN (a[(len(a) + 1) // 2] + a[(len(a) + 2) // 2]) / 2 END AS med FROM z)
SELECT asset, strftime(d, '%Y-%m-%d') AS d, med, concat_ws(',', CASE WHEN listed < 60 THEN 'RECENT_LISTING' END, CASE WHEN px < 500 THEN 'LOW_PRICE' END, CASE WHEN med IS NULL OR med < 30 THEN 'ILLIQUID' END) AS codes FROM m WHERE d >= '1996-01-01'""")
def win15(spark, sf):
    from marketloom.functions.numeric import reasons

    d = daily(spark, sf).withColumns(
        {"med": win.rolling_median("vol", 20, ["asset"], "d", 10), "listed": F.row_number().over(win.along(["asset"], "d"))})
    codes = reasons((F.col("listed") < 60, "RECENT_LISTING"), (F.col("px") < 500, "LOW_PRICE"), (F.col("med").isNull() | (F.col("med") < 30), "ILLIQUID"))
    return published(d.where("d >= '1996-01-01'").select("asset", "d", "med", codes.alias("codes")))


@query("win16_market_features", GRID + """, m AS (SELECT session_date, slot, avg(close) AS c FROM dense GROUP BY 1, 2), r AS (SELECT *, c / lag(c) OVER s - 1 AS r, c / lag(c, 3) OVER s - 1 AS trail FROM m WINDOW s AS (PARTITION BY session_date ORDER BY slot))
SELECT strftime(session_date, '%Y-%m-%d') AS session_date, slot, round(trail, 6) + 0.0 AS trail, round(CASE WHEN count(r) OVER f = 3 THEN sqrt(avg(r * r) OVER f) END, 6) AS realized FROM r WINDOW f AS (PARTITION BY session_date ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def win16(spark, sf):
    m = dense(spark, sf).groupBy("session_date", "slot").agg(F.avg("close").alias("c"))
    by = ["session_date"]
    m = m.withColumns({"r": win.simple_return("c", 2, by, "slot"), "trail": win.simple_return("c", 4, by, "slot")})
    realized = F.sqrt(win.rolling_mean(F.col("r") * F.col("r"), 3, by, "slot"))
    return published(m.select("session_date", "slot", "trail", realized.alias("realized")))


@query("win17_reversal_momentum", PANELS + f"""SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, {', '.join(f"round(close / lag(close, {w}) OVER a - 1, 6) + 0.0 AS mom{w}, round(-(close / lag(close, {w}) OVER a - 1), 6) + 0.0 AS rev{w}" for w in (1, 2, 4, 8))} FROM weekly WINDOW a AS {Y}""")
def win17(spark, sf):
    cols = {}
    for w in (1, 2, 4, 8):
        m = win.simple_return("close", w + 1, BY, ORD)
        cols |= {f"mom{w}": m, f"rev{w}": -m}
    return published(weekly(spark, sf).select("asset", "wk", *[c.alias(n) for n, c in cols.items()]))


@query("win18_range_mean", wk_sql("CASE WHEN count(*) OVER (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN avg((high - low) / close) OVER (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END", "v"))
def win18(spark, sf):
    return wk_out(spark, sf, win.range_mean(4, BY, ORD), "v")


@query("win19_return_volatility", PANELS + """, z AS (SELECT asset, yr, wk, ln(close / lag(close) OVER (PARTITION BY asset, yr ORDER BY wk)) AS r FROM weekly)
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN count(r) OVER f = 5 THEN stddev_pop(r) OVER f END, 6) AS v FROM z WINDOW f AS (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def win19(spark, sf):
    w = weekly(spark, sf).withColumn("r", win.log_return("close", 2, BY, ORD))
    return published(w.select("asset", "wk", win.rolling_std("r", 5, BY, ORD).alias("v")))


@query("win20_volume_surprise", PANELS + """SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN count(*) OVER f = 4 THEN volume / avg(volume) OVER f - 1 END, 6) + 0.0 AS v, CASE WHEN count(*) OVER f < 4 THEN 'INSUFFICIENT_HISTORY' END AS reason
FROM weekly WINDOW f AS (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def win20(spark, sf):
    v, why = win.volume_surprise("volume", 5, BY, ORD)
    return wk_out(spark, sf, v, "v", reason=why)


@query("win21_close_location", wk_sql("CASE WHEN high - low <= 1e-15 THEN 0 ELSE (close - low) / (high - low) - 0.5 END", "v"))
def win21(spark, sf):
    return wk_out(spark, sf, win.close_location(), "v")


@query("win22_skip_momentum", RETS + f""", z AS (SELECT asset, wk, lag(close, 2) OVER a / lag(close, 10) OVER a - 1 AS mom FROM weekly WINDOW a AS {A})
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(mom, 6) + 0.0 AS mom, round(CASE WHEN count(r) OVER f = 5 THEN -(product(1 + r) OVER f - 1) END, 6) + 0.0 AS reversal,
  round(CASE WHEN count(r) OVER f = 5 THEN stddev_samp(r) OVER f * sqrt(52) END, 6) AS ann_vol FROM z JOIN rets USING (asset, wk) WINDOW f AS (PARTITION BY asset ORDER BY wk ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def win22(spark, sf):
    by = ["asset"]
    w = weekly(spark, sf).withColumn("r", F.log(F.col("close") / win.lagged("close", 1, by, ORD)) / 20)
    mom = win.lagged("close", 2, by, ORD) / win.lagged("close", 10, by, ORD) - 1
    rev = -(win.gated(F.product(F.col("r") + 1), "r", 5, by, ORD) - 1)
    vol = win.gated(F.stddev_samp("r"), "r", 5, by, ORD) * 52**0.5
    return published(w.select("asset", "wk", mom.alias("mom"), rev.alias("reversal"), vol.alias("ann_vol")))


@query("win23_session_relative", GRID + """, z AS (SELECT asset, session_date, slot, CASE WHEN bool_and(is_complete) OVER s THEN close / first(open) OVER s - 1 END AS m FROM dense WINDOW s AS (PARTITION BY asset, session_date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT asset, strftime(session_date, '%Y-%m-%d') AS session_date, slot, round(m - avg(m) OVER (PARTITION BY session_date, slot), 6) + 0.0 AS v FROM z""")
def win23(spark, sf):
    w = Window.partitionBy("asset", "session_date").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.min(F.col("is_complete").cast("int")).over(w) == 1
    d = dense(spark, sf).withColumn("m", F.when(whole, F.col("close") / F.first("open").over(w) - 1))
    rel = F.col("m") - F.avg("m").over(Window.partitionBy("session_date", "slot"))
    return published(d.select("asset", "session_date", "slot", rel.alias("v")))


@query("win24_trailing_sessions", PANELS + """, s AS (SELECT asset, CAST(ts AS DATE) AS d, sum(price) AS s, count(price) AS c FROM ticks GROUP BY 1, 2)
SELECT asset, strftime(d, '%Y-%m-%d') AS session_date, round(sum(s) OVER f / sum(c) OVER f, 6) AS v FROM s WINDOW f AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def win24(spark, sf):
    t = ticks(spark, sf).withColumn("session_date", F.to_date("ts"))
    return published(win.trailing_sessions(t, ["asset"], "session_date", 5, "price", "v"))


@query("win25_tick_rolling_mean", PANELS + """SELECT event_id, round(avg(price) OVER f, 6) AS v FROM ticks WINDOW f AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def win25(spark, sf):
    """A row frame over raw ticks, computed per range of rows with carried tail rows."""
    from marketloom.operators.chunks import with_lookback

    def mean(frame, part):
        return frame.withColumn("v", F.avg("price").over(win.frame(10, part, "ts")))

    t = ticks(spark, sf).select("asset", "ts", "event_id", "price")
    return published(with_lookback(t, ["asset"], ["ts"], 9, mean).select("event_id", "v"))


# --- cross-sections -------------------------------------------------------------------

FX = PANELS + f""",
fx AS (SELECT asset, wk, yr, volume, close, close / lag(close) OVER a - 1 AS f, lead(close) OVER a / close - 1 AS y FROM weekly WINDOW a AS {A}),
fr AS (SELECT *, count(f) OVER (PARTITION BY wk) AS nf, CASE WHEN f IS NOT NULL THEN (rank() OVER (PARTITION BY wk ORDER BY f) + count(f) OVER (PARTITION BY wk ORDER BY f)) / 2.0 END AS rk FROM fx)
"""


def factor_panel(spark, sf):
    by = ["asset"]
    w = Window.partitionBy("asset").orderBy("wk")
    return weekly(spark, sf).select(
        "asset", "wk", "yr", "volume", "close", (F.col("close") / win.lagged("close", 1, by, ORD) - 1).alias("f"),
        (F.lead("close").over(w) / F.col("close") - 1).alias("y"))


def fx_sql(expr: str, name: str, source: str = "fr") -> str:
    return FX + f"SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round({expr}, 6) + 0.0 AS {name} FROM {source}"


def fx_out(spark, sf, col, name="v"):
    return published(factor_panel(spark, sf).select("asset", "wk", col.alias(name)))


T = ["wk"]


@query("xs01_average_rank", fx_sql("rk", "v"))
def xs01(spark, sf):
    return fx_out(spark, sf, average_rank("f", T))


@query("xs01b_average_rank_ties", PANELS + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, (rank() OVER (PARTITION BY wk ORDER BY days) + count(*) OVER (PARTITION BY wk ORDER BY days)) / 2.0 AS v FROM weekly")
def xs01b(spark, sf):
    return published(weekly(spark, sf).select("asset", "wk", average_rank("days", T).alias("v")))


@query("xs02_percentile_rank", fx_sql("CASE WHEN nf >= 10 THEN (rk - 1) / (nf - 1) END", "v"))
def xs02(spark, sf):
    return fx_out(spark, sf, xs.percentile_rank("f", T, 10))


@query("xs03_zscore_population", fx_sql("CASE WHEN count(f) OVER (PARTITION BY wk) >= 2 THEN (f - avg(f) OVER (PARTITION BY wk)) / nullif(stddev_pop(f) OVER (PARTITION BY wk), 0) END", "v"))
def xs03(spark, sf):
    return fx_out(spark, sf, xs.zscore_population("f", T))


@query("xs04_zscore_sample", fx_sql("CASE WHEN count(f) OVER (PARTITION BY wk) >= 2 THEN (f - avg(f) OVER (PARTITION BY wk)) / stddev_samp(f) OVER (PARTITION BY wk) END", "v"))
def xs04(spark, sf):
    return fx_out(spark, sf, xs.zscore_sample("f", T))


@query("xs05_winsorize", fx_sql("least(quantile_cont(f, 0.9) OVER (PARTITION BY wk), greatest(quantile_cont(f, 0.1) OVER (PARTITION BY wk), f))", "v", "fx WHERE f IS NOT NULL"))
def xs05(spark, sf):
    return published(factor_panel(spark, sf).where("f IS NOT NULL").select("asset", "wk", xs.winsorized("f", T, 0.1, 0.9).alias("v")))


@query("xs06_regime_gate", STATE + f""", fx AS (SELECT asset, wk, close / lag(close) OVER {A} - 1 AS f FROM weekly)
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(CASE WHEN state IN ('UP_LOW', 'DOWN_LOW') THEN f END, 6) + 0.0 AS gated, CASE WHEN state IS NULL THEN 'REGIME_UNAVAILABLE' WHEN state NOT IN ('UP_LOW', 'DOWN_LOW') THEN 'REGIME_EXCLUDED' END AS reason FROM fx LEFT JOIN state USING (wk)""")
def xs06(spark, sf):
    reg = market_state(spark, sf).select("wk", F.col("state").alias("regime"), F.date_sub("wk", 1).alias("known_at"))
    p = factor_panel(spark, sf).select("asset", "wk", "f")
    return published(xs.regime_gate(p, reg, ["UP_LOW", "DOWN_LOW"], "f", "wk").drop("f"))


@query("xs07_neutralize", fx_sql("CASE WHEN count(f) OVER t > 2 THEN f - avg(f) OVER t - covar_pop(f, v) OVER t / var_pop(v) OVER t * (v - avg(v) OVER t) END", "v0", "(SELECT *, ln(volume) AS v FROM fx WHERE f IS NOT NULL) AS g WINDOW t AS (PARTITION BY wk)"))
def xs07(spark, sf):
    p = factor_panel(spark, sf).where("f IS NOT NULL").withColumn("lv", F.log("volume"))
    return published(p.select("asset", "wk", xs.neutralized("f", "lv", T).alias("v0")))


@query("xs07b_neutralize_many", FX + """, g AS (SELECT asset, wk, f, ln(volume) AS v, ln(close) AS p FROM fx WHERE f IS NOT NULL),
m AS (SELECT wk, covar_pop(f, v) AS fv, covar_pop(f, p) AS fp, covar_pop(v, p) AS vp, var_pop(v) AS vv, var_pop(p) AS pp, avg(f) AS mf, avg(v) AS mv, avg(p) AS mp, count(*) AS n FROM g GROUP BY wk)
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(f - mf - (fv * pp - fp * vp) / (vv * pp - vp * vp) * (v - mv) - (fp * vv - fv * vp) / (vv * pp - vp * vp) * (p - mp), 6) + 0.0 AS resid FROM g JOIN m USING (wk) WHERE n > 3""")
def xs07b(spark, sf):
    p = factor_panel(spark, sf).where("f IS NOT NULL").select("asset", "wk", "f", F.log("volume").alias("v"), F.log("close").alias("p"))
    return published(xs.neutralized_many(p, "f", ["v", "p"], T, "resid").where("resid IS NOT NULL").select("asset", "wk", "resid"))


@query("xs08_volatility_scale", PANELS + """, z AS (SELECT asset, wk, close / open - 1 AS x, stddev_samp(close) OVER (PARTITION BY asset ORDER BY wk ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / close AS v FROM weekly)
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(x / greatest(v, 0.3), 6) + 0.0 AS v FROM z WHERE v IS NOT NULL""")
def xs08(spark, sf):
    w = weekly(spark, sf).withColumn("s", F.stddev_samp("close").over(win.frame(10, ["asset"], "wk")) / F.col("close")).where("s IS NOT NULL")
    return published(w.select("asset", "wk", xs.volatility_scaled(F.col("close") / F.col("open") - 1, "s", 0.3).alias("v")))


RW = FX + ", c AS (SELECT *, rk - avg(rk) OVER (PARTITION BY wk) AS ctr FROM fr), rw AS (SELECT *, ctr / nullif(sum(abs(ctr)) OVER (PARTITION BY wk), 0) AS w0 FROM c), wt AS (SELECT asset, wk, yr, f, y, CASE WHEN ctr IS NOT NULL THEN coalesce(w0, 0) END AS w FROM rw)\n"


@query("xs09_rank_weights", RW + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(w, 6) + 0.0 AS weight FROM wt")
def xs09(spark, sf):
    return published(xs.rank_weights(factor_panel(spark, sf), "f", T).select("asset", "wk", "weight"))


@query("xs10_rank_signal", fx_sql("CASE WHEN nf >= 2 THEN 2 * (rk - 1) / (nf - 1) - 1 END", "v"))
def xs10(spark, sf):
    return fx_out(spark, sf, xs.rank_signal("f", T))


B5 = FX + ", bk AS (SELECT *, least(4, (row_number() OVER (PARTITION BY wk ORDER BY f, asset) - 1) * 5 // count(*) OVER (PARTITION BY wk)) AS bf, ntile(5) OVER (PARTITION BY wk ORDER BY f, asset) - 1 AS bn FROM fx WHERE f IS NOT NULL)\n"


@query("xs11_bucket_floor", B5 + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, CAST(bf AS BIGINT) AS bucket FROM bk")
def xs11(spark, sf):
    p = factor_panel(spark, sf).where("f IS NOT NULL")
    return published(p.select("asset", "wk", xs.bucket_floor("f", "asset", T, 5).alias("bucket")))


@query("xs12_bucket_even", B5 + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, CAST(bn AS BIGINT) AS bucket FROM bk")
def xs12(spark, sf):
    p = factor_panel(spark, sf).where("f IS NOT NULL")
    return published(p.select("asset", "wk", xs.bucket_even("f", "asset", T, 5).alias("bucket")))


@query("xs13_spread_monotonicity", B5 + """, m AS (SELECT wk, bn, avg(y) AS m FROM bk WHERE y IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY wk ORDER BY m) AS rm FROM m)
SELECT strftime(wk, '%Y-%m-%d') AS wk, round(sum(m) FILTER (bn = 4) - sum(m) FILTER (bn = 0), 6) + 0.0 AS spread, round(corr(bn, rm), 6) + 0.0 AS monotonicity FROM r GROUP BY wk HAVING count(*) = 5""")
def xs13(spark, sf):
    p = factor_panel(spark, sf).where("f IS NOT NULL").withColumn("b", xs.bucket_even("f", "asset", T, 5))
    return published(xs.spread_and_monotonicity(p, T, "b", "y", 5, ranked=True))


TURN = RW + """, tw AS (SELECT asset, wk, w FROM wt WHERE w IS NOT NULL), ti AS (SELECT wk, row_number() OVER (ORDER BY wk) AS i FROM (SELECT DISTINCT wk FROM tw)),
tg AS (SELECT a.asset, ti.wk, ti.i, coalesce(tw.w, 0) AS w FROM (SELECT DISTINCT asset FROM tw) AS a CROSS JOIN ti LEFT JOIN tw ON tw.asset = a.asset AND tw.wk = ti.wk),
tl AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY asset ORDER BY i), 0) AS p FROM tg), turn AS (SELECT wk, 0.5 * sum(abs(w - p)) AS turnover FROM tl GROUP BY wk)
"""


@query("xs14_turnover", TURN + "SELECT strftime(wk, '%Y-%m-%d') AS wk, round(turnover, 6) + 0.0 AS turnover FROM turn")
def xs14(spark, sf):
    w = xs.rank_weights(factor_panel(spark, sf), "f", T).where("weight IS NOT NULL")
    return published(xs.turnover(w, "wk", "asset", "weight"))


@query("xs15_top_positive", FX + """, p AS (SELECT *, row_number() OVER (PARTITION BY wk ORDER BY f DESC NULLS LAST, asset) AS r FROM fr)
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(1.0 / count(*) OVER (PARTITION BY wk), 6) AS weight FROM p WHERE nf >= 15 AND r <= 6 AND f > 0""")
def xs15(spark, sf):
    return published(xs.top_positive(factor_panel(spark, sf), T, "f", "asset", 6, 15).select("asset", "wk", "weight"))


@query("xs16_activity_basket", FX + """, v AS (SELECT asset, wk, f, volume / avg(volume) OVER (PARTITION BY asset ORDER BY wk ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS ratio FROM fx),
s AS (SELECT *, CASE WHEN ratio >= 1.2 THEN avg(f) OVER (PARTITION BY wk) - f END AS score FROM v WHERE f IS NOT NULL AND ratio IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY wk ORDER BY score DESC NULLS LAST, asset) AS r FROM s)
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(1.0 / count(*) OVER (PARTITION BY wk), 6) AS weight FROM p WHERE r <= 5 AND score > 0""")
def xs16(spark, sf):
    p = factor_panel(spark, sf).select("asset", "wk", "f", "volume")
    ref = win.along(["asset"], "wk").rowsBetween(-8, -1)
    p = p.withColumn("ratio", F.col("volume") / F.avg("volume").over(ref)).where("f IS NOT NULL AND ratio IS NOT NULL")
    p = p.withColumn("score", F.when(F.col("ratio") >= 1.2, F.avg("f").over(xs.over(T)) - F.col("f")))
    return published(xs.top_positive(p, T, "score", "asset", 5, 1).select("asset", "wk", "weight"))


TWO = FX + """, lg AS (SELECT asset, wk, 'mom' AS member, f AS value FROM fx WHERE f IS NOT NULL UNION ALL SELECT asset, wk, 'vol', ln(volume) FROM fx WHERE volume > 60),
sup AS (SELECT asset, wk FROM lg GROUP BY 1, 2 HAVING count(*) = 2), cs AS (SELECT lg.* FROM lg SEMI JOIN sup ON lg.asset = sup.asset AND lg.wk = sup.wk)
"""


def two_members(spark, sf):
    """Two members from one reading of the panel."""
    cells = F.array(
        F.struct(F.lit("mom").alias("member"), F.col("f").alias("value")),
        F.struct(F.lit("vol").alias("member"), F.when(F.col("volume") > 60, F.log("volume")).alias("value")))
    return factor_panel(spark, sf).select("asset", "wk", F.inline(cells)).where("value IS NOT NULL")


def member_weights(spark):
    return spark.sql("SELECT * FROM VALUES ('mom', 0.7D, 1), ('vol', 0.3D, -1) AS t(member, weight, direction)")


@query("join12_common_support", TWO + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, member, round(value, 6) + 0.0 AS value FROM cs")
def join12(spark, sf):
    from marketloom.operators.joins import common_support

    return published(common_support(two_members(spark, sf), ["wk", "asset"], "member", 2))


@query("xs17_combine_signals", TWO + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(sum(CASE member WHEN 'mom' THEN 0.7 ELSE 0.3 END * value), 6) + 0.0 AS combined, count(*) AS members FROM cs GROUP BY 1, 2")
def xs17(spark, sf):
    from marketloom.operators.joins import common_support

    d = common_support(two_members(spark, sf), ["wk", "asset"], "member", 2)
    return published(xs.combine_signals(d, member_weights(spark), ["wk", "asset"], "member", "value"))


@query("xs18_rank_with_seeds", """WITH c AS (SELECT c_nationkey::BIGINT AS nation, c_custkey, c_acctbal, c_mktsegment = 'BUILDING' AND c_acctbal < 0 AS seed FROM customer),
s AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY seed DESC, c_acctbal DESC, c_custkey) AS r FROM c)
SELECT nation, c_custkey, CAST(row_number() OVER (PARTITION BY nation ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM s WHERE r <= 12""")
def xs18(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal", ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)).alias("seed"))
    out = xs.rank_with_seeds(c, [F.desc("c_acctbal"), F.asc("c_custkey")], F.col("seed"), 12, ["nation"])
    return published(out.select("nation", "c_custkey", "place"))


@query("xs19_top_market_cap", """WITH l AS (SELECT l_suppkey, max((l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS m, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS cap FROM lineitem WHERE l_shipdate <= '1999-06-30' GROUP BY 1)
SELECT l_suppkey, cap FROM l WHERE cap > 5000 ORDER BY cap DESC, l_suppkey LIMIT 30""")
def xs19(spark, sf):
    from marketloom.operators.ordering import latest

    li = table(spark, sf, "lineitem").where("l_shipdate <= '1999-06-30'").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("cap"))
    last = latest(li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "cap"])
    return last.where("cap > 5000").orderBy(F.desc("cap"), "l_suppkey").limit(30).select("l_suppkey", "cap")


@query("xs20_spread_universe", """WITH q AS (SELECT event_type AS asset, user_id, max((ts, event_id)) AS k, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS spread, arg_max(value, (ts, event_id)) AS price, max(ts) AS seen FROM events GROUP BY 1, 2)
SELECT asset, user_id, concat_ws(',', CASE WHEN spread > 60 THEN 'SPREAD_WIDE' END, CASE WHEN seen < '2024-01-20' THEN 'STALE' END, CASE WHEN price > 200 THEN 'PRICE_OUT' END) AS blockers, NOT (spread > 60 OR seen < '2024-01-20' OR price > 200) AS passed FROM q""")
def xs20(spark, sf):
    """Latest quote per candidate, then spread, age and price gates."""
    from marketloom.operators.ordering import latest
    from marketloom.operators.quality import certify

    t = ticks(spark, sf).select("asset", "user_id", "ts", "event_id", F.col("size").alias("spread"), "price")
    q = latest(t, ["asset", "user_id"], ["ts", "event_id"])
    rules = [(F.col("spread") > 60, "SPREAD_WIDE"), (F.col("ts") < "2024-01-20", "STALE"), (F.col("price") > 200, "PRICE_OUT")]
    return published(certify(q, rules).select("asset", "user_id", "blockers", "passed"))


@query("xs21_ensemble", TWO + """, b AS (SELECT *, least(quantile_cont(value, 0.95) OVER t, greatest(quantile_cont(value, 0.05) OVER t, value)) AS wv FROM cs WINDOW t AS (PARTITION BY wk, member)),
z AS (SELECT *, CASE WHEN count(*) OVER t >= 2 THEN CASE WHEN stddev_samp(wv) OVER t > 1e-15 THEN (wv - avg(wv) OVER t) / stddev_samp(wv) OVER t ELSE 0 END END AS z FROM b WINDOW t AS (PARTITION BY wk, member))
SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(sum(CASE member WHEN 'mom' THEN 0.7 ELSE -0.3 END * z), 6) + 0.0 AS score FROM z GROUP BY 1, 2""")
def xs21(spark, sf):
    return published(xs.ensemble(two_members(spark, sf), member_weights(spark), T, "asset", 0.05, 0.95, 2))

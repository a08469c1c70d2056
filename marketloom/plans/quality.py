"""Queries over the row-quality operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import quality as q
from marketloom.operators import sets
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS, pub
from marketloom.sources.panels import hourly, table, ticks, vendor_rows, weekly

OK = (
    "asset IS NOT NULL AND ts IS NOT NULL AND trim(asset) <> '' AND open > 0 AND high > 0 AND low > 0 "
    "AND close > 0 AND high >= greatest(open, low, close) AND low <= least(open, high, close) AND volume >= 0"
)


@query("dq01_valid_bars", pub(PANELS + f"SELECT * FROM vendor WHERE {OK}", stamps="ts"))
def dq01(spark, sf):
    return published(q.valid_bars(vendor_rows(spark, sf)), None)


LI = "l_orderkey, l_linenumber, l_quantity, l_returnflag"


@query("dq02_collapse_exact", f"SELECT DISTINCT {LI} FROM lineitem")
def dq02(spark, sf):
    return q.collapse_exact(table(spark, sf, "lineitem"), LI.split(", "))


CLEAN = PANELS + """,
kept AS (
  SELECT asset, ts, min(open) AS open, min(high) AS high, min(low) AS low, min(close) AS close,
         min(volume) AS volume
  FROM vendor GROUP BY asset, ts HAVING count(DISTINCT (open, high, low, close, volume)) = 1)
"""


@query("dq03_quarantine_conflicts", pub(CLEAN + "SELECT * FROM kept", stamps="ts"))
def dq03(spark, sf):
    return published(q.quarantine_conflicts(vendor_rows(spark, sf), ["asset", "ts"]), None)


@query("dq04_cross_partition_guard", pub(CLEAN + f"SELECT * FROM kept WHERE {OK}", stamps="ts"))
def dq04(spark, sf):
    """Parts by volume share many keys; they are unioned first, so conflicts across parts count as well."""
    v = vendor_rows(spark, sf)
    odd = F.col("volume") % 2 != 0
    return published(q.clean_bars(sets.union_parts([v.where(odd), v.where(~odd)])), None)


@query(
    "dq05_corpus_summary",
    PANELS
    + f""",
k AS (SELECT asset, ts, count(*) AS n,
        min(open) = max(open) AND min(high) = max(high) AND min(low) = max(low)
        AND min(close) = max(close) AND min(volume) = max(volume) AS same
      FROM vendor GROUP BY 1, 2),
d AS (SELECT count(*) FILTER (n > 1) AS duplicate_keys,
        count(*) FILTER (n > 1 AND same) AS exact_duplicate_keys,
        count(*) FILTER (n > 1 AND NOT same) AS conflicting_keys,
        CAST(coalesce(sum(n - 1) FILTER (n > 1 AND same), 0) AS BIGINT) AS exact_extra_rows,
        CAST(coalesce(sum(n - 1) FILTER (n > 1 AND NOT same), 0) AS BIGINT) AS conflicting_extra_rows
      FROM k)
SELECT (SELECT count(*) FROM vendor) AS row_count,
  (SELECT count(DISTINCT asset) FROM vendor) AS asset_count,
  (SELECT CAST(min(epoch(ts)) AS BIGINT) FROM vendor) AS min_epoch,
  (SELECT CAST(max(epoch(ts)) AS BIGINT) FROM vendor) AS max_epoch, d.*,
  (SELECT count(*) FILTER (asset IS NULL OR ts IS NULL OR trim(asset) = '') FROM vendor) AS invalid_identity,
  (SELECT count(*) FILTER (NOT (open > 0 AND high > 0 AND low > 0 AND close > 0
     AND high >= greatest(open, low, close) AND low <= least(open, high, close))) FROM vendor) AS invalid_prices,
  (SELECT count(*) FILTER (volume < 0) FROM vendor) AS invalid_volume
FROM d""",
)
def dq05(spark, sf):
    return published(q.corpus_summary(vendor_rows(spark, sf)))


GROUPS = PANELS + """,
g AS (SELECT asset, ts, count(*) AS group_rows, count(DISTINCT open) AS open_variants,
        count(DISTINCT high) AS high_variants, count(DISTINCT low) AS low_variants,
        count(DISTINCT close) AS close_variants, count(DISTINCT volume) AS volume_variants,
        count(DISTINCT (open, high, low, close, volume)) > 1 AS conflicting
      FROM vendor GROUP BY 1, 2 HAVING count(*) > 1)
"""


@query("dq06_duplicate_groups", pub(GROUPS + "SELECT * FROM g", stamps="ts"))
def dq06(spark, sf):
    return published(q.duplicate_groups(vendor_rows(spark, sf), ["asset", "ts"]))


@query(
    "dq07_worst_conflicts",
    pub(
        GROUPS
        + """, w AS (SELECT asset, ts FROM g WHERE conflicting ORDER BY group_rows DESC, asset, ts LIMIT 20)
        SELECT * FROM vendor SEMI JOIN w USING (asset, ts)""",
        stamps="ts",
    ),
)
def dq07(spark, sf):
    """Rows of the twenty largest conflicting groups (the limit is the report)."""
    v = vendor_rows(spark, sf)
    worst = q.worst_conflicts(q.duplicate_groups(v, ["asset", "ts"]), ["asset", "ts"], 20)
    return published(v.join(F.broadcast(worst.select("asset", "ts")), ["asset", "ts"], "left_semi"), None)


@query(
    "dq08_outside_hours",
    PANELS
    + """, z AS (SELECT asset, strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') AS c FROM ticks)
SELECT asset, count(*) AS observations, count(*) FILTER (c < '09:30' OR c >= '16:00') AS outside_regular,
  count(*) FILTER (c < '04:00' OR c >= '20:00') AS outside_extended FROM z GROUP BY asset""",
)
def dq08(spark, sf):
    return q.outside_hours(ticks(spark, sf), "America/New_York")


@query(
    "dq09_certify_sources",
    """SELECT source, n_docs, mean_chars, short_share, concat_ws(',', CASE WHEN n_docs < 10 THEN 'FEW_ROWS' END,
  CASE WHEN mean_chars > 2500 THEN 'LONG_ROWS' END, CASE WHEN short_share > 0.1 THEN 'SHORT_SHARE' END) AS blockers,
  NOT (n_docs < 10 OR mean_chars > 2500 OR short_share > 0.1) AS passed
FROM (SELECT source, count(*) AS n_docs, round(avg(n_chars), 6) AS mean_chars,
  round(count(*) FILTER (n_chars < 200) / count(*), 6) AS short_share FROM documents GROUP BY source) AS m""",
)
def dq09(spark, sf):
    m = table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.round(F.count_if(F.col("n_chars") < 200) / F.count("*"), 6).alias("short_share"),
    )
    rules = [
        (F.col("n_docs") < 10, "FEW_ROWS"),
        (F.col("mean_chars") > 2500, "LONG_ROWS"),
        (F.col("short_share") > 0.1, "SHORT_SHARE"),
    ]
    return published(q.certify(m, rules))


MASTER = """master AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS asset,
    CASE WHEN s_acctbal < 0 THEN DATE '1970-01-01' ELSE first_day END AS list_date,
    CASE WHEN last_day < DATE '2001-10-20' THEN last_day END AS delist_date
  FROM supplier LEFT JOIN (
    SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
    FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"""


def master(spark, sf):
    """Suppliers as securities: listed at the first shipment, delisted after the last."""
    span = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day")
    )
    s = table(spark, sf, "supplier").join(span, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("asset"),
        F.when(F.col("s_acctbal") < 0, F.lit("1970-01-01").cast("date")).otherwise(F.col("first_day")).alias("list_date"),
        F.when(F.col("last_day") < F.lit("2001-10-20").cast("date"), F.col("last_day")).alias("delist_date"),
    )


@query(
    "dq10_master_profile",
    f"""WITH {MASTER} SELECT count(*) AS row_count, count(DISTINCT asset) AS asset_count,
  count(*) - count(DISTINCT asset) AS duplicate_rows,
  count(*) FILTER (list_date = DATE '1970-01-01') AS placeholder_list_dates,
  count(*) FILTER (list_date IS NULL) AS null_list_dates, count(delist_date) AS delisted FROM master""",
)
def dq10(spark, sf):
    return q.master_profile(master(spark, sf))


@query(
    "dq11_daily_profile",
    PANELS
    + """, f AS (SELECT *, open > 0 AND high > 0 AND low > 0 AND close > 0 AS p FROM vendor)
SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT asset, ts FROM f)) AS key_count,
  (SELECT count(*) FROM (SELECT asset FROM f GROUP BY asset, ts HAVING count(*) > 1)) AS duplicate_keys,
  count(*) FILTER (NOT p) AS nonpositive_prices,
  count(*) FILTER (p AND (high < greatest(open, low, close) OR low > least(open, high, close))) AS disordered_ohlc,
  count(*) FILTER (volume < 0) AS negative_flow FROM f""",
)
def dq11(spark, sf):
    return q.daily_profile(vendor_rows(spark, sf), ["asset", "ts"])


HOURS = [f"{h:02d}:00" for h in range(9, 17)]


@query(
    "dq12_clock_sequence",
    PANELS
    + """, w AS (SELECT ['09:00','10:00','11:00','12:00','13:00','14:00','15:00','16:00'] AS want),
g AS (SELECT asset, CAST(ts AS DATE) AS session_date, list_sort(list(DISTINCT strftime(ts, '%H:00'))) AS seen
      FROM ticks WHERE hour(ts) >= 9 AND hour(ts) < 20 GROUP BY 1, 2)
SELECT asset, strftime(session_date, '%Y-%m-%d') AS session_date, seen = want AS matches,
  array_to_string(list_filter(want, lambda x: NOT list_contains(seen, x)), ',') AS missing,
  array_to_string(list_filter(seen, lambda x: NOT list_contains(want, x)), ',') AS extra FROM g, w""",
)
def dq12(spark, sf):
    t = ticks(spark, sf).where((F.hour("ts") >= 9) & (F.hour("ts") < 20))
    t = t.withColumn("session_date", F.to_date("ts"))
    out = q.clock_sequence(t, ["asset", "session_date"], F.date_format(F.date_trunc("hour", "ts"), "HH:mm"), HOURS)
    return published(out)


@query(
    "dq13_daily_vs_intraday",
    PANELS
    + """, dly AS (SELECT asset, CAST(ts AS DATE) AS session_date, arg_min(price, ts) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, ts) AS close, CAST(sum(size) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2),
i AS (SELECT asset, CAST(ts AS DATE) AS session_date, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l,
    arg_max(price, ts) AS c, CAST(sum(size) AS DOUBLE) AS v
    FROM ticks WHERE hour(ts) >= 9 AND hour(ts) < 17 GROUP BY 1, 2)
SELECT asset, strftime(session_date, '%Y-%m-%d') AS session_date, o IS NOT NULL AS covered,
  coalesce(abs(open - o) <= 5, false) AS open_ok, coalesce(abs(high - h) <= 20, false) AS high_ok,
  coalesce(abs(low - l) <= 0.5, false) AS low_ok, coalesce(abs(close - c) <= 5, false) AS close_ok,
  coalesce(abs(volume - v) <= 1000, false) AS volume_ok FROM dly LEFT JOIN i USING (asset, session_date)""",
)
def dq13(spark, sf):
    t = ticks(spark, sf).withColumn("session_date", F.to_date("ts"))
    day = t.groupBy("asset", "session_date").agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.sum("size").cast("double").alias("volume"),
    )
    regular = t.where((F.hour("ts") >= 9) & (F.hour("ts") < 17))
    tol = {"open": 5.0, "high": 20.0, "low": 0.5, "close": 5.0, "volume": 1000.0}
    return published(q.reconcile_daily(regular, day, tol, ["asset", "session_date"]))


# Weekly bars of thin brands stand in for rows that a vendor fills on a suspended day.
HALTED = PANELS + """,
halted AS (
  SELECT asset, wk, yr, CASE WHEN stop THEN 0.0 ELSE open END AS open, CASE WHEN stop THEN 0.0 ELSE high END AS high,
    CASE WHEN stop THEN 0.0 ELSE low END AS low, CASE WHEN stop THEN pre_close ELSE close END AS close,
    CASE WHEN stop THEN 0.0 ELSE volume END AS volume, CASE WHEN stop THEN 0.0 ELSE volume * close END AS amount, pre_close
  FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY wk) AS pre_close,
          days < 3 AND lag(close) OVER (PARTITION BY asset ORDER BY wk) IS NOT NULL AS stop FROM weekly) AS z),
flagged AS (
  SELECT *, coalesce(open = 0 AND high = 0 AND low = 0 AND volume = 0 AND amount = 0 AND close > 0
    AND pre_close > 0 AND abs(close - pre_close) <= 1e-9, false) AS no_trade FROM halted)
"""


def halted_panel(spark, sf):
    w = Window.partitionBy("asset").orderBy("wk")
    z = weekly(spark, sf).withColumn("pre_close", F.lag("close").over(w))
    z = z.withColumn("_stop", (F.col("days") < 3) & F.col("pre_close").isNotNull())
    zero = F.lit(0.0)

    def unless(c):
        return F.when(F.col("_stop"), zero).otherwise(F.col(c) if isinstance(c, str) else c)

    return z.select(
        "asset", "wk", "yr", unless("open").alias("open"), unless("high").alias("high"), unless("low").alias("low"),
        F.when(F.col("_stop"), F.col("pre_close")).otherwise(F.col("close")).alias("close"),
        unless("volume").alias("volume"), unless(F.col("volume") * F.col("close")).alias("amount"), "pre_close",
    )


@query(
    "dq14_no_trade_placeholders",
    HALTED + "SELECT asset, count(*) AS rows, count(*) FILTER (no_trade) AS placeholders FROM flagged GROUP BY asset",
)
def dq14(spark, sf):
    return halted_panel(spark, sf).groupBy("asset").agg(
        F.count("*").alias("rows"), F.count_if(q.is_no_trade_placeholder()).alias("placeholders")
    )


@query(
    "dq15_ingest_issues",
    """WITH d AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS asset, o_orderdate AS ts,
  o_orderdate + to_days(CAST(o_totalprice AS BIGINT) % 400) AS available_at FROM orders),
k AS (SELECT asset, ts, count(*) AS n, max(available_at) AS av FROM d GROUP BY 1, 2),
a AS (SELECT count(DISTINCT ts) AS all_ts FROM d)
SELECT asset, 'DUPLICATE' AS code, count(*) AS issues FROM k WHERE n > 1 GROUP BY 1
UNION ALL SELECT asset, 'CLOCK', count(*) FROM (
  SELECT asset, av, lag(av) OVER (PARTITION BY asset ORDER BY ts) AS p FROM k) AS c WHERE av <= p GROUP BY 1
UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'MISSING_ASSET', 1 FROM customer
  WHERE 'C' || CAST(c_custkey AS VARCHAR) NOT IN (SELECT asset FROM k)
UNION ALL SELECT asset, 'CALENDAR_GAP', any_value(all_ts) - count(*) FROM k, a GROUP BY 1
  HAVING count(*) < any_value(all_ts)""",
)
def dq15(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("asset"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.date_add(F.to_date("o_orderdate"), (F.rint("o_totalprice").cast("bigint") % 400).cast("int")).alias("available_at"),
    )
    known = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("asset"))
    return q.ingest_issues(d, known)


@query(
    "dq16_provider_diff",
    """WITH l AS (SELECT l_suppkey, l_shipdate, avg(l_extendedprice / l_quantity) AS a FROM lineitem
  WHERE l_linestatus = 'O' GROUP BY 1, 2),
r AS (SELECT l_suppkey, l_shipdate, avg(l_extendedprice / l_quantity) AS b FROM lineitem
  WHERE l_returnflag = 'N' GROUP BY 1, 2),
j AS (SELECT a, b FROM l FULL JOIN r USING (l_suppkey, l_shipdate))
SELECT count(a) AS left_rows, count(b) AS right_rows, count(*) FILTER (b IS NULL) AS left_only,
  count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common,
  round(max(abs(a - b)), 6) AS max_abs_diff, round(max(abs(a - b) / greatest(abs(a), abs(b))), 6) AS max_rel_diff FROM j""",
)
def dq16(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    keys = ["l_suppkey", "l_shipdate"]
    left = li.where("l_linestatus = 'O'").groupBy(*keys).agg(F.avg("px").alias("px"))
    right = li.where("l_returnflag = 'N'").groupBy(*keys).agg(F.avg("px").alias("px"))
    return published(q.provider_diff(left, right, keys, "px"))


@query(
    "dq17_clock_offset_search",
    PANELS
    + """, l AS (SELECT asset, epoch(date_trunc('hour', ts))::BIGINT AS e, arg_max(price, ts) AS cl FROM ticks GROUP BY 1, 2),
r AS (SELECT asset, epoch(date_trunc('hour', ts))::BIGINT + 7200 AS e0, arg_max(price, ts) AS cr FROM ticks
  WHERE size > 30 GROUP BY 1, 2),
h AS (SELECT l.asset, k AS offset_steps, count(*) AS overlap, median(abs(cl / cr - 1)) AS median_gap, max(abs(cl / cr - 1)) AS max_gap
  FROM l JOIN (SELECT *, unnest([-3, -2, -1, 0, 1, 2, 3]) AS k FROM r) AS x
    ON l.asset = x.asset AND l.e = x.e0 + k * 3600 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY overlap DESC, abs(offset_steps), offset_steps) AS rn FROM h)
SELECT b.asset, CAST(offset_steps AS BIGINT) AS offset_steps, overlap, round(overlap / least(nl, nr), 6) AS overlap_ratio,
  round(median_gap, 6) AS median_gap, round(max_gap, 6) AS max_gap
FROM b JOIN (SELECT asset, count(*) AS nl FROM l GROUP BY 1) AS x USING (asset)
  JOIN (SELECT asset, count(*) AS nr FROM r GROUP BY 1) AS y USING (asset) WHERE rn = 1""",
)
def dq17(spark, sf):
    t = ticks(spark, sf)

    def closes(d, shift):
        hour = F.date_trunc("hour", "ts")
        g = d.groupBy("asset", hour.alias("h")).agg(F.max_by("price", "ts").alias("close"))
        return g.select("asset", (F.col("h") + F.expr(f"INTERVAL {shift} HOURS")).alias("ts"), "close")

    return published(q.clock_offsets(closes(t, 0), closes(t.where("size > 30"), 2), range(-3, 4), 3600))


@query(
    "dq18_broker_offset",
    PANELS
    + """, o AS (SELECT asset, CAST(7200.0 + size - 50 AS DOUBLE) AS x FROM ticks),
m AS (SELECT asset, count(*) AS observations, median(x) AS median_offset, min(x) AS lo, max(x) AS hi FROM o GROUP BY 1),
s AS (SELECT *, round(median_offset / 900) * 900 AS clock_offset FROM m),
z AS (SELECT *, greatest(abs(hi - clock_offset), abs(lo - clock_offset)) AS max_residual FROM s)
SELECT asset, observations, median_offset, clock_offset, max_residual,
  CASE WHEN max_residual > 49.5 THEN 'CLOCK_RESIDUAL' ELSE '' END AS blockers, max_residual <= 49.5 AS passed FROM z""",
)
def dq18(spark, sf):
    o = ticks(spark, sf).select("asset", (F.lit(7200.0) + F.col("size") - 50).alias("x"))
    return published(q.broker_offset(o, "asset", "x", 900.0, 49.5))


@query(
    "dq19_quote_quality",
    PANELS
    + """, z AS (SELECT event_id, price - size * 0.002 AS bid, price + (size - 5) * 0.002 AS ask, user_id - 20 AS age FROM ticks),
s AS (SELECT *, CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) * 10000 END AS spread_bps FROM z),
c AS (SELECT *, concat_ws(',', CASE WHEN bid <= 0 THEN 'NONPOSITIVE_BID' END, CASE WHEN ask < bid THEN 'CROSSED' END,
  CASE WHEN spread_bps > 200 THEN 'SPREAD_WIDE' END, CASE WHEN age > 60 THEN 'STALE' END,
  CASE WHEN age < 0 THEN 'FUTURE' END) AS codes FROM s)
SELECT event_id, round(spread_bps, 6) + 0.0 AS spread_bps, CAST(age AS DOUBLE) AS age, codes,
  CASE WHEN codes = '' THEN 'USABLE' WHEN codes = 'STALE' AND abs(age - 90) <= 60 THEN 'DELAYED_REFERENCE' ELSE 'REJECTED' END AS status
FROM c""",
)
def dq19(spark, sf):
    t = ticks(spark, sf).select(
        "event_id",
        (F.col("price") - F.col("size") * 0.002).alias("bid"),
        (F.col("price") + (F.col("size") - 5) * 0.002).alias("ask"),
        F.col("ts").alias("sampled_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("user_id") - 20)).alias("retrieved_at"),
    )
    out = q.quote_quality(t, 200.0, 60.0, 90.0)
    return published(out.select("event_id", "spread_bps", "age", "codes", "status"))


@query(
    "dq20_coverage_inventory",
    pub(
        PANELS
        + """, cal AS (SELECT DISTINCT d FROM daily),
s AS (SELECT asset, date_trunc('month', d) AS month, count(*) AS seen, count(*) FILTER (n >= 2) AS complete FROM daily GROUP BY 1, 2),
g AS (SELECT asset, month FROM (SELECT DISTINCT asset FROM daily),
  (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS month)),
e AS (SELECT date_trunc('month', d) AS month, count(*) AS x FROM cal GROUP BY 1)
SELECT g.asset, g.month, coalesce(seen, 0) AS seen_sessions, coalesce(complete, 0) AS complete_sessions,
  coalesce(x, 0) AS expected_sessions
FROM g LEFT JOIN s ON g.asset = s.asset AND g.month = s.month LEFT JOIN e ON g.month = e.month""",
        dates="month",
    ),
)
def dq20(spark, sf):
    from marketloom.sources.panels import daily

    d = daily(spark, sf)
    cal = d.select(F.col("d").alias("session_date")).distinct().withColumn("expected", F.lit(2))
    obs = d.select("asset", F.col("d").alias("session_date"), F.col("n").alias("observed"))
    return published(q.coverage_inventory(obs, cal, "1995-01-01", "2001-12-01"))


@query(
    "dq21_common_dates",
    PANELS + """SELECT strftime(wk, '%Y-%m-%d') AS wk FROM weekly GROUP BY wk
    HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM weekly)""",
)
def dq21(spark, sf):
    w = weekly(spark, sf)
    members = w.agg(F.count_distinct("asset")).first()[0]
    return published(q.common_dates(w, "wk", "asset", members))


@query(
    "dq22_panel_summary",
    PANELS
    + """, p AS (SELECT wk, count(*) AS n, count(*) FILTER (is_complete) AS ready,
  count(*) FILTER (is_complete AND nx IS NOT NULL) AS joint
  FROM (SELECT *, lead(wk) OVER (PARTITION BY asset ORDER BY wk) AS nx FROM weekly) AS z GROUP BY wk)
SELECT count(*) AS formations, CAST(sum(n) AS BIGINT) AS rows, min(joint) AS min_joint, max(joint) AS max_joint,
  count(*) FILTER (joint >= 20) AS broad_formations, count(*) FILTER (joint < 20 AND ready >= 20) AS label_short FROM p""",
)
def dq22(spark, sf):
    w = weekly(spark, sf)
    w = w.withColumn("nx", F.lead("wk").over(Window.partitionBy("asset").orderBy("wk")))
    return q.panel_summary(w, "wk", F.col("is_complete"), F.col("nx").isNotNull(), 20)


@query(
    "dq23_price_authority",
    """WITH rq AS (SELECT o_orderkey AS request_id, 'C' || CAST(o_custkey % 50 AS VARCHAR) AS asset, o_orderdate AS s,
  o_orderdate + to_days(30) AS e, o_orderpriority < '3' AS cross_session FROM orders),
ev AS (SELECT 'C' || CAST(c_custkey % 50 AS VARCHAR) AS asset, DATE '1995-01-01' + to_days(CAST(c_acctbal AS BIGINT)) AS t
  FROM customer),
cv AS (SELECT asset, min(t) AS f, max(t) AS l FROM ev GROUP BY 1),
j AS (SELECT rq.*, f, l, (SELECT count(*) FROM ev WHERE ev.asset = rq.asset AND ev.t >= rq.s AND ev.t <= rq.e) AS inside
  FROM rq LEFT JOIN cv ON rq.asset = cv.asset),
b AS (SELECT request_id, asset, inside AS events_inside,
  CASE WHEN NOT cross_session THEN '' WHEN f IS NULL THEN 'COVERAGE_UNAVAILABLE'
       WHEN NOT (f <= s AND e <= l) THEN 'INTERVAL_NOT_COVERED' WHEN inside > 0 THEN 'RAW_PRICE_DISCONTINUITY' ELSE '' END AS blockers FROM j)
SELECT *, blockers = '' AS allowed FROM b""",
)
def dq23(spark, sf):
    def code(c):
        return F.concat(F.lit("C"), (F.col(c) % 50).cast("string"))

    o = table(spark, sf, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("request_id"),
        code("o_custkey").alias("asset"),
        F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("end"),
        (F.col("o_orderpriority") < "3").alias("cross_session"),
    )
    c = table(spark, sf, "customer")
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.rint("c_acctbal").cast("int"))
    events = c.select(code("c_custkey").alias("asset"), day.alias("effective_at"))
    cover = events.groupBy("asset").agg(
        F.min("effective_at").alias("covered_from"), F.max("effective_at").alias("covered_to")
    )
    return published(q.price_authority(requests, events, cover))


@query(
    "dq24_overlay",
    """WITH b AS (SELECT doc_id, CASE WHEN n_chars > 300 THEN lang END AS lang, CASE WHEN n_chars > 900 THEN source END AS source FROM documents),
x AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'en' END AS lang, 'src' || CAST(doc_id % 20 AS VARCHAR) AS source FROM labels JOIN documents USING (doc_id))
SELECT b.doc_id, coalesce(b.lang, x.lang) AS lang, coalesce(b.source, x.source) AS source,
  coalesce(b.lang <> x.lang, false) OR coalesce(b.source <> x.source, false) AS conflict FROM b LEFT JOIN x USING (doc_id)""",
)
def dq24(spark, sf):
    d = table(spark, sf, "documents")
    base = d.select(
        "doc_id",
        F.when(F.col("n_chars") > 300, F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") > 900, F.col("source")).alias("source"),
    )
    extra = table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit("en")).alias("lang"),
        F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"),
    )
    return q.overlay(base, extra, "doc_id", ["lang", "source"])


@query(
    "dq25_research_dataset",
    pub(
        HALTED
        + """, k AS (SELECT asset, wk, close FROM flagged WHERE NOT no_trade),
r AS (SELECT *, row_number() OVER a AS rn FROM k WINDOW a AS (PARTITION BY asset ORDER BY wk)),
b AS (SELECT *, min(rn) FILTER (wk >= '1997-01-01' AND wk < '1999-01-01') OVER a AS lo,
  max(rn) FILTER (wk >= '1997-01-01' AND wk < '1999-01-01') OVER a AS hi FROM r WINDOW a AS (PARTITION BY asset)),
c AS (SELECT *, ln(close / lag(close, 4) OVER a) AS past4, lead(close, 2) OVER a / close - 1 AS next2, lead(wk, 2) OVER a AS target
  FROM b WHERE rn BETWEEN greatest(1, lo - 4) AND hi + 2 WINDOW a AS (PARTITION BY asset ORDER BY wk))
SELECT asset, wk, CASE WHEN wk < '1998-07-01' THEN 'train' ELSE 'test' END AS split, past4,
  CASE WHEN target < CASE WHEN wk < '1998-07-01' THEN DATE '1998-07-01' ELSE DATE '1999-01-01' END THEN next2 END AS next2
FROM c WHERE wk >= '1997-01-01' AND wk < '1999-01-01'""",
        "past4 next2",
        "wk",
    ),
)
def dq25(spark, sf):
    """No-trade rows out, context rows around the window in, labels clipped at the split."""
    from marketloom.operators import windows
    from marketloom.sources.bars import read_with_context

    p = halted_panel(spark, sf).where(~q.is_no_trade_placeholder()).select("asset", "wk", "close")
    p = read_with_context(p, "asset", "wk", "1997-01-01", "1999-01-01", 4, 2)
    p = p.withColumn("past4", windows.log_return("close", 5, ["asset"], "wk"))
    edge = F.when(F.col("wk") < "1998-07-01", F.lit("1998-07-01")).otherwise(F.lit("1999-01-01")).cast("date")
    p = p.withColumn("next2", windows.forward_return("close", 2, ["asset"], "wk", before=edge))
    p = p.where((F.col("wk") >= "1997-01-01") & (F.col("wk") < "1999-01-01"))
    split = F.when(F.col("wk") < "1998-07-01", "train").otherwise("test")
    return published(p.select("asset", "wk", split.alias("split"), "past4", "next2"))


@query(
    "dq03b_null_safe_quarantine",
    """SELECT conv_id, role, min(note) AS note FROM (
  SELECT conv_id, role, CASE WHEN length(text) > 400 THEN 'long' END AS note FROM conversations) AS z
  GROUP BY conv_id, role HAVING count(DISTINCT note) + CASE WHEN count(note) < count(*) THEN 1 ELSE 0 END = 1""",
)
def dq03b(spark, sf):
    """A value beside a NULL is a conflict too."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "role", F.when(F.length("text") > 400, F.lit("long")).alias("note")
    )
    return q.quarantine_conflicts(c, ["conv_id", "role"], ["note"])

"""Queries over scalar functions, order rules, lineage, registries and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.functions.numeric import reasons
from marketloom.operators import lineage as ln
from marketloom.operators import orders as od
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS
from marketloom.sources.panels import table, ticks, weekly

FMT = "'%Y-%m-%d %H:%M:%S'"


@query("fn05_local_clock", f"""SELECT event_id, strftime(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE), '%Y-%m-%d') AS local_date,
  strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') AS local_clock FROM events""")
def fn05(spark, sf):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return table(spark, sf, "events").select("event_id", F.date_format(local, "yyyy-MM-dd").alias("local_date"), F.date_format(local, "HH:mm").alias("local_clock"))


@query("fn06_content_id", """SELECT c_custkey, 'row-' || substr(sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}'), 1, 24) AS id FROM customer""")
def fn06(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", tx.content_id(["c_name", "c_custkey", "c_mktsegment"], "row").alias("id"))


def nested_docs(spark, sf, shift=0):
    d = table(spark, sf, "documents")
    body = F.struct(
        F.struct(F.col("lang").alias("lang"), F.struct((F.col("n_chars") + shift * (F.col("doc_id") % 3)).alias("n"), F.col("source").alias("src")).alias("size")).alias("meta"),
        F.col("doc_id").alias("id"), F.array(F.lit(1), F.lit(2)).alias("list"))
    return d.select("doc_id", F.to_json(body).alias("json"))


@query("fn07_flatten_json", """SELECT doc_id, unnest(['meta.lang', 'meta.size.n', 'meta.size.src', 'id', 'list']) AS field,
  unnest(['"' || lang || '"', CAST(n_chars AS VARCHAR), '"' || source || '"', CAST(doc_id AS VARCHAR), '[1,2]']) AS value FROM documents""")
def fn07(spark, sf):
    return tx.flatten_json(nested_docs(spark, sf), "doc_id", "json")


@query("fn08_document_diff", """SELECT field, count(*) AS n, count(*) FILTER (l IS DISTINCT FROM r) AS changed FROM (
  SELECT unnest(['meta.lang', 'meta.size.n', 'meta.size.src', 'id', 'list']) AS field, unnest([lang, CAST(n_chars AS VARCHAR), source, CAST(doc_id AS VARCHAR), '[1,2]']) AS l,
    unnest([lang, CAST(n_chars + doc_id % 3 AS VARCHAR), source, CAST(doc_id AS VARCHAR), '[1,2]']) AS r FROM documents) AS z GROUP BY 1""")
def fn08(spark, sf):
    a = tx.flatten_json(nested_docs(spark, sf), "doc_id", "json").withColumnRenamed("value", "l")
    b = tx.flatten_json(nested_docs(spark, sf, 1), "doc_id", "json").withColumnRenamed("value", "r")
    j = a.join(b, ["doc_id", "field"], "full_outer").withColumn("changed", ~F.col("l").eqNullSafe(F.col("r")))
    return j.groupBy("field").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("fn09_tokens", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n_tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens FROM documents")
def fn09(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.sort_array(tx.tokens("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("fn10_jaccard", """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM conversations), p AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM p WHERE b IS NOT NULL""")
def fn10(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.tokens("text").alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return published(c.select("conv_id", "turn", tx.jaccard(F.col("a"), F.col("b")).alias("similarity")))


@query("fn11_reason_category", """WITH r AS (SELECT CASE l_shipmode WHEN 0 THEN 'MODEL_ERROR:x' WHEN 1 THEN 'T1_LOCKED' WHEN 2 THEN 'SELL_LOT_ROUNDED' WHEN 3 THEN 'SUSPENDED' WHEN 4 THEN 'LIMIT_UP_HIT' WHEN 5 THEN 'CASH_SCALED' WHEN 6 THEN 'NO_SESSION_DATA' WHEN 7 THEN 'ACCEPTED' ELSE 'OTHER' END AS reason FROM (SELECT l_linenumber AS l_shipmode FROM lineitem))
SELECT reason, CASE reason WHEN 'MODEL_ERROR:x' THEN 'model/cash fallback' WHEN 'T1_LOCKED' THEN 'T+1' WHEN 'SELL_LOT_ROUNDED' THEN 'lot / quantity' WHEN 'SUSPENDED' THEN 'suspension' WHEN 'LIMIT_UP_HIT' THEN 'price limit' WHEN 'CASH_SCALED' THEN 'cash scaling' WHEN 'NO_SESSION_DATA' THEN 'session / data' WHEN 'ACCEPTED' THEN 'normal / no action' ELSE 'other' END AS category, count(*) AS n FROM r GROUP BY 1, 2""")
def fn11(spark, sf):
    names = ["MODEL_ERROR:x", "T1_LOCKED", "SELL_LOT_ROUNDED", "SUSPENDED", "LIMIT_UP_HIT", "CASH_SCALED", "NO_SESSION_DATA", "ACCEPTED"]
    reason = F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), F.col("l_linenumber")), F.lit("OTHER"))
    r = table(spark, sf, "lineitem").select(reason.alias("reason"))
    return r.groupBy("reason", tx.reason_category("reason").alias("category")).agg(F.count("*").alias("n"))


CODE = "lpad(CAST(l_partkey % 1000 * 1000 + l_linenumber AS VARCHAR), 6, '0')"
VENUE = "CASE WHEN l_suppkey % 3 = 0 THEN 'SSE' WHEN l_suppkey % 3 = 1 THEN 'SZSE' ELSE 'BSE' END"
BOARD = f"CASE WHEN {VENUE} = 'SSE' THEN CASE WHEN substr({CODE}, 1, 3) IN ('688', '689') THEN 'SSE_STAR' ELSE 'SSE_MAIN' END WHEN {VENUE} = 'SZSE' THEN CASE WHEN substr({CODE}, 1, 3) IN ('300', '301', '302') THEN 'SZSE_CHINEXT' ELSE 'SZSE_MAIN' END ELSE 'BSE' END"


def boarded(spark, sf):
    li = table(spark, sf, "lineitem")
    code = F.lpad((F.col("l_partkey") % 1000 * 1000 + F.col("l_linenumber")).cast("string"), 6, "0")
    venue = F.when(F.col("l_suppkey") % 3 == 0, "SSE").when(F.col("l_suppkey") % 3 == 1, "SZSE").otherwise("BSE")
    return li.withColumns({"code": code, "venue": venue}).withColumn("board", od.board("code", "venue"))


@query("fn12_board_inference", f"SELECT l_orderkey, l_linenumber, l_quantity, {BOARD} AS board FROM lineitem")
def fn12(spark, sf):
    return boarded(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "board")


@query("fn13_lot_rounding", f"""WITH q AS (SELECT l_orderkey, l_linenumber, {BOARD} AS board, l_quantity * 13.5 AS rq, CAST(floor(l_extendedprice) AS BIGINT) % 900 AS have FROM lineitem),
f AS (SELECT *, CAST(floor(rq + 1e-12) AS BIGINT) AS iq, least(CAST(floor(rq + 1e-12) AS BIGINT), have) AS cap, have % 100 AS odd FROM q)
SELECT l_orderkey, l_linenumber, CAST(CASE board WHEN 'SSE_STAR' THEN CASE WHEN iq >= 200 THEN iq ELSE 0 END WHEN 'BSE' THEN CASE WHEN iq >= 100 THEN iq ELSE 0 END ELSE iq // 100 * 100 END AS BIGINT) AS buy,
  CAST(CASE WHEN have <= 0 OR cap <= 0 THEN 0 WHEN cap >= have THEN have WHEN board = 'SSE_STAR' THEN CASE WHEN cap >= 200 THEN cap ELSE 0 END WHEN board = 'BSE' THEN CASE WHEN cap >= 100 THEN cap ELSE 0 END
    ELSE greatest(cap // 100 * 100, CASE WHEN odd > 0 AND cap >= odd THEN odd + (cap - odd) // 100 * 100 ELSE 0 END) END AS BIGINT) AS sell FROM f""")
def fn13(spark, sf):
    b = boarded(spark, sf).withColumns({"rq": F.col("l_quantity") * 13.5, "have": F.floor("l_extendedprice") % 900})
    return b.select("l_orderkey", "l_linenumber", od.buy_lots("board", "rq").alias("buy"), od.sell_lots("board", "rq", "have").alias("sell"))


@query("fn14_fee_schedule", f"""WITH q AS (SELECT l_orderkey, l_linenumber, {BOARD} AS board, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN l_discount > 0.09 THEN 0 ELSE l_extendedprice END AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 0 THEN greatest(5, n * 0.0003) ELSE 0 END, 8) AS commission, round(CASE WHEN side = 'SELL' THEN n * 0.0005 ELSE 0 END, 8) AS stamp_duty, round(n * 0.00001, 8) AS transfer,
  round(n * CASE WHEN board = 'BSE' THEN 0.000125 ELSE 0.0000341 END, 9) AS handling, round(n * 0.00002, 8) AS regulatory FROM q""")
def fn14(spark, sf):
    b = boarded(spark, sf).withColumns({"side": F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY"), "n": F.when(F.col("l_discount") > 0.09, 0.0).otherwise(F.col("l_extendedprice"))})
    f = od.fees("side", "n", "board", pass_through=True)
    digits = {"handling": 9}
    return b.select("l_orderkey", "l_linenumber", *[F.round(c, digits.get(k, 8)).alias(k) for k, c in f.items()])


@query("fn15_impact_cost", PANELS + """, o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, d.vol - 20 AS volume, d.px AS close FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN daily AS d ON d.asset = p_brand AND d.d = CAST(l_shipdate AS DATE) + 1),
f AS (SELECT *, CASE WHEN close IS NULL THEN 'MISSING_BAR' WHEN volume <= 0 THEN 'NON_POSITIVE_VOLUME' END AS reason, least(quantity, volume * 0.2) AS q FROM o)
SELECT l_orderkey, l_linenumber, side, reason, CASE WHEN reason IS NULL THEN round(q, 6) END AS fill_quantity, CASE WHEN reason IS NULL THEN round(close * (1 + CASE side WHEN 'BUY' THEN 1 ELSE -1 END * (2 + 30 * sqrt(q / volume)) / 10000), 4) END AS fill_price FROM f""")
def fn15(spark, sf):
    from marketloom.sources.panels import daily

    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    o = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"), F.col("p_brand").alias("asset"), F.date_add(F.to_date("l_shipdate"), 1).alias("d"))
    d = daily(spark, sf).select("asset", "d", (F.col("vol") - 20).alias("volume"), F.col("px").alias("close"))
    out = od.impact_fills(o.join(d, ["asset", "d"], "left"), 0.2, 2.0, 30.0, 1.0)
    return out.select("l_orderkey", "l_linenumber", "side", "reason", F.round("fill_quantity", 6).alias("fill_quantity"), F.round("fill_price", 4).alias("fill_price"))


BOOK = """WITH pos AS (SELECT o_custkey AS account, o_orderpriority AS asset, sum(o_totalprice) / 1000 AS quantity, CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 ELSE 3.0 END AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
tgt AS (SELECT account, asset, c / sum(c) OVER (PARTITION BY account) AS weight, price FROM (SELECT o_custkey AS account, o_orderpriority AS asset, count(*) AS c, CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 ELSE 3.0 END AS price FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) AS z)
"""


def books(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("asset"), "o_totalprice", "o_orderstatus")
    px = F.when(F.col("asset") == "1-URGENT", 5.0).otherwise(3.0)
    pos = o.where("o_orderstatus = 'F'").groupBy("account", "asset").agg((F.sum("o_totalprice") / 1000).alias("quantity")).withColumn("price", px)
    t = o.where("o_orderstatus <> 'F'").groupBy("account", "asset").agg(F.count("*").alias("c"))
    t = t.withColumn("weight", F.col("c") / F.sum("c").over(Window.partitionBy("account"))).withColumn("price", px).drop("c")
    return pos, t


@query("fn16_plan_orders", BOOK + """, nav AS (SELECT c_custkey AS account, c_acctbal + coalesce(h, 0) AS nav FROM customer LEFT JOIN (SELECT account, sum(quantity * price) AS h FROM pos GROUP BY 1) ON account = c_custkey),
j AS (SELECT account, asset, coalesce(pos.price, tgt.price) AS px, coalesce(weight, 0) * nav - coalesce(quantity, 0) * coalesce(pos.price, tgt.price) AS dv FROM pos FULL JOIN tgt USING (account, asset) JOIN nav USING (account))
SELECT account, asset, round(abs(dv / px), 2) AS quantity, CASE WHEN dv > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM j WHERE abs(dv) >= 50 AND round(abs(dv / px), 2) > 0""")
def fn16(spark, sf):
    pos, t = books(spark, sf)
    cash = table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))
    return od.plan_orders(t, pos, cash, "account", 50.0, 2).select("account", "asset", "quantity", "side")


@query("fn17_exposure_limits", BOOK + """, g AS (SELECT account, substr(asset, 1, 1) < '3' AS grp, sum(abs(weight)) AS g, max(abs(weight)) AS m FROM tgt GROUP BY 1, 2), e AS (SELECT account, sum(g) AS gross, max(m) AS largest, max(g) AS lg FROM g GROUP BY 1)
SELECT account, round(gross, 6) AS gross, round(largest, 6) AS largest, round(lg, 6) AS largest_group, concat_ws(',', CASE WHEN gross > 1 + 1e-9 THEN 'MAX_GROSS_EXPOSURE' END, CASE WHEN largest > 0.5 + 1e-9 THEN 'MAX_ABS_WEIGHT' END, CASE WHEN lg > 0.7 + 1e-9 THEN 'MAX_GROUP_EXPOSURE' END) AS violations FROM e""")
def fn17(spark, sf):
    _, t = books(spark, sf)
    t = t.withColumn("grp", F.substring("asset", 1, 1) < "3")
    return published(od.exposure_limits(t, ["account"], "grp", 1.0, 0.5, 0.7))


PAIR = BOOK + """, cur AS (SELECT account, asset, quantity * price / sum(quantity * price) OVER (PARTITION BY account) AS w FROM pos), pr AS (SELECT coalesce(tgt.account, cur.account) AS account, coalesce(tgt.asset, cur.asset) AS asset, coalesce(weight, 0) AS t, coalesce(w, 0) AS c FROM tgt FULL JOIN cur ON tgt.account = cur.account AND tgt.asset = cur.asset)
"""


def pairs(spark, sf):
    pos, t = books(spark, sf)
    v = F.col("quantity") * F.col("price")
    cur = pos.select("account", "asset", (v / F.sum(v).over(Window.partitionBy("account"))).alias("weight"))
    return od.paired(t.select("account", "asset", "weight"), cur, ["account"])


@query("fn18_rebalance_trigger", PAIR + """, d AS (SELECT account, 0.5 * sum(abs(t - c)) AS turnover, max(abs(t - c)) AS max_drift FROM pr GROUP BY 1), r AS (SELECT *, CASE WHEN turnover >= 0.79 THEN 'force_turnover' WHEN turnover >= 0.21 AND max_drift >= 0.31 THEN 'weight_drift' END AS reason FROM d)
SELECT account, round(turnover, 6) AS turnover, round(max_drift, 6) AS max_drift, reason, reason IS NOT NULL AS rebalance FROM r""")
def fn18(spark, sf):
    return published(od.rebalance_decision(pairs(spark, sf), ["account"], 0.79, 0.21, 0.31))


@query("fn19_scenario_stress", BOOK + """, sh AS (SELECT o_orderpriority AS asset, o_orderstatus AS scenario, avg(o_totalprice) / -1e6 AS shock FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2), every AS (SELECT account, asset, weight, scenario FROM tgt, (SELECT DISTINCT scenario FROM sh) AS z)
SELECT account, e.scenario, round(sum(weight * coalesce(shock, 0)), 6) + 0.0 AS scenario_return, count(*) - count(shock) AS missing_shocks FROM every AS e LEFT JOIN sh ON sh.asset = e.asset AND sh.scenario = e.scenario GROUP BY 1, 2""")
def fn19(spark, sf):
    _, t = books(spark, sf)
    sh = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderstatus").alias("scenario")).agg((F.avg("o_totalprice") / -1e6).alias("shock"))
    return published(od.stress(t.select("account", "asset", "weight"), sh, ["account"]))


@query("fn21_shadow_comparison", PAIR + "SELECT account, round(max(abs(t - c)), 6) AS max_gap, round(0.5 * sum(abs(t - c)), 6) AS distance, round(CASE WHEN sum(t * t) = 0 OR sum(c * c) = 0 THEN 0 ELSE sum(t * c) / sqrt(sum(t * t) * sum(c * c)) END, 6) AS cosine FROM pr GROUP BY 1")
def fn21(spark, sf):
    return published(od.compare_books(pairs(spark, sf), ["account"]))


@query("fn22_shortfall", PAIR + "SELECT account, round(0.5 * (sum(abs(t - c)) + abs(sum(c) - sum(t))), 6) AS shortfall FROM pr GROUP BY 1")
def fn22(spark, sf):
    return published(od.shortfall(pairs(spark, sf), ["account"]))


ACT = """WITH act AS (SELECT p_brand AS asset, CAST(min(l_shipdate) AS DATE) AS effective_at, CASE WHEN p_size % 2 = 0 THEN 'SPLIT' ELSE 'DIVIDEND' END AS kind, CASE WHEN p_size % 10 = 0 THEN 2.0 ELSE 1.0 END AS ratio, p_size * 0.01 AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_size)
"""


def actions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy(F.col("p_brand").alias("asset"), "p_size").agg(F.to_date(F.min("l_shipdate")).alias("effective_at"))
    return g.select("asset", "effective_at", F.when(F.col("p_size") % 2 == 0, "SPLIT").otherwise("DIVIDEND").alias("kind"), F.when(F.col("p_size") % 10 == 0, 2.0).otherwise(1.0).alias("ratio"), (F.col("p_size") * 0.01).alias("amount"))


@query("fn23_corporate_actions", ACT + """, a AS (SELECT *, coalesce(product(CASE kind WHEN 'SPLIT' THEN ratio ELSE 1 END) OVER (PARTITION BY asset ORDER BY effective_at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b FROM act),
g AS (SELECT asset, product(CASE kind WHEN 'SPLIT' THEN ratio ELSE 1 END) AS r, sum(CASE kind WHEN 'DIVIDEND' THEN amount * b ELSE 0 END) AS pay FROM a GROUP BY 1),
p AS (SELECT o_custkey AS account, p_brand AS asset, CAST(count(*) AS DOUBLE) AS quantity, round(max(p_retailprice), 2) AS mark FROM orders JOIN part ON o_orderkey % 2000 = p_partkey GROUP BY 1, 2)
SELECT account, asset, round(quantity * coalesce(r, 1), 6) AS quantity, round(mark / coalesce(r, 1), 6) AS mark, round(quantity * coalesce(pay, 0), 6) AS cash FROM p LEFT JOIN g USING (asset)""")
def fn23(spark, sf):
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    pos = o.join(p, F.col("o_orderkey") % 2000 == F.col("p_partkey")).groupBy(F.col("o_custkey").alias("account"), F.col("p_brand").alias("asset")).agg(F.count("*").cast("double").alias("quantity"), F.round(F.max("p_retailprice"), 2).alias("mark"))
    return published(od.apply_actions(pos, actions(spark, sf)))


@query("fn24_split_factor", PANELS + "," + ACT[5:] + """, sp AS (SELECT asset, effective_at, product(1 / ratio) AS f FROM act WHERE kind = 'SPLIT' AND effective_at <= '2000-01-01' GROUP BY 1, 2),
x AS (SELECT w.asset, w.wk, w.close, coalesce((SELECT product(f) FROM sp WHERE sp.asset = w.asset AND sp.effective_at > w.wk), 1) AS factor FROM weekly AS w)
SELECT asset, strftime(wk, '%Y-%m-%d') AS ts, round(factor, 6) AS factor, round(close * factor, 6) AS adjusted_close FROM x""")
def fn24(spark, sf):
    s = actions(spark, sf).where("kind = 'SPLIT'").withColumn("available_at", F.col("effective_at"))
    out = od.split_adjusted(weekly(spark, sf).select("asset", F.col("wk").alias("ts"), "close"), s, "2000-01-01")
    return published(out.drop("close"))


@query("fn25_admissibility", PANELS + """, e AS (SELECT event_id, CASE WHEN asset = 'click' THEN 'live' WHEN asset = 'view' THEN 'delayed' WHEN asset = 'error' THEN 'unknown' ELSE 'replay' END AS timing, CASE WHEN size > 80 THEN 900.0 ELSE 5.0 END AS source_delay, CAST(user_id - 5 AS DOUBLE) AS age_seconds FROM ticks),
c AS (SELECT event_id, concat_ws(',', CASE WHEN timing = 'replay' THEN 'timing:replay_not_allowed' END, CASE WHEN timing = 'delayed' THEN 'timing:delayed_not_allowed' END, CASE WHEN timing = 'unknown' THEN 'timing:unknown_not_allowed' END, CASE WHEN source_delay > 60 THEN 'freshness:source_delay_exceeded' END, CASE WHEN greatest(age_seconds, 0) > 100 THEN 'freshness:event_age_exceeded' END) AS codes FROM e)
SELECT event_id, codes, codes = '' AS allowed FROM c""")
def fn25(spark, sf):
    timing = F.when(F.col("asset") == "click", "live").when(F.col("asset") == "view", "delayed").when(F.col("asset") == "error", "unknown").otherwise("replay")
    e = ticks(spark, sf).select("event_id", timing.alias("timing"), F.when(F.col("size") > 80, 900.0).otherwise(5.0).alias("source_delay"), (F.col("user_id") - 5).cast("double").alias("age_seconds"))
    return published(od.admissible(e, 100.0, 60.0).select("event_id", "codes", "allowed"))


# --- lineage, registries, traces ------------------------------------------------------

EDGES = """edges AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""


def edges(spark, sf):
    def pair(df, a, pa, b, pb):
        return df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("parent"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("child"))

    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    return pair(n, "n_regionkey", "R", "n_nationkey", "N").unionByName(pair(c, "c_nationkey", "N", "c_custkey", "C")).unionByName(pair(o, "o_custkey", "C", "o_orderkey", "O"))


REACHED = f"""WITH RECURSIVE {EDGES}, t(node, depth) AS (SELECT 'N3', 0 UNION SELECT child, depth + 1 FROM t JOIN edges ON parent = node WHERE depth < 3),
f AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM t GROUP BY 1)
"""


@query("gr01_lineage_traversal", REACHED + "SELECT node, depth FROM f")
def gr01(spark, sf):
    return ln.traverse(edges(spark, sf), "N3", "out", 3)


@query("gr01b_lineage_edges", REACHED + "SELECT parent, child FROM edges WHERE parent IN (SELECT node FROM f) AND child IN (SELECT node FROM f)")
def gr01b(spark, sf):
    e = edges(spark, sf)
    return ln.traversed_edges(e, ln.traverse(e, "N3", "out", 3))


STATEMENT = "The quality of the market data and the training of the model"


@query("gr02_similar_statements", f"""WITH q AS (SELECT list_distinct(regexp_extract_all(lower('{STATEMENT}'), '[a-z0-9]+')) AS b), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, [lang, source] AS g FROM documents),
s AS (SELECT doc_id, 0.85 * CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END + 0.15 * len(list_intersect(g, ['en', 'src1'])) / len(list_distinct(list_concat(g, ['en', 'src1']))) AS score FROM t, q)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""")
def gr02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.array("lang", "source").alias("tags"))
    return published(ln.similar_statements(d, "doc_id", "text", "tags", STATEMENT, ["en", "src1"], 20))


@query("gr03_similar_experiments", f"""WITH q AS (SELECT list_distinct(regexp_extract_all(lower('{STATEMENT}'), '[a-z0-9]+')) AS b), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, lang, source, n_chars FROM documents),
s AS (SELECT doc_id, CASE WHEN doc_id = 7 THEN 1 ELSE 0.40 * CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END + 0.20 * CASE WHEN lang IN ('en', 'fr') THEN 0.5 ELSE 0 END + 0.15 * CASE WHEN source = 'src2' THEN 1 ELSE 0 END
  + 0.15 * CASE WHEN n_chars % 4 = 1 THEN 1 ELSE 0 END + 0.10 * CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END END AS score FROM t, q)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""")
def gr03(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("fingerprint"), F.col("text").alias("hypothesis"), F.array("lang").alias("universe"), F.array("source").alias("parameters"),
        (F.col("n_chars") % 4).cast("string").alias("dataset"), (F.col("n_chars") % 3).cast("string").alias("code"))
    spec = {"fingerprint": "7", "hypothesis": STATEMENT, "universe": ["en", "fr"], "parameters": ["src2"], "dataset": "1", "code": "0"}
    return published(ln.similar_experiments(d, "doc_id", spec, 20))


@query("gr03b_similar_features", f"""WITH q AS (SELECT list_distinct(regexp_extract_all(lower('{STATEMENT}'), '[a-z0-9]+')) AS b), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, lang, n_chars FROM documents),
s AS (SELECT doc_id, 0.60 * CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END + 0.25 * CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END + 0.15 * least(n_chars, 800) / greatest(n_chars, 800) AS score FROM t, q)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""")
def gr03b(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("hypothesis"), F.array("lang").alias("fields"), F.col("n_chars").alias("lookback"))
    return published(ln.similar_features(d, "doc_id", STATEMENT, ["en", "close"], 800, 20))


@query("gr05_latest_revision", "SELECT o_custkey, o_orderkey, o_orderstatus, count(*) OVER () AS entities FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) AS z WHERE r = 1")
def gr05(spark, sf):
    from marketloom.operators.ordering import latest

    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    out = latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")
    return out.join(F.broadcast(out.agg(F.count("*").alias("entities"))))


@query("gr05b_illegal_transitions", """WITH t AS (SELECT o_custkey, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_custkey, count(*) AS revisions, count(*) FILTER (p IS NOT NULL AND (p || s) NOT IN ('OP', 'PF', 'OF', 'OO')) AS illegal FROM t GROUP BY 1""")
def gr05b(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    allowed = [("O", "P"), ("P", "F"), ("O", "F"), ("O", "O")]
    return ln.illegal_transitions(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", allowed)


@query("gr06_append_register", """WITH i AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), e AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN lo <> hi THEN 'CONFLICT' WHEN a IS NULL THEN 'APPEND' WHEN a = lo AND b = lo THEN 'SKIP' ELSE 'CONFLICT' END AS action FROM i LEFT JOIN e USING (l_orderkey, l_linenumber)""")
def gr06(spark, sf):
    li = table(spark, sf, "lineitem")
    return ln.register(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query("gr07_family_runs", "SELECT c_mktsegment AS family, c_custkey AS member, count(*) AS runs, strftime(max(o_orderdate), '%Y-%m-%d') AS last_run FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def gr07(spark, sf):
    runs = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("runs"), F.max(F.to_date("o_orderdate")).alias("last_run"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("member"))
    return published(c.join(runs, F.col("member") == F.col("o_custkey")).drop("o_custkey"))


@query("gr08_failure_log", "SELECT event_type AS category, CAST(user_id % 7 AS BIGINT) AS stage, count(*) AS failures FROM events WHERE value > 20 AND event_type IN ('error', 'view') GROUP BY 1, 2")
def gr08(spark, sf):
    e = table(spark, sf, "events").where("value > 20 AND event_type IN ('error', 'view')")
    return e.groupBy(F.col("event_type").alias("category"), (F.col("user_id") % 7).alias("stage")).agg(F.count("*").alias("failures"))


def trace_lines(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "span_start").when(F.col("event_type") == "purchase", "span_end").otherwise("event")
    body = F.struct(
        kind.alias("event"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("span_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        F.when(F.col("event_type") == "click", "attributes").otherwise(F.col("event_type")).alias("name"), F.when(F.col("value") > 10, "ok").otherwise("error").alias("status"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"))
    return e.select(F.to_json(body).alias("line"))


@query("gr09_span_assembly", """WITH e AS (SELECT 'U' || user_id AS span_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_, value, json_extract_string(props, '$.k') AS k FROM events)
SELECT span_id, min(at_) FILTER (event_type = 'signup') AS started_at, max(at_) FILTER (event_type = 'purchase') AS ended_at,
  CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'orphan' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'open' ELSE arg_max(CASE WHEN value > 10 THEN 'ok' ELSE 'error' END, at_) FILTER (event_type = 'purchase') END AS status,
  arg_max(k, at_) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type IN ('view', 'error')) AS events, greatest(count(*) FILTER (event_type = 'signup') - 1, 0) AS duplicate_starts FROM e GROUP BY 1""")
def gr09(spark, sf):
    s = ln.assemble_spans(trace_lines(spark, sf), "line")
    return s.withColumn("k", F.try_element_at("attributes", F.lit("k"))).drop("attributes")


@query("gr10_span_depth_rollup", """WITH t AS (SELECT role, turn AS depth, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens, length(text) AS chars FROM conversations)
SELECT role, count(*) AS spans, CAST(max(depth) AS BIGINT) AS max_depth, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars FROM t GROUP BY 1""")
def gr10(spark, sf):
    """Each turn is a span under the turn before it; depth comes from the parent links."""
    c = table(spark, sf, "conversations")
    node = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    up = F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1))
    d = ln.depths(c.select(node.alias("node"), up.alias("up")), "node", "up")
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(tx.LATIN), F.lit(0)))
    spans = c.select(node.alias("node"), "role", words.alias("tokens"), F.length("text").alias("chars")).join(d, "node")
    return spans.groupBy("role").agg(F.count("*").alias("spans"), F.max("depth").alias("max_depth"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))


@query("gr11_thread_index", """SELECT user_id, coalesce(max(CASE WHEN value > 60 THEN event_type END), 'project-' || user_id) AS project, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS rows, count(DISTINCT CASE WHEN value > 60 THEN event_type END) > 1 AS conflict FROM events GROUP BY user_id""")
def gr11(spark, sf):
    e = table(spark, sf, "events").withColumn("project", F.when(F.col("value") > 60, F.col("event_type")))
    return published(ln.thread_index(e, "user_id", "project", F.concat(F.lit("project-"), F.col("user_id").cast("string")), "ts"))


@query("gr12_cycle_linkage", """SELECT o_orderkey, c_name, n_name, quality, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'CUSTOMER_MISSING' END, CASE WHEN n_nationkey IS NULL THEN 'NATION_MISSING' END, CASE WHEN doc_id IS NULL THEN 'LABEL_MISSING' END) AS missing
FROM orders LEFT JOIN customer AS c ON o_custkey = c_custkey + 10 LEFT JOIN nation AS n ON c_nationkey = n_nationkey + 3 LEFT JOIN (SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM labels) AS l ON o_orderkey = doc_id""")
def gr12(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    j = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey") + 10, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey") + 3, "left").join(lab, F.col("o_orderkey") == F.col("doc_id"), "left")
    miss = reasons((F.col("c_custkey").isNull(), "CUSTOMER_MISSING"), (F.col("n_nationkey").isNull(), "NATION_MISSING"), (F.col("doc_id").isNull(), "LABEL_MISSING"))
    return published(j.select("o_orderkey", "c_name", "n_name", "quality", miss.alias("missing")))


@query("gr14_graph_union", """WITH n AS (SELECT 'K' || c_custkey AS node, c_mktsegment AS kind FROM customer UNION ALL SELECT 'K' || o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'BUILDING' END FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT node, min(kind) AS kind, min(kind) <> max(kind) AS conflict FROM n GROUP BY 1""")
def gr14(spark, sf):
    def key(c):
        return F.concat(F.lit("K"), F.col(c).cast("string")).alias("node")

    a = table(spark, sf, "customer").select(key("c_custkey"), F.col("c_mktsegment").alias("kind"))
    b = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(key("o_custkey"), F.lit("BUILDING").alias("kind"))
    e = edges(spark, sf).withColumn("relation", F.lit("owns"))
    return ln.union_graphs([a, b], [e, e])[0]


@query("gr14b_graph_edges", f"WITH {EDGES} SELECT DISTINCT parent, child, 'owns' AS relation FROM edges")
def gr14b(spark, sf):
    e = edges(spark, sf).withColumn("relation", F.lit("owns"))
    n = e.select(F.col("parent").alias("node"), F.lit("any").alias("kind"))
    return ln.union_graphs([n], [e, e])[1]


@query("gr15_merge_registries", """WITH u AS (SELECT 'a' AS registry, o_custkey AS k, o_orderpriority AS d, o_orderkey AS x FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 400000)
SELECT k AS o_custkey, array_to_string(list_sort(list(DISTINCT registry)), ',') AS registries, min(d) <> max(d) AS conflict, count(x) AS evaluations FROM u GROUP BY 1""")
def gr15(spark, sf):
    o = table(spark, sf, "orders")
    return published(ln.merge_registries({"a": o.where("o_orderstatus = 'F'"), "b": o.where("o_totalprice > 400000")}, "o_custkey", "o_orderpriority", "o_orderkey"))

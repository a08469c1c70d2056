"""Queries over evaluation, statistics and walk-forward operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import cross as xs
from marketloom.operators import evaluate as ev
from marketloom.operators import folds as fo
from marketloom.operators import gram
from marketloom.operators import stats as st
from marketloom.operators import windows as win
from marketloom.plans.panel import A, STATE, market_state
from marketloom.plans.registry import SQL, published, query
from marketloom.plans.sqltext import PANELS, chi2_upper_sql, normal_quantile_sql, normal_upper_sql, pub, student_upper_sql
from marketloom.settings import cut_lineage
from marketloom.sources.panels import daily, table, weekly

# Candidates: two momentum widths, close location and volume surprise.
CAND = PANELS + f""",
cw AS (SELECT asset, wk, yr, is_complete, close / lag(close) OVER a - 1 AS mom1, close / lag(close, 4) OVER a - 1 AS mom4,
  CASE WHEN high - low <= 1e-15 THEN 0 ELSE (close - low) / (high - low) - 0.5 END AS loc,
  CASE WHEN count(*) OVER (PARTITION BY asset ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN volume / avg(volume) OVER (PARTITION BY asset ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - 1 END AS vsur,
  lead(close) OVER a / close - 1 AS y1, lead(close, 2) OVER a / close - 1 AS y2, lead(wk) OVER a AS nxt FROM weekly WINDOW a AS {A}),
obs AS (SELECT asset, wk, yr, is_complete, candidate, value, y1, y2, nxt FROM (
  SELECT *, unnest(['mom1', 'mom4', 'loc', 'vsur']) AS candidate, unnest([mom1, mom4, loc, vsur]) AS value FROM cw) AS u),
rk AS (SELECT candidate, wk, yr, (rank() OVER (PARTITION BY candidate, wk ORDER BY value) + count(*) OVER (PARTITION BY candidate, wk ORDER BY value)) / 2.0 AS rv,
  (rank() OVER (PARTITION BY candidate, wk ORDER BY y1) + count(*) OVER (PARTITION BY candidate, wk ORDER BY y1)) / 2.0 AS ry FROM obs WHERE value IS NOT NULL AND y1 IS NOT NULL),
ic AS (SELECT candidate, wk, yr, count(*) AS breadth, covar_pop(rv, ry) / nullif(stddev_pop(rv) * stddev_pop(ry), 0) AS rank_ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 5)
"""
FEATS = ["mom1", "mom4", "loc", "vsur"]


def candidates(spark, sf):
    by = ["asset"]
    w = Window.partitionBy("asset").orderBy("wk")
    vs, _ = win.volume_surprise("volume", 5, by, "wk")
    return weekly(spark, sf).select(
        "asset", "wk", "yr", "is_complete",
        (F.col("close") / win.lagged("close", 1, by, "wk") - 1).alias("mom1"),
        (F.col("close") / win.lagged("close", 4, by, "wk") - 1).alias("mom4"),
        win.close_location().alias("loc"), vs.alias("vsur"),
        (F.lead("close").over(w) / F.col("close") - 1).alias("y1"), (F.lead("close", 2).over(w) / F.col("close") - 1).alias("y2"),
        F.lead("wk").over(w).alias("nxt"))


def obs(spark, sf):
    return ev.observations(candidates(spark, sf), FEATS, ["asset", "wk", "yr", "is_complete", "y1", "y2", "nxt"])


CT = ["candidate", "wk"]


def period_ic(spark, sf):
    return ev.rank_ic(obs(spark, sf), [*CT, "yr"], "value", "y1", 5)


def stored_ic(spark, sf):
    """The metric series written once, for queries that read it several times."""
    return cut_lineage(period_ic(spark, sf), "rank-ic")


@query("ev01_pearson_ic", pub(CAND + """, b AS (SELECT candidate, wk, y1, least(quantile_cont(value, 0.95) OVER t, greatest(quantile_cont(value, 0.05) OVER t, value)) AS v FROM obs WHERE value IS NOT NULL AND y1 IS NOT NULL WINDOW t AS (PARTITION BY candidate, wk))
SELECT candidate, wk, count(*) AS breadth, covar_pop(v, y1) / nullif(stddev_pop(v) * stddev_pop(y1), 0) AS ic FROM b GROUP BY 1, 2 HAVING count(*) >= 5""", "ic", "wk"))
def ev01(spark, sf):
    return published(ev.pearson_ic(obs(spark, sf), CT, "value", "y1", 0.05, 0.95, 5))


@query("ev02_rank_ic", pub(CAND + "SELECT candidate, wk, breadth, rank_ic FROM ic", "rank_ic", "wk"))
def ev02(spark, sf):
    return published(period_ic(spark, sf).drop("yr"))


@query("ev03_ic_summary", pub(CAND + "SELECT candidate, count(*) AS periods, avg(rank_ic) AS ic_mean, avg(rank_ic) / stddev_samp(rank_ic) AS icir FROM ic GROUP BY 1", "ic_mean icir"))
def ev03(spark, sf):
    return published(ev.ic_summary(period_ic(spark, sf), ["candidate"]))


@query("ev04_ic_decay", pub(CAND + """, l AS (SELECT candidate, wk, value, unnest(['y1', 'y2']) AS label_name, unnest([y1, y2]) AS y FROM obs),
r AS (SELECT candidate, wk, label_name, (rank() OVER (PARTITION BY candidate, wk, label_name ORDER BY value) + count(*) OVER (PARTITION BY candidate, wk, label_name ORDER BY value)) / 2.0 AS rv,
  (rank() OVER (PARTITION BY candidate, wk, label_name ORDER BY y) + count(*) OVER (PARTITION BY candidate, wk, label_name ORDER BY y)) / 2.0 AS ry FROM l WHERE value IS NOT NULL AND y IS NOT NULL),
i AS (SELECT candidate, label_name, wk, covar_pop(rv, ry) / nullif(stddev_pop(rv) * stddev_pop(ry), 0) AS ic FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT candidate, label_name, count(*) AS periods, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS icir FROM i GROUP BY 1, 2""", "ic_mean icir"))
def ev04(spark, sf):
    return published(ev.ic_decay(obs(spark, sf), ["candidate"], "value", ["y1", "y2"], "wk", 5))


QP = CAND + """, qb AS (SELECT candidate, wk, asset, y1, count(*) OVER t AS n, count(y1) OVER t AS k, ntile(5) OVER (PARTITION BY candidate, wk ORDER BY value, asset) - 1 AS b FROM obs WHERE value IS NOT NULL WINDOW t AS (PARTITION BY candidate, wk)),
qk AS (SELECT *, CASE b WHEN 4 THEN 0.5 WHEN 0 THEN -0.5 ELSE 0 END / count(*) OVER (PARTITION BY candidate, wk, b) AS w FROM qb WHERE n >= 10 AND n = k),
qs AS (SELECT candidate, wk, avg(y1) FILTER (b = 4) - avg(y1) FILTER (b = 0) AS spread FROM qk GROUP BY 1, 2),
qi AS (SELECT candidate, wk, row_number() OVER (PARTITION BY candidate ORDER BY wk) AS i FROM qs),
qg AS (SELECT qi.candidate, qi.wk, i, a.asset, coalesce(qk.w, 0) AS w FROM qi CROSS JOIN (SELECT DISTINCT asset FROM obs) AS a LEFT JOIN qk ON qk.candidate = qi.candidate AND qk.wk = qi.wk AND qk.asset = a.asset),
qt AS (SELECT candidate, wk, 0.5 * sum(abs(w - p)) AS turnover FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY candidate, asset ORDER BY i), 0) AS p FROM qg) AS z GROUP BY 1, 2)
"""


@query("ev05_quantile_diagnostics", pub(QP + """SELECT candidate, count(*) AS periods, avg(spread) AS long_short_mean, avg(spread) / stddev_samp(spread) * sqrt(52) AS long_short_sharpe, avg(turnover) AS mean_turnover
FROM qs JOIN qt USING (candidate, wk) GROUP BY 1""", "long_short_mean long_short_sharpe mean_turnover"))
def ev05(spark, sf):
    return published(ev.quantile_diagnostics(obs(spark, sf), ["candidate"], "wk", "asset", "value", "y1", 5, 10, 52.0))


@query("ev06_coverage", pub(CAND + "SELECT candidate, count(*) FILTER (is_complete) AS eligible, count(*) FILTER (is_complete AND value IS NOT NULL) AS covered, count(*) FILTER (is_complete AND value IS NOT NULL) / count(*) FILTER (is_complete) AS coverage FROM obs GROUP BY 1", "coverage"))
def ev06(spark, sf):
    return published(ev.coverage(obs(spark, sf), ["candidate"], "value", F.col("is_complete")))


PAIRS = CAND + """, pr AS (SELECT wk, unnest(['loc','loc','loc','mom1','mom1','mom4']) AS l, unnest(['mom1','mom4','vsur','mom4','vsur','vsur']) AS r, unnest([loc,loc,loc,mom1,mom1,mom4]) AS a, unnest([mom1,mom4,vsur,mom4,vsur,vsur]) AS b FROM cw),
prk AS (SELECT wk, l, r, (rank() OVER (PARTITION BY wk, l, r ORDER BY a) + count(*) OVER (PARTITION BY wk, l, r ORDER BY a)) / 2.0 AS ra, (rank() OVER (PARTITION BY wk, l, r ORDER BY b) + count(*) OVER (PARTITION BY wk, l, r ORDER BY b)) / 2.0 AS rb
  FROM pr WHERE a IS NOT NULL AND b IS NOT NULL),
rho AS (SELECT wk, l, r, count(*) AS breadth, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS rho FROM prk GROUP BY 1, 2, 3 HAVING count(*) >= 5)
"""


@query("ev07_factor_correlation", PAIRS + 'SELECT l AS factor_a, r AS factor_b, count(*) AS periods, round(avg(rho), 6) + 0.0 AS rho FROM rho GROUP BY 1, 2')
def ev07(spark, sf):
    return published(gram.mean_rank_correlation(candidates(spark, sf), "wk", FEATS, 5).drop("weighting"))


WIDE = 37


@query("ev07b_wide_correlation", PANELS + f""", m AS (SELECT asset, wk, unnest(range(1, {WIDE + 1})) AS k, unnest([{", ".join(f"close / lag(close, {k}) OVER a" for k in range(1, WIDE + 1))}]) AS x FROM weekly WINDOW a AS (PARTITION BY asset ORDER BY wk)),
v AS (SELECT * FROM m WHERE x IS NOT NULL), p AS (SELECT a.wk, a.k AS i, b.k AS j, a.x, b.x AS y FROM v AS a JOIN v AS b ON a.asset = b.asset AND a.wk = b.wk AND a.k < b.k),
r AS (SELECT wk, i, j, (rank() OVER (PARTITION BY wk, i, j ORDER BY x) + count(*) OVER (PARTITION BY wk, i, j ORDER BY x)) / 2.0 AS u, (rank() OVER (PARTITION BY wk, i, j ORDER BY y) + count(*) OVER (PARTITION BY wk, i, j ORDER BY y)) / 2.0 AS v FROM p),
c AS (SELECT wk, i, j, covar_pop(u, v) / nullif(stddev_pop(u) * stddev_pop(v), 0) AS rho FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT 'mom' || lpad(CAST(i AS VARCHAR), 2, '0') AS factor_a, 'mom' || lpad(CAST(j AS VARCHAR), 2, '0') AS factor_b, count(*) AS periods, round(avg(rho), 6) + 0.0 AS rho FROM c GROUP BY 1, 2""")
def ev07b(spark, sf):
    """Thirty-seven candidates at once: 666 pairs that never exist as rows before their result."""
    names = {f"mom{k:02d}": F.col("close") / win.lagged("close", k, ["asset"], "wk") for k in range(1, WIDE + 1)}
    panel = weekly(spark, sf).select("wk", *[c.alias(n) for n, c in names.items()])
    return published(gram.mean_rank_correlation(panel, "wk", list(names), 5).drop("weighting"))


@query("ev08_state_similarity", PAIRS + """, p AS (SELECT wk, unnest(['lo', 'hi']) AS state, unnest([1 - month(wk) / 12.0, month(wk) / 12.0]) AS p FROM (SELECT DISTINCT wk FROM weekly))
SELECT l AS factor_a, r AS factor_b, state, round(sum(rho * p) FILTER (p > 0) / sum(p) FILTER (p > 0), 6) + 0.0 AS similarity FROM rho JOIN p USING (wk) GROUP BY 1, 2, 3""")
def ev08(spark, sf):
    hi = F.month("wk") / 12.0
    rho = gram.mean_rank_correlation(candidates(spark, sf), "wk", FEATS, 5, {"lo": 1 - hi, "hi": hi})
    return published(rho.select("factor_a", "factor_b", F.col("weighting").alias("state"), F.col("rho").alias("similarity")))


@query("ev09_candidate_status", CAND + """, t AS (SELECT candidate, wk, count(*) AS assets, count(y1) AS labelled, count(*) FILTER (coalesce(year(nxt) > yr, true)) AS crossing, count(value) FILTER (y1 IS NOT NULL) AS usable FROM obs WHERE is_complete GROUP BY 1, 2),
s AS (SELECT wk, max(assets) AS a, max(labelled) AS l, max(crossing) AS x FROM t GROUP BY 1)
SELECT candidate, strftime(wk, '%Y-%m-%d') AS wk, assets, labelled, usable, CASE WHEN x = a THEN 'BOUNDARY' WHEN l < a THEN 'PARTIAL_LABEL' WHEN usable < 20 THEN 'INSUFFICIENT_BREADTH' ELSE 'AVAILABLE' END AS status FROM t JOIN s USING (wk)""")
def ev09(spark, sf):
    crossing = F.coalesce(F.year("nxt") > F.col("yr"), F.lit(True))
    out = ev.candidate_status(obs(spark, sf), "value", "y1", crossing, 20, "wk", F.col("is_complete"))
    return published(out)


@query("ev10_observations", CAND + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, candidate, round(value, 6) + 0.0 AS value, CASE WHEN value IS NULL THEN 'HISTORY' END AS reason, round(y1, 6) + 0.0 AS y1 FROM obs WHERE is_complete")
def ev10(spark, sf):
    c = candidates(spark, sf).where("is_complete")
    c = c.withColumns({f"{f}_reason": F.when(F.col(f).isNull(), "HISTORY") for f in FEATS})
    return published(ev.observations(c, FEATS, ["asset", "wk", "y1"]))


@query("ev11_candidate_cache", CAND + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, yr, candidate, round(value, 6) + 0.0 AS value FROM obs WHERE is_complete AND y1 IS NOT NULL")
def ev11(spark, sf):
    """Candidate values written by year and read back through the partition column."""
    from marketloom.settings import shared_dir

    o = obs(spark, sf).where("is_complete AND y1 IS NOT NULL").select("asset", "wk", "yr", "candidate", "value")
    path = shared_dir(spark, "candidates")
    o.write.partitionBy("yr").parquet(path)
    return published(spark.read.parquet(path))


DIRS = CAND + ", dirs AS (SELECT candidate, avg(rank_ic) AS tm, CASE WHEN avg(rank_ic) >= 0 THEN 1 ELSE -1 END AS direction FROM ic WHERE yr <= 1997 GROUP BY 1)\n"


def directions(ic):
    return ev.train_direction(ic, ["candidate"], F.col("yr") <= 1997)


@query("ev12_train_direction", DIRS + "SELECT candidate, round(tm, 6) + 0.0 AS train_mean, CAST(direction AS BIGINT) AS direction FROM dirs")
def ev12(spark, sf):
    return published(directions(period_ic(spark, sf)))


@query("ev13_fold_summary", pub(DIRS + """SELECT candidate, yr, count(*) AS periods, avg(rank_ic * direction) AS signed_mean, avg(rank_ic * direction) / stddev_samp(rank_ic) AS signed_icir, avg(CASE WHEN rank_ic * direction > 0 THEN 1.0 ELSE 0 END) AS hit_rate
FROM ic JOIN dirs USING (candidate) WHERE yr > 1997 GROUP BY 1, 2""", "signed_mean signed_icir hit_rate"))
def ev13(spark, sf):
    ic = stored_ic(spark, sf)
    d = directions(ic).select("candidate", "direction")
    ic = ic.where("yr > 1997")
    return published(ev.fold_summary(ic, d, ["candidate"], "yr"))


@query("ev14_regime_pooled", pub(CAND + "," + STATE[len(PANELS) + 1:] + """SELECT candidate, state AS regime, count(*) AS periods, avg(rank_ic) AS mean, avg(rank_ic) / stddev_samp(rank_ic) AS ratio FROM ic JOIN state USING (wk) WHERE state IS NOT NULL GROUP BY 1, 2""", "mean ratio"))
def ev14(spark, sf):
    reg = market_state(spark, sf).select("wk", F.col("state").alias("regime"))
    return published(ev.pooled_by_regime(period_ic(spark, sf), reg, "wk", ["candidate"], "rank_ic"))


@query("ev15_robustness", DIRS + """, m AS (SELECT candidate, CASE WHEN breadth >= 25 THEN 'full' WHEN breadth >= 24 THEN 'near' ELSE 'thin' END AS slice, avg(rank_ic * direction) AS mean FROM ic JOIN dirs USING (candidate) GROUP BY 1, 2),
g AS (SELECT candidate, count(*) < 3 AS blocked, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0 END) AS s FROM m GROUP BY 1)
SELECT candidate, blocked, round(CASE WHEN blocked THEN 0 ELSE s END, 6) AS positive_share, CASE WHEN blocked THEN 0 ELSE s END >= 0.6 AS robust FROM g""")
def ev15(spark, sf):
    ic = stored_ic(spark, sf)
    ic = ic.join(directions(ic).select("candidate", "direction"), "candidate")
    slice_ = F.when(F.col("breadth") >= 25, "full").when(F.col("breadth") >= 24, "near").otherwise("thin")
    means = ic.groupBy("candidate", slice_.alias("slice")).agg(F.avg(F.col("rank_ic") * F.col("direction")).alias("mean"))
    return published(ev.robustness(means, ["candidate"], ["full", "near", "thin"], 0.6))


@query("ev16_year_stability", pub(CAND + "SELECT candidate, yr, count(*) AS periods, avg(rank_ic) AS ic_mean, avg(rank_ic) / stddev_samp(rank_ic) AS icir FROM ic GROUP BY 1, 2", "ic_mean icir"))
def ev16(spark, sf):
    return published(ev.ic_summary(period_ic(spark, sf), ["candidate", "yr"]))


NW = CAND + """, cc AS (SELECT candidate, wk, rank_ic AS x, rank_ic - avg(rank_ic) OVER (PARTITION BY candidate) AS c FROM ic),
cl AS (SELECT *, """ + ", ".join(f"c * lag(c, {k}) OVER (PARTITION BY candidate ORDER BY wk) AS l{k}" for k in (1, 2, 3, 4)) + """ FROM cc),
nw AS (SELECT candidate, count(*) AS n, avg(x) AS mean, sum(c * c) / count(*) AS variance, (sum(c * c) + 2 * (0.8 * sum(l1) + 0.6 * sum(l2) + 0.4 * sum(l3) + 0.2 * sum(l4))) / count(*) AS lrv FROM cl GROUP BY 1)
"""


@query("ev17_newey_west", pub(NW + "SELECT candidate, n, mean, mean / sqrt(lrv / n) AS t_stat FROM nw", "mean t_stat"))
def ev17(spark, sf):
    return published(st.newey_west(period_ic(spark, sf), ["candidate"], "wk", "rank_ic", 4, pvalues=False))


@query("ev17b_newey_west_pvalues", pub(NW + f"""SELECT candidate, n, mean, t_stat, 2 * {normal_upper_sql('abs(t_stat)')} AS p_value FROM (SELECT *, mean / sqrt(lrv / n) AS t_stat FROM nw)""", "mean t_stat p_value"))
def ev17b(spark, sf):
    return published(st.newey_west(period_ic(spark, sf), ["candidate"], "wk", "rank_ic", 4))


def boot_sql(series: str, order: str, draws: int, block: int, seed: int) -> str:
    """Direct form: every observation of every draw is looked up and averaged."""
    return f""", bs AS (SELECT candidate, x, row_number() OVER (PARTITION BY candidate ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY candidate) AS n, avg(x) OVER (PARTITION BY candidate) AS mu FROM {series}),
bn AS (SELECT DISTINCT candidate, n, mu FROM bs), bp AS (SELECT candidate, n, mu, d, unnest(generate_series(0, n - 1)) AS j FROM bn, (SELECT unnest(generate_series(1, {draws})) AS d) AS dd),
bi AS (SELECT candidate, n, mu, d, (CAST('0x' || substr(md5('{seed}:' || d || ':' || (j // {block} + 1)), 1, 8) AS BIGINT) % n + j % {block}) % n AS i FROM bp),
bm AS (SELECT bi.candidate, bi.n, bi.mu, d, avg(x) AS m FROM bi JOIN bs ON bs.candidate = bi.candidate AND bs.i = bi.i GROUP BY 1, 2, 3, 4)
SELECT candidate, n, mu AS mean, (count(*) FILTER (abs(m - mu) >= abs(mu)) + 1) / {draws + 1}.0 AS p_value, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY 1, 2, 3"""


@query("ev18_block_bootstrap", pub(CAND + ", sx AS (SELECT candidate, wk, rank_ic AS x FROM ic WHERE rank_ic IS NOT NULL)" + boot_sql("sx", "wk", 200, 8, 7), "mean p_value low high"))
def ev18(spark, sf):
    return published(st.block_bootstrap(stored_ic(spark, sf), ["candidate"], "wk", "rank_ic", 200, 8, 7))


@query("ev19_session_bootstrap", pub(CAND + ", sx AS (SELECT candidate, date_trunc('month', wk) AS mo, avg(rank_ic) AS x FROM ic GROUP BY 1, 2)" + boot_sql("sx", "mo", 200, 4, 11), "mean p_value low high"))
def ev19(spark, sf):
    ic = stored_ic(spark, sf).withColumn("mo", F.trunc("wk", "month"))
    return published(st.session_bootstrap(ic, ["candidate"], "mo", "rank_ic", 200, 4, 11))


@query("ev20_multiple_testing", """WITH p AS (SELECT l_suppkey, l_returnflag AS family, round(abs(avg(l_discount) - 0.05) * 20, 6) AS p FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, l_suppkey) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, l_suppkey, p, round(least(1, p * m), 6) AS bonferroni, round(least(1, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY p, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS holm,
  round(least(1, min(m * p / r) OVER (PARTITION BY family ORDER BY p, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r""")
def ev20(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("family")).agg(F.round(F.abs(F.avg("l_discount") - 0.05) * 20, 6).alias("p"))
    return published(st.adjust_pvalues(p, ["family"], "l_suppkey", "p"))


@query("ev21_one_sided_mean", pub(CAND + f"""SELECT candidate, n, mean, t_stat, {student_upper_sql('t_stat', '(n - 1)')} AS p_value
FROM (SELECT candidate, count(*) AS n, avg(rank_ic) AS mean, avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(*)) AS t_stat FROM ic GROUP BY 1)""", "mean t_stat p_value"))
def ev21(spark, sf):
    return published(st.one_sided_mean(period_ic(spark, sf), ["candidate"], "rank_ic"))


@query("ev22_sharpe", pub(CAND + "SELECT candidate, count(*) AS n, avg(rank_ic) / stddev_samp(rank_ic) * sqrt(52) AS sharpe FROM ic GROUP BY 1", "sharpe"))
def ev22(spark, sf):
    return published(st.sharpe(period_ic(spark, sf), ["candidate"], "rank_ic", 52.0))


def family(spark, sf):
    """Trials: weekly damped returns of every brand, one family."""
    w = weekly(spark, sf)
    r = F.log(F.col("close") / win.lagged("close", 1, ["asset"], "wk")) / 20
    r = w.select(F.lit("all").alias("family"), F.col("asset").alias("trial"), "wk", r.alias("r")).where("r IS NOT NULL")
    r = cut_lineage(r, "family")
    full = r.groupBy("wk").agg(F.count("*").alias("c")).withColumn("k", F.max("c").over(Window.partitionBy())).where("c = k").select("wk")
    return r.join(full, "wk", "left_semi")


FAMILY = PANELS + """, fr AS (SELECT asset AS trial, wk, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY wk)) / 20 AS r FROM weekly), fk AS (SELECT wk, count(r) AS c FROM fr GROUP BY 1),
fam AS (SELECT * FROM fr WHERE r IS NOT NULL AND wk IN (SELECT wk FROM fk WHERE c = (SELECT max(c) FROM fk)))"""


DEFLATED = FAMILY + f""", g AS (SELECT 'all' AS family, trial, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(r) / stddev_samp(r) AS sharpe, skewness(r) AS skew, kurtosis(r) + 3 AS kurt FROM fam GROUP BY 2),
gt AS (SELECT *, count(*) OVER () AS trials, stddev_samp(sharpe) OVER () AS spread FROM g),
gb AS (SELECT *, spread * ((1 - 0.5772156649015329) * {normal_quantile_sql('1 - 1.0 / trials')} + 0.5772156649015329 * {normal_quantile_sql('1 - 1.0 / (trials * 2.718281828459045)')}) AS benchmark FROM gt),
gz AS (SELECT *, (sharpe - benchmark) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 2.220446049250313e-16)) AS z FROM gb),
ds AS (SELECT * EXCLUDE (z, spread), {normal_upper_sql('(-z)')} AS probability FROM gz)
"""


@query("ev23_deflated_sharpe", pub(DEFLATED + "SELECT * FROM ds", "mean sd sharpe skew kurt benchmark probability"))
def ev23(spark, sf):
    return published(st.deflated_sharpe(family(spark, sf), ["family"], "trial", "r"))


@query("ev23b_trial_moments", pub(FAMILY + ", g AS (SELECT trial, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(r) / stddev_samp(r) AS sharpe, skewness(r) AS skew, kurtosis(r) + 3 AS kurt FROM fam GROUP BY 1) SELECT * FROM g", "mean sd sharpe skew kurt"))
def ev23b(spark, sf):
    out = st.deflated_sharpe(family(spark, sf), ["family"], "trial", "r")
    return published(out.select("trial", "n", "mean", "sd", "sharpe", "skew", "kurt"))


@query("ev24_overfitting", pub(FAMILY + """, cut AS (SELECT wk, ntile(6) OVER (ORDER BY wk) - 1 AS b FROM (SELECT DISTINCT wk FROM fam)), x AS (SELECT trial, r, b FROM fam JOIN cut USING (wk)),
m AS (SELECT mask FROM (SELECT unnest(generate_series(0, 63)) AS mask) WHERE bit_count(mask) = 3 AND mask & 1 = 1),
g AS (SELECT mask, trial, avg(r) FILTER ((mask >> b) & 1 = 1) / stddev_samp(r) FILTER ((mask >> b) & 1 = 1) AS i, avg(r) FILTER ((mask >> b) & 1 = 0) / stddev_samp(r) FILTER ((mask >> b) & 1 = 0) AS o FROM x, m GROUP BY 1, 2),
k AS (SELECT *, (rank() OVER (PARTITION BY mask ORDER BY o) + count(*) OVER (PARTITION BY mask ORDER BY o)) / 2.0 AS rk, count(*) OVER (PARTITION BY mask) AS n, row_number() OVER (PARTITION BY mask ORDER BY i DESC, trial) AS best FROM g),
l AS (SELECT mask, least(1 - 0.5 / n, greatest(0.5 / n, (rk - 0.5) / n)) AS w FROM k WHERE best = 1)
SELECT 'all' AS family, count(*) AS splits, avg(CASE WHEN ln(w / (1 - w)) <= 0 THEN 1.0 ELSE 0 END) AS pbo, avg(ln(w / (1 - w))) AS mean_logit FROM l""", "pbo mean_logit"))
def ev24(spark, sf):
    return published(st.overfitting(family(spark, sf), ["family"], "trial", "wk", "r", 6))


@query("ev25_reality_check", pub(FAMILY + """, s AS (SELECT trial, r, row_number() OVER (PARTITION BY trial ORDER BY wk) - 1 AS i, count(*) OVER (PARTITION BY trial) AS n, avg(r) OVER (PARTITION BY trial) AS mu FROM fam),
p AS (SELECT n, d, unnest(generate_series(0, n - 1)) AS j FROM (SELECT DISTINCT n FROM s), (SELECT unnest(generate_series(1, 100)) AS d) AS dd),
q AS (SELECT n, d, (CAST('0x' || substr(md5('3:' || d || ':' || (j // 7 + 1)), 1, 8) AS BIGINT) % n + j % 7) % n AS i FROM p),
z AS (SELECT d, trial, sum(r - mu) / sqrt(any_value(q.n)) AS z FROM q JOIN s ON s.i = q.i GROUP BY 1, 2), t AS (SELECT d, max(z) AS z FROM z GROUP BY 1), o AS (SELECT max(sqrt(n) * mu) AS o FROM s)
SELECT 'all' AS family, any_value(o) AS observed, (count(*) FILTER (z >= o) + 1) / 101.0 AS p_value FROM t, o""", "observed p_value"))
def ev25(spark, sf):
    return published(st.reality_check(family(spark, sf), ["family"], "trial", "wk", "r", 100, 7, 3))


@query("ev26_family_verdict", pub(DEFLATED + f""", t AS (SELECT family, trial, n, mean, mean / sd * sqrt(n) AS t_stat, probability FROM ds),
pv AS (SELECT *, {student_upper_sql('t_stat', '(n - 1)')} AS p_value FROM t),
pr AS (SELECT *, row_number() OVER (ORDER BY p_value, trial) AS r, count(*) OVER () AS m FROM pv),
pa AS (SELECT * EXCLUDE (r, m), least(1, p_value * m) AS bonferroni, least(1, max((m - r + 1) * p_value) OVER (ORDER BY p_value, trial ROWS UNBOUNDED PRECEDING)) AS holm,
  least(1, min(m * p_value / r) OVER (ORDER BY p_value, trial ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM pr),
j AS (SELECT *, (SELECT pbo FROM ({SQL['ev24_overfitting']}) AS o) AS pbo, (SELECT p_value FROM ({SQL['ev25_reality_check']}) AS c) AS reality_p FROM pa),
jb AS (SELECT *, concat_ws(',', CASE WHEN holm > 0.05 THEN 'MULTIPLICITY' END, CASE WHEN probability < 0.95 THEN 'DEFLATED_SHARPE' END, CASE WHEN pbo > 0.5 THEN 'OVERFITTING' END, CASE WHEN reality_p > 0.05 THEN 'REALITY_CHECK' END) AS blockers FROM j)
SELECT *, blockers = '' AS passed FROM jb""", "mean t_stat p_value bonferroni holm bh probability pbo reality_p"))
def ev26(spark, sf):
    return published(st.family_verdict(family(spark, sf), ["family"], "trial", "wk", "r", 100, 7, 3, 6))


LJUNG = FAMILY + ", c AS (SELECT trial, wk, r - avg(r) OVER (PARTITION BY trial) AS c FROM fr WHERE r IS NOT NULL), l AS (SELECT *, " + ", ".join(f"c * lag(c, {k}) OVER (PARTITION BY trial ORDER BY wk) AS l{k}" for k in (1, 2, 3)) + " FROM c), g AS (SELECT trial AS asset, count(*) AS n, " + ", ".join(f"sum(l{k}) / sum(c * c) AS rho{k}" for k in (1, 2, 3)) + " FROM l GROUP BY 1) SELECT *, n * (n + 2) * (rho1 * rho1 / (n - 1) + rho2 * rho2 / (n - 2) + rho3 * rho3 / (n - 3)) AS q_stat FROM g"


@query("ev27_autocorrelation", pub(LJUNG, "rho1 rho2 rho3 q_stat"))
def ev27(spark, sf):
    r = weekly(spark, sf).select("asset", "wk", (F.log(F.col("close") / win.lagged("close", 1, ["asset"], "wk")) / 20).alias("r"))
    return published(st.autocorrelation(r, ["asset"], "wk", "r", 3))


@query("ev27b_ljung_box", pub(f"SELECT *, {chi2_upper_sql('q', 3)} AS p_value FROM (SELECT *, q_stat AS q FROM (" + LJUNG + "))", "rho1 rho2 rho3 q_stat p_value").replace("SELECT * REPLACE", "SELECT * EXCLUDE (q) REPLACE"))
def ev27b(spark, sf):
    r = weekly(spark, sf).select("asset", "wk", (F.log(F.col("close") / win.lagged("close", 1, ["asset"], "wk")) / 20).alias("r"))
    return published(st.ljung_box(r, ["asset"], "wk", "r", 3))


@query("ev28_describe_returns", pub(NW + """, dd AS (SELECT candidate, min(nav / greatest(1, pk) - 1) AS max_drawdown FROM (SELECT candidate, wk, nav, max(nav) OVER (PARTITION BY candidate ORDER BY wk) AS pk FROM (SELECT candidate, wk, product(1 + x) OVER (PARTITION BY candidate ORDER BY wk) AS nav FROM cc)) AS z GROUP BY 1)
SELECT candidate, n, 0 AS missing, mean, mean / sqrt(lrv / n) AS t_stat, n * variance / lrv AS effective_n, max_drawdown FROM nw JOIN dd USING (candidate)""", "mean t_stat effective_n max_drawdown").replace("0 AS missing", "CAST(0 AS BIGINT) AS missing"))
def ev28(spark, sf):
    return published(st.describe_returns(stored_ic(spark, sf), ["candidate"], "wk", "rank_ic", 4))


REPORT = DIRS + """, rep AS (SELECT candidate, avg(CASE WHEN m * direction > 0 THEN 1.0 ELSE 0 END) AS positive_share, avg(CASE WHEN (m >= 0) = (direction = 1) THEN 1.0 ELSE 0 END) AS direction_share, min(m * direction / s) AS worst_icir, avg(m * direction / s) AS mean_icir
  FROM (SELECT candidate, yr, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s FROM ic WHERE yr > 1997 GROUP BY 1, 2) AS f JOIN dirs USING (candidate) GROUP BY 1),
pool AS (SELECT candidate, avg(rank_ic * direction) / stddev_samp(rank_ic) AS icir FROM ic JOIN dirs USING (candidate) WHERE yr > 1997 GROUP BY 1)
"""


def walk_forward_report(spark, sf):
    ic = stored_ic(spark, sf)
    d = directions(ic).select("candidate", "direction")
    ic = ic.where("yr > 1997")
    per = ic.groupBy("candidate", "yr").agg(F.avg("rank_ic").alias("m"), F.stddev_samp("rank_ic").alias("s")).join(d, "candidate")
    signed = F.col("m") * F.col("direction")
    rep = per.groupBy("candidate").agg(
        F.avg((signed > 0).cast("double")).alias("positive_share"),
        F.avg(((F.col("m") >= 0) == (F.col("direction") == 1)).cast("double")).alias("direction_share"),
        F.min(signed / F.col("s")).alias("worst_icir"), F.avg(signed / F.col("s")).alias("mean_icir"))
    x = ic.join(d, "candidate")
    pool = x.groupBy("candidate").agg((F.avg(F.col("rank_ic") * F.col("direction")) / F.stddev_samp("rank_ic")).alias("icir"))
    return rep.join(pool, "candidate")


@query("ev34_walk_forward_report", pub(REPORT + "SELECT * FROM rep JOIN pool USING (candidate)", "positive_share direction_share worst_icir mean_icir icir"))
def ev34(spark, sf):
    return published(walk_forward_report(spark, sf))


GATES = {
    "positive_share": (">=", 0.5, "POSITIVE_SHARE_LOW"), "direction_share": (">=", 0.5, "DIRECTION_UNSTABLE"), "icir": (">=", 0.0, "POOLED_ICIR_LOW"),
    "worst_icir": (">=", -0.3, "WORST_ICIR_LOW"), "turnover": ("<=", 0.9, "TURNOVER_HIGH"), "coverage": (">=", 0.5, "COVERAGE_LOW"),
    "mean_icir": (">=", 0.0, "MEAN_FOLD_ICIR_LOW"), "long_short": (">=", 0.0, "LONG_SHORT_SHARPE_LOW"), "monotonicity": (">=", 0.0, "NOT_MONOTONIC"),
    "horizon_share": (">=", 1.0, "HORIZON_SIGN_INCONSISTENT"), "significant_share": (">=", 0.5, "HAC_SIGNIFICANCE_LOW"), "q_value": ("<=", 0.1, "Q_VALUE_HIGH"),
}


def hac_sql(name: str, series: str, keys: str, lags: int = 4) -> str:
    """A CTE of the mean of x and its two-sided HAC p-value by ``keys``."""
    back = ", ".join(f"c * lag(c, {k}) OVER (PARTITION BY {keys} ORDER BY wk) AS l{k}" for k in range(1, lags + 1))
    total = " + ".join(f"greatest(1 - {k} / (least({lags}, count(*) - 1) + 1), 0) * coalesce(sum(l{k}), 0)" for k in range(1, lags + 1))
    return f"""{name}_t AS (SELECT {keys}, avg(x) AS mean, count(*) AS n, sqrt(greatest((sum(c * c) + 2 * ({total})) / count(*), 0) / count(*)) AS se
  FROM (SELECT *, {back} FROM (SELECT *, x - avg(x) OVER (PARTITION BY {keys}) AS c FROM {series}) AS a) AS b GROUP BY ALL),
{name} AS (SELECT {keys}, mean, CASE WHEN n >= 2 AND se > 1e-15 THEN 2 * {normal_upper_sql('abs(mean / se)')} ELSE 1 END AS p_value FROM {name}_t)"""


GATED = REPORT + QP[len(CAND):] + """, cov AS (SELECT candidate, count(value) FILTER (is_complete) / count(*) FILTER (is_complete) AS coverage FROM obs GROUP BY 1),
tt AS (SELECT candidate, avg(turnover) AS turnover FROM qt GROUP BY 1), ls AS (SELECT candidate, avg(spread) / stddev_samp(spread) * sqrt(52) AS long_short FROM qs GROUP BY 1),
mo AS (SELECT candidate, corr(b, m) AS monotonicity FROM (SELECT candidate, b, avg(y1) AS m FROM qk GROUP BY 1, 2) AS z GROUP BY 1),
""" + f"""hh AS (SELECT candidate, label_name, wk, (rank() OVER (PARTITION BY candidate, wk, label_name ORDER BY value) + count(*) OVER (PARTITION BY candidate, wk, label_name ORDER BY value)) / 2.0 AS rv,
  (rank() OVER (PARTITION BY candidate, wk, label_name ORDER BY y) + count(*) OVER (PARTITION BY candidate, wk, label_name ORDER BY y)) / 2.0 AS ry
  FROM (SELECT candidate, wk, value, unnest(['y1', 'y2']) AS label_name, unnest([y1, y2]) AS y FROM obs WHERE yr > 1997) AS l WHERE value IS NOT NULL AND y IS NOT NULL),
hi AS (SELECT candidate, label_name, avg(ic) AS m FROM (SELECT candidate, label_name, wk, covar_pop(rv, ry) / nullif(stddev_pop(rv) * stddev_pop(ry), 0) AS ic FROM hh GROUP BY 1, 2, 3 HAVING count(*) >= 5) AS x GROUP BY 1, 2),
hs AS (SELECT candidate, avg(CASE WHEN m * direction > 0 THEN 1.0 ELSE 0 END) AS horizon_share FROM hi JOIN dirs USING (candidate) GROUP BY 1),
sx AS (SELECT candidate, yr, wk, rank_ic * direction AS x FROM ic JOIN dirs USING (candidate) WHERE yr > 1997),
{hac_sql("fo", "sx", "candidate, yr")}, sg AS (SELECT candidate, avg(CASE WHEN p_value <= 0.1 AND mean > 0 THEN 1.0 ELSE 0 END) AS significant_share FROM fo GROUP BY 1),
{hac_sql("po", "sx", "candidate")}, qv AS (SELECT candidate, least(1, min(m * p_value / r) OVER (ORDER BY p_value, candidate ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value
  FROM (SELECT *, row_number() OVER (ORDER BY p_value, candidate) AS r, count(*) OVER () AS m FROM po) AS x),
""" + """ga AS (SELECT * FROM rep JOIN pool USING (candidate) JOIN cov USING (candidate) JOIN tt USING (candidate) JOIN ls USING (candidate) JOIN mo USING (candidate) JOIN hs USING (candidate) JOIN sg USING (candidate) JOIN qv USING (candidate)),
gc AS (SELECT *, concat_ws(',', CASE WHEN positive_share < 0.5 THEN 'POSITIVE_SHARE_LOW' END, CASE WHEN direction_share < 0.5 THEN 'DIRECTION_UNSTABLE' END, CASE WHEN icir < 0 THEN 'POOLED_ICIR_LOW' END, CASE WHEN worst_icir < -0.3 THEN 'WORST_ICIR_LOW' END,
  CASE WHEN turnover > 0.9 THEN 'TURNOVER_HIGH' END, CASE WHEN coverage < 0.5 THEN 'COVERAGE_LOW' END, CASE WHEN mean_icir < 0 THEN 'MEAN_FOLD_ICIR_LOW' END, CASE WHEN long_short < 0 THEN 'LONG_SHORT_SHARPE_LOW' END, CASE WHEN monotonicity < 0 THEN 'NOT_MONOTONIC' END,
  CASE WHEN horizon_share < 1 THEN 'HORIZON_SIGN_INCONSISTENT' END, CASE WHEN significant_share < 0.5 THEN 'HAC_SIGNIFICANCE_LOW' END, CASE WHEN q_value > 0.1 THEN 'Q_VALUE_HIGH' END) AS codes FROM ga)
"""


def gated(spark, sf):
    o = obs(spark, sf)
    cov = ev.coverage(o, ["candidate"], "value", F.col("is_complete")).select("candidate", "coverage")
    t = ev.quantile_diagnostics(o, ["candidate"], "wk", "asset", "value", "y1", 5, 10, 52.0).select("candidate", F.col("mean_turnover").alias("turnover"), F.col("long_short_sharpe").alias("long_short"))
    held = ev.quantile_portfolios(o, ["candidate"], "wk", "asset", "value", "y1", 5, 10)
    mono = xs.spread_and_monotonicity(held, ["candidate"], "bucket", "y1", 5, ranked=False).select("candidate", "monotonicity")
    rep = walk_forward_report(spark, sf).join(cov, "candidate").join(t, "candidate").join(mono, "candidate")
    ic = stored_ic(spark, sf)
    way = ev.train_direction(ic, ["candidate"], F.col("yr") <= 1997).select("candidate", "direction")
    tested = cut_lineage(ic.where("yr > 1997").join(way, "candidate").withColumn("signed", F.col("rank_ic") * F.col("direction")), "tested")
    sure = st.newey_west(tested, ["candidate", "yr"], "wk", "signed", 4)
    sure = sure.groupBy("candidate").agg(F.avg(((F.col("p_value") <= 0.1) & (F.col("mean") > 0)).cast("double")).alias("significant_share"))
    q = st.newey_west(tested, ["candidate"], "wk", "signed", 4).withColumn("family", F.lit("weekly"))
    q = st.adjust_pvalues(q, ["family"], "candidate", "p_value").select("candidate", F.col("bh").alias("q_value"))
    far = ev.ic_decay(o.where("yr > 1997"), ["candidate"], "value", ["y1", "y2"], "wk", 5).join(way, "candidate")
    far = far.groupBy("candidate").agg(F.avg((F.col("ic_mean") * F.col("direction") > 0).cast("double")).alias("horizon_share"))
    rep = rep.join(far, "candidate").join(sure, "candidate").join(q, "candidate")
    return ev.gate_candidates(rep, GATES, 0.5)


@query("ev30_candidate_gate", GATED + """SELECT candidate, codes, codes = '' AS passed, round(CASE WHEN codes = '' THEN greatest(icir, 1e-12) * positive_share * direction_share * (greatest(monotonicity, 0) * 0.5 + 0.5) * sqrt(greatest(coverage, 1e-12)) * (1 - q_value * 0.5) / (1 + 0.5 * turnover) ELSE 0 END, 6) + 0.0 AS score FROM gc""")
def ev30(spark, sf):
    return published(gated(spark, sf).select("candidate", "codes", "passed", "score"))


@query("ev31_greedy_selection", (GATED + """, sc AS (SELECT candidate, abs(icir) + 0.001 AS score FROM gc),
pk AS (SELECT 0 AS place, CAST([] AS VARCHAR[]) AS chosen, true AS more
  UNION ALL SELECT place + 1, list_append(chosen, b), b IS NOT NULL FROM (SELECT place, chosen, (SELECT arg_min(candidate, (-score, candidate)) FROM sc WHERE score > 0 AND NOT list_contains(chosen, candidate)
    AND NOT EXISTS (SELECT 1 FROM nearby WHERE (l = candidate AND list_contains(chosen, r)) OR (r = candidate AND list_contains(chosen, l)))) AS b FROM pk WHERE more AND place < 3) AS z WHERE b IS NOT NULL),
pc AS (SELECT chosen FROM pk ORDER BY place DESC LIMIT 1)
SELECT 'weekly' AS family, candidate, round(score, 6) AS score, round(greatest(score, 1e-12) / sum(greatest(score, 1e-12)) OVER (), 6) AS weight, CAST(list_position(chosen, candidate) AS BIGINT) AS place FROM sc, pc WHERE list_contains(chosen, candidate)""")
    .replace("WITH ticks", "WITH RECURSIVE ticks").replace(", sc AS", PAIRS[len(CAND):] + ", nearby AS (SELECT l, r FROM rho GROUP BY 1, 2 HAVING abs(avg(rho)) > 0.5), sc AS"))
def ev31(spark, sf):
    s = gated(spark, sf).select(F.lit("weekly").alias("family"), "candidate", (F.abs("icir") + 0.001).alias("score"))
    rho = gram.mean_rank_correlation(candidates(spark, sf), "wk", FEATS, 5).drop("weighting", "periods")
    return published(ev.greedy_selection(s, rho.withColumn("family", F.lit("weekly")), "family", 3, 0.5))


@query("ev32_strategy_correlation", CAND + """, s AS (SELECT wk, avg(y1) FILTER (mom1 > 0) AS a, avg(y1) FILTER (loc > 0) AS b, avg(y1) AS c FROM cw WHERE y1 IS NOT NULL GROUP BY 1)
SELECT 'a' AS factor_a, 'b' AS factor_b, count(*) AS days, round(CASE WHEN count(*) FILTER (a IS NULL OR b IS NULL) = 0 THEN corr(a, b) END, 6) + 0.0 AS rho FROM s
UNION ALL SELECT 'a', 'c', count(*), round(CASE WHEN count(*) FILTER (a IS NULL OR c IS NULL) = 0 THEN corr(a, c) END, 6) + 0.0 FROM s UNION ALL SELECT 'b', 'c', count(*), round(CASE WHEN count(*) FILTER (b IS NULL OR c IS NULL) = 0 THEN corr(b, c) END, 6) + 0.0 FROM s""")
def ev32(spark, sf):
    s = candidates(spark, sf).where("y1 IS NOT NULL").groupBy("wk").agg(
        F.avg(F.when(F.col("mom1") > 0, F.col("y1"))).alias("a"), F.avg(F.when(F.col("loc") > 0, F.col("y1"))).alias("b"), F.avg("y1").alias("c"))
    return published(gram.series_correlation(s.drop("wk"), ["a", "b", "c"]))


@query("ev33_structural_novelty", """WITH m AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT (SELECT count(*) FROM m) AS manual, (SELECT count(*) FROM p) AS programmatic, count(*) AS agent, count(*) FILTER (k IN (FROM m)) AS agent_and_manual, count(*) FILTER (k IN (FROM p)) AS agent_and_programmatic, count(*) FILTER (k NOT IN (FROM m) AND k NOT IN (FROM p)) AS agent_new FROM a""")
def ev33(spark, sf):
    o = table(spark, sf, "orders")
    return ev.novelty(o.where("o_orderpriority = '1-URGENT'"), o.where("o_totalprice > 400000"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query("ev36_factor_series", CAND + """SELECT candidate, strftime(wk, '%Y-%m-%d') AS wk, 'ic' AS kind, 'rank_ic' AS metric, round(rank_ic, 6) + 0.0 AS value FROM ic
UNION ALL SELECT candidate, strftime(wk, '%Y-%m-%d'), 'count', 'breadth', CAST(breadth AS DOUBLE) FROM ic""")
def ev36(spark, sf):
    return published(ev.metric_series(period_ic(spark, sf), CT, {"rank_ic": "ic", "breadth": "count"}))


TRIAL = CAND + """, th AS (SELECT candidate, wk, asset, value, y1, count(y1) OVER (PARTITION BY candidate, wk) AS h FROM obs WHERE value IS NOT NULL),
tk AS (SELECT *, (rank() OVER (PARTITION BY candidate, wk ORDER BY value) + count(*) OVER (PARTITION BY candidate, wk ORDER BY value)) / 2.0 AS r FROM th WHERE h > 0),
tc AS (SELECT *, r - avg(r) OVER (PARTITION BY candidate, wk) AS c FROM tk), tw AS (SELECT *, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY candidate, wk), 0), 0) AS w FROM tc),
tp AS (SELECT candidate, wk, count(*) AS breadth, sum(w * y1) AS gross, count(*) FILTER (y1 IS NULL AND w <> 0) AS missing_labels FROM tw GROUP BY 1, 2),
ti AS (SELECT candidate, wk, row_number() OVER (PARTITION BY candidate ORDER BY wk) AS i FROM tp),
tg AS (SELECT ti.candidate, ti.wk, i, a.asset, coalesce(tw.w, 0) AS w FROM ti CROSS JOIN (SELECT DISTINCT asset FROM obs) AS a LEFT JOIN tw ON tw.candidate = ti.candidate AND tw.wk = ti.wk AND tw.asset = a.asset),
tt AS (SELECT candidate, wk, 0.5 * sum(abs(w - p)) AS turnover FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY candidate, asset ORDER BY i), 0) AS p FROM tg) AS z GROUP BY 1, 2),
trace AS (SELECT candidate, wk, breadth, gross, missing_labels, turnover, turnover * 2 * 5 / 10000 AS cost, gross - turnover * 2 * 5 / 10000 AS net FROM tp JOIN tt USING (candidate, wk))
"""


@query("ev38_trial_trace", pub(TRIAL + "SELECT * FROM trace", "gross turnover cost net", "wk"))
def ev38(spark, sf):
    return published(ev.trial_trace(obs(spark, sf), ["candidate"], "wk", "asset", "value", "y1", 5.0))


@query("ev39_oos_returns", pub(TRIAL + """, r AS (SELECT candidate, wk, net / 20 AS r FROM trace), n AS (SELECT *, product(1 + r) OVER (PARTITION BY candidate ORDER BY wk) AS nav FROM r), d AS (SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY candidate ORDER BY wk)) - 1 AS dd FROM n)
SELECT candidate, count(*) AS periods, product(1 + r) - 1 AS total_return, avg(r) * 252 AS annual_mean, stddev_samp(r) * sqrt(252) AS annual_vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(dd) AS max_drawdown FROM d GROUP BY 1""", "total_return annual_mean annual_vol sharpe max_drawdown"))
def ev39(spark, sf):
    t = ev.trial_trace(obs(spark, sf), ["candidate"], "wk", "asset", "value", "y1", 5.0)
    return published(ev.return_summary(t.select("candidate", "wk", (F.col("net") / 20).alias("r")), ["candidate"], "r", "wk", 252.0))


@query("ev40_slot_accounting", """WITH v AS (SELECT event_type AS arm, user_id, value > 5 AS ok FROM events)
SELECT arm, count(*) AS slots, count(*) FILTER (NOT ok) AS invalid, count(DISTINCT CASE WHEN ok THEN user_id END) AS accepted, count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN user_id END) AS duplicate,
  round(count(DISTINCT CASE WHEN ok THEN user_id END) / count(*), 6) AS accept_rate FROM v GROUP BY 1""")
def ev40(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "arm")
    return published(ev.slot_accounting(e, "arm", "user_id", "ts", F.col("value") > 5))


# --- folds ----------------------------------------------------------------------------

CALX = PANELS + ", cal AS (SELECT wk, row_number() OVER (ORDER BY wk) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT wk FROM weekly))\n"
WF = CALX + """, fd AS (SELECT unnest(generate_series(0, (SELECT (any_value(n) - (104 + 3 + 26)) // 26 FROM cal))) AS fold),
folds AS (SELECT CAST(fold AS BIGINT) AS fold, (SELECT wk FROM cal WHERE i = fold * 26) AS train_start, (SELECT wk FROM cal WHERE i = fold * 26 + 103) AS train_end, (SELECT wk FROM cal WHERE i = fold * 26 + 107) AS test_start, (SELECT wk FROM cal WHERE i = fold * 26 + 132) AS test_end FROM fd)
"""


def week_folds(spark, sf):
    return fo.purged_folds(weekly(spark, sf).select("wk"), "wk", 104, 26, 26, 2, 1)


@query("wf01_purged_folds", pub(WF + "SELECT * FROM folds", dates="train_start train_end test_start test_end"))
def wf01(spark, sf):
    return published(week_folds(spark, sf))


@query("wf01b_expanding_folds", pub(WF + "SELECT fold, (SELECT min(wk) FROM cal) AS train_start, train_end, test_start, test_end FROM folds", dates="train_start train_end test_start test_end"))
def wf01b(spark, sf):
    return published(fo.purged_folds(weekly(spark, sf).select("wk"), "wk", 104, 26, 26, 2, 1, expanding=True))


@query("wf03_nested_folds", pub(WF + """, ic0 AS (SELECT folds.fold AS outer_fold, c.wk, row_number() OVER (PARTITION BY folds.fold ORDER BY c.wk) - 1 AS i FROM folds JOIN cal AS c ON c.wk BETWEEN train_start AND train_end)
SELECT outer_fold, CAST(k AS BIGINT) AS fold, max(wk) FILTER (i = k * 13) AS train_start, max(wk) FILTER (i = k * 13 + 51) AS train_end, max(wk) FILTER (i = k * 13 + 54) AS test_start, max(wk) FILTER (i = k * 13 + 66) AS test_end
FROM ic0, (SELECT unnest(generate_series(0, (104 - 67) // 13)) AS k) AS kk GROUP BY 1, 2""", dates="train_start train_end test_start test_end"))
def wf03(spark, sf):
    return published(fo.nested_folds(weekly(spark, sf), week_folds(spark, sf), "wk", 52, 13, 13, 1, 1))


@query("wf04_fold_tagging", pub(WF + """, d AS (SELECT fold, 'train' AS role, train_start AS a, train_end AS b FROM folds UNION ALL SELECT fold, 'test', test_start, test_end FROM folds)
SELECT fold, role, asset, count(*) AS rows, avg(CASE WHEN t.wk2 <= b THEN t.y END) AS mean_label FROM (SELECT asset, wk, lead(wk) OVER (PARTITION BY asset ORDER BY wk) AS wk2, lead(close) OVER (PARTITION BY asset ORDER BY wk) / close - 1 AS y FROM weekly) AS t JOIN d ON t.wk BETWEEN a AND b GROUP BY 1, 2, 3""", "mean_label"))
def wf04(spark, sf):
    """Labels whose target leaves the role's range are dropped."""
    w = Window.partitionBy("asset").orderBy("wk")
    p = weekly(spark, sf).select("asset", "wk", F.lead("wk").over(w).alias("wk2"), (F.lead("close").over(w) / F.col("close") - 1).alias("y"))
    d = fo.tag(p, week_folds(spark, sf), "wk")
    y = F.when(F.col("wk2") <= F.col("role_end"), F.col("y"))
    return published(d.groupBy("fold", "role", "asset").agg(F.count("*").alias("rows"), F.avg(y).alias("mean_label")))


@query("wf06_thirds", CALX + """SELECT strftime(wk, '%Y-%m-%d') AS wk, CASE WHEN i + 1 IN (n // 3, 2 * n // 3) THEN 'purge' WHEN i + 1 < n // 3 THEN 'development' WHEN i + 1 < 2 * n // 3 THEN 'validation' ELSE 'outer_exploratory' END AS part FROM cal""")
def wf06(spark, sf):
    return published(fo.thirds(weekly(spark, sf), "wk"))


@query("wf07_gap_minutes", WF + """, g AS (SELECT fold, count(d) * 480 AS m FROM folds LEFT JOIN (SELECT DISTINCT d FROM daily WHERE isodow(d) < 6) AS s ON d > train_end AND d < test_start GROUP BY 1)
SELECT fold, CAST(m AS BIGINT) AS gap_minutes, m >= 9000 AS sufficient FROM g""")
def wf07(spark, sf):
    s = daily(spark, sf).where(F.weekday("d") < 5).select(F.col("d").alias("session_date")).distinct().withColumn("minutes", F.lit(480).cast("bigint"))
    return published(fo.gap_minutes(week_folds(spark, sf), s, 9000))


@query("wf09_nested_selection", WF + CAND[len(PANELS):] + """, tr AS (SELECT fold, candidate, avg(rank_ic) AS s FROM ic JOIN folds ON wk BETWEEN train_start AND train_end GROUP BY 1, 2),
te AS (SELECT fold, candidate, avg(rank_ic) AS t, count(*) AS periods FROM ic JOIN folds ON wk BETWEEN test_start AND test_end GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY s DESC, candidate) AS r FROM tr)
SELECT fold AS outer_fold, candidate, round(s, 6) + 0.0 AS inner_score, round(t, 6) + 0.0 AS outer_score, periods FROM b JOIN te USING (fold, candidate) WHERE r = 1""")
def wf09(spark, sf):
    d = cut_lineage(fo.tag(period_ic(spark, sf), week_folds(spark, sf), "wk"), "tagged").withColumnRenamed("fold", "outer_fold")
    inner = d.where("role = 'train'")
    outer = d.where("role = 'test'").groupBy("outer_fold", "candidate").agg(F.avg("rank_ic").alias("outer_score"), F.count("*").alias("periods"))
    return published(fo.choose_by_inner(inner, outer, "rank_ic"))

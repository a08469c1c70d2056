"""Queries over models, market states and allocators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import allocate as al
from marketloom.operators import evaluate as ev
from marketloom.operators import folds as fo
from marketloom.operators import models as md
from marketloom.operators import state as ms
from marketloom.operators import windows as win
from marketloom.plans.evaluation import CAND, FAMILY, TRIAL, WF, family, obs, period_ic, stored_ic, week_folds
from marketloom.plans.factor import BASE, catalog_panel
from marketloom.plans.market import GRID, dense
from marketloom.plans.panel import STATE, market_state
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS, pub
from marketloom.sources.panels import weekly

COV = FAMILY + """, k AS (SELECT wk FROM fam GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT trial) FROM fam)), ag AS (SELECT wk, row_number() OVER (ORDER BY wk DESC) - 1 AS age FROM k),
pw AS (SELECT fam.trial, fam.r, wk, power(0.97, age) AS w FROM fam JOIN ag USING (wk)), pr AS (SELECT a.trial AS asset_i, b.trial AS asset_j, a.r AS x, b.r AS y, a.w FROM pw AS a JOIN pw AS b USING (wk)),
ew AS (SELECT asset_i, asset_j, sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w) AS c FROM pr GROUP BY 1, 2), eq AS (SELECT asset_i, asset_j, covar_pop(x, y) AS c FROM pr GROUP BY 1, 2)
"""


def trials(spark, sf):
    return family(spark, sf).select(F.col("trial").alias("asset"), "wk", "r")


@query("md01_ewma_covariance", COV + "SELECT asset_i, asset_j, round(CASE WHEN asset_i = asset_j THEN c ELSE 0.9 * c END, 8) + 0.0 AS cov FROM ew")
def md01(spark, sf):
    return published(md.ewma_covariance(trials(spark, sf), "wk", "asset", "r", 0.97, 0.1), 8)


@query("md02_oas_covariance", COV + """, g AS (SELECT (SELECT count(*) FROM k) AS n, count(*) FILTER (asset_i = asset_j) AS p, sum(c) FILTER (asset_i = asset_j) AS t, avg(c * c) AS al FROM eq),
s AS (SELECT t / p AS mu, greatest(0, least(1, (al + t / p * t / p) / ((n + 1) * (al - t / p * t / p / p)))) AS sh FROM g)
SELECT asset_i, asset_j, round((1 - sh) * c + CASE WHEN asset_i = asset_j THEN sh * mu ELSE 0 END, 8) + 0.0 AS cov, round(sh, 8) AS shrinkage FROM eq, s""")
def md02(spark, sf):
    return published(md.oas_covariance(trials(spark, sf), "wk", "asset", "r"), 8)


@query("md03_pca_risk")
def md03(spark, sf):
    p = md.pca_risk(trials(spark, sf), "wk", "asset", "r", 3, 1e-8)
    return published(p.select("asset", F.element_at("loadings", 1).alias("loading1"), "idiosyncratic", "explained"))


@query("md03b_eigen_floor")
def md03b(spark, sf):
    return published(md.eigen_floor(md.ewma_covariance(trials(spark, sf), "wk", "asset", "r", 0.97, 0.1), 1e-8), 8)


AR = PANELS + ", r AS (SELECT asset, wk, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY wk)) / 20 AS r FROM weekly), x AS (SELECT asset, r AS y, lag(r) OVER (PARTITION BY asset ORDER BY wk) AS x FROM r)\n"


def log_returns(spark, sf):
    return weekly(spark, sf).select("asset", "wk", (F.log(F.col("close") / win.lagged("close", 1, ["asset"], "wk")) / 20).alias("r"))


@query("md04_ar1", pub(AR + "SELECT asset, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, sqrt(regr_sxx(x, y) * (1 - power(corr(y, x), 2)) / (count(*) - 2)) AS residual_std FROM x WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1", "slope intercept residual_std"))
def md04(spark, sf):
    r = log_returns(spark, sf).withColumn("x", F.lag("r").over(Window.partitionBy("asset").orderBy("wk")))
    return published(md.ar1(r, "asset", "x", "r"))


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


#: Normal equations of three lags by determinants.
_SQUARE = [[f"c{min(i, j)}{max(i, j)}" for j in (1, 2, 3)] for i in (1, 2, 3)]
_COEFFICIENTS = ", ".join(f"{_det3([[f'c0{i + 1}' if j == k else _SQUARE[i][j] for j in range(3)] for i in range(3)])} / {_det3(_SQUARE)} AS b{k + 1}" for k in range(3))


@query("md04b_ar_p", pub(PANELS + f""", r AS (SELECT asset, wk, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY wk)) / 20 AS l0 FROM weekly),
x AS (SELECT asset, l0, lag(l0) OVER a AS l1, lag(l0, 2) OVER a AS l2, lag(l0, 3) OVER a AS l3 FROM r WINDOW a AS (PARTITION BY asset ORDER BY wk)),
g AS (SELECT asset, count(*) AS n, {", ".join(f"avg(l{k}) AS m{k}" for k in range(4))}, {", ".join(f"covar_pop(l{i}, l{j}) AS c{i}{j}" for i in range(4) for j in range(i, 4))} FROM x WHERE l0 + l1 + l2 + l3 IS NOT NULL GROUP BY 1),
b AS (SELECT *, {_COEFFICIENTS} FROM g)
SELECT asset, n, m0 - b1 * m1 - b2 * m2 - b3 * m3 AS intercept, b1 AS first, sqrt(n * (c00 - b1 * c01 - b2 * c02 - b3 * c03) / (n - 4)) AS residual_std FROM b""", "intercept first residual_std"))
def md04b(spark, sf):
    out = md.ar_p(log_returns(spark, sf), "asset", "wk", "r", 3)
    return published(out.withColumn("first", F.element_at("coefficients", 1)).drop("coefficients"))


@query("md05_arma")
def md05(spark, sf):
    return published(md.arma11(log_returns(spark, sf), "asset", "wk", "r"), 4)


@query("md05b_garch")
def md05b(spark, sf):
    return published(md.garch11(log_returns(spark, sf), "asset", "wk", "r"), 4)


CALB = CAND + """, zz AS (SELECT candidate, wk, asset, y1 AS y, (value - avg(value) OVER t) / stddev_pop(value) OVER t AS z, count(*) OVER t AS c FROM obs WHERE value IS NOT NULL AND y1 IS NOT NULL WINDOW t AS (PARTITION BY candidate, wk)),
sm AS (SELECT candidate, count(DISTINCT wk) AS periods, count(*) AS n, sum(z) AS sz, sum(y) AS sy, sum(z * z) + 5.0 AS a, sum(z * y) AS szy FROM zz WHERE c >= 10 GROUP BY 1),
ft AS (SELECT candidate, periods, n, (a * sy - sz * szy) / (n * a - sz * sz) AS intercept, (n * szy - sz * sy) / (n * a - sz * sz) AS slope FROM sm),
fr AS (SELECT ft.candidate, any_value(periods) AS periods, any_value(ft.n) AS n, any_value(intercept) AS intercept, any_value(slope) AS slope, sqrt(avg(power(y - intercept - slope * z, 2))) AS residual_std, 1 - sum(power(y - intercept - slope * z, 2)) / (var_pop(y) * count(*)) AS r_squared FROM zz JOIN ft USING (candidate) WHERE c >= 10 GROUP BY 1)
"""


@query("md06_calibration", pub(CALB + "SELECT * FROM fr", "intercept slope residual_std r_squared"))
def md06(spark, sf):
    return published(md.calibrate(obs(spark, sf), ["candidate"], "wk", "value", "y1", 5.0, 10))


@query("md07_forecast_ensemble", pub(CALB + "SELECT asset, wk, sum(0.25 * (intercept + slope * z)) AS mu, sqrt(sum(power(0.25 * residual_std, 2))) AS sigma, count(*) AS members FROM zz JOIN fr USING (candidate) WHERE c >= 10 GROUP BY 1, 2", "mu sigma", "wk"))
def md07(spark, sf):
    from marketloom.operators.cross import zscore_population

    o = obs(spark, sf)
    fit = md.calibrate(o, ["candidate"], "wk", "value", "y1", 5.0, 10)
    s = o.where("value IS NOT NULL AND y1 IS NOT NULL").withColumn("z", zscore_population("value", ["candidate", "wk"], 10)).where("z IS NOT NULL")
    f = md.forecast(s.select("asset", "wk", "candidate", "z"), fit, ["candidate"], "z").withColumn("w", F.lit(0.25))
    return published(md.combine_forecasts(f, ["asset", "wk"], "w"))


@query("md08_drift", pub(AR + "SELECT asset, count(r) AS n, avg(r) AS drift, stddev_samp(r) AS volatility FROM r GROUP BY 1", "drift volatility"))
def md08(spark, sf):
    return published(md.drift(log_returns(spark, sf), ["asset"], "r"))


@query("md09_equal_targets", PANELS + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, round(0.95 / count(*) OVER (PARTITION BY wk), 6) AS weight FROM weekly WHERE is_complete")
def md09(spark, sf):
    return published(md.equal_targets(weekly(spark, sf).where("is_complete").select("asset", "wk"), ["wk"], 0.05))


@query("md10_correlation_matrix", COV + """, e2 AS (SELECT asset_i, asset_j, CASE WHEN asset_i = asset_j THEN c ELSE 0.9 * c END AS c FROM ew), v AS (SELECT asset_i AS a, sqrt(c) AS s FROM e2 WHERE asset_i = asset_j)
SELECT asset_i, asset_j, round(CASE WHEN asset_i = asset_j THEN 1 ELSE greatest(-1, least(1, c / (x.s * y.s))) END, 6) + 0.0 AS rho FROM e2 JOIN v AS x ON asset_i = x.a JOIN v AS y ON asset_j = y.a""")
def md10(spark, sf):
    return published(md.correlation_matrix(md.ewma_covariance(trials(spark, sf), "wk", "asset", "r", 0.97, 0.1)))


@query("fn20_ex_ante_metrics", COV + f""", tg AS (SELECT asset_i AS asset, 1.0 / (SELECT count(*) FROM eq WHERE asset_i = asset_j) AS w FROM eq WHERE asset_i = asset_j), mu AS (SELECT trial AS asset, avg(r) AS mu FROM fam GROUP BY 1)
SELECT round(sum(w * mu), 8) + 0.0 AS expected_return, round(sqrt((SELECT sum(a.w * b.w * c) FROM eq JOIN tg AS a ON asset_i = a.asset JOIN tg AS b ON asset_j = b.asset)), 8) AS volatility, round(sum(abs(w)), 8) AS gross FROM tg JOIN mu USING (asset)""")
def fn20(spark, sf):
    t = trials(spark, sf)
    cov = md.covariance(t, "wk", "asset", "r").select("asset_i", "asset_j", "cov")
    w = md.equal_targets(t.select("asset").distinct().withColumn("book", F.lit("eq")), ["book"], 0.0)
    var = md.portfolio_variance(w, cov, ["book"])
    mu = t.groupBy("asset").agg(F.avg("r").alias("mu"))
    er = w.join(mu, "asset").groupBy("book").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"), F.sum(F.abs("weight")).alias("gross"))
    return published(er.join(var, "book").select("expected_return", F.sqrt("variance").alias("volatility"), "gross"), 8)


# --- states ---------------------------------------------------------------------------

FEATS = PANELS + """, mk AS (SELECT wk, avg(close / open - 1) AS r FROM weekly GROUP BY 1), mf AS (SELECT wk, CASE WHEN count(r) OVER f = 4 THEN avg(r) OVER f END AS trail, CASE WHEN count(r) OVER f = 4 THEN sqrt(avg(r * r) OVER f) END AS vol FROM mk WINDOW f AS (ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def market_features(spark, sf):
    m = weekly(spark, sf).groupBy("wk").agg(F.avg(F.col("close") / F.col("open") - 1).alias("r")).withColumn("market", F.lit("all"))
    return m.select("wk", win.rolling_mean("r", 4, ["market"], "wk").alias("trail"), F.sqrt(win.rolling_mean(F.col("r") * F.col("r"), 4, ["market"], "wk")).alias("vol"))


def _em_sql(rows: str, tol: str = "1e-6") -> str:
    """Two-state diagonal EM over columns x and y: one recursive step a round, until the mean likelihood stands still."""
    def log(j: int) -> str:
        return f"(ln(w{j}) - 0.5 * (power(x - a{j}, 2) / s{j} + ln(2 * pi() * s{j})) - 0.5 * (power(y - b{j}, 2) / t{j} + ln(2 * pi() * t{j})))"

    top = f"greatest({log(0)}, {log(1)})"
    post = f"SELECT em.*, x, y, sx, sy, {top} + ln(exp({log(0)} - {top}) + exp({log(1)} - {top})) AS l, exp({log(0)} - {top}) / (exp({log(0)} - {top}) + exp({log(1)} - {top})) AS p0 FROM em, {rows}, sc WHERE it < 500 AND (prior IS NULL OR abs(now - prior) >= {tol})"
    step = []
    for p, (mx, my) in (("p0", ("sum(p0 * x) / sum(p0)", "sum(p0 * y) / sum(p0)")), ("(1 - p0)", ("sum((1 - p0) * x) / sum(1 - p0)", "sum((1 - p0) * y) / sum(1 - p0)"))):
        step.append((f"sum({p}) / count(*)", mx, my, f"greatest(sum({p} * x * x) / sum({p}) - power({mx}, 2), 1e-6 * any_value(sx))", f"greatest(sum({p} * y * y) / sum({p}) - power({my}, 2), 1e-6 * any_value(sy))"))
    cells = ", ".join(step[j][c] for c in range(5) for j in range(2))
    return f"""sc AS (SELECT quantile_cont(x, 0.25) AS q0, quantile_cont(x, 0.75) AS q1, avg(y) AS my, var_pop(x) AS sx, var_pop(y) AS sy FROM {rows}),
em AS (SELECT 0 AS it, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, q0 AS a0, q1 AS a1, my AS b0, my AS b1, sx AS s0, sx AS s1, sy AS t0, sy AS t1, NULL::DOUBLE AS now, NULL::DOUBLE AS prior FROM sc
  UNION ALL SELECT it + 1, {cells}, avg(l), any_value(now) FROM ({post}) AS e GROUP BY it),
fit AS (SELECT * FROM em ORDER BY it DESC LIMIT 1)"""


@query("st01_mixture_fit", pub(FEATS.replace("WITH ticks", "WITH RECURSIVE ticks") + ", tr AS (SELECT trail AS x, vol AS y FROM mf WHERE wk < '1999-01-01' AND trail IS NOT NULL AND vol IS NOT NULL), " + _em_sql("tr") + """
SELECT CAST(row_number() OVER (ORDER BY trail, vol) - 1 AS INTEGER) AS state, weight, trail, vol FROM (SELECT unnest([w0, w1]) AS weight, unnest([a0, a1]) AS trail, unnest([b0, b1]) AS vol FROM fit)""", "weight trail vol", digits=4).replace("CAST(row_number() OVER (ORDER BY trail, vol) - 1 AS INTEGER)", "row_number() OVER (ORDER BY trail, vol) - 1"))
def st01(spark, sf):
    m = ms.fit_mixture(market_features(spark, sf).where("wk < '1999-01-01'"), ["trail", "vol"], 2)
    rows = ", ".join(f"({j}, {m.weights[j]!r}D, {m.means[j][0]!r}D, {m.means[j][1]!r}D)" for j in range(2))
    return published(spark.sql(f"SELECT * FROM VALUES {rows} AS t(state, weight, trail, vol)"), 4)


FIXED = ms.Mixture(("trail", "vol"), (0.4, 0.6), ((0.2, 0.6), (0.8, 1.5)), ((0.04, 0.09), (0.25, 0.36)))


def dens(x: str, m: float, v: float) -> str:
    return f"-0.5 * (power({x} - {m}, 2) / {v} + ln({v}))"


@query("st02_state_projection", FEATS + f""", q AS (SELECT wk, CASE WHEN wk < '1999-01-01' THEN 'FIT_HISTORY_NOT_PROJECTION' WHEN trail IS NULL THEN 'FEATURE_UNAVAILABLE' END AS reason,
  ln(0.4) + {dens('trail', 0.2, 0.04)} + {dens('vol', 0.6, 0.09)} AS a, ln(0.6) + {dens('trail', 0.8, 0.25)} + {dens('vol', 1.5, 0.36)} AS b FROM mf)
SELECT strftime(wk, '%Y-%m-%d') AS wk, reason, round(CASE WHEN reason IS NULL THEN exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) END, 6) AS p0,
  round(CASE WHEN reason IS NULL THEN exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) END, 6) AS p1 FROM q""")
def st02(spark, sf):
    out = ms.project(market_features(spark, sf), FIXED, "1999-01-01", "wk", "wk")
    return published(out.select("wk", "reason", "p0", "p1"))


@query("st02b_projection_as_of", FEATS + f""", q AS (SELECT wk, CASE WHEN wk + INTERVAL 7 DAY > TIMESTAMP '1999-06-01' THEN 'OBSERVATION_NOT_AVAILABLE' WHEN wk < '1999-01-01' THEN 'FIT_HISTORY_NOT_PROJECTION'
  WHEN wk + INTERVAL 7 DAY < TIMESTAMP '1999-02-15' THEN 'MODEL_NOT_AVAILABLE' WHEN trail IS NULL THEN 'FEATURE_UNAVAILABLE' END AS reason,
  ln(0.4) + {dens('trail', 0.2, 0.04)} + {dens('vol', 0.6, 0.09)} AS a, ln(0.6) + {dens('trail', 0.8, 0.25)} + {dens('vol', 1.5, 0.36)} AS b FROM mf)
SELECT strftime(wk, '%Y-%m-%d') AS wk, reason, round(CASE WHEN reason IS NULL THEN exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) END, 6) AS p0 FROM q""")
def st02b(spark, sf):
    """What was known on a day: later rows and rows before the model's release have no probabilities."""
    m = market_features(spark, sf).withColumn("known", F.date_add("wk", 7))
    out = ms.project(m, FIXED, "1999-01-01", "wk", "known", "1999-06-01", "1999-02-15")
    return published(out.select("wk", "reason", "p0"))


@query("gr13_state_transitions", STATE + "SELECT 'all' AS series, p AS from_state, state AS to_state, count(*) AS n FROM (SELECT wk, state, lag(state) OVER (ORDER BY wk) AS p FROM state) AS z WHERE p <> state GROUP BY 2, 3")
def gr13(spark, sf):
    return ms.transitions(market_state(spark, sf).withColumn("series", F.lit("all")), ["series"], "wk", "state")


# --- allocators -----------------------------------------------------------------------

HIST = CAND + """, si AS (SELECT wk, row_number() OVER (ORDER BY wk) AS i FROM (SELECT DISTINCT wk FROM ic)), hs AS (SELECT ic.candidate, ic.wk, i, rank_ic FROM ic JOIN si USING (wk)),
tq AS (SELECT candidate, wk, CASE WHEN count(rank_ic) OVER w >= 8 THEN avg(rank_ic) OVER w END AS q FROM hs WINDOW w AS (PARTITION BY candidate ORDER BY i RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING)),
pq AS (SELECT candidate, wk, greatest(coalesce(q, 0), 0) AS q FROM tq), aw AS (SELECT candidate, wk, CASE WHEN sum(q) OVER t > 0 THEN q / sum(q) OVER t ELSE 1.0 / count(*) OVER t END AS weight, NOT sum(q) OVER t > 0 AS fallback FROM pq WINDOW t AS (PARTITION BY wk))
"""


def rolling_weights(spark, sf):
    return al.rolling_allocator(stored_ic(spark, sf).select("candidate", "wk", "rank_ic"), "wk", "rank_ic", 26, 8)


@query("al01_rolling_allocator", HIST + "SELECT candidate, strftime(wk, '%Y-%m-%d') AS wk, round(weight, 6) + 0.0 AS weight, fallback FROM aw")
def al01(spark, sf):
    return published(rolling_weights(spark, sf).select("candidate", "wk", "weight", "fallback"))


PROB = """, pb AS (SELECT wk, unnest(['lo', 'hi']) AS state, unnest([1 - month(wk) / 12.0, month(wk) / 12.0]) AS p FROM (SELECT DISTINCT wk FROM weekly))"""


def month_probabilities(spark, sf):
    hi = F.month("wk") / 12.0
    cells = F.array(F.struct(F.lit("lo").alias("state"), (1 - hi).alias("p")), F.struct(F.lit("hi").alias("state"), hi.alias("p")))
    return weekly(spark, sf).select("wk").distinct().select("wk", F.explode(cells).alias("s")).select("wk", "s.*")


@query("al02_regime_allocator", HIST + PROB + """, sq AS (SELECT candidate, wk, state, p, CASE WHEN count(*) FILTER (p > 0) OVER w >= 8 THEN sum(rank_ic * p) FILTER (p > 0) OVER w / sum(p) FILTER (p > 0) OVER w END AS q FROM hs JOIN pb USING (wk) WINDOW w AS (PARTITION BY candidate, state ORDER BY i RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING)),
sp AS (SELECT *, greatest(coalesce(q, 0), 0) AS g FROM sq), sw AS (SELECT *, CASE WHEN sum(g) OVER t > 0 THEN g / sum(g) OVER t ELSE 1.0 / count(*) OVER t END AS part, NOT sum(g) OVER t > 0 AS fb FROM sp WINDOW t AS (PARTITION BY wk, state))
SELECT candidate, strftime(wk, '%Y-%m-%d') AS wk, round(sum(p * part), 6) + 0.0 AS weight, count(*) FILTER (fb AND p > 0) AS failed_states FROM sw GROUP BY 1, 2""")
def al02(spark, sf):
    ic = stored_ic(spark, sf).select("candidate", "wk", "rank_ic")
    return published(al.regime_allocator(ic, month_probabilities(spark, sf), "wk", "rank_ic", 26, 8))


def ridge_examples(spark, sf):
    ic = stored_ic(spark, sf).select("candidate", "wk", "rank_ic")
    q = al.trailing_quality(ic, "wk", "rank_ic", 26, 8).withColumnRenamed("quality", "x1")
    return al.trailing_quality(q, "wk", "rank_ic", 8, 4).withColumnRenamed("quality", "x2")


@query("al03_ridge_meta", HIST + """, ex AS (SELECT hs.candidate, hs.wk, CASE WHEN count(rank_ic) OVER a >= 8 THEN avg(rank_ic) OVER a END AS x1, CASE WHEN count(rank_ic) OVER b >= 4 THEN avg(rank_ic) OVER b END AS x2, rank_ic AS y FROM hs
  WINDOW a AS (PARTITION BY candidate ORDER BY i RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY candidate ORDER BY i RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)),
g AS (SELECT candidate, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(y) AS my, count(*) * covar_pop(x1, x2) / (stddev_pop(x1) * stddev_pop(x2)) AS a, count(*) * covar_pop(x1, y) / stddev_pop(x1) AS b1, count(*) * covar_pop(x2, y) / stddev_pop(x2) AS b2, count(*) + 2.0 AS d FROM ex WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY 1),
u AS (SELECT *, (d * b1 - a * b2) / (d * d - a * a) AS u1, (d * b2 - a * b1) / (d * d - a * a) AS u2 FROM g)
SELECT candidate, n, round(m1, 6) + 0.0 AS m1, round(m2, 6) + 0.0 AS m2, round(s1, 6) AS s1, round(s2, 6) AS s2, round(CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN greatest(b1, 0) >= greatest(b2, 0) THEN greatest(b1, 0) / d ELSE 0 END, 6) + 0.0 AS coef1,
  round(CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN greatest(b1, 0) >= greatest(b2, 0) THEN 0 ELSE greatest(b2, 0) / d END, 6) + 0.0 AS coef2, round(my, 6) + 0.0 AS intercept, CAST(NULL AS VARCHAR) AS reason FROM u""")
def al03(spark, sf):
    return published(al.ridge_meta(ridge_examples(spark, sf), ["candidate"], "x1", "x2", "rank_ic", 2.0, 20))


@query("al04_weight_metrics", HIST + """, x AS (SELECT candidate, w.wk, coalesce(weight, 0) AS w, row_number() OVER (PARTITION BY c.candidate ORDER BY w.wk) AS i FROM (SELECT DISTINCT wk FROM aw) AS w CROSS JOIN (SELECT DISTINCT candidate FROM aw) AS c LEFT JOIN aw USING (candidate, wk)),
t AS (SELECT wk, 0.5 * sum(abs(w - p)) AS turnover FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY candidate ORDER BY wk), 0) AS p FROM x) AS z GROUP BY 1), h AS (SELECT wk, sum(weight * weight) AS hhi, bool_or(fallback) AS fb FROM aw GROUP BY 1)
SELECT 'rolling' AS allocator, count(*) AS sessions, round(avg(hhi), 6) AS concentration, round(avg(turnover), 6) AS mean_turnover, CAST(sum(CASE WHEN fb THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks FROM h JOIN t USING (wk)""")
def al04(spark, sf):
    w = rolling_weights(spark, sf).withColumn("allocator", F.lit("rolling"))
    return published(al.weight_metrics(w, ["allocator"], "wk", F.col("fallback")))


@query("al05_conditional_nav", PANELS + PROB + """, e AS (SELECT asset, wk, lag(wk) OVER a AS pw, close / lag(close) OVER a - 1 AS chg FROM weekly WINDOW a AS (PARTITION BY asset ORDER BY wk))
SELECT asset, state, round(sum(chg * p) FILTER (p > 0) / sum(p) FILTER (p > 0), 6) + 0.0 AS mean_change, count(*) AS intervals FROM e JOIN pb ON e.pw = pb.wk GROUP BY 1, 2""")
def al05(spark, sf):
    out = al.conditional_change(weekly(spark, sf).select("asset", "wk", "close"), month_probabilities(spark, sf), ["asset"], "wk", "close")
    return published(out)


@query("al06_factor_library", CAND + "," + PROB[2:] + """, sm AS (SELECT candidate, state, sum(rank_ic * p) FILTER (p > 0) / sum(p) FILTER (p > 0) AS state_ic, count(*) AS periods FROM ic JOIN pb USING (wk) GROUP BY 1, 2),
cv AS (SELECT candidate, count(value) FILTER (is_complete) / count(*) FILTER (is_complete) AS coverage FROM obs GROUP BY 1)
SELECT candidate, state, round(state_ic, 6) + 0.0 AS state_ic, periods, round(coverage, 6) AS coverage FROM sm JOIN cv USING (candidate)""")
def al06(spark, sf):
    from marketloom.functions.numeric import weighted_mean

    ic = period_ic(spark, sf).join(month_probabilities(spark, sf), "wk")
    s = ic.groupBy("candidate", "state").agg(weighted_mean("rank_ic", "p").alias("state_ic"), F.count("*").alias("periods"))
    cov = ev.coverage(obs(spark, sf), ["candidate"], "value", F.col("is_complete")).select("candidate", "coverage")
    return published(s.join(cov, "candidate"))


@query("al07_completed_session", GRID + """, s AS (SELECT asset, session_date, slot, close, (close - low) / nullif(high - low, 0) AS sig FROM dense), j AS (SELECT s.session_date, s.slot, s.sig, t.close / s.close - 1 AS y FROM s JOIN s AS t ON s.asset = t.asset AND s.session_date = t.session_date AND t.slot = s.slot + 1),
r AS (SELECT session_date, slot, (rank() OVER (PARTITION BY session_date, slot ORDER BY sig) + count(*) OVER (PARTITION BY session_date, slot ORDER BY sig)) / 2.0 AS a, (rank() OVER (PARTITION BY session_date, slot ORDER BY y) + count(*) OVER (PARTITION BY session_date, slot ORDER BY y)) / 2.0 AS b FROM j WHERE sig IS NOT NULL AND y IS NOT NULL),
i AS (SELECT session_date, slot, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT 'loc' AS candidate, strftime(session_date, '%Y-%m-%d') AS session_date, count(ic) AS decisions, round(avg(ic), 6) + 0.0 AS session_ic FROM i GROUP BY 2""")
def al07(spark, sf):
    d = dense(spark, sf).withColumns({"candidate": F.lit("loc"), "sig": F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))})
    out = al.completed_session(d.select("candidate", "session_date", "slot", "asset", "sig", "close"), ["candidate"], "session_date", "slot", "asset", "sig", "close", 1, 3)
    return published(out)


@query("wf08_adaptive_evaluation", pub(WF + TRIAL[len(PANELS):] + "," + HIST[len(CAND) + 1:] + """, pr AS (SELECT wk, sum(weight * net) / 20 AS r FROM aw JOIN trace USING (candidate, wk) GROUP BY 1)
SELECT fold, count(*) AS periods, avg(r) AS mean, stddev_samp(r) AS sd, product(1 + r) - 1 AS total FROM pr JOIN folds ON wk BETWEEN test_start AND test_end GROUP BY 1""", "mean sd total"))
def wf08(spark, sf):
    """Allocator weights on factor returns, scored on each fold's test range only."""
    t = ev.trial_trace(obs(spark, sf), ["candidate"], "wk", "asset", "value", "y1", 5.0).select("candidate", "wk", "net")
    r = rolling_weights(spark, sf).select("candidate", "wk", "weight").join(t, ["candidate", "wk"])
    r = r.groupBy("wk").agg((F.sum(F.col("weight") * F.col("net")) / 20).alias("r"))
    d = fo.tag(r, week_folds(spark, sf), "wk").where("role = 'test'")
    return published(d.groupBy("fold").agg(F.count("*").alias("periods"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), (F.product(F.col("r") + 1) - 1).alias("total")))


@query("xs22_catalog_ic", BASE + """, z AS (SELECT wk, f1, lead(close) OVER (PARTITION BY asset ORDER BY wk) / close - 1 AS y FROM l5), r AS (SELECT wk, (rank() OVER (PARTITION BY wk ORDER BY f1) + count(*) OVER (PARTITION BY wk ORDER BY f1)) / 2.0 AS a, (rank() OVER (PARTITION BY wk ORDER BY y) + count(*) OVER (PARTITION BY wk ORDER BY y)) / 2.0 AS b FROM z WHERE f1 IS NOT NULL AND y IS NOT NULL)
SELECT strftime(wk, '%Y-%m-%d') AS wk, count(*) AS breadth, round(corr(a, b), 6) + 0.0 AS rank_ic FROM r GROUP BY 1 HAVING count(*) >= 5""")
def xs22(spark, sf):
    """A catalog factor end to end: expression, label and rank IC."""
    p = catalog_panel(spark, sf).withColumn("y", F.lead("close").over(Window.partitionBy("asset").orderBy("wk")) / F.col("close") - 1)
    return published(ev.rank_ic(p, ["wk"], "f1", "y", 5))

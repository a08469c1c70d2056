"""Queries over the whole vocabulary of primitive candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import evaluate as ev
from marketloom.operators.primitives import candidate_values, vocabulary
from marketloom.plans.evaluation import CAND, CT, directions
from marketloom.plans.factor import fr
from marketloom.plans.panel import market_state
from marketloom.plans.registry import SQL, published, query
from marketloom.plans.sqltext import PANELS
from marketloom.settings import cut_lineage, shared_dir
from marketloom.sources.panels import weekly

VOCABULARY = vocabulary()
BARS = ["asset", "wk", "yr", "is_complete", "y1", "y2", "nxt"]


def value_sql(kind: str, w: int) -> str:
    before = f"avg(volume) OVER (PARTITION BY asset, yr ORDER BY wk ROWS BETWEEN {w - 1} PRECEDING AND 1 PRECEDING)"
    return {
        "reversal": f"1 - close / lag(close, {w - 1}) OVER s", "momentum": f"close / lag(close, {w - 1}) OVER s - 1", "range_mean": f"avg(rg) OVER {fr(w)}",
        "return_volatility": f"stddev_pop(lr) OVER {fr(w - 1)}", "volume_surprise": f"CASE WHEN {before} > 0 THEN volume / {before} - 1 END",
        "close_location": "CASE WHEN high - low <= 1e-15 THEN 0 ELSE (close - low) / (high - low) - 0.5 END",
    }[kind]


# The rows that the queries of four candidates call ``obs``, here for all candidates; ranks and correlations follow as there.
FULL = PANELS + f""",
pb AS (SELECT *, row_number() OVER a AS n, row_number() OVER s AS p, ln(close / lag(close) OVER s) AS lr, (high - low) / close AS rg, lead(close) OVER a / close - 1 AS y1, lead(close, 2) OVER a / close - 1 AS y2,
  lead(wk) OVER a AS nxt FROM weekly WINDOW a AS (PARTITION BY asset ORDER BY wk), s AS (PARTITION BY asset, yr ORDER BY wk)),
pv AS (SELECT asset, wk, yr, is_complete, n, p, y1, y2, nxt, unnest([{", ".join(f"'{c.name}'" for c in VOCABULARY)}]) AS candidate, unnest([{", ".join(str(c.window) for c in VOCABULARY)}]) AS w,
  unnest([{", ".join(value_sql(c.kind, c.window) for c in VOCABULARY)}]) AS v, unnest([{", ".join(f"bool_and(is_complete) OVER {fr(c.window)}" for c in VOCABULARY)}]) AS whole FROM pb WINDOW s AS (PARTITION BY asset, yr ORDER BY wk)),
pr AS (SELECT *, CASE WHEN n < w THEN 'INSUFFICIENT_HISTORY' WHEN p < w THEN 'CROSS_SESSION_WINDOW' WHEN NOT whole THEN 'INCOMPLETE_BAR' WHEN v IS NULL THEN CASE WHEN candidate LIKE 'volume_surprise%' THEN 'ZERO_REFERENCE_VOLUME' ELSE 'NUMERIC_UNAVAILABLE' END END AS reason FROM pv),
obs AS (SELECT asset, wk, yr, is_complete, candidate, CASE WHEN reason IS NULL THEN v END AS value, reason, y1, y2, nxt FROM pr),
""" + CAND[CAND.index("rk AS ("):].replace("ic AS (", "fic AS (") + ", ic AS (SELECT * FROM fic WHERE rank_ic IS NOT NULL)\n"


def full_sql(name: str) -> str:
    """The SQL of a query over four candidates, over all of them."""
    text = SQL[name]
    if CAND not in text:
        raise ValueError(f"{name} does not read the candidates")
    return text.replace(CAND, FULL)


def full_observations(spark, sf):
    by = Window.partitionBy("asset").orderBy("wk")
    panel = weekly(spark, sf).withColumns({
        "y1": F.lead("close").over(by) / F.col("close") - 1, "y2": F.lead("close", 2).over(by) / F.col("close") - 1, "nxt": F.lead("wk").over(by)})
    return candidate_values(panel, VOCABULARY, BARS, "asset", "yr", "wk")


def full_ic(spark, sf):
    """Periods in which the correlation exists; a candidate whose values are all equal (one return's deviation) has none."""
    return ev.rank_ic(full_observations(spark, sf), [*CT, "yr"], "value", "y1", 5).where("rank_ic IS NOT NULL")


def stored_full_ic(spark, sf):
    return cut_lineage(full_ic(spark, sf), "full-ic")


@query("ev09b_vocabulary_status", full_sql("ev09_candidate_status"))
def ev09b(spark, sf):
    crossing = F.coalesce(F.year("nxt") > F.col("yr"), F.lit(True))
    return published(ev.candidate_status(full_observations(spark, sf), "value", "y1", crossing, 20, "wk", F.col("is_complete")))


@query("ev10b_vocabulary_reasons", FULL + "SELECT candidate, reason, count(*) AS bars, count(value) AS available FROM obs GROUP BY 1, 2")
def ev10b(spark, sf):
    return full_observations(spark, sf).groupBy("candidate", "reason").agg(F.count("*").alias("bars"), F.count("value").alias("available"))


@query("ev11b_vocabulary_cache", FULL + "SELECT asset, strftime(wk, '%Y-%m-%d') AS wk, yr, candidate, round(value, 6) + 0.0 AS value, reason FROM obs")
def ev11b(spark, sf):
    """Every candidate of every bar with value or reason, written by year and read back; bars without a label stay."""
    path = shared_dir(spark, "vocabulary")
    full_observations(spark, sf).select("asset", "wk", "yr", "candidate", "value", "reason").write.partitionBy("yr").parquet(path)
    return published(spark.read.parquet(path))


@query("ev12b_vocabulary_direction", full_sql("ev12_train_direction"))
def ev12b(spark, sf):
    return published(directions(full_ic(spark, sf)))


@query("ev13b_vocabulary_folds", full_sql("ev13_fold_summary"))
def ev13b(spark, sf):
    ic = stored_full_ic(spark, sf)
    return published(ev.fold_summary(ic.where("yr > 1997"), directions(ic).select("candidate", "direction"), ["candidate"], "yr"))


@query("ev14b_vocabulary_regimes", full_sql("ev14_regime_pooled"))
def ev14b(spark, sf):
    reg = market_state(spark, sf).select("wk", F.col("state").alias("regime"))
    return published(ev.pooled_by_regime(full_ic(spark, sf), reg, "wk", ["candidate"], "rank_ic"))


@query("ev15b_vocabulary_robustness", full_sql("ev15_robustness"))
def ev15b(spark, sf):
    ic = stored_full_ic(spark, sf)
    ic = ic.join(directions(ic).select("candidate", "direction"), "candidate")
    slice_ = F.when(F.col("breadth") >= 25, "full").when(F.col("breadth") >= 24, "near").otherwise("thin")
    means = ic.groupBy("candidate", slice_.alias("slice")).agg(F.avg(F.col("rank_ic") * F.col("direction")).alias("mean"))
    return published(ev.robustness(means, ["candidate"], ["full", "near", "thin"], 0.6))


@query("ev16b_vocabulary_years", full_sql("ev16_year_stability"))
def ev16b(spark, sf):
    return published(ev.ic_summary(full_ic(spark, sf), ["candidate", "yr"]))

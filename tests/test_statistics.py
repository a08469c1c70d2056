from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import as_map, close, rows
from marketloom.functions import tails
from marketloom.operators import allocate, evaluate, models, state, stats


def series(spark, n=120, seed=0, trials=4):
    rng = np.random.default_rng(seed)
    data = []
    for k in range(trials):
        e = rng.normal(0.01 * k, 0.1, n)
        data += [("f", f"t{k}", i, float(v)) for i, v in enumerate(e)]
    return spark.createDataFrame(data, "family string, trial string, i int, r double")


def matrix(df):
    return df.toPandas().pivot(index="i", columns="trial", values="r").sort_index()


def test_tail_functions_match_known_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1, 2.228138851986273, 10)], "q double, k int, t double, n int")
    row = df.select(tails.chi2_upper("q", F.col("k")), tails.chi2_upper("q", 2), tails.student_upper("t", F.col("n")), tails.student_upper("t", 1)).first()
    want = (0.05, math.exp(-3.841458820694124 / 2), 0.025, 0.5 - math.atan(2.228138851986273) / math.pi)
    assert all(close(a, b, 1e-12) for a, b in zip(row, want))


def test_normal_tails_and_quantiles_agree_with_the_library(spark):
    z = [-38.0, -9.0, -3.0, -1e-9, 0.0, 0.3, 2.4, 3.53, 3.54, 5.0, 20.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", tails.normal_upper("z")).collect()
    assert all(abs(p - 0.5 * math.erfc(v / math.sqrt(2))) < 1e-15 for v, p in got)
    p = [1e-12, 1e-5, 0.01, 0.3, 0.5, 0.7, 0.999999]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", tails.normal_quantile("p")).collect()
    assert all(close(x, NormalDist().inv_cdf(v), 1e-12) for v, x in got if v != 0.5)
    edge = spark.createDataFrame([(0.0, None), (1.0, float("nan"))], "p double, z double")
    assert [tuple(r) for r in edge.select(tails.normal_quantile("p"), tails.normal_upper("z"), tails.chi2_upper("z", 3), tails.student_upper("z", 3)).collect()] == [(None,) * 4] * 2


def test_tails_agree_with_numerical_integration(spark):
    def integral(f, a, b, n=40_000):
        h = (b - a) / n
        return h / 3 * (f(a) + f(b) + 4 * sum(f(a + h * i) for i in range(1, n, 2)) + 2 * sum(f(a + h * i) for i in range(2, n, 2)))

    for k in (2, 3, 6, 7, 61, 1999, 2000, 2400):
        scale = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi)
        want = 0.5 - scale * integral(lambda x, k=k: (1 + x * x / k) ** (-(k + 1) / 2), 0.0, 1.7)
        assert abs(spark.range(1).select(tails.student_upper(F.lit(1.7), k)).first()[0] - want) < 1e-11
    for k in (3, 4, 9, 12):
        want = 1 - integral(lambda x, k=k: x ** (k / 2 - 1) * math.exp(-x / 2) / 2 ** (k / 2) / math.gamma(k / 2), 0.0, 5.5)
        assert abs(spark.range(1).select(tails.chi2_upper(F.lit(5.5), k)).first()[0] - want) < 1e-6


def test_gram_correlations_equal_pairwise_ranks(spark):
    from marketloom.operators import gram

    rng = np.random.default_rng(11)
    names = [f"c{i}" for i in range(7)]
    data = np.round(rng.normal(size=(90, 7)), 1)
    data[rng.random(data.shape) < 0.15] = np.nan
    data[:, 6] = np.where(np.arange(90) % 3 == 0, 1.0, data[:, 6])
    pdf = pd.DataFrame(data, columns=names).assign(ts=np.arange(90) % 6, w=(np.arange(90) % 6) / 4.0)
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for t, g in pdf.groupby("ts"):
                both = g[[a, b]].dropna().rank()
                if len(both) >= 5 and both[a].std() > 0 and both[b].std() > 0:
                    want.setdefault((a, b), []).append((t / 4.0, both[a].corr(both[b])))
    for block in (3, 100):
        got = gram.mean_rank_correlation(df, "ts", names, 5, {"even": F.lit(1.0), "late": F.col("w")}, block)
        got = {(r["factor_a"], r["factor_b"], r["weighting"]): (r["periods"], r["rho"]) for r in got.collect()}
        for pair, seen in want.items():
            assert got[(*pair, "even")][0] == len(seen) and close(got[(*pair, "even")][1], float(np.mean([v for _, v in seen])), 1e-9)
            assert close(got[(*pair, "late")][1], sum(w * v for w, v in seen) / sum(w for w, _ in seen), 1e-9)
        assert len(got) == 2 * len(want)
    whole = pdf[names].fillna(0.0)
    whole["c1"], whole.loc[4, "c2"] = 2.0, np.nan
    for block in (2, 50):
        got = gram.series_correlation(spark.createDataFrame(whole).replace(float("nan"), None).repartition(5), names, block)
        got = {(r["factor_a"], r["factor_b"]): (r["days"], r["rho"]) for r in got.collect()}
        assert len(got) == 21 and got[("c0", "c1")] == (90, None) and got[("c0", "c2")] == (90, None)
        assert close(got[("c0", "c3")][1], whole["c0"].corr(whole["c3"]), 1e-9)


def test_ar_p_and_many_exposures_against_least_squares(spark):
    from marketloom.operators import cross, models

    rng = np.random.default_rng(5)
    r = rng.normal(size=200).cumsum() * 0.1 + rng.normal(size=200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)] + [("flat", i, 2.0) for i in range(9)] + [("gap", i, None if i == 4 else float(i % 3)) for i in range(20)], "k string, i int, r double")
    got = {x["k"]: x for x in models.ar_p(df, "k", "i", "r", 3).collect()}
    x = np.column_stack([np.ones(197), r[2:-1], r[1:-2], r[:-3]])
    beta, *_ = np.linalg.lstsq(x, r[3:], rcond=None)
    assert got["a"]["n"] == 197 and np.allclose([got["a"]["intercept"], *got["a"]["coefficients"]], beta, atol=1e-9)
    e = r[3:] - x @ beta
    assert close(got["a"]["residual_std"], float(np.sqrt(e @ e / 193)), 1e-9)
    assert got["flat"]["coefficients"] == [0.0] * 3 and got["flat"]["intercept"] == 2.0 and got["gap"]["n"] == 13
    rows_ = [(t, f"a{i}", *map(float, rng.normal(size=3))) for t in (1, None) for i in range(15)]
    rows_ = [(*v, v[3] * 2 - v[4]) for v in rows_] + [(1, "none", None, 1.0, 1.0, 1.0), (2, "few", 1.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows_, "ts int, asset string, f double, v double, p double, spanned double")
    out = cross.neutralized_many(df, "f", ["v", "p", "spanned"], ["ts"], "resid").toPandas()
    for t in (1, None):
        g = out[(out.ts == t) if t else out.ts.isna()].dropna(subset=["f"])
        x = np.column_stack([np.ones(len(g)), g[["v", "p"]].to_numpy()])
        beta, *_ = np.linalg.lstsq(x, g.f.to_numpy(), rcond=None)
        assert np.allclose(g.resid, g.f - x @ beta, atol=1e-9)
    assert out[out.asset.isin(["none", "few"])].resid.isna().all()


def test_newey_west_against_numpy(spark):
    df = series(spark)
    got = {r["trial"]: r for r in stats.newey_west(df, ["trial"], "i", "r", 5).collect()}
    for name, x in matrix(df).items():
        c = x.to_numpy() - x.mean()
        n = len(c)
        lrv = c @ c / n + 2 * sum((1 - k / 6) * (c[k:] @ c[:-k]) / n for k in range(1, 6))
        t = x.mean() / math.sqrt(lrv / n)
        assert close(got[name]["t_stat"], t, 1e-9)
        assert close(got[name]["p_value"], math.erfc(abs(t) / math.sqrt(2)), 1e-9)


def test_short_series_caps_the_lags(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0)], "k string, i int, r double")
    got = stats.newey_west(df, ["k"], "i", "r", 5).first()
    c = np.array([-1.0, 1.0])
    lrv = c @ c / 2 + 2 * (1 - 1 / 2) * (c[1:] @ c[:-1]) / 2
    assert close(got["t_stat"], 2.0 / math.sqrt(lrv / 2))


def test_multiplicity_golden(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("f", str(i), v) for i, v in enumerate(p)], "f string, k string, p double")
    got = stats.adjust_pvalues(df, ["f"], "k", "p")
    assert [round(as_map(got, "k", "holm")[str(i)], 6) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert [round(as_map(got, "k", "bh")[str(i)], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]


def test_overfitting_against_direct_recomputation(spark):
    df = series(spark, n=50, trials=5)
    m = matrix(df).to_numpy()
    blocks = np.array_split(np.arange(len(m)), 6)
    logits = []
    for c in combinations(range(6), 3):
        if 0 not in c:
            continue
        a = m[np.concatenate([blocks[b] for b in c])]
        o = m[np.concatenate([blocks[b] for b in range(6) if b not in c])]
        best = int(np.argmax(a.mean(0) / a.std(0, ddof=1)))
        z = o.mean(0) / o.std(0, ddof=1)
        frac = ((z < z[best]).sum() + 0.5 * (z == z[best]).sum()) / 5
        w = min(0.9, max(0.1, frac))
        logits.append(math.log(w / (1 - w)))
    got = stats.overfitting(df, ["family"], "trial", "i", "r", 6).first()
    assert got["splits"] == 10 and close(got["pbo"], np.mean(np.array(logits) <= 0)) and close(got["mean_logit"], np.mean(logits))


def test_bootstrap_separates_signal_from_noise(spark):
    rng = np.random.default_rng(4)
    data = [("signal", i, float(v)) for i, v in enumerate(rng.normal(0.5, 0.2, 80))] + [("noise", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 80))]
    df = spark.createDataFrame(data, "k string, i int, r double")
    got = {r["k"]: r for r in stats.block_bootstrap(df, ["k"], "i", "r", 300, 5, 1).collect()}
    assert got["signal"]["p_value"] < 0.01 and got["noise"]["p_value"] > 0.05
    assert got["signal"]["low"] < got["signal"]["mean"] < got["signal"]["high"]


def test_deflation_lowers_with_more_trials(spark):
    few = stats.deflated_sharpe(series(spark, trials=2), ["family"], "trial", "r")
    many = stats.deflated_sharpe(series(spark, trials=8), ["family"], "trial", "r")
    assert as_map(many, "trial", "benchmark")["t1"] > as_map(few, "trial", "benchmark")["t1"]
    x = matrix(series(spark, trials=2))["t1"]
    got = {r["trial"]: r for r in few.collect()}["t1"]
    assert close(got["skew"], float(x.skew()), 1e-9) and close(got["kurt"], float(x.kurt()) + 3, 1e-9)


def test_family_verdict_rows(spark):
    v = stats.family_verdict(series(spark), ["family"], "trial", "i", "r", 50, 5, 1, 4)
    assert v.count() == 4 and "blockers" in v.columns


def test_ewma_and_oas_against_numpy(spark):
    df = series(spark, n=60, trials=4).withColumnRenamed("trial", "asset")
    # one incomplete period drops out
    df = df.where(~((F.col("i") == 5) & (F.col("asset") == "t0")))
    m = matrix(df.withColumnRenamed("asset", "trial")).dropna().to_numpy()
    w = 0.9 ** np.arange(len(m) - 1, -1, -1)
    w /= w.sum()
    c = m - w @ m
    want = c.T @ (c * w[:, None])
    want = 0.8 * want + 0.2 * np.diag(np.diag(want))
    got = as_map(models.ewma_covariance(df, "i", "asset", "r", 0.9, 0.2), ["asset_i", "asset_j"], "cov")
    assert all(close(got[(f"t{a}", f"t{b}")], want[a, b], 1e-9) for a in range(4) for b in range(4))
    e = np.cov(m.T, bias=True)
    mu, al, n = np.trace(e) / 4, (e * e).mean(), len(m)
    sh = min((al + mu * mu) / ((n + 1) * (al - mu * mu / 4)), 1.0)
    got = as_map(models.oas_covariance(df, "i", "asset", "r"), ["asset_i", "asset_j"], "cov")
    assert close(got[("t1", "t1")], (1 - sh) * e[1, 1] + sh * mu, 1e-9) and close(got[("t1", "t2")], (1 - sh) * e[1, 2], 1e-9)


def test_arma_and_garch_recover_parameters(spark):
    rng = np.random.default_rng(8)
    n, x, e1 = 1500, [0.0], 0.0
    for v in rng.normal(0, 1, n):
        x.append(0.6 * x[-1] + v + 0.3 * e1)
        e1 = v
    h, y = 1.0, []
    for v in rng.normal(0, 1, n):
        y.append(math.sqrt(h) * v / 100)
        h = 0.1 + 0.15 * (y[-1] * 100) ** 2 + 0.75 * h
    a = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "asset string, i int, r double")
    g = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(y)], "asset string, i int, r double")
    fit = models.arma11(a, "asset", "i", "r").first()
    assert abs(fit["phi"] - 0.6) < 0.1 and abs(fit["theta"] - 0.3) < 0.12
    fit = models.garch11(g, "asset", "i", "r").first()
    assert 0.05 < fit["alpha"] < 0.3 and 0.5 < fit["beta"] < 0.9 and fit["alpha"] + fit["beta"] < 0.999


def test_mixture_finds_two_states(spark):
    rng = np.random.default_rng(9)
    data = [(float(a), float(b)) for a, b in zip(rng.normal(-2, 0.3, 150), rng.normal(1, 0.2, 150))] + [(float(a), float(b)) for a, b in zip(rng.normal(2, 0.5, 50), rng.normal(3, 0.4, 50))]
    m = state.fit_mixture(spark.createDataFrame(data, "x double, y double"), ["x", "y"], 2)
    assert abs(m.means[0][0] + 2) < 0.2 and abs(m.means[1][0] - 2) < 0.3 and abs(m.weights[0] - 0.75) < 0.05


def test_mixture_refuses_what_it_cannot_fit(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=60)], "x double")
    with pytest.raises(ValueError, match="not converged"):
        state.fit_mixture(df, ["x"], 2, rounds=2)
    with pytest.raises(ValueError, match="different rows"):
        state.fit_mixture(spark.createDataFrame([(1.0,)] * 9, "x double"), ["x"], 2)
    with pytest.raises(ValueError, match="too few"):
        state.fit_mixture(df.limit(3), ["x"], 2)


def test_null_state_breaks_the_chain(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(["a", "b", None, "a", "a", "b"])], "k string, t int, st string")
    assert rows(state.transitions(df, ["k"], "t", "st")) == [("s", "a", "b", 2)]


def test_allocator_uses_only_the_past(spark):
    rng = np.random.default_rng(3)
    data = [(c, i, float(rng.normal(0.02, 0.1))) for c in "abc" for i in range(40)]
    h = spark.createDataFrame(data, "candidate string, s int, q double")
    w = allocate.rolling_allocator(h, "s", "q", 10, 5)
    later = allocate.rolling_allocator(h.withColumn("q", F.when(F.col("s") >= 30, -F.col("q")).otherwise(F.col("q"))), "s", "q", 10, 5)
    a, b = as_map(w, ["candidate", "s"], "weight"), as_map(later, ["candidate", "s"], "weight")
    assert all(a[k] == b[k] for k in a if k[1] <= 30)
    total = w.groupBy("s").agg(F.sum("weight").alias("t")).collect()
    assert all(close(r["t"], 1.0) for r in total) and close(a[("a", 0)], 1 / 3)


def test_greedy_selection_skips_close_candidates(spark):
    s = spark.createDataFrame([("f", "a", 3.0), ("f", "b", 2.0), ("f", "c", 1.0), ("f", "d", 0.0)], "family string, candidate string, score double")
    r = spark.createDataFrame([("f", "a", "b", 0.9), ("f", "a", "c", -0.1), ("f", "b", "c", 0.2)], "family string, factor_a string, factor_b string, rho double")
    got = evaluate.greedy_selection(s, r, "family", 5, 0.7)
    assert as_map(got, "candidate", "weight") == {"a": 0.75, "c": 0.25}


def test_greedy_rounds_equal_a_plain_loop_for_many_families(spark):
    rng = np.random.default_rng(7)
    s = [(f"f{f}", f"c{i:02d}", float(rng.integers(0, 6))) for f in range(5) for i in range(14)]
    r = [(f"f{f}", *((f"c{i:02d}", f"c{j:02d}") if rng.random() < 0.5 else (f"c{j:02d}", f"c{i:02d}")), float(rng.uniform(-1, 1))) for f in range(5) for i in range(14) for j in range(i)]
    got = evaluate.greedy_selection(spark.createDataFrame(s, "family string, candidate string, score double"), spark.createDataFrame(r, "family string, factor_a string, factor_b string, rho double"), "family", 4, 0.7)
    got = {(x["family"], x["place"]): x["candidate"] for x in got.collect()}
    near = {(f, *sorted((a, b))): abs(v) for f, a, b, v in r}
    want = {}
    for f in sorted({x[0] for x in s}):
        chosen = []
        for _, c, v in sorted((x for x in s if x[0] == f), key=lambda x: (-x[2], x[1])):
            if v > 0 and len(chosen) < 4 and all(near[(f, *sorted((c, d)))] <= 0.7 for d in chosen):
                chosen.append(c)
        want |= {(f, n): c for n, c in enumerate(chosen, 1)}
    assert got == want


def test_rank_ic_perfect_and_flat(spark):
    data = [(1, f"a{i}", float(i), float(i * i)) for i in range(5)] + [(2, f"a{i}", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(data, "ts int, asset string, v double, y double")
    got = as_map(evaluate.rank_ic(df, ["ts"], "v", "y"), "ts", "rank_ic")
    assert close(got[1], 1.0) and got[2] is None


def test_partial_label_blocks_every_candidate(spark):
    data = [(t, c, a, 1.0, None if (t == 1 and a == 2) or t == 3 else 1.0, t == 3) for t in (1, 2, 3) for c in ("x", "y") for a in range(3)]
    df = spark.createDataFrame(data, "ts int, candidate string, a int, v double, y double, cross boolean")
    got = evaluate.candidate_status(df, "v", "y", F.col("cross"), 2)
    assert as_map(got, ["ts", "candidate"], "status") == {(t, c): s for t, s in ((1, "PARTIAL_LABEL"), (2, "AVAILABLE"), (3, "BOUNDARY")) for c in ("x", "y")}

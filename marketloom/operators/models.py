"""Risk and return models fitted from partial sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numeric import FLAT, clip
from marketloom.functions.solve import solve_normal
from marketloom.operators.chunks import numbered
from marketloom.settings import cut_lineage

ONE = "\u0001one"


def complete_vectors(df: DataFrame, ts: str, asset: str, value: str) -> DataFrame:
    """One row per timestamp at which every asset has a value: ``names`` and ``xs``, in the order of the assets.

    The panel is read once; its vectors are stored, and the members are counted on them.
    """
    # One row per (time, asset): repeated rows count by their mean, so they can't stand in for a missing asset.
    cells = df.groupBy(ts, asset).agg(F.avg(value).alias(value))
    rows = cells.groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(asset, value))).alias("_v"))
    rows = cut_lineage(rows.select(ts, F.col("_v").getField(asset).alias("names"), F.col("_v").getField(value).alias("xs")), "vectors")
    members = rows.select(F.explode("names").alias("_a")).agg(F.count_distinct("_a").alias("_k"))
    whole = (F.size("names") == F.col("_k")) & ~F.exists("xs", lambda x: x.isNull())
    return rows.join(F.broadcast(members)).where(whole).drop("_k")


def gram(vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """Σ w x_i x_j over complete timestamps as (i, j, s), with a constant column added.

    Each task multiplies the vectors it holds and emits one matrix, so the shuffle carries
    assets squared per task instead of pairs per timestamp. The constant column yields weights and sums.
    """
    rows = vectors.select("names", "xs", (F.lit(1.0) if weight is None else weight).alias("_w"))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, names = None, None
        for pdf in frames:
            if not len(pdf):
                continue
            names = [ONE, *pdf["names"].iloc[0]]
            x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["xs"].to_numpy())])
            part = x.T @ (x * pdf["_w"].to_numpy()[:, None])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": names, "row": list(total), "names": [names] * len(names), "mass": total[0, 0]})

    parts = rows.mapInPandas(partial, "i string, row array<double>, names array<string>, mass double")
    cells = parts.select("i", "mass", F.explode(F.arrays_zip("names", "row")).alias("c"))
    return cells.groupBy("i", F.col("c.names").alias("j")).agg(F.sum("c.row").alias("s"), F.sum("mass").alias("mass"))


def _moments(g: DataFrame) -> DataFrame:
    # Sums of each asset sit in the constant row and column of the same table.
    mi = F.max(F.when(F.col("j") == ONE, F.col("s"))).over(Window.partitionBy("i")) / F.col("mass")
    mj = F.max(F.when(F.col("i") == ONE, F.col("s"))).over(Window.partitionBy("j")) / F.col("mass")
    c = g.withColumns({"_mi": mi, "_mj": mj}).where((F.col("i") != ONE) & (F.col("j") != ONE))
    return c.select(F.col("i").alias("asset_i"), F.col("j").alias("asset_j"), (F.col("s") / F.col("mass") - F.col("_mi") * F.col("_mj")).alias("cov"), "mass")


def covariance(df: DataFrame, ts: str, asset: str, value: str) -> DataFrame:
    """Covariance over complete timestamps as (asset_i, asset_j, cov, mass)."""
    return _moments(gram(complete_vectors(df, ts, asset, value)))


def ewma_covariance(df: DataFrame, ts: str, asset: str, value: str, decay: float, shrink: float) -> DataFrame:
    """Covariance (divisor Σw) weighted by decay^(age), off-diagonals shrunk towards zero.

    Age counts complete timestamps from the newest, 0, across ranges of time.
    """
    aged = numbered(complete_vectors(df, ts, asset, value), [], [F.desc(ts)], "_age")
    c = _moments(gram(aged, F.pow(F.lit(decay), F.col("_age") - 1)))
    off = F.col("asset_i") != F.col("asset_j")
    return c.select("asset_i", "asset_j", F.when(off, F.col("cov") * (1 - shrink)).otherwise(F.col("cov")).alias("cov"))


def correlation_matrix(cov: DataFrame) -> DataFrame:
    """Clipped correlations with a unit diagonal from a covariance table."""
    cov = cut_lineage(cov, "covariance")
    var = cov.where("asset_i = asset_j").select(F.col("asset_i").alias("_a"), F.sqrt("cov").alias("_s"))
    c = cov.join(var.select(F.col("_a").alias("asset_i"), F.col("_s").alias("_si")), "asset_i")
    c = c.join(var.select(F.col("_a").alias("asset_j"), F.col("_s").alias("_sj")), "asset_j")
    rho = F.when(F.col("asset_i") == F.col("asset_j"), F.lit(1.0)).otherwise(clip(F.try_divide(F.col("cov"), F.col("_si") * F.col("_sj")), -1.0, 1.0))
    return c.select("asset_i", "asset_j", rho.alias("rho"))


def oas_covariance(df: DataFrame, ts: str, asset: str, value: str) -> DataFrame:
    """Oracle-approximating shrinkage towards the mean variance."""
    c = cut_lineage(covariance(df, ts, asset, value), "covariance")
    diag = F.col("asset_i") == F.col("asset_j")
    g = c.agg(F.max("mass").alias("n"), F.count_if(diag).alias("p"), F.sum(F.when(diag, F.col("cov"))).alias("_t"), F.avg(F.col("cov") * F.col("cov")).alias("alpha"))
    g = g.withColumn("mu", F.col("_t") / F.col("p"))
    den = (F.col("n") + 1) * (F.col("alpha") - F.col("mu") * F.col("mu") / F.col("p"))
    g = g.withColumn("shrinkage", F.when(den <= 1e-30, 1.0).otherwise(clip((F.col("alpha") + F.col("mu") * F.col("mu")) / den, 0.0, 1.0)))
    j = c.join(F.broadcast(g.select("mu", "shrinkage")))
    cell = (1 - F.col("shrinkage")) * F.col("cov") + F.when(diag, F.col("shrinkage") * F.col("mu")).otherwise(0.0)
    return j.select("asset_i", "asset_j", cell.alias("cov"), "shrinkage")


def eigen_floor(cov: DataFrame, floor: float) -> DataFrame:
    """Raise eigenvalues to ``floor``. Works on the aggregated matrix, assets squared cells."""

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="asset_i", columns="asset_j", values="cov").sort_index(axis=0).sort_index(axis=1)
        val, vec = np.linalg.eigh((m.to_numpy() + m.to_numpy().T) / 2)
        fixed = (vec * np.maximum(val, floor)) @ vec.T
        names = list(m.index)
        return pd.DataFrame({"asset_i": np.repeat(names, len(names)), "asset_j": names * len(names), "cov": fixed.ravel()})

    return cov.select("asset_i", "asset_j", "cov", F.lit(1).alias("_g")).groupBy("_g").applyInPandas(repair, "asset_i string, asset_j string, cov double")


def pca_risk(df: DataFrame, ts: str, asset: str, value: str, factors: int, floor: float) -> DataFrame:
    """Loadings, factor variances and idiosyncratic variance per asset.

    The covariance is summed on the cluster; only the final eigen step sees the matrix.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="asset_i", columns="asset_j", values="cov").sort_index(axis=0).sort_index(axis=1)
        a = (m.to_numpy() + m.to_numpy().T) / 2
        val, vec = np.linalg.eigh(a)
        top = np.argsort(val)[::-1][: min(factors, len(val))]
        kept = np.maximum(val[top], 0.0)
        v = vec[:, top]
        v = v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1.0, 1.0)
        rest = np.maximum(np.diag(a - (v * kept) @ v.T), floor)
        share = kept.sum() / max(np.maximum(val, 0.0).sum(), 1e-30)
        return pd.DataFrame({"asset": list(m.index), "loadings": list(v), "factor_variance": [kept] * len(m), "idiosyncratic": rest, "explained": share})

    c = covariance(df, ts, asset, value).select("asset_i", "asset_j", "cov", F.lit(1).alias("_g"))
    return c.groupBy("_g").applyInPandas(split, "asset string, loadings array<double>, factor_variance array<double>, idiosyncratic double, explained double")


def ar1(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per-asset regression of the next return on the last one."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.where(both)
    slope = F.try_divide(F.covar_pop(y, x), F.var_pop(x))
    g = d.groupBy(by).agg(F.count("*").alias("n"), slope.alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy"), F.covar_pop(y, x).alias("_c"))
    sse = (F.col("_vy") - F.col("slope") * F.col("_c")) * F.col("n")
    return g.select(by, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))).alias("residual_std"))


def ar_p(df: DataFrame, by: str, order: str, value: str, p: int) -> DataFrame:
    """AR(p) with intercept per asset: the cross-moments of the lags are one aggregate, elimination gives the coefficients.

    Rows whose lags are not all present don't count. Constant series have coefficients 0.
    """
    w = Window.partitionBy(by).orderBy(order)
    d = df.select(by, F.col(value).alias("_l0"), *[F.lag(value, k).over(w).alias(f"_l{k}") for k in range(1, p + 1)]).dropna(subset=[f"_l{k}" for k in range(p + 1)])
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    g = d.groupBy(by).agg(
        F.count("*").alias("n"), *[F.avg(f"_l{k}").alias(f"_m{k}") for k in range(p + 1)],
        *[F.covar_pop(f"_l{i}", f"_l{j}").alias(f"_c{i}_{j}") for i, j in pairs])
    square = [[F.col(f"_c{min(i, j)}_{max(i, j)}") for j in range(1, p + 1)] for i in range(1, p + 1)]
    g = g.withColumn("coefficients", solve_normal(square, [F.col(f"_c0_{k}") for k in range(1, p + 1)]))
    level, explained = F.col("_m0"), F.lit(0.0)
    for k in range(1, p + 1):
        level = level - F.get("coefficients", F.lit(k - 1)) * F.col(f"_m{k}")
        explained = explained + F.get("coefficients", F.lit(k - 1)) * F.col(f"_c0_{k}")
    sse = F.greatest(F.col("_c0_0") - explained, F.lit(0.0)) * F.col("n")
    return g.select(by, "n", level.alias("intercept"), "coefficients", F.sqrt(sse / F.greatest(F.col("n") - p - 1, F.lit(1))).alias("residual_std"))


def _refine(loss, boxes: list[tuple[float, float]], rounds: int = 6, points: int = 11) -> np.ndarray:
    """Minimize a vectorized loss on a shrinking grid; ``loss`` maps (m, k) to (m,)."""
    lo, hi = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    bounds = lo.copy(), hi.copy()
    best = (lo + hi) / 2
    for _ in range(rounds):
        grid = np.stack(np.meshgrid(*[np.linspace(a, b, points) for a, b in zip(lo, hi)], indexing="ij"), -1).reshape(-1, len(boxes))
        best = grid[np.nanargmin(loss(grid))]
        span = (hi - lo) / (points - 1) * 1.5
        lo, hi = np.maximum(best - span, bounds[0]), np.minimum(best + span, bounds[1])
    return best


def arma11(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """ARMA(1,1) per asset by conditional sum of squares, |phi| and |theta| below 0.999."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        mu, z = x.mean(), x - x.mean()

        def css(g: np.ndarray) -> np.ndarray:
            e, total = np.zeros(len(g)), np.zeros(len(g))
            for t in range(1, len(z)):
                e = z[t] - g[:, 0] * z[t - 1] - g[:, 1] * e
                total += e * e
            return total

        phi, theta = _refine(css, [(-0.999, 0.999), (-0.999, 0.999)])
        sd = float(np.sqrt(css(np.array([[phi, theta]]))[0] / max(len(z) - 1, 1)))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(x)], "mean": [mu], "phi": [phi], "theta": [theta], "residual_std": [sd]})

    d = df.where(F.col(value).isNotNull()).select(by, order, value)
    return d.groupBy(by).applyInPandas(fit, f"{by} string, n long, mean double, phi double, theta double, residual_std double")


def garch11(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """GARCH(1,1) per asset by Gaussian likelihood in percent units, alpha+beta < 0.999."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float) * 100
        e2, var = (x - x.mean()) ** 2, float(x.var())

        def nll(g: np.ndarray) -> np.ndarray:
            a, b = g[:, 0], g[:, 1]
            omega = var * np.maximum(1 - a - b, 1e-6)
            h, total = np.full(len(g), var), np.zeros(len(g))
            for v in e2:
                total += np.log(h) + v / h
                h = omega + a * v + b * h
            return np.where(a + b < 0.999, total, np.inf)

        try:
            alpha, beta = _refine(nll, [(0.001, 0.5), (0.0, 0.998)])
            omega, ok = var * (1 - alpha - beta), True
        except ValueError:
            omega, alpha, beta, ok = 0.05 * var, 0.05, 0.90, False
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(x)], "omega": [omega], "alpha": [alpha], "beta": [beta], "converged": [ok]})

    d = df.where(F.col(value).isNotNull()).select(by, order, value)
    return d.groupBy(by).applyInPandas(fit, f"{by} string, n long, omega double, alpha double, beta double, converged boolean")


def calibrate(df: DataFrame, by: Sequence[str], ts: str, value: str, label: str, ridge: float, minimum: int) -> DataFrame:
    """Ridge regression of the label on the within-period z-score, from pooled sums."""
    part = [*by, ts]
    d = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy(*part)
    sd = F.stddev_pop(value).over(w)
    z = F.when((F.count("*").over(w) >= minimum) & (sd > FLAT), (F.col(value) - F.avg(value).over(w)) / sd)
    d = d.select(*part, z.alias("z"), F.col(label).alias("y")).where("z IS NOT NULL")
    per = d.groupBy(*part).agg(
        F.count("*").alias("n"), F.sum("z").alias("sz"), F.sum("y").alias("sy"), F.sum(F.col("z") * F.col("z")).alias("szz"),
        F.sum(F.col("z") * F.col("y")).alias("szy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    g = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sz", "sy", "szz", "szy", "syy")], F.count("*").alias("periods"))
    n, a = F.col("n"), F.col("szz") + ridge
    det = n * a - F.col("sz") * F.col("sz")
    g = g.withColumns({"slope": (n * F.col("szy") - F.col("sz") * F.col("sy")) / det, "intercept": (a * F.col("sy") - F.col("sz") * F.col("szy")) / det})
    i, s = F.col("intercept"), F.col("slope")
    sse = F.col("syy") - i * F.col("sy") * 2 - s * F.col("szy") * 2 + i * i * n + i * s * F.col("sz") * 2 + s * s * F.col("szz")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / n
    return g.select(*by, "periods", "n", "intercept", "slope", F.sqrt(F.greatest(sse, F.lit(0.0)) / n).alias("residual_std"),
                    F.when(sst > FLAT, 1 - sse / sst).otherwise(0.0).alias("r_squared"))


def forecast(scores: DataFrame, fitted: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    """Expected return and its uncertainty from a calibration."""
    j = scores.join(fitted.select(*by, "intercept", "slope", "residual_std"), list(by))
    return j.select(*scores.columns, (F.col("intercept") + F.col("slope") * F.col(z)).alias("mu"), F.col("residual_std").alias("sigma"))


def combine_forecasts(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    u = F.col(weight) * F.col("sigma")
    return df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col("mu")).alias("mu"), F.sqrt(F.sum(u * u)).alias("sigma"), F.count("*").alias("members"))


def drift(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("drift"), F.stddev_samp(value).alias("volatility"))


def equal_targets(df: DataFrame, asof: Sequence[str], cash: float) -> DataFrame:
    """Equal weights over the assets of each as-of that sum to 1 - cash."""
    return df.withColumn("weight", F.lit(1.0 - cash) / F.count("*").over(Window.partitionBy(*asof)))


def portfolio_variance(weights: DataFrame, cov: DataFrame, by: Sequence[str]) -> DataFrame:
    """w'Cw per portfolio: two joins along the covariance cells."""
    wi = weights.select(*by, F.col("asset").alias("asset_i"), F.col("weight").alias("_wi"))
    wj = weights.select(*by, F.col("asset").alias("asset_j"), F.col("weight").alias("_wj"))
    half = wi.join(cov, "asset_i").groupBy(*by, "asset_j").agg(F.sum(F.col("_wi") * F.col("cov")).alias("_c"))
    return half.join(wj, [*by, "asset_j"]).groupBy(*by).agg(F.greatest(F.sum(F.col("_c") * F.col("_wj")), F.lit(0.0)).alias("variance"))


def log_density(x: Column, mean: float, var: float) -> Column:
    return (F.pow(x - mean, F.lit(2)) / var + float(np.log(2 * np.pi * var))) * -0.5

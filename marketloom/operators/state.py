"""Market states: a diagonal Gaussian mixture fitted by iterated aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.models import log_density
from marketloom.operators.resample import exact_quantiles
from marketloom.settings import cut_lineage


@dataclass(frozen=True)
class Mixture:
    """Weights, means and variances per state, in raw feature units."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]

    def logs(self) -> list[Column]:
        """Log of weight times density per state."""
        logs = []
        for w, m, v in zip(self.weights, self.means, self.variances):
            total = F.lit(float(np.log(w)))
            for f, a, b in zip(self.features, m, v):
                total = total + log_density(F.col(f), a, b)
            logs.append(total)
        return logs

    def posteriors(self) -> list[Column]:
        logs = self.logs()
        top = F.greatest(*logs)
        exps = [F.exp(x - top) for x in logs]
        norm = sum(exps[1:], exps[0])
        return [e / norm for e in exps]


def fit_mixture(df: DataFrame, features: Sequence[str], k: int, rounds: int = 500, tol: float = 1e-6, floor: float = 1e-6) -> Mixture:
    """Expectation-maximization; every round is one aggregate that returns a single row.

    Starts from the exact quantiles of the first feature and stops once a round raises the mean log-likelihood
    by less than ``tol``; a fit that has not come to that after ``rounds`` rounds is an error, as are too few
    rows and fewer than ``k`` different ones. States end ordered by centroid, which settles label switching.
    """
    feats = list(features)
    d = cut_lineage(df.select(*feats).dropna(), "mixture")
    scale = d.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(feats)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(feats)], F.count("*").alias("n")).first()
    if scale["n"] < 2 * k:
        raise ValueError("too few rows to fit the states")
    if d.distinct().limit(k).count() < k:
        raise ValueError("fewer different rows than states")
    starts = exact_quantiles(d.select(F.lit(0).alias("_all"), F.col(feats[0]).alias("_x")), ["_all"], "_x", [(j + 0.5) / k for j in range(k)]).drop("_all").first()
    spread = [max(scale[f"s{i}"], 1e-12) ** 2 for i in range(len(feats))]
    mean0 = [scale[f"m{i}"] for i in range(len(feats))]
    model = Mixture(tuple(feats), (1.0 / k,) * k, tuple(tuple([starts[j], *mean0[1:]]) for j in range(k)), (tuple(spread),) * k)
    last = None
    for _ in range(rounds):
        logs = model.logs()
        top = F.greatest(*logs)
        r = d.withColumns({f"_p{j}": p for j, p in enumerate(model.posteriors())})
        aggs = [F.count("*").alias("n"), F.avg(top + F.log(sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top)))).alias("likelihood")]
        for j in range(k):
            aggs.append(F.sum(f"_p{j}").alias(f"r{j}"))
            for i, f in enumerate(feats):
                aggs += [F.sum(F.col(f"_p{j}") * F.col(f)).alias(f"x{j}_{i}"), F.sum(F.col(f"_p{j}") * F.col(f) * F.col(f)).alias(f"y{j}_{i}")]
        row = r.agg(*aggs).first()
        w, m, v = [], [], []
        for j in range(k):
            mass = max(row[f"r{j}"], 1e-12)
            w.append(mass / row["n"])
            m.append(tuple(row[f"x{j}_{i}"] / mass for i in range(len(feats))))
            v.append(tuple(max(row[f"y{j}_{i}"] / mass - m[-1][i] ** 2, floor * spread[i]) for i in range(len(feats))))
        model = Mixture(tuple(feats), tuple(w), tuple(m), tuple(v))
        if last is not None and abs(row["likelihood"] - last) < tol:
            break
        last = row["likelihood"]
    else:
        raise ValueError(f"the fit has not converged in {rounds} rounds")
    order = sorted(range(k), key=lambda j: model.means[j])
    return Mixture(model.features, *(tuple(getattr(model, a)[j] for j in order) for a in ("weights", "means", "variances")))


def project(df: DataFrame, model: Mixture, fit_end: str, ts: str, available: str, as_of: str | None = None, released: str | None = None) -> DataFrame:
    """State probabilities of rows after the fit window, as known at ``as_of``; others carry a reason.

    In this order: a row that was not available at ``as_of``, a row of the fit window, a row available before
    the model was ``released`` (the end of its fit window unless given), a missing feature.
    """
    missing = F.lit(False)
    for f in model.features:
        missing = missing | F.col(f).isNull()
    end = F.lit(fit_end).cast("timestamp")
    release = F.lit(released or fit_end).cast("timestamp")
    if released and released < fit_end:
        raise ValueError("the model can't be released before its fit window ends")
    late = F.col(available).cast("timestamp") > F.lit(as_of).cast("timestamp") if as_of else F.lit(False)
    # The reasons that results carry.
    why = (
        F.when(late, "OBSERVATION_NOT_AVAILABLE").when(F.col(ts).cast("timestamp") < end, "FIT_HISTORY_NOT_PROJECTION")
        .when(F.col(available).cast("timestamp") < release, "MODEL_NOT_AVAILABLE").when(missing, "FEATURE_UNAVAILABLE")
    )
    out = df.withColumn("reason", why)
    return out.withColumns({f"p{j}": F.when(F.col("reason").isNull(), p) for j, p in enumerate(model.posteriors())})


def transitions(df: DataFrame, by: Sequence[str], order: str, state: str) -> DataFrame:
    """Changes of state between neighbouring rows; a NULL state breaks the chain."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_p", F.lag(state).over(w))
    d = d.where(F.col("_p").isNotNull() & F.col(state).isNotNull() & (F.col("_p") != F.col(state)))
    return d.groupBy(*by, F.col("_p").alias("from_state"), F.col(state).alias("to_state")).agg(F.count("*").alias("n"))

"""Correlations of many columns as Gram products: one small matrix a task instead of a row for each pair.

A cross-section reaches a task once, as one row of all its columns; the pairs exist only as cells of the product
of rank vectors, which a task adds up over all its timestamps before anything leaves it. Columns beyond
``block`` are cut into blocks, and a pair of blocks is the unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.numeric import FLAT


def _blocks(names: Sequence[str], block: int) -> list[tuple[list[str], list[str]]]:
    cut = [list(names[i : i + block]) for i in range(0, len(names), block)]
    return [(a, b) for i, a in enumerate(cut) for b in cut[i:]]


def _correlated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of every column of ``x`` with every one of ``y``; NaN where one is flat."""
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    sx, sy = np.sqrt((x * x).mean(axis=0)), np.sqrt((y * y).mean(axis=0))
    scale = np.outer(np.where(sx > FLAT, sx, np.nan), np.where(sy > FLAT, sy, np.nan))
    return np.clip(x.T @ y / len(x) / scale, -1.0, 1.0)


def rank_correlations(left: np.ndarray, right: np.ndarray, minimum: int) -> np.ndarray:
    """Rank correlation of each column of ``left`` with each of ``right`` over the rows that both have.

    Columns with equal gaps are ranked together, so the work is one product for each pair of gap patterns.
    Pairs with fewer than ``minimum`` common rows, and flat ones, are NaN.
    """
    out = np.full((left.shape[1], right.shape[1]), np.nan)

    def patterns(m: np.ndarray) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for i, col in enumerate(~np.isnan(m.T)):
            found.setdefault(np.packbits(col).tobytes(), []).append(i)
        return found

    for a in patterns(left).values():
        for b in patterns(right).values():
            both = ~np.isnan(left[:, a[0]]) & ~np.isnan(right[:, b[0]])
            if both.sum() >= max(minimum, 1):
                x, y = (pd.DataFrame(m[both][:, c]).rank().to_numpy() for m, c in ((left, a), (right, b)))
                out[np.ix_(a, b)] = _correlated(x, y)
    return out


def mean_rank_correlation(
    panel: DataFrame, ts: str, features: Sequence[str], minimum: int, weights: dict[str, Column] | None = None, block: int = 256
) -> DataFrame:
    """Rank correlation of every two features, averaged over timestamps.

    Returns ``(factor_a, factor_b, weighting, periods, rho)`` with factor_a before factor_b. Ranks are taken
    inside the pair's own assets at a timestamp. ``weights`` are columns of the panel that are constant at a
    timestamp; timestamps whose weight is null or not positive don't count. Without weights all count alike.
    Pairs without a single period have no row.
    """
    names, marks = sorted(features), weights or {"": F.lit(1.0)}
    if len(names) < 2:
        raise ValueError("two features at least")
    jobs = _blocks(names, block)
    kinds = list(marks)

    def columns(cols: Sequence[str]) -> Column:
        return F.array(*[F.col(c).cast("double") for c in cols])

    unit = [F.struct(F.lit(i).alias("job"), columns(a).alias("a"), columns(b if b is not a else []).cast("array<double>").alias("b")) for i, (a, b) in enumerate(jobs)]
    rows = panel.select(F.col(ts).alias("_ts"), F.array(*[w.cast("double") for w in marks.values()]).alias("w"), F.explode(F.array(*unit)).alias("u")).select("_ts", "w", "u.*")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}

        def close(job: int, group: list[dict]) -> None:
            left = np.array([r["a"] for r in group], dtype=float)
            right = np.array([r["b"] for r in group], dtype=float) if group[0]["b"] else left
            rho = rank_correlations(left, right, minimum)
            have = ~np.isnan(rho)
            total = sums.setdefault(job, [np.zeros((len(kinds), *rho.shape)) for _ in range(3)])
            for k, w in enumerate(group[0]["w"]):
                if w is not None and w > 0:
                    total[0][k] += have
                    total[1][k] += have * w
                    total[2][k] += np.where(have, rho, 0.0) * w

        key, group = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["job"], row["_ts"])) != key and group:
                    close(key[0], group)
                    group = []
                key = now
                group.append(row)
        if group:
            close(key[0], group)
        for job, (n, w, s) in sums.items():
            a, b = jobs[job]
            k, i, j = np.nonzero(n)
            upper = np.array([a[x] < b[y] for x, y in zip(i, j)], dtype=bool)
            k, i, j = k[upper], i[upper], j[upper]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[x] for x in i], pa.string()), pa.array([b[x] for x in j], pa.string()), pa.array([kinds[x] for x in k], pa.string()),
                 pa.array(n[k, i, j].astype(np.int64)), pa.array(w[k, i, j]), pa.array(s[k, i, j])],
                ["factor_a", "factor_b", "weighting", "n", "w", "s"])

    made = rows.repartition("job", "_ts").sortWithinPartitions("job", "_ts").mapInArrow(add, "factor_a string, factor_b string, weighting string, n long, w double, s double")
    g = made.groupBy("factor_a", "factor_b", "weighting").agg(F.sum("n").alias("periods"), F.sum("w").alias("_w"), F.sum("s").alias("_s"))
    return g.select("factor_a", "factor_b", "weighting", "periods", (F.col("_s") / F.col("_w")).alias("rho"))


def series_correlation(wide: DataFrame, names: Sequence[str], block: int = 256) -> DataFrame:
    """``(factor_a, factor_b, days, rho)`` of all pairs of columns over all rows.

    A row in which one of the two is missing makes the pair's ``rho`` null, and so does a flat series. Tasks send the
    counts, means and co-moments of their rows, which merge exactly, never a row for each pair.
    """
    names = sorted(names)
    jobs = _blocks(names, block)
    cells = wide.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    place = {c: i for i, c in enumerate(names)}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            for a, b in jobs:
                x, y = m[:, [place[c] for c in a]], m[:, [place[c] for c in b]]
                missing = np.isnan(x).astype(float), np.isnan(y).astype(float)
                gaps = missing[0].sum(axis=0)[:, None] + missing[1].sum(axis=0)[None, :] - missing[0].T @ missing[1]
                x, y = np.nan_to_num(x), np.nan_to_num(y)
                mx, my = x.mean(axis=0), y.mean(axis=0)
                dx, dy = x - mx, y - my
                i, j = (v.ravel() for v in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))
                keep = np.array([a[p] < b[q] for p, q in zip(i, j)], dtype=bool)
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a[p] for p in i], pa.string()), pa.array([b[q] for q in j], pa.string()), pa.array(np.full(len(i), len(m), np.int64)), pa.array(gaps[i, j].astype(np.int64)),
                     pa.array(mx[i]), pa.array(my[j]), pa.array((dx * dx).sum(axis=0)[i]), pa.array((dy * dy).sum(axis=0)[j]), pa.array((dx.T @ dy)[i, j])],
                    ["factor_a", "factor_b", "n", "gaps", "mx", "my", "xx", "yy", "xy"])

    parts = cells.mapInArrow(moments, "factor_a string, factor_b string, n long, gaps long, mx double, my double, xx double, yy double, xy double")
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    g = parts.groupBy("factor_a", "factor_b").agg(
        F.sum(n).alias("days"), F.sum("gaps").alias("gaps"), (F.sum(n * mx) / F.sum(n)).alias("gx"), (F.sum(n * my) / F.sum(n)).alias("gy"),
        F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy"), F.sum(n * mx * mx).alias("sxx"), F.sum(n * my * my).alias("syy"), F.sum(n * mx * my).alias("sxy"))
    days = F.col("days")
    xx = F.col("xx") + F.col("sxx") - days * F.col("gx") * F.col("gx")
    yy = F.col("yy") + F.col("syy") - days * F.col("gy") * F.col("gy")
    xy = F.col("xy") + F.col("sxy") - days * F.col("gx") * F.col("gy")
    sx, sy = F.sqrt(F.greatest(xx / days, F.lit(0.0))), F.sqrt(F.greatest(yy / days, F.lit(0.0)))
    rho = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), xy / days / (sx * sy)))
    return g.select("factor_a", "factor_b", "days", F.when((F.col("gaps") == 0) & (sx > FLAT) & (sy > FLAT), rho).alias("rho"))

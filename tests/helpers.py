"""Shared checks: row sets, causality by mutation, invariance under repartitioning."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


def rows(df, *order):
    cols = df.columns
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r)) if not order else [
        tuple(r[c] for c in cols) for r in df.orderBy(*order).collect()
    ]


def as_map(df, key, value):
    keys = [key] if isinstance(key, str) else key
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r[value] for r in df.collect()}


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def assert_causal(op, df, ts, cut, column):
    """Changing rows after ``cut`` must not change results up to it."""
    changed = df.withColumn(column, F.when(F.col(ts) > cut, F.col(column) * 3 + 7).otherwise(F.col(column)))
    a = rows(op(df).where(F.col(ts) <= cut))
    b = rows(op(changed).where(F.col(ts) <= cut))
    assert a == b


def assert_layout_free(op, df):
    """The result does not depend on how the rows were spread over partitions."""
    assert rows(op(df)) == rows(op(df.repartition(7))) == rows(op(df.coalesce(1)))

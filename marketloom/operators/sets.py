"""Set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """UNION ALL where each part carries its name in ``tag``."""
    return union_parts([df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def common_members(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))


def missing_members(expected: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    """Expected members without any observation."""
    return expected.select(column).distinct().join(observed.select(column), column, "left_anti")


def zero_filled(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both weight vectors over the union of their keys, gaps as zero."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    j = a.join(b, list(keys), "full_outer")
    return j.select(
        *keys,
        F.coalesce("left_value", F.lit(0.0)).alias("left_value"),
        F.coalesce("right_value", F.lit(0.0)).alias("right_value"),
    )

"""Registry of named queries and the SQL text each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is left out where no SQL statement expresses it."""

    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(value: Column | str, digits: int = 6) -> Column:
    """Publish a double: rounding hides the summation order of either engine."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double"), digits)


def published(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Round doubles (unless ``digits`` is None) and render dates and times as text."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(field.name)
        if kind == "double":
            c = c if digits is None else F.round(c, digits)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(field.name))
    return df.select(*out)

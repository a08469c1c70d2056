"""Paging, canonical order, order checks and latest states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.chunks import numbered, with_lookback
from marketloom.settings import cut_lineage

#: Bits of the column types whose values pack into one number. Timestamps are micros in 60 bits (18,000 years both ways).
BITS = {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 60}
#: Types that a hash aggregate can update in place, so that a single one needs no packing.
FIXED = (*BITS, "float", "double", "decimal", "timestamp_ntz")


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 5000:
        raise ValueError("limit must lie in 1..5000")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: int, limit: int) -> DataFrame:
    """Keyset paging: cost does not grow with depth."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must lie in 1..5000")
    return df.where(F.col(key) > last).orderBy(key).limit(limit)


def with_total(df: DataFrame, shown: DataFrame) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return shown.join(F.broadcast(total))


def ordinal(column: str, ranking: Sequence[str]) -> Column:
    """Position of an enum-like value; values outside the list sort last."""
    pairs = [F.lit(x) for i, name in enumerate(ranking) for x in (name, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(len(ranking)))


def canonical(df: DataFrame, order: Sequence[Column | str], prefix: str, key: Sequence[str]) -> DataFrame:
    """Sequence number in canonical order and a row id from the key columns."""
    out = numbered(df, [], order, "sequence")
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return out.withColumn("row_id", F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 24)))


def order_violations(df: DataFrame, by: str, ts: str, clocks: Sequence[str]) -> DataFrame:
    """Rows whose clocks fail to increase strictly after the previous row of the asset."""

    def check(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(ts)
        bad = F.lit(False)
        for c in clocks:
            bad = bad | F.coalesce(F.col(c) <= F.lag(c).over(w), F.lit(False))
        return frame.withColumn("_bad", bad)

    flagged = with_lookback(df, [by], [ts], 1, check)
    return flagged.groupBy(by).agg(F.count("*").alias("rows"), F.count_if("_bad").alias("violations"))


def packed_order(df: DataFrame, order: Sequence[str]) -> Column | None:
    """One number that sorts like as many leading ``order`` columns as fit in 38 digits.

    NULL sorts first. A timestamp beyond its 60 bits ties with all others on that side, whatever follows it.
    A first column that packs with nothing stands for itself; None where it has no fixed width.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    total, size, taken, inside = F.lit(0).cast("decimal(1,0)"), 1, 0, F.lit(True)
    for c in order:
        kind = kinds[c]
        if kind not in BITS or size * (2 ** BITS[kind] + 2) >= 10**38:
            break
        half, count = 2 ** (BITS[kind] - 1), 2 ** BITS[kind] + 2
        value = {"timestamp": F.unix_micros, "date": F.unix_date}.get(kind, lambda x: x.cast("bigint"))(F.col(c))
        if kind == "timestamp":
            value = F.greatest(F.lit(-half), F.least(F.lit(half), value))
        code = F.coalesce(value.cast("decimal(20,0)") + F.lit(str(half + 1)).cast("decimal(20,0)"), F.lit(0))
        code = F.when(inside, code).otherwise(0).cast("decimal(20,0)")
        total = total * F.lit(str(count)).cast("decimal(20,0)") + code
        if kind == "timestamp":
            inside = inside & F.coalesce(F.abs(value) < half, F.lit(True))
        size, taken = size * count, taken + 1
    if taken > 1:
        return total
    return F.col(order[0]) if kinds[order[0]].split("(")[0] in FIXED else None


def newest_marks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Per key the largest packed order as ``_top``: a hash aggregate, which reads only keys and order columns."""
    top = packed_order(df, order)
    return None if top is None else df.groupBy(*keys).agg(F.max(top).alias("_top"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key under a multi-part order; rows that tie are told apart by their other columns.

    The marks of the keys are one hash aggregate over narrow columns, stored, so that the planner knows their
    size. Only rows that carry their key's mark bring their payload and are compared in full: where the marks
    fit a broadcast, no other row is shuffled or sorted. ``df`` is read twice. An order whose first column has
    no fixed width (text) is one aggregate over whole rows.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    marks = newest_marks(df, keys, order)
    if marks is not None:
        stored = cut_lineage(marks, "newest")
        d, same = df.withColumn("_top", packed_order(df, order)), F.lit(True)
        for i, k in enumerate([*keys, "_top"]):
            stored = stored.withColumnRenamed(k, f"_m{i}")
            same = same & d[k].eqNullSafe(F.col(f"_m{i}"))
        df = d.join(stored, same, "left_semi")
    g = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])

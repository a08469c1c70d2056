"""Ordered computations over keys too large for one task.

A plain window gathers a whole key in one task. Here the rows are laid out in ranges of
(key, order) with bounds taken from the rows themselves, so every range holds about the same number
of rows however they spread over keys and times: a key that holds half the table is many ranges, and
a thousand small keys are one. The ranges are written once, which also fixes the bounds; the window
then runs per (key, range), and only a summary of each range (a total, a last row, a short tail) is
carried across. A key has at most as many summaries as there are ranges.

Rows that tie in the order are spread by their content, so only identical rows must stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.settings import cut_lineage

CHUNK = "_chunk"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range in ``_chunk``, ascending along (``by``, ``order``).

    The number of ranges is the session's number of shuffle partitions unless given.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in flat])
    d = df.withColumn("_spread", spread).repartitionByRange(n, *by, *order, "_spread")
    return cut_lineage(d.withColumn(CHUNK, F.spark_partition_id()).drop("_spread"), "ranges")


def matches(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on (``by``, range) in which NULL keys meet; ``right`` holds one row for each."""
    keys = [*by, CHUNK]
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (left[k].eqNullSafe(F.col(f"_r{i}")) if k != CHUNK else left[k] == F.col(f"_r{i}"))
    return left.join(named, same, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def _before(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, name: str, ranges: int | None = None, before: bool = False
) -> DataFrame:
    """Running sum of ``value`` up to and including each row, or strictly before it."""
    d = ranged(df, by, order, ranges)
    sums = d.groupBy(*by, CHUNK).agg(F.sum(value).alias("_s"))
    base = sums.select(*by, CHUNK, F.coalesce(F.sum("_s").over(_before(by)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    d = d.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return matches(d, base, by).withColumn(name, F.col("_run") + F.col("_base")).drop(CHUNK, "_run", "_base")


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, ranges: int | None = None
) -> DataFrame:
    """Row number from 1 in ``order``; without ``by`` it numbers the whole table."""
    d = ranged(df, by, order, ranges)
    counts = d.groupBy(*by, CHUNK).agg(F.count("*").alias("_c"))
    base = counts.select(*by, CHUNK, F.coalesce(F.sum("_c").over(_before(by)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order)
    d = matches(d.withColumn("_rn", F.row_number().over(inside)), base, by)
    return d.withColumn(name, (F.col("_rn") + F.col("_base")).cast("bigint")).drop(CHUNK, "_rn", "_base")


def with_lookback(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    rows: int,
    compute: Callable[[DataFrame, Sequence[str]], DataFrame],
    ranges: int | None = None,
) -> DataFrame:
    """Run ``compute(frame, partition)`` per (key, range) with ``rows`` earlier rows added.

    The result equals one window per key for any frame that looks back at most ``rows``.
    ``compute`` partitions by the columns it is given and must keep ``_halo``.
    """
    d = ranged(df, by, order, ranges).withColumn("_halo", F.lit(False))
    cols = [c for c in d.columns if c != CHUNK]
    last = Window.partitionBy(*by, CHUNK).orderBy(*[F.desc(o) for o in order])
    body = F.struct(*[F.col(o) for o in order], *[F.col(c) for c in cols if c not in order])
    tails = (
        d.withColumn("_back", F.row_number().over(last))
        .where(F.col("_back") <= rows)
        .groupBy(*by, CHUNK)
        .agg(F.sort_array(F.collect_list(body)).alias("_tail"))
    )
    prior = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(-rows, -1)
    seen = F.flatten(F.collect_list("_tail").over(prior))
    halo = (
        tails.select(*by, CHUNK, seen.alias("_all"))
        .select(CHUNK, F.explode(F.slice("_all", F.greatest(F.size("_all") - rows + 1, F.lit(1)), rows)).alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) for c in cols if c != "_halo"], F.lit(True).alias("_halo"), CHUNK)
    )
    out = compute(d.unionByName(halo), [*by, CHUNK])
    return out.where(~F.col("_halo")).drop(CHUNK, "_halo")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    strict: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Attach to each left row the last right row at or before it (before, if ``strict``).

    Both sides lie in common ranges of (key, time, side). Each range receives one carried row, the
    last right row of any earlier range of its key, so no task holds a whole key. ``payload``
    columns come back with their own names plus ``matched_ts``; NULL where none exists.
    """
    body = F.struct(
        F.col(right_ts).alias("_rts"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)],
        *[F.col(p).alias(p) for p in payload],
    )
    side_r, side_l = (2, 1) if strict else (1, 2)
    r = right.select(*by, F.col(right_ts).alias("_ts"), body.alias("_pay")).withColumn("_side", F.lit(side_r))
    lhs = left.withColumn("_ts", F.col(left_ts)).withColumn("_side", F.lit(side_l))
    both = ranged(lhs.unionByName(r, allowMissingColumns=True), by, ["_ts", "_side", "_pay"], ranges)
    latest = both.groupBy(*by, CHUNK).agg(F.max("_pay").alias("_last"))
    carried = latest.select(*by, CHUNK, F.max("_last").over(_before(by)).alias("_carried"))
    w = Window.partitionBy(*by, CHUNK).orderBy("_ts", "_side", "_pay").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_hit", F.last("_pay", ignorenulls=True).over(w)).where(F.col("_side") == side_l)
    hit = matches(hit, carried, by).withColumn("_hit", F.coalesce("_hit", "_carried"))
    return hit.select(
        *left.columns,
        F.col("_hit._rts").alias("matched_ts"),
        *[F.col(f"_hit.{p}").alias(p) for p in payload],
    )


def running_max(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Largest ``value`` strictly before each row; NULL on the first row of a key."""
    d = ranged(df, by, order, ranges)
    tops = d.groupBy(*by, CHUNK).agg(F.max(value).alias("_t"))
    base = tops.select(*by, CHUNK, F.max("_t").over(_before(by)).alias("_base"))
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = matches(d.withColumn("_run", F.max(value).over(inside)), base, by)
    return out.withColumn(name, F.greatest("_run", "_base")).drop(CHUNK, "_run", "_base")

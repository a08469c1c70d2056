"""Bar readers: bounded scans, month routing, context rows, inventories, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(
    df: DataFrame,
    columns: Sequence[str],
    start: str,
    end: str,
    assets: Sequence[str] | None = None,
    clock: str = "available_at",
    interval_minutes: int = 1,
    asset: str = "asset",
    ts: str = "ts",
) -> DataFrame:
    """Projection and half-open time bound on the chosen clock.

    The bound is moved onto the stored column, so it still reaches the file scan.
    """
    step = F.expr(f"INTERVAL {interval_minutes} MINUTES")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if clock == "available_at":
        lo, hi = lo - step, hi - step
    elif clock != "event_time":
        raise ValueError(f"unknown clock {clock}")
    out = df.where((F.col(ts) >= lo) & (F.col(ts) < hi))
    if assets is not None:
        out = out.where(F.col(asset).isin(list(assets)))
    return out.select(
        asset, F.col(ts).alias("event_time"), (F.col(ts) + step).alias("available_at"), *columns
    )


def month_of(ts: str, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def write_by_month(df: DataFrame, path: str, zone: str = "UTC", ts: str = "ts", files_per_month: int = 4) -> None:
    """Monthly layout; rows of a month spread over several files instead of one task."""
    d = df.withColumn("month", month_of(ts, zone)).withColumn("_salt", F.abs(F.xxhash64(*df.columns)) % files_per_month)
    d.repartition("month", "_salt").drop("_salt").write.partitionBy("month").mode("errorifexists").parquet(path)


def read_months(spark: SparkSession, path: str, start: str, end: str, zone: str = "UTC", ts: str = "ts") -> DataFrame:
    """Read ``[start, end)`` of a monthly layout; the month predicate prunes folders."""
    if start >= end:
        raise ValueError("empty time range")
    local = f"date_format(from_utc_timestamp(TIMESTAMP '{{}}'{{}}, '{zone}'), 'yyyy-MM')"
    first, last = local.format(start, ""), local.format(end, " - INTERVAL 1 MICROSECOND")
    d = spark.read.parquet(path).where(f"month >= {first} AND month <= {last}")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return d.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def month_gaps(df: DataFrame, month: str, by: Sequence[str] = ()) -> DataFrame:
    """Months between the first and last observed one, of each key, that have no rows."""
    seen = df.select(*by, F.trunc(F.col(month), "month").alias("month")).distinct()
    span = seen.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    want = span.select(*by, F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("month"))
    return want.join(seen, [*by, "month"], "left_anti")


def partition_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Files of a corpus as (month, file, length); contents are never read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path).select("path", "length")
    )
    month = F.nullif(F.regexp_extract("path", r"month=(\d{4}-\d{2})", 1), F.lit(""))
    return files.select(month.alias("month"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def manifest(spark: SparkSession, path: str, source: str, revision: str, pattern: str = "*.parquet") -> DataFrame:
    """One identity over months, names and sizes, never the path.

    File hashes are summed, so no list of files is gathered however many there are.
    """
    files = partition_files(spark, path, pattern)
    h = F.xxhash64(F.coalesce("month", F.lit("")), "file", "length").cast("decimal(38,0)")
    one = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sum(h).alias("_h"))
    body = F.concat_ws("|", F.lit(source), F.lit(revision), F.col("file_count"), F.col("bytes"), F.col("_h"))
    ident = F.concat(F.lit("manifest-"), F.substring(F.sha2(body, 256), 1, 24))
    # An empty corpus is an error, not an empty manifest.
    ident = F.when(F.col("file_count") > 0, ident).otherwise(F.raise_error(F.lit(f"no file matches {pattern}")).cast("string"))
    return one.select(ident.alias("manifest_id"), "file_count", "bytes")


def preview(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    if not 1 <= limit <= 100_000:
        raise ValueError("limit must lie in 1..100000")
    return df.orderBy(*keys).limit(limit)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def content_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of the content."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def materialize(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write Parquet once (or replace it) and return the record of what was written."""
    df.write.option("compression", "zstd").mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return content_digest(df.sparkSession.read.schema(df.schema).parquet(path))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest version per key wins; a reduction by key, so hot keys combine map-side.

    Most keys have one or two versions, so marks of the keys would be nearly as many as the rows: here whole
    rows go through one shuffle. ``ordering.latest`` suits keys with many rows.
    """
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    ordered = [version, *[c for c in rest if c != version]]
    g = both.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_row"))
    return g.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def load_range(df: DataFrame, start: str, end: str, clock: str = "available_at") -> DataFrame:
    return df.where((F.col(clock) >= F.lit(start).cast("timestamp")) & (F.col(clock) < F.lit(end).cast("timestamp")))


def read_with_context(
    df: DataFrame, key: str, ts: str, start: str, end: str, prior: int, future: int
) -> DataFrame:
    """Rows in ``[start, end)`` plus ``prior`` earlier and ``future`` later rows per key.

    Keys without a row in the range vanish. The range is a filter that reaches the scan; the
    context is the nearest ``prior`` or ``future`` rows per key, which Catalyst limits inside every
    map task, so a key with a long history ships only that many rows a task.
    """
    inside = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    parts = [inside]
    for rows, side, order in ((prior, F.col(ts) < start, F.desc(ts)), (future, F.col(ts) >= end, F.asc(ts))):
        nearest = F.row_number().over(Window.partitionBy(key).orderBy(order))
        near = df.where(side).withColumn("_n", nearest).where(F.col("_n") <= rows).drop("_n")
        parts.append(near.join(inside.select(key).distinct(), key, "left_semi"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

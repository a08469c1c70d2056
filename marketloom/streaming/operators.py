"""Streaming twins of the batch operators.

Wherever a mergeable aggregate says the same as keyed user state, the aggregate is used:
it combines before the shuffle and spreads a busy key over tasks. Keyed Python state is
kept for rolling features only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marketloom.operators.chunks import running_max
from marketloom.settings import shared_dir
from marketloom.sources.records import projection_key
from marketloom.streaming.run import ROCKSDB, batch_folder, collect_batches, previous_batch, run_available


def deduplicated(stream: DataFrame, ident: str, ts: str, delay: str) -> DataFrame:
    """Events once per identity within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def source_conflicts(stream: DataFrame, keys: Sequence[str], ident: str, ts: str, delay: str) -> DataFrame:
    """Provider keys of a day with their number of deliveries and whether contents differ.

    Differing identities show as min <> max, so no per-key Python state is needed. A day's keys
    leave the state once the watermark has passed the day.
    """
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("_w"), *keys)
    g = g.agg(F.count("*").alias("deliveries"), (F.min(ident) != F.max(ident)).alias("conflict"))
    return g.select(F.to_date("_w.start").alias("day"), *keys, "deliveries", "conflict")


def derived_rows(stream: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One row per key and day with ``conflict``: equal deliveries collapse, unequal ones are told apart.

    Values are those of the smallest delivery; they mean nothing where ``conflict`` holds.
    """
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.min(v) != F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count("*")))
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("_w"), *keys)
    g = g.agg(*[F.min(v).alias(v) for v in values], differs.alias("conflict"))
    return g.select(F.to_date("_w.start").alias("day"), *keys, *values, "conflict")


def latest_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Newest row per key under (event_time, sequence, ...), for update mode."""
    g = stream.groupBy(*keys).agg(F.max(F.struct(*order, *payload)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*order, *payload)])


def projections(events: DataFrame) -> DataFrame:
    """Latest state of all kinds from one pass over decoded events, for update mode.

    One row per (kind, key) with the newest event under (event_time, sequence, received_at, event_id); equal
    deliveries change nothing. The tagged state combines before its shuffle, so a busy key is no single task.
    """
    order = ["event_time", "sequence", "received_at", "event_id"]
    d = events.withColumn("key", projection_key()).where(F.col("key").isNotNull())
    rest = [c for c in d.columns if c not in ("kind", "key", *order)]
    g = d.groupBy("kind", "key").agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return g.select("kind", "key", *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])


def arrival_counters(stream: DataFrame, source: str, sequence: str, arrival: str, event: str, stale: float, purpose: str) -> DataFrame:
    """Per source: events, out-of-order, stale and future arrivals.

    The running maximum of the sequence is taken per range of rows inside a batch. A batch stores the
    maximum so far, one row per source, and reads that of the batch before it, so its cost doesn't
    depend on how many came earlier.
    """
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    tops = StructType([stream.schema[source], StructField("_top", stream.schema[sequence].dataType)])

    def step(df: DataFrame, batch: int) -> None:
        d = running_max(df, [source], [arrival, sequence], sequence, "_before")
        prior = previous_batch(df.sparkSession, root, "tops", tops, batch)
        if prior is not None:
            d = d.join(prior, source, "left").withColumn("_before", F.greatest("_before", "_top"))
        age = F.col(arrival).cast("double") - F.col(event).cast("double")
        out = d.groupBy(source).agg(
            F.count("*").alias("events"), F.count_if(F.col(sequence) <= F.col("_before")).alias("out_of_order"),
            F.count_if(age > stale).alias("stale"), F.count_if(age < 0).alias("future"))
        batch_folder(root, "counts")(out, batch)
        top = df.groupBy(source).agg(F.max(sequence).alias("_top"))
        if prior is not None:
            top = top.union(prior.select(source, "_top")).groupBy(source).agg(F.max("_top").alias("_top"))
        batch_folder(root, "tops")(top, batch)

    run_available(stream, step, "append", purpose)
    names = ["events", "out_of_order", "stale", "future"]
    schema = StructType([stream.schema[source], *[StructField(n, LongType()) for n in names]])
    rows = collect_batches(spark, root, "counts", schema)
    return rows.groupBy(source).agg(*[F.sum(n).alias(n) for n in names])


def positions(stream: DataFrame, deal: str, ts: str, delay: str, by: Sequence[str], signed: Column, purpose: str) -> DataFrame:
    """Net position per key from deduplicated deals; flat positions vanish.

    Each batch stores its partial sums; the position is their total.
    """
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)

    def step(df: DataFrame, batch: int) -> None:
        batch_folder(root, "parts")(df.groupBy(*by).agg(F.sum(signed).alias("position"), F.count("*").alias("deals")), batch)

    run_available(deduplicated(stream, deal, ts, delay), step, "append", purpose)
    schema = StructType([stream.schema[b] for b in by]).add("position", "double").add("deals", "long")
    rows = collect_batches(spark, root, "parts", schema).groupBy(*by).agg(F.sum("position").alias("position"), F.sum("deals").alias("deals"))
    return rows.where(F.abs("position") > 1e-12)


def session_bars(stream: DataFrame, sessions: DataFrame, base_minutes: int, widths: Sequence[int], price: str, size: str, delay: str = "1 day") -> DataFrame:
    """Session-anchored bars of several widths (in base slots) in update mode."""
    cal = sessions.select("session_date", "open_at", "close_at")
    d = stream.withWatermark("ts", delay).withColumn("session_date", F.to_date("ts")).join(cal, "session_date")
    d = d.where((F.col("ts") >= F.col("open_at")) & (F.col("ts") < F.col("close_at")))
    slot = F.floor(F.expr("timestampdiff(MINUTE, open_at, ts)") / base_minutes)
    d = d.withColumns({"slot": slot, "width": F.explode(F.array(*[F.lit(int(w)) for w in widths]))})
    # The day window is the event-time key: bars leave the state when the watermark has passed their day.
    g = d.groupBy(F.window("ts", "1 day").alias("_w"), "asset", "session_date", "width", F.floor(F.col("slot") / F.col("width")).alias("bucket"))
    return g.agg(
        F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"),
        F.sum(size).cast("double").alias("volume"), F.count("*").alias("rows")).drop("_w")


def barrier(stream: DataFrame, keys: Sequence[str], member: str, expected: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Cross-sections that are complete; partial ones are not emitted and leave the state with the watermark.

    ``keys`` must hold the event time ``ts``; ``expected`` is one row with the number of members of a whole one.
    """
    g = stream.withWatermark(ts, delay).groupBy(*keys).agg(F.size(F.collect_set(member)).cast("long").alias("members"))
    return g.crossJoin(expected.select(expected[0].alias("_expected"))).where("members = _expected").drop("_expected")


def gated(stream: DataFrame, verdict: Callable[[DataFrame], DataFrame], purpose: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and blocked sinks from one pass; ``verdict`` adds ``allowed`` and ``codes``."""
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    judged = verdict(stream)

    def step(df: DataFrame, batch: int) -> None:
        # One write, by verdict, serves both sinks.
        df.withColumn("sink", F.when(F.col("allowed"), "accepted").otherwise("blocked")).write.partitionBy("sink").mode("overwrite").parquet(f"{root}/judged/batch={batch}")

    run_available(judged, step, "append", purpose)
    schema = StructType(list(judged.schema.fields)).add("sink", "string")
    rows = collect_batches(spark, root, "judged", schema).drop("batch")
    return tuple(rows.where(F.col("sink") == n).drop("sink") for n in ("accepted", "blocked"))


def late_rows(stream: DataFrame, ts: str, delay_seconds: int, purpose: str) -> tuple[DataFrame, DataFrame]:
    """On-time rows and a side table of rows older than the limit that the batches before have set."""
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    tops = StructType().add("_top", "timestamp")

    def step(df: DataFrame, batch: int) -> None:
        d, top = df.withColumn("late", F.lit(False)), df.agg(F.max(ts).alias("_top"))
        prior = previous_batch(df.sparkSession, root, "tops", tops, batch)
        if prior is not None:
            limit = F.col("_top") - F.make_dt_interval(secs=F.lit(delay_seconds))
            d = df.crossJoin(prior).withColumn("late", F.coalesce(F.col(ts) < limit, F.lit(False))).drop("_top")
            top = top.union(prior).agg(F.max("_top").alias("_top"))
        batch_folder(root, "rows")(d, batch)
        batch_folder(root, "tops")(top, batch)

    run_available(stream, step, "append", purpose)
    rows = collect_batches(spark, root, "rows", StructType(list(stream.schema.fields)).add("late", "boolean")).drop("batch")
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")


class RollingFeatures(StatefulProcessor):
    """Momentum and rolling mean over the last ``width`` bars of one asset.

    State is the last bars only. Bars of a key must move forward in time.
    """

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", StructType([StructField("t", DoubleType()), StructField("close", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.bars.get()] if self.bars.exists() else []
        # A key's rows of one micro-batch come in several Arrow batches in any order.
        parts = [pdf for pdf in rows if len(pdf)]
        for pdf in [pd.concat(parts).sort_values("ts")] if parts else []:
            t = pdf["ts"].astype("int64").to_numpy(dtype=float)
            if held and t[0] <= held[-1][0] or (len(t) > 1 and (t[1:] <= t[:-1]).any()):
                raise ValueError(f"bars of {key[0]} do not move forward")
            closes = pd.Series([c for _, c in held] + pdf["close"].tolist(), dtype="float64")
            out = pd.DataFrame({
                "asset": pdf["asset"].to_numpy(), "ts": pdf["ts"].to_numpy(),
                "momentum": (closes / closes.shift(self.width - 1) - 1)[len(held):].to_numpy(),
                "mean": closes.rolling(self.width).mean()[len(held):].to_numpy(),
            })
            both = held + list(zip(t.tolist(), pdf["close"].tolist()))
            held = both[max(0, len(both) - self.width + 1):]
            yield out.astype(object).where(out.notna(), None)
        if held:
            self.bars.put([(float(a), float(b)) for a, b in held])

    def close(self) -> None:
        pass


def rolling_features(stream: DataFrame, width: int) -> DataFrame:
    """Features per asset from a stream of (asset, ts, close) bars."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = StructType([stream.schema["asset"], stream.schema["ts"], StructField("momentum", DoubleType()), StructField("mean", DoubleType())])
    return stream.groupBy("asset").transformWithStateInPandas(
        statefulProcessor=RollingFeatures(width), outputStructType=out, outputMode="Append", timeMode="None")


def labelled(stream: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, known: str, clock: str) -> DataFrame:
    """Stream bars with static labels; a label shows only once its target is available."""
    j = stream.join(labels, list(keys), "left")
    return j.withColumn(label, F.when(F.col(known) <= F.col(clock), F.col(label)))


def quote_events(stream: DataFrame, raw_millis: str, offset_seconds: Column) -> DataFrame:
    """Raw broker ticks to canonical quotes: clock offset removed, identity from raw fields."""
    d = stream.withColumn("event_time", F.timestamp_millis(F.col(raw_millis) - (offset_seconds * 1000).cast("long")))
    ident = F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(stream.columns)])
    return d.withColumn("event_id", F.concat(F.lit("evt-"), F.substring(F.sha2(ident, 256), 1, 24)))


def run_algorithm(stream: DataFrame, algorithm: Callable[[DataFrame], DataFrame], purpose: str) -> DataFrame:
    """User hook: a function from micro-batch to output rows, stored per batch."""
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    shape: dict[str, StructType] = {}

    def step(df: DataFrame, batch: int) -> None:
        out = algorithm(df)
        shape.setdefault("schema", out.schema)
        batch_folder(root, "out")(out, batch)

    run_available(stream, step, "append", purpose)
    return collect_batches(spark, root, "out", shape["schema"])


def parity(stream_rows: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """Counts of both tables and of rows found in only one of them (duplicates count)."""
    cols = sorted(batch_rows.columns)
    s = stream_rows.select(*cols).groupBy(*cols).agg(F.count("*").alias("_s"))
    b = batch_rows.select(*cols).groupBy(*cols).agg(F.count("*").alias("_b"))
    left, right = s.alias("s"), b.alias("b")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = left.join(right, same, "full_outer").select(F.coalesce("_s", F.lit(0)).alias("_s"), F.coalesce("_b", F.lit(0)).alias("_b"))
    extra = F.greatest(F.col("_s") - F.col("_b"), F.lit(0))
    lack = F.greatest(F.col("_b") - F.col("_s"), F.lit(0))
    g = j.agg(F.sum("_s").alias("stream_rows"), F.sum("_b").alias("batch_rows"), F.sum(extra).alias("only_stream"), F.sum(lack).alias("only_batch"))
    return g.withColumn("equal", (F.col("only_stream") == 0) & (F.col("only_batch") == 0))

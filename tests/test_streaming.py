from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from helpers import as_map, rows
from marketloom.settings import shared_dir
from marketloom.streaming import operators as so
from marketloom.streaming import run

SCHEMA = "source string, seq long, ts timestamp, received_at timestamp, price double, asset string"


def feed(spark, batches):
    """One file per micro-batch, in the order given."""
    folder = shared_dir(spark, "feed").removeprefix("file:")
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, "source string, seq long, t long, lag long, price double, asset string")
        df = df.select("source", "seq", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds(F.col("t") + F.col("lag")).alias("received_at"), "price", "asset")
        df.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > time.time() - 1000 and not name.startswith("x"):
                os.rename(path, os.path.join(folder, f"x{i}-{name}"))
                os.utime(os.path.join(folder, f"x{i}-{name}"), (1_700_000_000 + i * 10,) * 2)
    schema = spark.createDataFrame([], SCHEMA).schema
    return run.file_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def batches():
    return [
        [("s", 1, 100, 1, 1.0, "A"), ("s", 2, 160, 1, 2.0, "A"), ("s", 4, 200, 1, 3.0, "B")],
        [("s", 2, 160, 50, 2.0, "A"), ("s", 3, 210, 1, 4.0, "B"), ("s", 5, 220, 900, 5.0, "A")],
        [("s", 6, 10, 1, 9.0, "A"), ("s", 7, 300, -5, 6.0, "B")],
    ]


def test_dedupe_across_batches(spark, batches):
    d = so.deduplicated(feed(spark, batches), "seq", "ts", "1 hour")
    assert sorted(r["seq"] for r in run.to_table(d.select("seq"), "append", "t-dedupe").collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_latest_state_follows_event_time(spark, batches):
    d = so.latest_state(feed(spark, batches), ["asset"], ["ts", "seq"], ["price"])
    assert as_map(run.to_table(d, "update", "t-latest", ["asset"]), "asset", "price") == {"A": 5.0, "B": 6.0}


def test_arrival_counters_carry_state_between_batches(spark, batches):
    got = so.arrival_counters(feed(spark, batches), "source", "seq", "received_at", "ts", 600.0, "t-count").first()
    # seq 2 again and seq 3 arrive after seq 4
    assert (got["events"], got["out_of_order"], got["stale"], got["future"]) == (8, 2, 1, 1)


def test_late_rows_go_to_the_side_table(spark, batches):
    on, late = so.late_rows(feed(spark, batches), "ts", 100, "t-late")
    assert [r["seq"] for r in late.collect()] == [6] and on.count() == 7


def test_positions_ignore_repeated_deals(spark, batches):
    signed = F.when(F.col("asset") == "A", F.col("price")).otherwise(-F.col("price"))
    got = so.positions(feed(spark, batches), "seq", "ts", "1 hour", ["asset"], signed, "t-pos")
    assert as_map(got, "asset", "position") == {"A": 17.0, "B": -13.0}


def test_conflicts_and_barrier(spark, batches):
    again = batches + [[("s", 1, 400, 1, 8.0, "A")]]
    c = run.to_table(so.source_conflicts(feed(spark, again), ["seq"], "price", "ts", "365 days"), "update", "t-conf", ["day", "seq"])
    assert {r["seq"] for r in c.where("conflict").collect()} == {1} and as_map(c, "seq", "deliveries")[2] == 2
    pairs = [[("s", 1, 10, 0, 1.0, "A")], [("s", 2, 10, 0, 1.0, "B"), ("s", 3, 20, 0, 1.0, "A")]]
    b = run.to_table(so.barrier(feed(spark, pairs), ["ts"], "asset", spark.range(2, 3).toDF("members")), "update", "t-barrier", ["ts"])
    assert b.count() == 1


def test_rolling_features_keep_state_between_batches(spark):
    b = [[("s", i, 60 * i, 0, float(i + 1), "A") for i in range(k, k + 3)] for k in (0, 3, 6)]
    d = so.rolling_features(feed(spark, b).select("asset", "ts", F.col("price").alias("close")), 4)
    got = [(r["momentum"], r["mean"]) for r in run.to_table(d, "append", "t-roll").orderBy("ts").collect()]
    assert got[:3] == [(None, None)] * 3
    assert got[3] == (3.0, 2.5) and got[8] == (9 / 6 - 1, 7.5)


def test_parity_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    r = so.parity(a, b).first()
    assert (r["only_stream"], r["only_batch"], r["equal"]) == (1, 1, False)
    assert so.parity(a, a).first()["equal"]


def test_gate_splits_without_loss(spark, batches):
    def verdict(df):
        return df.withColumn("codes", F.array_compact(F.array(F.when(F.col("price") > 4, F.lit("HIGH"))))).withColumn("allowed", F.size("codes") == 0)

    ok, bad = so.gated(feed(spark, batches), verdict, "t-gate")
    assert ok.count() + bad.count() == 8 and {r["seq"] for r in bad.collect()} == {5, 6, 7}


def test_projections_of_all_kinds_follow_event_time_across_batches(spark):
    from marketloom.sources import records

    kinds = list(records.PROJECTED)
    # The same state is told twice; the newer event comes in the earlier batch for every other kind.
    rows_ = [[("s", n, 100 + (50 if (n % 2) == b else 0), b, float(b), k) for n, k in enumerate(kinds)] for b in (0, 1)]
    stream = feed(spark, rows_).withColumnRenamed("asset", "kind")
    events = stream.select(
        "kind", F.lit("S").alias("symbol"), F.lit(60).alias("interval_seconds"), *[F.lit(c).alias(c) for c in ("market", "account_id", "client_order_id", "connection_id")],
        F.col("ts").alias("event_time"), F.col("seq").alias("sequence"), "received_at", F.concat("kind", F.col("price").cast("string")).alias("event_id"), "price")
    got = run.to_table(so.projections(events), "update", "t-kinds", ["kind", "key"])
    assert as_map(got, "kind", "price") == {k: float(n % 2) for n, k in enumerate(kinds)}
    assert as_map(got, "kind", "key") == dict(zip(kinds, ["S", "S:60", "market", "account_id", "client_order_id", "client_order_id", "connection_id"]))

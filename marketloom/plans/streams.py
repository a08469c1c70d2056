"""Streaming queries: run over everything available and compared with their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators.orders import admissible
from marketloom.operators.resample import multi_interval
from marketloom.plans.market import UNION_SQL, union_lines
from marketloom.plans.registry import published, query
from marketloom.plans.sqltext import PANELS
from marketloom.settings import cut_lineage, shared_dir
from marketloom.sources import records
from marketloom.sources.panels import hourly, sessions, table, ticks
from marketloom.streaming import operators as so
from marketloom.streaming import run

FMT = "'%Y-%m-%d %H:%M:%S'"


def tick_stream(spark, sf):
    """events as an unbounded tick stream."""
    s = run.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    return s.select(
        F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"), "event_id", "user_id")


def batched_ticks(spark, sf, batches=3, files=2):
    """All events dealt to files of several micro-batches, so later batches hold rows that are late and out of order."""
    events = table(spark, sf, "events")
    path = shared_dir(spark, "batches")
    for b in range(batches):  # one after the other: the source reads files in the order of their times
        events.where(F.pmod("event_id", F.lit(batches)) == b).repartition(files).write.parquet(f"{path}/part{b}")
    s = run.file_stream(spark, path, "*.parquet", events.schema, files)
    return s.select(
        F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"), "event_id", "user_id")


def doubled(spark, sf):
    """Deliveries with repeats: users below 50 are delivered twice."""
    n = F.when(F.col("user_id") < 50, 2).otherwise(1)
    return tick_stream(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


@query("str01_dedupe", "SELECT event_id, event_type AS asset, value AS price FROM events")
def str01(spark, sf):
    d = so.deduplicated(doubled(spark, sf), "event_id", "ts", "1 day")
    return run.to_table(d.select("event_id", "asset", "price"), "append", "str01")


@query("str02_source_conflicts", """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type AS asset, count(*) + count(*) FILTER (user_id < 50) AS deliveries, min(value) <> max(value) AS conflict FROM events GROUP BY 1, 2, 3""")
def str02(spark, sf):
    d = so.source_conflicts(doubled(spark, sf), ["user_id", "asset"], "price", "ts", "2 days")
    return published(run.to_table(d, "update", "str02", ["day", "user_id", "asset"]))


@query("str03_arrival_counters", PANELS + """, z AS (SELECT asset, event_id AS seq, event_id % 3 AS batch, CAST(floor(epoch(ts)) AS BIGINT) + size * 30 - 60 AS arr, size * 30 - 60 AS age FROM ticks),
m AS (SELECT *, max(seq) OVER (PARTITION BY asset ORDER BY batch, arr, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM z)
SELECT asset, count(*) AS events, count(*) FILTER (seq <= top) AS out_of_order, count(*) FILTER (age > 1500) AS stale, count(*) FILTER (age < 0) AS future FROM m GROUP BY 1""")
def str03(spark, sf):
    d = batched_ticks(spark, sf).select("asset", F.col("event_id").alias("seq"), F.date_trunc("second", "ts").alias("event_time"), "size")
    d = d.withColumn("received_at", F.col("event_time") + F.make_dt_interval(secs=F.col("size") * 30 - 60))
    return so.arrival_counters(d, "asset", "seq", "received_at", "event_time", 1500.0, "str03")


@query("str04_latest_state", f"SELECT user_id, strftime(ts, {FMT}) AS ts, event_id, event_type AS asset, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS x WHERE r = 1")
def str04(spark, sf):
    d = so.latest_state(tick_stream(spark, sf), ["user_id"], ["ts", "event_id"], ["asset", "price"])
    return published(run.to_table(d, "update", "str04", ["user_id"]), None)


def projection_query(kind: str, letter: str) -> None:
    sql = f"""WITH {UNION_SQL} SELECT key, event_id AS sequence, strftime(t, {FMT}) AS event_time, state, price FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, event_id DESC) AS r FROM ub WHERE codes = '' AND key IS NOT NULL AND kind = '{kind}') AS x WHERE r = 1"""

    @query(f"str04{letter}_latest_{kind}", sql)
    def latest_of_kind(spark, sf):
        """One stream keeps the latest states of all kinds; this is one of its tables."""
        lines = union_lines(run.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema))
        good, _ = records.decode_events(lines, "line", positive=False)
        every = run.to_table(so.projections(good), "update", "str04", ["kind", "key"])
        return published(every.where(F.col("kind") == kind).select("key", "sequence", "event_time", "state", "price"), None)


for _letter, _kind in zip("bcdefgh", records.PROJECTED):
    projection_query(_kind, _letter)


@query("str05_positions", PANELS + """SELECT user_id, asset, CAST(sum(CASE WHEN size > 50 THEN 1 ELSE -1 END * size) AS DOUBLE) AS position, count(*) AS deals FROM ticks GROUP BY 1, 2 HAVING abs(sum(CASE WHEN size > 50 THEN 1 ELSE -1 END * size)) > 1e-12""")
def str05(spark, sf):
    signed = (F.when(F.col("size") > 50, 1).otherwise(-1) * F.col("size")).cast("double")
    return so.positions(doubled(spark, sf), "event_id", "ts", "1 day", ["user_id", "asset"], signed, "str05")


BARS = PANELS + """, t AS (SELECT k.*, session_date, CAST(floor(epoch(ts - open_at) / 3600) AS BIGINT) AS slot FROM ticks AS k JOIN sessions ON CAST(ts AS DATE) = session_date AND ts >= open_at AND ts < close_at),
b AS (SELECT asset, session_date, CAST(w AS BIGINT) AS width, slot // w AS bucket, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(size) AS DOUBLE) AS volume, count(*) AS rows FROM t, (SELECT unnest([1, 2, 4]) AS w) AS ww GROUP BY asset, session_date, w, slot // w)
"""


@query("str06_session_bars", BARS + "SELECT * EXCLUDE (width, session_date), strftime(session_date, '%Y-%m-%d') AS session_date FROM b WHERE width = 1")
def str06(spark, sf):
    d = so.session_bars(tick_stream(spark, sf), sessions(spark, sf), 60, [1], "price", "size")
    out = run.to_table(d, "update", "str06", ["asset", "session_date", "width", "bucket"])
    return published(out.drop("width"), None)


@query("str07_multi_interval", BARS + "SELECT * EXCLUDE (session_date), strftime(session_date, '%Y-%m-%d') AS session_date FROM b")
def str07(spark, sf):
    d = so.session_bars(tick_stream(spark, sf), sessions(spark, sf), 60, [1, 2, 4], "price", "size")
    return published(run.to_table(d, "update", "str07", ["asset", "session_date", "width", "bucket"]), None)


def bar_rows(spark, sf):
    h = hourly(spark, sf)
    ts = F.col("session_date").cast("timestamp") + F.make_dt_interval(hours=F.col("slot") + 9)
    return h.select("asset", ts.alias("ts"), "close", "session_date", "slot")


def bar_stream(spark, sf):
    """Hourly bars written once and read back as a stream."""
    rows = bar_rows(spark, sf)
    path = shared_dir(spark, "bars")
    rows.write.parquet(path)
    return run.file_stream(spark, path, "*.parquet", rows.schema)


@query("str08_rolling_features", PANELS + f""", z AS (SELECT asset, CAST(session_date AS TIMESTAMP) + to_hours(slot + 9) AS ts, close FROM hourly)
SELECT asset, strftime(ts, {FMT}) AS ts, round(close / lag(close, 4) OVER (PARTITION BY asset ORDER BY ts) - 1, 6) + 0.0 AS momentum, round(CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f END, 6) AS mean FROM z WINDOW f AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def str08(spark, sf):
    d = so.rolling_features(bar_stream(spark, sf).select("asset", "ts", "close"), 5)
    return published(run.to_table(d, "append", "str08"))


@query("str09_cross_section_barrier", PANELS + f"SELECT strftime(CAST(session_date AS TIMESTAMP) + to_hours(slot + 9), {FMT}) AS ts, count(*) AS members FROM hourly GROUP BY session_date, slot HAVING count(*) = (SELECT count(DISTINCT asset) FROM hourly)")
def str09(spark, sf):
    expected = bar_rows(spark, sf).agg(F.count_distinct("asset").alias("expected"))
    d = so.barrier(bar_stream(spark, sf), ["ts"], "asset", expected)
    return published(run.to_table(d, "update", "str09", ["ts"]))


@query("str10_freshness_gate", PANELS + """, c AS (SELECT event_id, concat_ws(',', CASE WHEN asset = 'view' THEN 'timing:delayed_not_allowed' END, CASE WHEN size > 80 THEN 'freshness:source_delay_exceeded' END, CASE WHEN user_id > 100 THEN 'freshness:event_age_exceeded' END) AS codes FROM ticks)
SELECT CASE WHEN codes = '' THEN 'accepted' ELSE 'blocked' END AS sink, codes, count(*) AS n FROM c GROUP BY 1, 2""")
def str10(spark, sf):
    def verdict(df):
        d = df.select("event_id", F.when(F.col("asset") == "view", "delayed").otherwise("live").alias("timing"), F.when(F.col("size") > 80, 900.0).otherwise(5.0).alias("source_delay"), F.col("user_id").cast("double").alias("age_seconds"))
        return admissible(d, 100.0, 60.0)

    ok, bad = so.gated(tick_stream(spark, sf), verdict, "str10")
    rows = ok.withColumn("sink", F.lit("accepted")).unionByName(bad.withColumn("sink", F.lit("blocked")))
    return rows.groupBy("sink", F.array_join("codes", ",").alias("codes")).agg(F.count("*").alias("n"))


@query("str11_late_rows", """WITH e AS (SELECT *, event_id % 3 AS batch FROM events), t AS (SELECT batch, max(ts) AS top FROM e GROUP BY 1),
l AS (SELECT e.*, (SELECT max(top) FROM t WHERE t.batch < e.batch) AS top FROM e)
SELECT coalesce(ts < top - INTERVAL 1 HOUR, false) AS late, event_type AS asset, count(*) AS n FROM l GROUP BY 1, 2""")
def str11(spark, sf):
    """Rows older than the limit that earlier batches set go to a side table."""
    on, late = so.late_rows(batched_ticks(spark, sf), "ts", 3600, "str11")
    rows = on.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return rows.groupBy("late", "asset").agg(F.count("*").alias("n"))


@query("str12_stream_labels", PANELS + f""", l AS (SELECT s.asset, s.session_date, s.slot, t.close / s.close - 1 AS y, s.slot + 2 AS known FROM hourly AS s JOIN hourly AS t ON s.asset = t.asset AND s.session_date = t.session_date AND t.slot = s.slot + 2)
SELECT h.asset, strftime(h.session_date, '%Y-%m-%d') AS session_date, h.slot, round(CASE WHEN known <= 6 THEN y END, 6) + 0.0 AS y FROM hourly AS h LEFT JOIN l ON h.asset = l.asset AND h.session_date = l.session_date AND h.slot = l.slot""")
def str12(spark, sf):
    from marketloom.operators.joins import same_session_label

    h = bar_rows(spark, sf)
    lab = same_session_label(h, 2, ["asset", "session_date"], "slot", "close", "y").select("asset", "session_date", "slot", "y", (F.col("slot") + 2).alias("known"))
    lab = cut_lineage(lab.where("y IS NOT NULL"), "labels")
    d = so.labelled(bar_stream(spark, sf).withColumn("clock", F.lit(6)), lab, ["asset", "session_date", "slot"], "y", "known", "clock")
    return published(run.to_table(d.select("asset", "session_date", "slot", "y"), "append", "str12"))


@query("str13_derived_rows", """SELECT user_id, event_type AS asset, strftime(ts, '%Y-%m-%d') AS day, min(value) AS price FROM events GROUP BY 1, 2, 3 HAVING count(DISTINCT value) = 1""")
def str13(spark, sf):
    """Equal derived rows collapse, unequal ones drop out."""
    d = so.derived_rows(doubled(spark, sf), ["user_id", "asset"], ["price"], "ts", "2 days")
    out = run.to_table(d, "update", "str13", ["day", "user_id", "asset"])
    return published(out.where("NOT conflict").drop("conflict"), None)


@query("str14_quote_events", PANELS + f"SELECT strftime(date_trunc('second', ts), {FMT}) AS event_time, asset, count(*) AS n FROM ticks GROUP BY 1, 2")
def str14(spark, sf):
    raw = tick_stream(spark, sf).select("asset", "price", "event_id", ((F.unix_timestamp("ts") + 7200) * 1000).alias("raw_ms")).withColumnRenamed("event_id", "seq")
    d = so.quote_events(raw, "raw_ms", F.lit(7200))
    out = run.to_table(d.select("event_time", "asset", "event_id"), "append", "str14")
    return published(out.groupBy("event_time", "asset").agg(F.count_distinct("event_id").alias("n")))


@query("src20_replay_stream", f"SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 90 SECOND, {FMT}) AS received_at, value AS price FROM events")
def src20(spark, sf):
    t = ticks(spark, sf).select("event_id", F.date_trunc("second", "ts").alias("available_at"), "price", F.to_date("ts").alias("day"))
    d = run.replay(t, "day", 90, 10)
    return published(run.to_table(d.select("event_id", "received_at", "price"), "append", "src20"), None)


@query("ev35_stream_batch_parity", BARS + "SELECT CAST(count(*) AS BIGINT) AS stream_rows, CAST(count(*) AS BIGINT) AS batch_rows, CAST(0 AS BIGINT) AS only_stream, CAST(0 AS BIGINT) AS only_batch, true AS equal FROM b")
def ev35(spark, sf):
    """Streamed bars against batch bars of the same ticks, all days and columns."""
    d = so.session_bars(tick_stream(spark, sf), sessions(spark, sf), 60, [1, 2, 4], "price", "size")
    s = run.to_table(d, "update", "ev35", ["asset", "session_date", "width", "bucket"])
    h = hourly(spark, sf)
    b = multi_interval(h.drop("n"), [1, 2, 4]).drop("is_complete", "rows")
    wide = h.withColumn("width", F.explode(F.array(*[F.lit(w) for w in (1, 2, 4)])))
    n = wide.groupBy("asset", "session_date", "width", F.floor(F.col("slot") / F.col("width")).alias("bucket")).agg(F.sum("n").alias("rows"))
    return so.parity(s, b.join(n, ["asset", "session_date", "width", "bucket"]))


@query("udf04_stream_algorithm", "SELECT event_type AS asset, count(*) FILTER (value > 50) AS alerts FROM events GROUP BY 1")
def udf04(spark, sf):
    def alerts(df):
        return df.groupBy("asset").agg(F.count_if(F.col("price") > 50).alias("alerts"))

    out = so.run_algorithm(tick_stream(spark, sf), alerts, "udf04")
    return out.groupBy("asset").agg(F.sum("alerts").alias("alerts"))

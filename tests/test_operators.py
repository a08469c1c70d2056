from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import as_map, assert_causal, assert_layout_free, close, rows
from marketloom.functions import text as tx
from marketloom.functions.numeric import average_rank, clip, correlation, safe_divide
from marketloom.operators import calendar, chunks, cross, folds, joins, lineage, ordering, orders, quality, resample, windows
from marketloom.operators import factors as fa

BAR = "asset string, ts int, open double, high double, low double, close double, volume double"


def skewed(spark, n=400, seed=3):
    """One asset holds most rows."""
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.7 else f"a{rng.randrange(4)}", i, float(rng.randrange(50))) for i in range(n)]
    return spark.createDataFrame(data, "asset string, ts int, x double")


# --- quality --------------------------------------------------------------------------


def test_bad_row_quarantines_good_row_and_exact_copies_collapse(spark):
    good = ("A", 1, 10.0, 11.0, 9.0, 10.5, 5.0)
    data = [good, good, ("B", 1, 10.0, 11.0, 9.0, 10.5, 5.0), ("B", 1, 10.0, 8.0, 9.0, 10.5, 5.0), ("C", 1, 1.0, 0.5, 1.0, 1.0, 1.0), ("D", 1, 1.0, 1.0, 1.0, 1.0, -1.0)]
    df = spark.createDataFrame(data, BAR)
    assert [r[0] for r in rows(quality.clean_bars(df))] == ["A"]
    assert_layout_free(quality.clean_bars, df)


def test_null_beside_value_is_a_conflict(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("B", None), ("B", None), ("C", 2.0)], "k string, v double")
    assert rows(quality.quarantine_conflicts(df, ["k"], ["v"])) == [("B", None), ("C", 2.0)]


def test_duplicate_groups_count_null_as_variant(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("A", 1.0), ("B", 2.0), ("B", 2.0)], "k string, v double")
    assert rows(quality.duplicate_groups(df, ["k"], ["v"])) == [("A", 3, 2, True), ("B", 2, 1, False)]


def test_placeholder_is_strict(spark):
    df = spark.createDataFrame(
        [("halt", 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 5.0), ("moved", 0.0, 0.0, 0.0, 5.1, 0.0, 0.0, 5.0), ("null", 0.0, 0.0, 0.0, 5.0, 0.0, None, 5.0)],
        "k string, open double, high double, low double, close double, volume double, amount double, pre_close double")
    assert as_map(df.withColumn("p", quality.is_no_trade_placeholder()), "k", "p") == {"halt": True, "moved": False, "null": False}


def test_price_authority_bounds_are_inclusive(spark):
    req = spark.sql("SELECT * FROM VALUES (1L,'A',DATE'2024-01-10',DATE'2024-01-20',true),(2L,'A',DATE'2024-01-11',DATE'2024-01-19',true),(3L,'A',DATE'2024-01-10',DATE'2024-01-20',false) AS t(request_id,asset,start,end,cross_session)")
    ev = spark.sql("SELECT 'A' AS asset, explode(array(DATE'2024-01-10', DATE'2024-01-20')) AS effective_at")
    cov = spark.sql("SELECT 'A' AS asset, DATE'2024-01-01' AS covered_from, DATE'2024-12-31' AS covered_to")
    got = quality.price_authority(req, ev, cov)
    assert as_map(got, "request_id", "events_inside") == {1: 2, 2: 0, 3: 2}
    assert as_map(got, "request_id", "allowed") == {1: False, 2: True, 3: True}


# --- chunked windows ------------------------------------------------------------------


def test_lookback_equals_plain_window_on_a_hot_key(spark):
    df = skewed(spark)

    def mean(frame, part):
        return frame.withColumn("m", F.avg("x").over(windows.frame(6, part, "ts")))

    got = chunks.with_lookback(df, ["asset"], ["ts"], 5, mean, ranges=9)
    want = mean(df, ["asset"])
    assert [(a, t, round(m, 9)) for a, t, _, m in rows(got.select(*want.columns))] == [(a, t, round(m, 9)) for a, t, _, m in rows(want)]


def test_running_total_max_and_numbering(spark):
    df = skewed(spark)
    w = Window.partitionBy("asset").orderBy("ts")
    got = chunks.running_total(df, ["asset"], ["ts"], "x", "v", ranges=7)
    assert rows(got) == rows(df.withColumn("v", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    got = chunks.running_max(df, ["asset"], ["ts"], "x", "v", ranges=7)
    assert rows(got) == rows(df.withColumn("v", F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    got = chunks.numbered(df, [], ["ts"], "v", ranges=7)
    assert sorted(r["v"] for r in got.collect()) == list(range(1, 401))
    assert all(r["v"] == r["ts"] + 1 for r in got.collect())


def test_ranges_share_out_a_key_that_holds_half_the_rows_on_one_day(spark):
    hot = spark.range(30_000).select(F.lit("hot").alias("asset"), (F.lit(1_700_000_000) + F.col("id") % 20_000).alias("ts"), "id")
    cold = spark.range(30_000, 60_000).select(F.concat(F.lit("c"), F.col("id") % 300).alias("asset"), (F.lit(1_600_000_000) + F.col("id") * 977).alias("ts"), "id")
    df = hot.union(cold)
    laid = chunks.ranged(df, ["asset"], ["ts"], 12)
    sizes = [r["count"] for r in laid.groupBy(chunks.CHUNK).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2.5 * 60_000 / 12
    got = chunks.running_total(df.withColumn("x", F.lit(1)), ["asset"], ["ts", "id"], "x", "n", ranges=12)
    w = Window.partitionBy("asset").orderBy("ts", "id")
    assert got.join(df.withColumn("m", F.row_number().over(w)), "id").where("n != m").isEmpty()


def test_ranges_take_null_keys_ties_and_empty_tables(spark):
    data = [(None, 1, 2.0), (None, 1, 2.0), (None, None, 5.0), ("a", 3, 1.0), ("a", 3, 4.0), ("a", None, None)] * 3
    df = spark.createDataFrame(data, "asset string, ts long, x double")
    for n in (1, 3, 5):
        got = chunks.running_total(df, ["asset"], ["ts"], "x", "v", ranges=n)
        ends = {r["asset"]: r["m"] for r in got.groupBy("asset").agg(F.max("v").alias("m")).collect()}
        assert ends == {None: 27.0, "a": 15.0} and got.count() == len(data)
        assert sorted(r["v"] for r in chunks.numbered(df, ["asset"], ["ts"], "v", ranges=n).collect()) == sorted([*range(1, 10)] * 2)
    assert chunks.numbered(df.limit(0), ["asset"], ["ts"], "v").isEmpty()


def test_context_rows_and_split_factors(spark):
    from marketloom.operators import orders
    from marketloom.sources import bars

    df = spark.createDataFrame([("a", t) for t in range(10)] + [("b", 1), ("b", 9)], "k string, ts long")
    got = rows(bars.read_with_context(df, "k", "ts", 4, 6, 2, 1))
    assert got == [("a", t) for t in (2, 3, 4, 5, 6)]
    day = "2024-01-{:02d}".format
    px = spark.createDataFrame([("a", day(d), 10.0) for d in range(1, 8)] + [("z", day(1), 7.0)], "asset string, ts string, close double").withColumn("ts", F.to_date("ts"))
    sp = spark.createDataFrame([("a", day(3), day(1), 2.0), ("a", day(6), day(1), 5.0), ("a", day(7), day(9), 3.0)], "asset string, effective_at string, available_at string, ratio double")
    sp = sp.withColumn("effective_at", F.to_date("effective_at")).withColumn("available_at", F.to_date("available_at"))
    out = {(r["asset"], r["ts"].day): round(r["factor"], 9) for r in orders.split_adjusted(px, sp, day(8)).collect()}
    assert out == {("a", 1): 0.1, ("a", 2): 0.1, ("a", 3): 0.2, ("a", 4): 0.2, ("a", 5): 0.2, ("a", 6): 1.0, ("a", 7): 1.0, ("z", 1): 1.0}


@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_pandas(spark, strict):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.choice(["h", "h", "h", "c"], 200), "t": np.sort(rng.integers(0, 300, 200)), "i": range(200)})
    right = pd.DataFrame({"k": rng.choice(["h", "h", "c"], 60), "t": np.sort(rng.integers(20, 300, 60))}).drop_duplicates()
    right["p"] = np.arange(len(right)) * 1.5
    got = chunks.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", ["p"], strict=strict, ranges=6)
    want = pd.merge_asof(left, right, on="t", by="k", allow_exact_matches=not strict)
    expect = {r.i: (None if pd.isna(r.p) else r.p) for r in want.itertuples()}
    assert as_map(got, "i", "p") == expect


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(6)
    data = [("hot", float(round(v, 1))) for v in rng.lognormal(0, 2, 700)] + [("one", 3.0), ("flat", 2.0), ("flat", 2.0)]
    got = resample.exact_quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", [0.0, 0.1, 0.5, 0.95, 1.0])
    for r in got.collect():
        want = np.quantile([v for k, v in data if k == r["k"]], [0.0, 0.1, 0.5, 0.95, 1.0])
        assert all(close(a, float(b), 1e-9) for a, b in zip(list(r)[1:], want))


# --- time windows ---------------------------------------------------------------------


def test_rolling_needs_every_value(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])], "asset string, ts int, x double")
    got = df.select("ts", windows.rolling_mean("x", 3, ["asset"], "ts").alias("m"))
    assert as_map(got, "ts", "m") == {0: None, 1: None, 2: None, 3: None, 4: None, 5: 5.0}


def test_windows_do_not_look_ahead(spark):
    df = skewed(spark).withColumn("x", F.col("x") + 1)
    for op in (
        lambda d: d.select("asset", "ts", windows.rolling_std("x", 4, ["asset"], "ts").alias("v")),
        lambda d: d.select("asset", "ts", windows.simple_return("x", 3, ["asset"], "ts").alias("v")),
        lambda d: d.select("asset", "ts", windows.rolling_median("x", 5, ["asset"], "ts", 3, lag=1).alias("v")),
        lambda d: windows.nav_and_drawdown(d.withColumn("r", F.col("x") / 1000), "r", ["asset"], "ts").select("asset", "ts", "drawdown"),
    ):
        assert_causal(op, df, "ts", 200, "x")


def test_forward_return_stops_at_the_edge(spark):
    df = spark.createDataFrame([("A", i, 10.0 + i) for i in range(6)], "asset string, ts int, x double")
    got = as_map(df.select("ts", windows.forward_return("x", 2, ["asset"], "ts", before=F.lit(4)).alias("y")), "ts", "y")
    assert close(got[1], 13 / 11 - 1) and got[2] is None and got[5] is None


# --- cross-sections -------------------------------------------------------------------


def panel(spark, values, label=None):
    data = [(1, f"a{i}", v, (label or values)[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "ts int, asset string, x double, y double")


def test_average_rank_ties_and_nulls(spark):
    df = panel(spark, [3.0, 1.0, 3.0, None, 2.0])
    assert as_map(df.select("asset", average_rank("x", ["ts"]).alias("r")), "asset", "r") == {"a0": 3.5, "a1": 1.0, "a2": 3.5, "a3": None, "a4": 2.0}


def test_zero_dispersion_differs_between_the_two_scores(spark):
    df = panel(spark, [2.0, 2.0, 2.0])
    got = df.select(cross.zscore_population("x", ["ts"]).alias("p"), cross.zscore_sample("x", ["ts"]).alias("s")).collect()
    assert {(r["p"], r["s"]) for r in got} == {(None, 0.0)}


def test_winsor_uses_linear_quantiles(spark):
    vals = [float(v) for v in (1, 2, 3, 4, 100)]
    got = as_map(panel(spark, vals).select("asset", cross.winsorized("x", ["ts"], 0.1, 0.9).alias("w")), "asset", "w")
    lo, hi = np.quantile(vals, [0.1, 0.9])
    assert all(close(got[f"a{i}"], float(np.clip(v, lo, hi))) for i, v in enumerate(vals))


def test_bucket_rules_differ(spark):
    df = panel(spark, [float(i) for i in range(7)])
    got = df.select("asset", cross.bucket_floor("x", "asset", ["ts"], 3).alias("f"), cross.bucket_even("x", "asset", ["ts"], 3).alias("e"))
    assert [as_map(got, "asset", "f")[f"a{i}"] for i in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    assert [as_map(got, "asset", "e")[f"a{i}"] for i in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    df = panel(spark, [float(i) for i in range(8)])
    got = df.select("asset", cross.bucket_floor("x", "asset", ["ts"], 3).alias("f"), cross.bucket_even("x", "asset", ["ts"], 3).alias("e"))
    assert [as_map(got, "asset", "e")[f"a{i}"] for i in range(8)] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_turnover_equals_dense_grid(spark):
    rng = np.random.default_rng(5)
    data = [(int(t), f"a{a}", float(rng.normal())) for t in (2, 3, 7, 9, 12) for a in range(6) if rng.random() < 0.6]
    df = spark.createDataFrame(data, "ts int, asset string, weight double")
    wide = pd.DataFrame(data, columns=["ts", "asset", "w"]).pivot(index="ts", columns="asset", values="w").fillna(0.0).sort_index()
    want = (0.5 * (wide - wide.shift(1).fillna(0.0)).abs().sum(axis=1)).to_dict()
    got = as_map(cross.turnover(df, "ts", "asset", "weight"), "ts", "turnover")
    assert all(close(got[t], want[t]) for t in want)


def test_neutralized_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(2)
    data = [(1, f"a{i}", float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(12)]
    df = spark.createDataFrame(data, "ts int, asset string, f double, v double, p double")
    r = cross.neutralized_many(df, "f", ["v", "p"], ["ts"], "resid").toPandas()
    assert abs((r.resid * r.v).sum()) < 1e-9 and abs((r.resid * r.p).sum()) < 1e-9 and abs(r.resid.sum()) < 1e-9


def test_correlation_of_flat_side_is_null(spark):
    df = panel(spark, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0])
    assert df.agg(correlation("x", "y").alias("c")).first()["c"] is None


def test_scalar_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    got = df.select(safe_divide("a", "b", 1e-12).alias("d"), safe_divide("a", "b", 1e-12, 9.0).alias("e"), clip("a", 2.0, 3.0).alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, 9.0, 2.0), (0.5, 0.5, 2.0), (None, None, None)]


# --- factors --------------------------------------------------------------------------


def test_factor_masks_every_level_and_names_the_reason(spark):
    data = [("A", 1, i, 10.0 + i, 5.0, i != 3) for i in range(8)]
    df = spark.createDataFrame(data, "asset string, session int, ts int, close double, volume double, is_complete boolean")
    for c in ("open", "high", "low"):
        df = df.withColumn(c, F.col("close"))
    f = fa.mean(fa.ret(fa.field("close"), 2), 2)
    got = fa.with_factors(df, {"v": f}, session="session")
    assert as_map(got, "ts", "v_reason") == {0: "INSUFFICIENT_HISTORY", 1: "INSUFFICIENT_HISTORY", 2: None, 3: "INCOMPLETE_BAR", 4: "INCOMPLETE_BAR", 5: "INCOMPLETE_BAR", 6: None, 7: None}
    assert close(as_map(got, "ts", "v")[7], (17 / 16 - 1 + 16 / 15 - 1) / 2)


def test_factor_types_are_checked():
    close_, volume = fa.field("close"), fa.field("volume")
    with pytest.raises(ValueError):
        _ = close_ + volume
    with pytest.raises(ValueError):
        _ = close_ * volume
    with pytest.raises(ValueError):
        fa.mean(fa.rank(close_), 3)
    with pytest.raises(ValueError):
        fa.ret(close_, 1)
    assert (fa.const(1.0) + fa.const(2.0)).key == (fa.const(2.0) + fa.const(1.0)).key


# --- joins, calendar, folds -----------------------------------------------------------


def test_null_safe_anti_join(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "i int, k string")
    b = spark.createDataFrame([(None,), ("x",)], "k string")
    assert [r["i"] for r in joins.without(a, b, ["k"]).collect()] == [3]


def test_same_session_label_needs_the_exact_slot(spark):
    df = spark.createDataFrame([("A", 1, 0, 10.0), ("A", 1, 2, 12.0), ("A", 1, 3, 13.0), ("A", 2, 0, 50.0)], "asset string, d int, slot int, close double")
    got = joins.same_session_label(df, 2, ["asset", "d"], "slot", "close")
    assert close(as_map(got, ["d", "slot"], "fwd")[(1, 0)], 0.2)
    assert as_map(got, ["d", "slot"], "fwd_reason")[(1, 2)] == "TARGET_MISSING"


def test_half_open_sessions_and_dst(spark):
    s = spark.sql("SELECT DATE'2024-03-11' AS session_date, TIMESTAMP'2024-03-11 13:30:00' AS open_at, TIMESTAMP'2024-03-11 20:00:00' AS close_at")
    t = spark.sql("SELECT explode(array(TIMESTAMP'2024-03-11 13:29:59', TIMESTAMP'2024-03-11 13:30:00', TIMESTAMP'2024-03-11 19:59:59', TIMESTAMP'2024-03-11 20:00:00')) AS ts")
    got = [(r["session_type"], r["minute"]) for r in calendar.sessionize(t, s, "America/New_York").orderBy("ts").collect()]
    assert got == [("outside_regular", None), ("regular", 0), ("regular", 389), ("outside_regular", None)]
    with pytest.raises(ValueError):
        calendar.session_filter(t, "extended")


def test_folds_keep_their_gap_and_are_complete(spark):
    cal = spark.range(60).selectExpr("date_add(DATE'2024-01-01', cast(id as int)) AS d")
    f = folds.purged_folds(cal, "d", 20, 10, 10, 3, 2).orderBy("fold").collect()
    assert len(f) == 3
    for r in f:
        assert (r["test_start"] - r["train_end"]).days == 6 and (r["test_end"] - r["test_start"]).days == 9
    parts = as_map(folds.thirds(cal, "d").groupBy("part").count(), "part", "count")
    assert parts == {"development": 19, "purge": 2, "validation": 19, "outer_exploratory": 20}


def test_latest_uses_the_full_order(spark):
    df = spark.createDataFrame([("k", 1, 5, "a"), ("k", 1, 6, "b"), ("k", 0, 9, "c")], "k string, t int, s int, v string")
    assert rows(ordering.latest(df, ["k"], ["t", "s"])) == [("k", 1, 6, "b")]


ORDERS = {
    "timestamp_seq": (["t", "n"], "t timestamp, n bigint"),
    "date_flag_int": (["d", "f", "i"], "d date, f boolean, i int"),
    "two_longs": (["n", "m"], "n bigint, m bigint"),
    "price": (["x"], "x double"),
    "text": (["s", "i"], "s string, i int"),
}


@pytest.mark.parametrize("name", ORDERS)
def test_newest_rows_agree_with_the_largest_struct(spark, name):
    """Nulls, extremes of the types, ties, null keys and one key with most rows."""
    order, schema = ORDERS[name]
    rng = random.Random(7)
    pools = {
        "timestamp": ["NULL", "TIMESTAMP'2024-01-02 00:00:00'", "TIMESTAMP'2024-01-02 00:00:00.000001'", "timestamp_micros(9223372036854775807)",
                      "timestamp_micros(9223372036854775806)", "timestamp_micros(-9223372036854775808)", "timestamp_micros(-1)"],
        "date": ["NULL", "DATE'1969-12-31'", "DATE'2024-02-29'", "DATE'9999-12-31'"], "boolean": ["NULL", "true", "false"],
        "bigint": ["NULL", "9223372036854775807L", "-9223372036854775807L - 1L", "0L", "-1L", "3L"], "int": ["NULL", "2147483647", "-2147483647 - 1", "0"],
        "double": ["NULL", "double('NaN')", "double('Infinity')", "-1.5D", "0D"], "string": ["NULL", "'a'", "'b'", "''"],
    }
    kinds = [part.split() for part in schema.split(", ")]
    lines = []
    for _ in range(300):
        key = rng.choice(["'hot'", "'hot'", "'hot'", "'a'", "'b'", "'c'", "NULL"])
        lines.append(f"({key}, {', '.join(f'CAST({rng.choice(pools[kind])} AS {kind})' for _, kind in kinds)}, '{rng.randrange(3)}')")
    df = spark.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS v(k, {', '.join(c for c, _ in kinds)}, payload)")
    whole = df.groupBy("k").agg(F.max(F.struct(*order, "payload")).alias("_r")).select("k", "_r.*")
    shown = [F.col(c).cast("string") if c not in "td" else F.expr({"t": "unix_micros(t)", "d": "unix_date(d)"}[c]).cast("string") for c in whole.columns]
    assert sorted(map(repr, ordering.latest(df, ["k"], order).select(*shown).collect())) == sorted(map(repr, whole.select(*shown).collect()))


def test_newest_marks_sort_nothing_and_read_no_payload(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS k", "timestamp_micros(id) AS t", "id AS n", "cast(id as string) AS payload").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    plan = ordering.newest_marks(df, ["k"], ["t", "n"])._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "HashAggregate" in plan and "Sort" not in plan.replace("ShuffleSort", "") and "payload" not in plan
    assert ordering.newest_marks(df, ["k"], ["payload"]) is None
    assert [r[3] for r in ordering.latest(df, ["k"], ["t", "n"]).orderBy("k").collect()] == [str(x) for x in (994, 995, 996, 997, 998, 999, 993)]
    assert ordering.latest(df.where("n < 0"), ["k"], ["t", "n"]).count() == 0


def test_common_support_needs_a_value_of_every_member(spark):
    data = [("a", 1, "x", 1.0), ("a", 1, "y", 2.0), ("a", 1, "y", 3.0), ("b", 1, "x", 1.0), ("b", 1, "x", 2.0), ("c", 1, "x", 1.0), ("c", 1, "y", None), (None, 1, "x", 1.0), (None, 1, "y", 1.0)]
    df = spark.createDataFrame(data, "asset string, ts int, member string, value double")
    got = joins.common_support(df, ["ts", "asset"], "member", 2)
    assert rows(got) == sorted(data[:3]) and got.columns == df.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert joins.common_support(df.where("ts < 0"), ["ts", "asset"], "member", 2).count() == 0


# --- orders, text, lineage ------------------------------------------------------------


def test_lots_and_fees(spark):
    df = spark.createDataFrame([("SSE_MAIN", 250.0, 330), ("SSE_STAR", 250.0, 900), ("SSE_STAR", 150.0, 900), ("BSE", 150.0, 900), ("SSE_MAIN", 335.0, 330), ("SSE_MAIN", 230.0, 330)], "b string, q double, h int")
    got = df.select(orders.buy_lots("b", "q").alias("buy"), orders.sell_lots("b", "q", "h").alias("sell")).collect()
    assert [tuple(r) for r in got] == [(200, 230), (250, 250), (0, 0), (150, 150), (300, 330), (200, 230)]
    f = spark.createDataFrame([("SELL", 10000.0, "SSE_MAIN"), ("BUY", 0.0, "BSE")], "s string, n double, b string")
    r = f.select(*[c.alias(k) for k, c in orders.fees("s", "n", "b").items()]).collect()
    assert (r[0]["commission"], round(r[0]["stamp_duty"], 9), round(r[0]["transfer"], 9)) == (5.0, 5.0, 0.1)
    assert set(r[1].asDict().values()) == {0.0}


def test_tokens_and_jaccard(spark):
    df = spark.createDataFrame([("Hello, hello W2 你好吗 好",), ("",)], "t string")
    got = [sorted(r["x"]) for r in df.select(tx.tokens("t").alias("x")).collect()]
    assert got == [sorted(["hello", "w2", "你好", "好吗", "好"]), []]
    j = df.select(tx.jaccard(tx.tokens("t"), tx.tokens(F.lit("hello"))).alias("j"), tx.jaccard(tx.tokens(F.lit("")), tx.tokens(F.lit(""))).alias("e")).collect()
    assert [r["j"] for r in j] == [0.2, 0.0] and j[0]["e"] == 1.0


def test_traversal_reaches_each_node_once_at_its_least_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a")], "parent string, child string")
    assert as_map(lineage.traverse(e, "a", "out", 6), "node", "depth") == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_depths_by_doubling(spark):
    n = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(11)], "n string, p string")
    assert as_map(lineage.depths(n, "n", "p"), "node", "depth") == {str(i): i for i in range(11)}


def test_register_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, c string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("d", "2")], "id string, c string")
    assert as_map(lineage.register(old, new, ["id"], "c"), "id", "action") == {"a": "SKIP", "b": "CONFLICT", "c": "APPEND", "d": "CONFLICT"}


def test_next_open_waits_for_the_first_session_from_any_distance(spark):
    from marketloom.operators.calendar import next_open

    s = spark.sql("SELECT DATE'2024-01-20' AS session_date, TIMESTAMP'2024-01-20 09:00:00' AS open_at, TIMESTAMP'2024-01-20 17:00:00' AS close_at")
    t = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2023-06-01 10:00:00'), (2, TIMESTAMP'2024-01-20 10:00:00'), (3, TIMESTAMP'2024-03-01 10:00:00') AS t(id, ts)")
    got = {r["id"]: (r["in_session"], str(r["next_open"])) for r in next_open(t, s).collect()}
    assert got == {1: (False, "2024-01-20 09:00:00"), 2: (True, "None"), 3: (False, "None")}


def test_open_periods_have_no_assumed_end(spark):
    from marketloom.operators.joins import interval_status

    p = spark.sql("SELECT 1 AS k, DATE'2020-05-01' AS start_date, CAST(NULL AS DATE) AS end_date, 'x' AS status")
    d = spark.sql("SELECT 1 AS k, explode(array(DATE'2019-01-01', DATE'2020-05-01', DATE'2101-07-01')) AS day")
    assert sorted(str(r["day"]) for r in interval_status(d, p, "k", "day").collect()) == ["2020-05-01", "2101-07-01"]


def test_stress_shows_books_without_any_shock(spark):
    from marketloom.operators.orders import stress

    w = spark.sql("SELECT * FROM VALUES ('a', 'X', 1.0D), ('b', 'Y', 1.0D) AS t(account, asset, weight)")
    sh = spark.sql("SELECT 's' AS scenario, 'X' AS asset, -0.5D AS shock")
    got = sorted(tuple(r) for r in stress(w, sh, ["account"]).collect())
    assert got == [("a", "s", -0.5, 0), ("b", "s", 0.0, 1)]


def test_traversal_has_no_node_limit(spark):
    from marketloom.operators.lineage import traverse, traversed_edges

    e = spark.range(1, 301).selectExpr("'r' AS parent", "concat('n', id) AS child").union(spark.sql("SELECT 'n1' AS parent, 'r' AS child"))
    got = traverse(e, "r", "out", 4)
    assert got.count() == 301 and got.agg({"depth": "max"}).first()[0] == 1
    assert traversed_edges(e, got).count() == 301


def test_exact_quantiles_survive_an_outlier(spark):
    from marketloom.operators.resample import exact_quantiles

    d = spark.range(1000).selectExpr("'g' AS g", "CASE WHEN id = 999 THEN 1e15 ELSE CAST(id AS DOUBLE) END AS v")
    assert exact_quantiles(d, ["g"], "v", [0.25, 0.5]).first()[1:] == (249.75, 499.5)


def test_shared_folders_can_be_cleared(spark, monkeypatch):
    from marketloom import settings

    monkeypatch.setattr(settings, "_made", [])
    frame = settings.cut_lineage(spark.range(3), "clear")
    assert frame.count() == 3 and settings.clear_shared(spark) == 1 and settings.clear_shared(spark) == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_user_features_over_ranges_equal_windows_of_each_key(spark, ranges):
    from marketloom.operators.userfn import FeatureSpec, with_feature

    rng = np.random.default_rng(3)
    data = [("hot", t, float(rng.normal()), float(rng.integers(1, 9))) for t in range(300)] + [(k, t, float(t), 1.0) for k in ("a", None) for t in range(5)]
    data[40] = ("hot", 40, None, 2.0)
    df = spark.createDataFrame(data, "k string, t long, x double, y double").repartition(6)

    def last_less_mean(block):
        assert block.shape[1:] == (6, 2)
        return block[:, -1, 0] - (block[:, :, 0] * block[:, :, 1]).sum(axis=1) / block[:, :, 1].sum(axis=1)

    got = {(r["k"], r["t"]): r["gap"] for r in with_feature(df, FeatureSpec("gap", ("x", "y"), 6, last_less_mean), ["k"], "t", ranges).collect()}
    assert len(got) == len(data)
    for k in ("hot", "a", None):
        rows_ = sorted((r for r in data if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(rows_):
            w = rows_[max(i - 5, 0) : i + 1]
            if len(w) < 6 or any(v[2] is None for v in w):
                assert got[(k, r[1])] is None
            else:
                assert close(got[(k, r[1])], r[2] - sum(v[2] * v[3] for v in w) / sum(v[3] for v in w), 1e-9)
    with pytest.raises(Exception, match="non-finite"):
        with_feature(df, FeatureSpec("gap", ("x",), 2, lambda b: b[:, 0, 0] * np.inf), ["k"], "t", ranges).collect()


def test_json_of_any_depth_flattens_in_one_reading(spark):
    from marketloom.functions.text import flatten_json

    deep = '{"a":' * 9 + '{"x":1,"l":[{"y":2}],"n":null}' + "}" * 9
    df = spark.createDataFrame([(1, deep), (2, '{"s":"q\\"z","e":{}}'), (3, "[1]"), (4, None), (5, '{"b":true,"c":{"d":1.5}}')], "id long, t string")
    got = {(r["id"], r["field"]): r["value"] for r in flatten_json(df, "id", "t").collect()}
    p = ".".join("a" * 9)
    assert got == {(1, f"{p}.x"): "1", (1, f"{p}.l"): '[{"y":2}]', (1, f"{p}.n"): "null", (2, "s"): '"q\\"z"', (5, "b"): "true", (5, "c.d"): "1.5"}

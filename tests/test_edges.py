"""Queries against their SQL on small tables that hold the edge cases the given ones seldom hold."""

from __future__ import annotations

import random

import duckdb
import pytest
from test_queries import check

import __spark_entry__ as entry


@pytest.fixture
def agrees(spark, tmp_path):
    """Writes the named tables from SQL and compares a query with its own SQL over them."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, text in tables.items():
            con.sql(f"COPY ({text}) TO '{tmp_path}/{table}.parquet'")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        verdict = check.compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])
        assert verdict.startswith("ok") and int(verdict.split()[1]) > 0, verdict

    return run


def test_half_prices_become_the_even_day(agrees):
    """dq15: 2.5 is day 2 and 3.5 day 4, so the second clock of customer 1 stands still."""
    agrees(
        "dq15_ingest_issues",
        orders="""FROM (VALUES (1, DATE '1996-01-01', 3.5), (1, DATE '1996-01-03', 2.5), (2, DATE '1996-01-01', 2.5), (2, DATE '1996-01-02', 1.5))
          AS o(k, d, p) SELECT CAST(k AS BIGINT) AS o_custkey, CAST(d AS TIMESTAMP) AS o_orderdate, CAST(p AS DOUBLE) AS o_totalprice""",
        customer="SELECT CAST(k AS BIGINT) AS c_custkey FROM range(1, 4) AS r(k)",
    )


def test_half_balances_become_the_even_day(agrees):
    """dq23: a balance of 2.5 acts on day 2, the last day of the request, and not on day 3."""
    agrees(
        "dq23_price_authority",
        orders="""SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(1 AS BIGINT) AS o_custkey, DATE '1995-01-03' - to_days(CAST(k AS INTEGER)) AS o_orderdate, '1-URGENT' AS o_orderpriority
          FROM range(28, 33) AS r(k)""",
        customer="SELECT CAST(1 AS BIGINT) AS c_custkey, CAST(unnest([-900.0, 2.5, 3.5, 900.0]) AS DOUBLE) AS c_acctbal",
    )


def zero_correlations(groups, size=25):
    """Label ranks along the value ranks, of groups whose rank correlation is exactly zero."""
    rng, out = random.Random(5), []
    while len(out) < groups:
        y = rng.sample(range(1, size + 1), size)
        if 4 * sum((i + 1) * v for i, v in enumerate(y)) == size * (size + 1) ** 2:
            out.append(y)
    return out


def test_zero_rank_correlation_rounds_as_summed_along_the_labels(spark):
    """ev13b: the sign of the rounding decides a hit, so it follows the SQL's order in any layout."""
    from marketloom.operators.evaluate import rank_ic

    groups = zero_correlations(60)
    want = {}
    for g, labels in enumerate(groups):
        n = mx = my = c = 0.0
        for y, x in sorted((y, x + 1) for x, y in enumerate(labels)):
            n += 1
            dx = y - mx
            mx += dx / n
            my += (x - my) / n
            c += dx * (x - my)
        want[g] = (c > 0) - (c < 0)
    rows = [(g, float(x), float(y)) for g, labels in enumerate(groups) for x, y in enumerate(labels)]
    df = spark.createDataFrame(rows, "g long, value double, label double")
    for layout in (df, df.repartition(7)):
        got = {r["g"]: (r["rank_ic"] > 0) - (r["rank_ic"] < 0) for r in rank_ic(layout, ["g"], "value", "label").collect()}
        assert got == want


#: Events of every kind with a value of zero among others; 400 = 0 modulo 8 and 16.
ZEROS = """SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-05 10:00:00' + to_seconds(CAST(i * 11 AS INTEGER)) AS ts, CAST(i % 9 AS BIGINT) AS user_id,
  ['click', 'view', 'purchase', 'error', 'signup'][1 + i % 5] AS event_type, CASE WHEN i % 3 = 0 THEN 0.0 ELSE i / 4.0 END::DOUBLE AS value, '{"k": ' || (i % 90) || '}' AS props FROM range(400) AS r(i)"""


@pytest.mark.parametrize("name", ["src19_event_decode", "src19b_event_rejects", "src19c_all_event_kinds", "str04c_latest_bar"])
def test_zero_values_are_prices(agrees, name):
    agrees(name, events=ZEROS)


def test_prices_must_be_positive_unless_told_otherwise(spark):
    from marketloom.sources.records import decode_events

    body = '"event_time": "2024-01-05 10:00:00", "received_at": "2024-01-05 10:00:01", "sequence": 1'
    bar = '"open": 0.0, "high": 0.0, "low": %s, "close": 0.0, "interval_seconds": 60'
    lines = [f'{{"kind": "trade", "price": 0.0, {body}}}', f'{{"kind": "bar", {bar % "0.0"}, {body}}}', f'{{"kind": "bar", {bar % "0.5"}, {body}}}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [sorted(r["codes"][0] for r in decode_events(df, "line", p)[1].collect()) for p in (True, False)] == [
        ["BAR_INVALID", "BAR_INVALID", "TRADE_PRICE_INVALID"], ["BAR_INVALID"]]


def test_pvalues_of_a_large_family_are_adjusted_in_linear_time(spark):
    """ev20: against a direct computation, with equal values, missing ones and a family without a name; no window looks ahead without end."""
    from marketloom.operators import stats

    rng = random.Random(3)
    rows = [(f, k, None if k % 50 == 7 else round(rng.random() ** 3, 3)) for f in ("a", None) for k in range(700)]
    got = stats.adjust_pvalues(spark.createDataFrame(rows, "f string, k long, p double"), ["f"], "k", "p")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing$()" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "")
    seen = {(r["f"], r["k"]): (r["bonferroni"], r["holm"], r["bh"]) for r in got.collect()}
    assert len(seen) == sum(p is not None for *_, p in rows)
    for f in ("a", None):
        own = sorted((p, k) for g, k, p in rows if g == f and p is not None)
        m, holm, bh = len(own), 0.0, 1.0
        low = {}
        for r in range(m, 0, -1):
            bh = min(bh, m * own[r - 1][0] / r)
            low[r] = bh
        for r, (p, k) in enumerate(own, 1):
            holm = max(holm, (m - r + 1) * p)
            assert seen[f, k] == pytest.approx((min(1, p * m), min(1, holm), low[r]), rel=1e-12)


def test_only_periods_of_keys_with_days_are_spread_over_years(spark):
    """join11: the rows stay the same, and the filter comes before the years."""
    from marketloom.operators.joins import interval_status

    days = spark.sql("SELECT * FROM VALUES (1, DATE'2020-05-01'), (1, DATE'2022-05-01'), (CAST(NULL AS INT), DATE'2021-01-01') AS t(k, day)")
    periods = spark.sql("""SELECT * FROM VALUES (1, DATE'2019-01-01', DATE'2020-06-01', 'a'), (1, DATE'2021-01-01', NULL, 'b'), (2, DATE'2019-01-01', NULL, 'c'),
      (CAST(NULL AS INT), DATE'2019-01-01', NULL, 'd') AS t(k, start_date, end_date, status)""")
    got = interval_status(days, periods, "k", "day")
    assert sorted((str(r["day"]), r["status"]) for r in got.collect()) == [("2020-05-01", "a"), ("2022-05-01", "b")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("LeftSemi")


@pytest.mark.parametrize("gathered", [0, 3, 10_000])
def test_duplicate_groups_of_any_size_and_key(spark, gathered):
    """dq06: small and large keys agree, and a key that is NULL has variants too."""
    from marketloom.operators.quality import duplicate_groups

    nan = float("nan")
    rows = [("a", 0.0, "x"), ("a", -0.0, "x"), ("b", nan, "x"), ("b", nan, None), ("c", 1.0, "x"), (None, 1.0, "x"), (None, 2.0, "x"), *[("d", float(i % 4), str(i % 3)) for i in range(12)]]
    got = duplicate_groups(spark.createDataFrame(rows, "k string, v double, w string"), ["k"], ["v", "w"], gathered=gathered)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {
        "a": (2, 1, 1, False), "b": (2, 1, 2, True), None: (2, 2, 1, True), "d": (12, 4, 3, True)}

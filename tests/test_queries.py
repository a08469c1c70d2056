"""Registered queries against their SQL on DuckDB. MARKETLOOM_SWEEP=1 runs all of them."""

from __future__ import annotations

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path("/root/testdata/sf0.01")
spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SAMPLE = [
    "flagship_weekly_rank_ic", "dq03_quarantine_conflicts", "dq23_price_authority", "src02_month_routing", "src18_series_sequence", "cal05_dense_grid",
    "join01b_snapshots_many", "join11_status_periods", "agg02_multi_interval", "win10_rolling_performance", "win25_tick_rolling_mean", "xs14_turnover",
    "xs21_ensemble", "udf03_factor_catalog", "ev05_quantile_diagnostics", "ev18_block_bootstrap", "ev24_overfitting", "wf03_nested_folds",
    "md02_oas_covariance", "al02_regime_allocator", "fn13_lot_rounding", "gr09_span_assembly", "str07_multi_interval",
]
NAMES = list(entry.queries()) if os.environ.get("MARKETLOOM_SWEEP") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not ROOT.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    verdict = check.compare(entry.queries()[name](spark, str(ROOT)), con, entry.oracle_sql().get(name))
    assert not verdict.startswith("FAIL"), verdict


@pytest.mark.parametrize("name", ["cal01_sessionize", "cal05_dense_grid", "cal06_common_calendar", "cal07_execution_calendar", "cal08_next_open", "str06_session_bars", "str09_cross_section_barrier"])
def test_sessions_and_members_follow_the_events(spark, tmp_path, name):
    """Events of another year, over a leap day, with a sixth type."""
    kinds = ["click", "view", "purchase", "error", "signup", "refund"]
    c = duckdb.connect()
    c.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2028-02-25' + to_minutes(CAST(i * 7 AS INTEGER)) AS ts, i % 9 AS user_id, {kinds}[1 + i % 6] AS event_type,
      CAST(10 + i % 13 AS DOUBLE) AS value, '{{"k": ' || (i % 90) || '}}' AS props FROM range(2600) r(i)) TO '{tmp_path}/events.parquet'""")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    verdict = check.compare(entry.queries()[name](spark, str(tmp_path)), c, entry.oracle_sql()[name])
    assert verdict.startswith("ok") and int(verdict.split()[1]) > 0, verdict

"""Registered queries against their SQL on the smallest tables.

A selection that touches every module runs by default; ALL_QUERIES=1 runs all of them.
"""

import os
import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import normal  # noqa: E402

FOLDER = pathlib.Path("/root/testdata/sf0.001")
SELECTION = (
    "event_study_by_code", "event_preparation", "signal_outcomes", "created_signals", "validated_signals", "strict_numbers",
    "price_hashes", "normalized_prices", "historical_read", "price_coverage", "quarter_spine", "reconciled_ids",
    "provenance_safety", "bulk_records", "filing_index_rows", "ownership_xml", "price_load_outcomes",
    "archive_expansion", "quarter_load", "event_returns", "backtest_trades", "stored_outcomes", "filing_detail_counts",
    "stored_details", "unreadable_documents", "provenance_cleanup", "orphaned_actions", "signals_of_symbol",
    "research_event_store", "research_event_lookup", "series_by_source_name", "performance_summary", "companies_of_filings",
    "order_risk", "streamed_quarters", "archive_source", "archive_columns", "provenance_upsert", "state_upsert",
    "historical_read_refused", "signal_by_key", "bucketed_event_returns", "integrity_audit", "chosen_checks", "idempotency",
    "quarter_profiles", "profile_totals", "stored_backtest", "event_study_overall",
)
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else list(SELECTION)

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, db, name):
    df = entry.queries()[name](spark, str(FOLDER))
    cur = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_registered_with_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SELECTION) <= set(entry.oracle_sql())

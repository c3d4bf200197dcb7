"""Queries against their DuckDB equivalents on the smallest tables, and the registry's shape."""

from __future__ import annotations

import pytest

from barline import plans
from compare import assert_same

# The driver compares every query at sf0.01; planning the deep ones (rankings, breadth, scans) takes too long for a test run.
SOME = [
    "returns_block", "volatility_63", "rsi_wilder", "rsi_divergence", "obv_divergence", "peer_rs_score", "td_countdown", "weekly_close", "rrg", "read_rrg", "bars_from_wide", "upsert_bars",
    "fetch_log_update", "universe_members", "listing_clean", "universe_refresh_apply", "universe_refresh_outage", "security_page", "document_save", "document_load", "run_record", "review_store", "fund_metrics",
    "underlying_rs", "holding_return", "holding_review", "payout_schedule", "point_in_time_scores", "ratio_trend", "leverage_ratios", "volatility_snapshot", "risk_monitor", "business_cycle",
    "exposure_merge", "price_islands", "unadjusted_splits", "dedupe_splits", "notice_read", "metric_verdict", "summary_scan", "chunk_topk", "import_watchlist_flags", "stream_hedge", "stream_notices",
    "stream_bars", "immutable_runs",
]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, sf, name):
    assert_same(plans.QUERIES[name](spark, sf), plans.SQL[name], sf)


def test_every_sql_has_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES)
    assert len(plans.QUERIES) > 120

"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from sievework.catalog import all_queries, all_sql
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "clean_and_summarise", "fill_mode", "dedup_copies", "dedup_overview", "outlier_remove", "text_title", "one_hot",
    "feature_bins", "histogram", "line_grouped", "contingency", "box_stats", "poly_fit_parabola", "corr_pearson",
    "ab_event_metrics", "ab_quality", "dwell", "sessions", "stream_counts", "event_sheet",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert compare(all_queries()[name](spark, FOLDER), con, all_sql()[name]) in ("same", "close")


def test_every_query_is_named_once():
    assert set(all_sql()) <= set(all_queries())
    assert len(all_queries()) > 140

"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in entry.QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data absent")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 41 and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], ORACLE[name], FOLDER) == ""


#: Columns that a source does not have, so that conforming fills them with NULL.
ABSENT = {
    "factors_value": {"ps_factor"}, "conform_record": {"pre_close", "pct_change", "turnover"},
    "normalize_ohlcv": {"pre_close", "pct_change", "turnover", "adj_factor"},
    "vendor_daily": {"amount", "pre_close", "pct_change", "turnover", "adj_factor"},
    "concept_boards": {"list_date"}, "concept_boards_fallback": {"member_count", "list_date"},
}
LARGER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="test data absent")
def test_no_result_is_empty_or_all_null():
    larger, bad = connect(LARGER), []
    for name, sql in ORACLE.items():
        found = larger.execute(sql).df()
        void = {c for c in found.columns if found[c].isna().all()}
        if found.empty or void - ABSENT.get(name, set()):
            bad.append((name, len(found), sorted(void)))
    assert bad == []


def test_universe_scores_order_the_codes():
    ranked = connect(LARGER).execute(ORACLE["universe_monthly_top_k"]).df()
    assert ranked["score"].notna().mean() > 0.9 and ranked["score"].nunique() > 50  # the first months have no past
    firsts = ranked[ranked["rank"] == 1].groupby("l1_code")["code"].nunique()
    assert (firsts > 1).any()

"""The registered queries: a fast sample against DuckDB, and the shape of the registry."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "trade_index", "first_buyers", "window_counts", "slot_analysis", "execution_atomic_groups", "asof_funding", "wallet_history", "recurring_groups_hot_launch",
    "wallet_overlap_pairs_hot", "holder_concentration", "creator_graduations", "bundle_score", "classification", "evidence", "stream_watch_alerts",
]


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 150


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, con, name):
    assert compare(queries()[name](spark, SMALL), con, oracle_sql()[name]) is None


def test_groups_write_payments_without_amounts(spark, monkeypatch):
    from mintweave.catalog.graph import groups
    from mintweave.operators import funding as M

    written = {}
    real = M.cut
    monkeypatch.setattr(M, "cut", lambda df, name="step": (written.setdefault(name, df.columns), real(df, name))[1])
    groups(spark, SMALL)
    assert written["money"] == ["source", "recipient", "signature", "block_time", "slot"]

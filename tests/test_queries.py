"""The registry, and a few queries against their SQL (all of them: tests/oracle.py)."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from barloom import queries as registered

SAMPLE = ["flagship_4h_context", "upsert_incremental", "reconcile_sources", "breaks_crossing_1h", "zigzag_pct_events", "conversation_lengths", "streamed_bars_4h"]


def test_registry_is_consistent():
    names, sqls = set(registered.queries()), set(registered.oracle_sql())
    assert names <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert sqls <= names and len(names) > 120
    # fitted models have no SQL twin
    assert names - sqls == {"ridge_validation", "logistic_validation", "boosted_validation", "walk_forward_models"}


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(registered.queries()) if os.environ.get("BARLOOM_ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, name):
    sf_dir = str(oracle.DATA / "sf0.01")
    ok, note = oracle.compare(spark, oracle.connect(sf_dir), sf_dir, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note

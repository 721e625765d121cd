"""Every registered query against its check SQL on the smallest tables."""

from functools import lru_cache

import check_queries
import pytest

from signaloom.operators import hubs, procedures, timeline
from signaloom.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@lru_cache(maxsize=1)
def connection():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_check(spark, name):
    sql = registry.oracle_sql().get(name)
    assert sql is not None, "a query without a check needs a test of its own"
    assert check_queries.compare(registry.queries()[name](spark, SF_DIR), connection(), sql) is None


CHAINED = (
    "request_latency", "keepalive_runs", "stream_quality", "claimed_legs", "handover_interruptions", "master_sessions",
    "diagram_rows", "step_records", "gtp_sessions", "session_documents", "last_signup_before_purchase",
)


@pytest.mark.parametrize("name", CHAINED)
def test_heavy_keys_cut_into_slabs(spark, monkeypatch, name):
    """The same results when every key is too heavy for one slab, every join has hubs and blocks are short."""
    monkeypatch.setattr(timeline, "ROWS_PER_SLAB", 5)
    monkeypatch.setattr(hubs, "HUB_ROWS", 5)
    monkeypatch.setattr(procedures, "BLOCK", 3)
    query, sql = registry.queries()[name], registry.oracle_sql()[name]
    assert check_queries.compare(query(spark, SF_DIR), connection(), sql) is None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

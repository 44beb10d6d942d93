"""Registered queries against their SQL; TIDEWATCH_ALL=1 runs every one of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare

SOME = ["entity_counts_1h", "order_distinct_senders_90d", "velocity_baseline", "device_surge", "dated_membership_flags",
        "score_events", "training_set", "metrics_at_budget", "member_list_scan", "stream_deduplicate"]
NAMES = sorted(oracle_sql()) if os.environ.get("TIDEWATCH_ALL") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, folder, name):
    same, note = compare(queries()[name](spark, folder), oracle_sql()[name], folder)
    assert same, note


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_gives_rows(spark, folder):
    assert set(entry(spark).columns) >= {"transaction_id", "decision", "final_score"}


def test_scans_read_only_what_they_need(spark, folder):
    plan = queries()["customer_txn_count_1h"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan and "CartesianProduct" not in plan

"""Monitoring queries against their SQL, and nulls."""

import pytest

from tests.check import compare
from tidewatch.operators import monitor
from tidewatch.queries import monitoring


@pytest.mark.parametrize("name", sorted(monitoring.QUERIES))
def test_matches_sql(spark, folder, name):
    same, note = compare(monitoring.QUERIES[name](spark, folder), monitoring.ORACLE[name], folder)
    assert same, note


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([("a", 0, 0.95, 1, 10.0), ("b", 0, None, 0, 1.0), ("c", 1, 1.0, None, 2.0), ("d", 2, 0.1, 0, 3.0)],
                                 "transaction_id string, ms long, score double, label int, amount_base double")
    drift = monitor.score_drift(rows).collect()
    assert [tuple(r) for r in drift] == [(0, 3, 1, None)]
    swept = {r.threshold: r for r in monitor.threshold_costs(rows, 5.0).collect()}
    assert sorted(swept) == [0.1, 0.95] and swept[0.95].best and swept[0.95].cost == 0 and swept[0.1].cost == 5
    assert monitor.threshold_costs(rows.limit(0), 5.0).collect() == [] and monitor.score_drift(rows.limit(0)).collect() == []
    done = spark.createDataFrame([("a", None), ("b", "decline")], "transaction_id string, decision string")
    assert sorted(monitor.explore(done, 0.0).collect()) == sorted(
        [("a", None, False), ("b", "decline", False)], key=lambda r: r[0])
    with pytest.raises(ValueError):
        monitor.explore(done, 1.0)

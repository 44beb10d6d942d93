"""Odd rows and repeated work: each test once gave a wrong answer."""

import pytest
from pyspark.sql import functions as F

from tidewatch.config import RuleDef
from tidewatch.operators import labels as lab
from tidewatch.operators.rules import with_rules
from tidewatch.operators.windows import with_recent_count
from tidewatch.plans import learning
from tidewatch.plans.scoring import with_history
from tidewatch.session import scratch
from tidewatch.streaming import jobs


def test_failing_rules_let_the_others_go_on(spark):
    rules = [RuleDef("A", "soft", "a / b > 1", 0.1), RuleDef("B", "soft", "t > 1", 0.1), RuleDef("C", "soft", "a > 1", 0.4),
             RuleDef("D", "soft", "no_such > 1", 0.1)]
    rows = with_rules(spark.createDataFrame([(2, 0, "x"), (4, 2, "3")], "a int, b int, t string"), rules).orderBy("a").collect()
    assert [r.rules_fired for r in rows] == [["C"], ["A", "B", "C"]]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_one_id_under_two_customers(spark):
    rows = spark.createDataFrame([("t", "c1", 10), ("t", "c2", 20), ("u", "c1", 30)], "transaction_id string, customer_id string, ms long")
    got = with_recent_count(rows, ["customer_id"], 1000, "n").collect()
    assert sorted((r.transaction_id, r.customer_id, r.n) for r in got) == [("t", "c1", 0), ("t", "c2", 0), ("u", "c1", 1)]
    with pytest.raises(Exception, match="repeats"):
        with_recent_count(rows.union(rows), ["customer_id"], 1000, "n").collect()


def test_promotion_is_one_write(spark):
    path = scratch(spark, "registry")
    learning.register(spark, path, "a", "champion", "/a", ["x"], 1, 1, 1)
    learning.register(spark, path, "b", "challenger", "/b", ["x"], 1, 1, 2)
    learning.promote(spark, path, "b")
    assert {r.version: r.role for r in learning.registry(spark, path).collect()} == {"a": "retired", "b": "champion"}
    with pytest.raises(ValueError):
        learning.promote(spark, path, "nobody")


def test_repeated_batch_and_waiting_entries(spark):
    path, seen = scratch(spark, "blocks"), {}

    class Stream:                       # hands the batch function over
        @property
        def writeStream(self):
            return self

        def foreachBatch(self, write):
            seen["write"] = write
            return self

        def option(self, *_):
            return self

        def trigger(self, **_):
            return self

        def start(self):
            return None

    jobs.reactive_blocks(Stream(), path, "x", limit=1)
    fraud = spark.createDataFrame([("confirmed_fraud", s, p, None, 5) for s in lab.TRUSTED[:1] for p in ("p", "p", "q", "r")],
                                  "label string, source string, receiver_account string, device_fingerprint string, labeled_at_ms long")
    def listed():
        return sorted(r.member for r in jobs.block_list(spark, path).collect())
    seen["write"](fraud, 0)
    assert listed() == ["p"]
    seen["write"](fraud, 0)
    assert listed() == ["p"]
    seen["write"](fraud.limit(0), 1)
    seen["write"](fraud.limit(0), 2)
    assert listed() == ["p", "q", "r"]
    seen["write"](fraud.where(F.lit(False)), 2)
    assert listed() == ["p", "q", "r"]


def test_rows_without_an_entity_have_no_history(spark):
    """Null customers, payees and devices see nothing of one another, in buckets, pairs and running sums alike."""
    rows = [(f"t{k}", 1_704_067_200_000 + k * 1000, c, p, d) for k, (c, p, d) in enumerate(
        [(None, "p", "d")] * 6 + [(None, "p", "d"), (None, "p", "d"), ("c", None, None), ("c", None, None), (None, None, None), ("c", "p", "d"), (None, "p", "d")])]
    txns = spark.createDataFrame(rows, "transaction_id string, ms long, customer_id string, receiver_account string, device_fingerprint string")
    txns = txns.withColumns({"ts": F.timestamp_millis("ms"), "amount_base": F.lit(5.0), "declined": F.lit(1), "event_kind": F.lit("payment"),
                             "tpp_name_ud": F.lit("x"), "customer_portfolio_country": F.lit("GB")})
    got = {r.transaction_id: r for r in with_history(txns).collect()}
    assert len(got) == len(rows)
    for n, (key, _, c, p, d) in enumerate(rows):
        before = rows[:n]
        r = got[key]
        assert r.customer_txn_count_1h == sum(b[2] == c for b in before if c)
        assert r.customer_declines_24h == sum(b[2] == c for b in before if c)
        assert c or r.interarrival_cv == 999.0
        assert r.pair_txn_count_90d == sum(b[2:4] == (c, p) for b in before if c and p)
        assert r.bene_distinct_senders_24h == len({b[2] for b in before if p and b[3] == p and b[2]})
        assert r.device_distinct_customers == len({b[2] for b in before if d and b[4] == d and b[2]})

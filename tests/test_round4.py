"""FINDINGS_r04: work that wrote or kept more than it needs, or ran in a few tasks, and training on a part of the rows."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import signals, skew
from tidewatch.operators.skew import HeavyKeys, SkewPolicy
from tidewatch.plans import learning, scoring
from tidewatch.queries import history, models, streams
from tidewatch.session import pinned, pins_dropped
from tidewatch.sources.kept import KeptTable


class Stop(Exception):
    pass


def payments(spark, n=200):
    made = {"transaction_id": F.col("id").cast("string"), "ms": F.lit(1_704_067_200_000) + F.col("id") * 3_600_000,
            "customer_id": (F.col("id") % 7).cast("string"), "receiver_account": (F.col("id") % 5).cast("string"),
            "device_fingerprint": (F.col("id") % 3).cast("string"), "customer_portfolio_country": F.lit("GB"),
            "tpp_name_ud": F.lit("x"), "event_kind": F.lit("payment"), "declined": (F.col("id") % 2).cast("int"),
            "amount_base": F.col("id") * 1.0}
    return spark.range(n).select(*[c.alias(name) for name, c in made.items()]).withColumn("ts", F.timestamp_millis("ms"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_champion_is_trained_on_all_rows_and_its_features_are_made_once(spark, folder, monkeypatch):
    """a million rows at most were trained on. F3: history was worked out for the audit and again for the champion."""
    asked, made = {}, []

    def retrain(*_, cap=learning.SAMPLE_CAP, **__):
        asked["cap"] = cap
        return {"version": "trees-1"}

    monkeypatch.setattr(models.learn, "retrain", retrain)
    monkeypatch.setattr(models.learn, "register", lambda *_: None)
    monkeypatch.setattr(models.learn, "promote", lambda *_: None)
    monkeypatch.setattr(models.learn, "active_scorer", lambda *_: None)
    monkeypatch.setattr(models, "pinned", lambda df: df)
    whole = scoring.with_history
    monkeypatch.setattr(scoring, "with_history", lambda *a, **k: made.append(1) or whole(*a, **k))
    monkeypatch.setattr(models, "with_history", lambda *a, **k: made.append(1) or whole(*a, **k), raising=False)
    out = models.champion_decides(spark, folder)
    assert asked["cap"] is None
    assert len(made) == 1
    assert out.columns == ["transaction_id", "rules_fired", "by_champion", "blended", "banded"]


def test_pinned_rows_are_parquet_and_go_with_their_block(spark):
    """pinned rows were written uncompressed, and stayed until the driver collected its garbage."""
    with pins_dropped(spark):
        rows = pinned(spark.range(10).withColumn("x", F.lit("a")))
        files = rows.inputFiles()
        assert files and rows.count() == 10
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert pinned(spark.range(0)).count() == 0
    assert all(os.path.exists(f.removeprefix("file://")) for f in pinned(spark.range(3)).inputFiles())


def test_a_history_shuffles_rows_once_for_each_entity(spark):
    """pairs, devices, arrivals, buckets and every join of the two had a shuffle of their own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scoring.with_history(payments(spark))
        assert plan(out).count("Exchange hashpartitioning") == 9        # rows, buckets and sightings of three entities
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.count() == 200


def test_an_order_line_is_shuffled_once(spark, folder):
    """the text that is a line's id went through the join, the pairs and the payees."""
    assert plan(history.order_distinct_senders(spark, folder)).count("Exchange hashpartitioning") == 3


def test_lanes_do_not_work_out_their_rows_again(spark):
    """the light rows of every step had the work of all steps before, and so had the heavy ones of the next."""
    rows = signals.with_pair_state(payments(spark))
    heavy = skew.find_heavy(rows, signals.PAYEE, policy=SkewPolicy(min_rows=20, sample=1.0, lanes=1))
    lanes = skew.into_lanes(rows, signals.PAYEE, ("ms", "transaction_id"), heavy)
    assert "Window" not in plan(lanes.light)
    assert lanes.light.count() + lanes.wide.count() == 200


def test_lanes_and_whole_keys_give_the_same(spark):
    """light and heavy customers are worked out apart now, with null keys, equal times and equal ids among them."""
    t = payments(spark, 300).withColumns({
        "customer_id": F.when(F.col("ms") % 11 != 0, F.col("customer_id")), "ms": F.col("ms") - F.col("ms") % 7_200_000,
        "receiver_account": F.when(F.col("transaction_id") != "13", F.col("receiver_account"))})
    t = t.unionByName(t.filter(F.col("transaction_id") == "17"))
    columns = sorted(c for c in scoring.with_history(t).columns if c != "ts")
    heavy = signals.heavy_keys(t, policy=SkewPolicy(min_rows=35, sample=1.0, lanes=2))
    assert heavy.of(signals.CUSTOMER) and heavy.of(signals.PAYEE) and heavy.of(signals.DEVICE)

    def rows(heavy):
        out = scoring.with_history(t, heavy=heavy)
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in out.select(*columns).collect())
    assert rows(heavy) == rows(HeavyKeys())


def test_a_part_of_a_base_is_written_by_several_tasks(spark, tmp_path):
    """a base was sorted and written in as many tasks as it has parts, four for any number of rows."""
    table = KeptTable(str(tmp_path), {"k": "long", "n": "long"}, ("k",), {"n": "sum"}, parts=1, every=1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in (0, 1):
            table.add(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), batch)
        assert table.fold(spark, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/base/0/_part=0")) > 1
    assert table.rows(spark).agg(F.sum("n"), F.count("*")).first()[:] == (2000, 1000)


def test_label_join_keeps_the_columns_that_are_counted(spark, folder, monkeypatch):
    """the state of the join held every column of a decision."""
    seen = []

    def judged(decisions, labels, lag):
        seen.append((decisions.columns, labels.columns))
        raise Stop

    monkeypatch.setattr(streams.jobs, "judged_stream", judged)
    with pytest.raises(Stop):
        streams.stream_judged(spark, folder)
    assert seen == [(["transaction_id", "model_version", "decision", "amount_base", "ts"], ["transaction_id", "label", "labeled_at_ms"])]

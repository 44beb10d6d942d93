"""Work that must not gather in a few tasks or be shuffled more than it needs."""

import os

from pyspark.sql import functions as F

import __spark_entry__
from tidewatch import schemas
from tidewatch.operators import signals, skew
from tidewatch.operators.history import bucket_table
from tidewatch.operators.windows import replay_decisions
from tidewatch.plans import learning
from tidewatch.queries import history
from tidewatch.sources.sinks import write_audit
from tidewatch.sources.tables import most_rows

FINER = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def payments(spark, n=200):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("transaction_id"), (F.lit(1_704_067_200_000) + F.col("id") * 3_600_000).alias("ms"),
        (F.col("id") % 7).cast("string").alias("customer_id"), (F.col("id") % 5).cast("string").alias("receiver_account"),
        (F.col("id") * 1.0).alias("amount_base"))
    return rows.withColumn("ts", F.timestamp_millis("ms"))


def test_queries_bound_the_size_of_a_task(spark, folder):
    """F1 to F6: with the session's own sizes a task of the window chains grew with the input."""
    before = spark.conf.get(BYTES), spark.conf.get(FINER, None)
    spark.conf.set(BYTES, "64m")
    spark.conf.unset(FINER)
    try:
        __spark_entry__.queries()["fx_to_base"](spark, folder)
        assert spark.conf.get(BYTES) == "8m"
        assert int(spark.conf.get(FINER)) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(BYTES, before[0])
        if before[1]:
            spark.conf.set(FINER, before[1])


def test_rows_and_membership_steps_share_a_shuffle(spark):
    """F8: steps were summed up on their own and then once more with the buckets of the rows."""
    table = bucket_table(payments(spark), signals.PAYEE, signals.amount_measures()[:1], (signals.SENDERS_90D, signals.SENDERS_24H))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(receiver_account") == 3     # sightings of a unit, of a pair, buckets
    assert table.groupBy().agg(F.sum("n")).first()[0] == 200


def test_rounds_of_a_replay_carry_few_columns(spark, folder, monkeypatch):
    """every round shuffled and stored all columns of a transaction."""
    seen = []
    monkeypatch.setattr(history, "replay_decisions", lambda rows, **more: seen.append(rows.columns) or replay_decisions(rows, **more))
    out = history.closed_loop(spark, folder)
    assert seen == [["customer_id", "ms", "transaction_id", "base_score", "hard_block", "hard_allow"]]
    assert out.count() == spark.read.parquet(f"{folder}/events.parquet").count()


def test_a_replay_of_nothing(spark):
    rows = payments(spark, 0).withColumns({"base_score": F.lit(0.5), "hard_block": F.lit(False), "hard_allow": F.lit(False)})
    assert replay_decisions(rows).count() == 0


def test_training_rows_of_one_file_are_spread(spark):
    """boosted trees were trained in as many tasks as the input had file splits."""
    parts = min(3, spark.sparkContext.defaultParallelism)
    assert learning.dealt(spark.range(0, 150_000, 1, 1)).rdd.getNumPartitions() == parts
    assert learning.dealt(spark.range(0, 1_000, 1, 1)).rdd.getNumPartitions() == 1


def test_parts_of_a_shuffle_follow_the_input(spark, folder, monkeypatch):
    """a shuffle had as many parts for any input, so its tasks grew with the rows."""
    before = spark.conf.get(BYTES), spark.conf.get(FINER, None)
    monkeypatch.setattr(__spark_entry__, "most_rows", lambda *_: 36_000_000)
    try:
        __spark_entry__.queries()["fx_to_base"](spark, folder)
        assert int(spark.conf.get(FINER)) == 1_440
    finally:
        spark.conf.set(BYTES, before[0])
        if before[1]:
            spark.conf.set(FINER, before[1])


def test_rows_of_the_larger_table(spark, tmp_path):
    assert most_rows(spark, str(tmp_path)) == 0
    spark.range(7).write.parquet(f"{tmp_path}/events.parquet")
    assert most_rows(spark, str(tmp_path)) == 7
    spark.range(9).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert most_rows(spark, str(tmp_path)) == 9


def test_lanes_follow_the_rows_of_heavy_keys(spark, monkeypatch):
    """heavy keys were dealt to as many lanes for any number of rows."""
    monkeypatch.setattr(skew, "LANE_ROWS", 25)
    rows = payments(spark, 200)
    heavy = skew.find_heavy(rows, signals.PAYEE, policy=skew.SkewPolicy(min_rows=20, sample=1.0, lanes=3))
    assert heavy.lanes(rows, signals.PAYEE) == 8                # five payees of 40 rows
    lanes = skew.into_lanes(rows, signals.PAYEE, ("ms", "transaction_id"), heavy)
    assert lanes.wide.select(skew.LANE).distinct().count() > 3
    counted = skew.running(lanes, signals.PAYEE, ("ms", "transaction_id"), {"n": ("sum", F.lit(1))}).done()
    assert counted.groupBy("receiver_account").agg(F.max("n").alias("n")).select("n").distinct().collect()[0].n == 39


def test_an_audit_file_is_one_file(spark, tmp_path):
    """every audit file had a checksum file beside it, and a process was started for each of the two."""
    made = {"transaction_id": F.col("id").cast("string"), "dt": F.lit("2024-01-01"), "rules_fired": F.array(F.lit("R001"))}
    records = spark.range(100).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.AUDIT.fields])
    for batch in (None, 0, 0):                          # a batch that comes again replaces its files
        path = f"{tmp_path}/{batch}"
        write_audit(records, path, 40, 1, batch)
        names = [n for _, _, names in os.walk(path) for n in names]
        assert sum(n.endswith(".parquet") for n in names) == 3
        assert not any(n.endswith(".parquet.crc") for n in names)
        read = spark.read.parquet(path)
        assert read.count() == read.select("transaction_id").distinct().count() == 100

"""Plain rollups: bucketed sufficient statistics, counts per window, last events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import times
from tidewatch.functions.values import quotient


def rollup(txns: DataFrame, keys: Sequence[str], unit: str, value: str = "amount_base") -> DataFrame:
    """Count, sum, sum of squares, minimum and maximum per entity and bucket.

    Partial aggregation runs before the shuffle, so a key with a large share of rows stays cheap.
    """
    x = F.col(value)
    return (txns.withColumn("bucket", times.index(F.col("ms"), unit)).groupBy(*keys, "bucket")
            .agg(F.count("*").alias("cnt"), F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq"),
                 F.min(x).alias("min"), F.max(x).alias("max")))


def combine(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bucket statistics added up to count, sum, mean and population deviation."""
    total = buckets.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.sum("sum").alias("sum"),
                                       F.sum("sumsq").alias("sumsq"))
    mean = quotient(F.col("sum"), F.col("cnt"))
    spread = F.sqrt(F.greatest(F.lit(0.0), quotient(F.col("sumsq"), F.col("cnt")) - mean * mean))
    return total.select(*keys, "cnt", "sum", mean.alias("mean"),
                        F.when(F.col("cnt") > 0, spread).alias("stddev"))


def counts(txns: DataFrame, keys: Sequence[str], width_ms: int) -> DataFrame:
    return (txns.groupBy(*keys, (times.floor_div(F.col("ms"), width_ms) * width_ms).alias("bucket_ms"))
            .agg(F.count("*").alias("cnt")))


def weekly_amounts(txns: DataFrame) -> DataFrame:
    start = times.floor_div(F.col("ms"), times.WEEK_MS) * times.WEEK_MS
    return (txns.groupBy("customer_id", start.alias("week_ms"))
            .agg(F.sum("amount_base").alias("sum"), F.count("*").alias("cnt")))


def last_events(txns: DataFrame) -> DataFrame:
    return (txns.groupBy("customer_id", "event_kind")
            .agg(F.max("ms").alias("last_ms"),
                 F.max_by("transaction_id", F.struct("ms", "transaction_id")).alias("last_id")))


def latest(txns: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The newest `n` rows per key. The rank filter is applied before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("ms"), F.desc("transaction_id"))
    return txns.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in `order`; copies are folded before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(kept).select(*keys, "_row.*")


def distinct_members(txns: DataFrame, entity: str, member: str) -> DataFrame:
    return (txns.filter(F.col(member).isNotNull()).select(entity, member).distinct()
            .groupBy(entity).agg(F.count("*").alias("members")))


def member_sketches(txns: DataFrame, entity: str, member: str, precision: int = 14) -> DataFrame:
    """One mergeable sketch of the members per entity and month."""
    return (txns.withColumn("month", times.index(F.col("ms"), "month")).groupBy(entity, "month")
            .agg(F.hll_sketch_agg(member, F.lit(precision)).alias("sketch")))


def sketch_window(sketches: DataFrame, entity: str, months: int = 4) -> DataFrame:
    """Estimated members over each month and the `months - 1` before it."""
    reach = F.sequence(F.col("month"), F.col("month") + months - 1)
    return (sketches.withColumn("month", F.explode(reach)).groupBy(entity, "month")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("members")))


def decision_mix(scored: DataFrame) -> DataFrame:
    d = F.col("decision")
    return scored.agg(
        F.count("*").alias("total"), F.count_if(d == "approve").alias("approve"),
        F.count_if(d == "review").alias("review"), F.count_if(d == "decline").alias("decline"),
        F.count_if(F.col("degraded")).alias("degraded"), F.count_if(d == "approve").alias("pass"),
        F.count_if(d != "approve").alias("fail"))


def rule_counts(scored: DataFrame) -> DataFrame:
    return (scored.select(F.explode("rules_fired").alias("rule_id")).groupBy("rule_id")
            .agg(F.count("*").alias("fired")))


def scoreboard(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """Samples whose decision is the expected one."""
    hit = F.col("decision") == F.col("expected_decision")
    return (expected.join(scored.select("transaction_id", "decision"), "transaction_id", "left")
            .agg(F.count("*").alias("total"), F.count_if(F.coalesce(hit, F.lit(False))).alias("passed")))


def tier(ts: Column, cutoff: Column) -> Column:
    """Hourly tier from the cut-off on, daily tier before it."""
    return F.when(ts >= cutoff, "1h").otherwise("1d")

"""Windows that are exact to the millisecond, windows that end with an idle gap, and decision feedback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewatch.config import Config, RuleDef
from tidewatch.operators.history import ARRIVAL, Measure, amount_now, attach, bucket_sum, Feature, zero
from tidewatch.operators.rules import band
from tidewatch.operators.signals import CUSTOMER
from tidewatch.operators.skew import HeavyKeys, into_lanes, running
from tidewatch.session import pinned, scratch

# Order of what happens at one instant: windows open, then rows arrive, then windows close.
OPENS, ARRIVES, CLOSES = 0, 1, 2
MOMENT = ("ms", "_turn", "transaction_id")


def with_recent_count(rows: DataFrame, keys: Sequence[str], span_ms: int, name: str,
                      heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """Earlier rows of the entity at most `span_ms` old, the edge included.

    Every row adds a marker where its window opens. Rows before the row minus rows before its marker
    are the rows inside, so the window needs no range scan. Rows without a key are no entity and count nothing.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    marked = rows.withColumns({"_turn": F.lit(ARRIVES), "_id": F.col("transaction_id")})
    markers = rows.select(*keys, (F.col("ms") - span_ms).alias("ms"), F.lit(OPENS).alias("_turn"),
                          "transaction_id", F.col("transaction_id").alias("_id"))
    both = marked.unionByName(markers, allowMissingColumns=True)
    counted = running(into_lanes(both, keys, MOMENT, heavy), keys, MOMENT,
                      {"_seen": ("sum", F.when(known & (F.col("_turn") == ARRIVES), 1).otherwise(0))}).done()
    # A row and its marker meet again by entity and id; a second row of the same id in one entity is an error.
    arrived = F.col("_turn") == ARRIVES
    kept = [c for c in rows.columns]
    both = counted.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], "_id").agg(
        F.count(F.when(arrived, 1)).alias("_rows"), F.first(F.when(arrived, F.struct(*kept, F.col("_seen").alias("_upto"))), ignorenulls=True).alias("r"),
        F.max(F.when(~arrived, F.col("_seen"))).alias("_before"))
    once = F.when(F.col("_rows") == 1, F.col("r")).otherwise(
        F.raise_error(F.concat(F.lit("transaction id repeats in one entity: "), "_id")))
    return both.select(once.alias("r"), "_before").select("r.*", "_before").withColumn(
        name, (zero(F.col("_upto")) - zero(F.col("_before"))).cast("long")).drop("_upto", "_before")


def with_recent_members(rows: DataFrame, entity: str, member: str, span_ms: int, name: str,
                        heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """Distinct members among the earlier rows of the entity at most `span_ms` old, the edge included.

    A member enters when it was not seen for `span_ms` and leaves `span_ms` after its last sighting.
    """
    pair = (entity, member)
    seen = running(into_lanes(rows, pair, ARRIVAL, heavy), pair, ARRIVAL,
                   {"_last": ("max", F.col("ms"))}).done()
    known = F.col(entity).isNotNull() & F.col(member).isNotNull()
    enters = known & (F.col("_last").isNull() | (F.col("ms") - F.col("_last") > span_ms))
    seen = seen.withColumns({"_turn": F.lit(ARRIVES), "_step": F.when(enters, 1).otherwise(0)})
    leaves = F.array(
        F.struct((F.col("ms") + span_ms).alias("ms"), F.lit(-1).alias("_step")),
        F.when(~enters, F.struct((F.col("_last") + span_ms).alias("ms"), F.lit(1).alias("_step"))))
    steps = (seen.filter(known).select(entity, F.inline(F.array_compact(leaves)))
             .groupBy(entity, "ms").agg(F.sum("_step").alias("_step")).filter(F.col("_step") != 0)
             .withColumns({"_turn": F.lit(CLOSES), "transaction_id": F.lit("")}))
    both = seen.unionByName(steps, allowMissingColumns=True)
    out = running(into_lanes(both, [entity], MOMENT, heavy), [entity], MOMENT,
                  {name: ("sum", F.col("_step"))}).done()
    return (out.filter(F.col("_turn") == ARRIVES)
            .withColumn(name, F.when(F.col(entity).isNotNull(), zero(F.col(name))).otherwise(0).cast("long"))
            .drop("_turn", "_step", "_last"))


def with_idle_count(rows: DataFrame, keys: Sequence[str], idle_ms: int, name: str, counted: Column,
                    heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """Count of earlier `counted` rows since the last gap of `idle_ms` without one; 0 once that gap passed."""
    lanes = into_lanes(rows.withColumn("_hit", F.coalesce(counted, F.lit(False))), keys, ARRIVAL, heavy)
    lanes = running(lanes, keys, ARRIVAL, {
        "_hits": ("sum", F.col("_hit").cast("long")),
        "_last": ("max", F.when(F.col("_hit"), F.col("ms")))})
    opens = F.col("_hit") & (F.col("_last").isNull() | (F.col("ms") - F.col("_last") >= idle_ms))
    lanes = running(lanes, keys, ARRIVAL, {"_base": ("max", F.when(opens, zero(F.col("_hits"))))})
    alive = F.col("_last").isNotNull() & (F.col("ms") - F.col("_last") < idle_ms)
    return (lanes.done().withColumn(name, F.when(alive, F.col("_hits") - F.col("_base")).otherwise(0)
                                    .cast("long"))
            .drop("_hit", "_hits", "_last", "_base"))


def with_idle_members(rows: DataFrame, entity: str, member: str, idle_ms: int, name: str,
                      heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """Distinct members since the entity's last gap of `idle_ms` without any row; 0 once that gap passed."""
    lanes = into_lanes(rows, [entity], ARRIVAL, heavy)
    lanes = running(lanes, [entity], ARRIVAL, {"_last": ("max", F.col("ms"))})
    opens = F.col("_last").isNull() | (F.col("ms") - F.col("_last") >= idle_ms)
    lanes = lanes.map(lambda df, by: df.withColumn("_opened", F.when(opens, F.col("ms"))))
    lanes = running(lanes, [entity], ARRIVAL, {"_since": ("max", F.col("_opened"))})
    flat = lanes.done().withColumn("_since", F.coalesce("_opened", "_since"))
    pair = (entity, member)
    flat = running(into_lanes(flat, pair, ARRIVAL, heavy), pair, ARRIVAL, {"_met": ("max", F.col("ms"))}).done()
    fresh = F.col(member).isNotNull() & (F.col("_met").isNull() | (F.col("_met") < F.col("_since")))
    flat = flat.withColumn("_fresh", F.when(fresh, 1).otherwise(0))
    lanes = running(into_lanes(flat, [entity], ARRIVAL, heavy), [entity], ARRIVAL,
                    {"_sum": ("sum", F.col("_fresh"))})
    lanes = lanes.map(lambda df, by: df.withColumn("_sum", zero(F.col("_sum"))))
    lanes = running(lanes, [entity], ARRIVAL,
                    {"_base": ("max", F.when(F.col("_opened").isNotNull(), F.col("_sum")))})
    alive = F.col("_last").isNotNull() & (F.col("ms") - F.col("_last") < idle_ms)
    return (lanes.done().withColumn(name, F.when(alive, F.col("_sum") - F.col("_base")).otherwise(0)
                                    .cast("long"))
            .drop("_last", "_opened", "_since", "_met", "_fresh", "_sum", "_base"))


DECLINES = {"customer_declines_24h": ("hour", 24), "customer_declines_90d": ("month", 3)}


def decline_rules(config: Config) -> list[RuleDef]:
    """The soft rules that read a decline count."""
    return [r for r in config.rules if r.type == "soft" and any(name in r.condition for name in DECLINES)]


def replay_decisions(rows: DataFrame, config: Config = Config(), heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """Decisions when each decline feeds the decline counts of the customer's later transactions.

    `rows` carry `base_score` (soft score without the rules that read a decline count; these come from `config`),
    `hard_block` and `hard_allow`. A decision depends on earlier ones only and more declines must never lower a score, so
    starting from no declines and repeating the counts reaches the one consistent answer. Only customers whose last round
    added a decline go on; a round fixes at least one more decision of each, so it ends. A null customer has no history.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "replayed")
    blocked, allowed = F.col("hard_block"), F.col("hard_allow")
    counts = [Feature(n, zero(F.col(f"_b_{n}")) + amount_now("d"), {f"_b_{n}": bucket_sum(CUSTOMER, "d", unit, -back, 0)})
              for n, (unit, back) in DECLINES.items()]
    soft = F.col("base_score")
    for r in decline_rules(config):
        soft = soft + F.when(F.coalesce(F.expr(r.condition), F.lit(False)), float(r.weight or 0.0)).otherwise(0.0)
    score = F.when(blocked, 1.0).when(allowed, 0.0).otherwise(F.least(F.lit(1.0), soft))
    decision = F.when(blocked, "decline").when(allowed, "approve").otherwise(band(F.col("final_score"), config.bands))
    keep = [c for c in rows.columns if c != "declined"]
    out = [*keep, "declined", *DECLINES, "final_score", "decision"]
    active, number = pinned(rows.select(*keep).withColumn("declined", blocked.cast("int"))), 0
    while True:
        seen = attach(active, active, CUSTOMER, [Measure("d", "sum", F.col("declined"))], counts, (), heavy)
        decided = seen.withColumn("final_score", score).withColumn("decision", decision)
        now = decided.withColumnRenamed("declined", "_was").withColumn("declined", (F.col("decision") == "decline").cast("int"))
        now = now.select(*out, "_was")
        now.write.parquet(f"{path}-rounds/{number}")            # columns are smaller than the rows of a checkpoint
        now = spark.read.schema(now.schema).parquet(f"{path}-rounds/{number}")
        moved = now.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
            F.max((F.col("declined") != F.col("_was")).cast("int")).alias("_moved")).filter(F.col("_moved") == 1).select("customer_id")
        moved = pinned(moved)
        # one pass parts the rows that are settled from those that go on
        parted = now.join(moved.withColumn("_moved", F.lit(1)), "customer_id", "left").withColumn("_moved", F.coalesce("_moved", F.lit(0)))
        parted.select(*out, "_moved").write.partitionBy("_moved").mode("overwrite").parquet(f"{path}/round={number}")
        schema = now.select(*out).schema
        if moved.isEmpty():
            parts = StructType([*schema.fields, StructField("_moved", IntegerType())])
            done = spark.read.schema(parts).parquet(path).filter(F.col("_moved") == 0).select(*out)
            return done if "declined" in rows.columns else done.drop("declined")
        active, number = spark.read.schema(schema).parquet(f"{path}/round={number}/_moved=1").select(*keep, "declined"), number + 1

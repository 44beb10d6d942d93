"""Monitoring of rules, scores and decisions: precision, drift, rates by segment, exploration, thresholds by cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal parts of [0, 1] in which scores are compared between days, and those in which thresholds are tried.
BINS, GRID = 10, 100


def rule_precision(decided: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each rule fired, how many of those transactions have an outcome, and the share of fraud among them.

    `decided` has transaction_id and rules_fired, `labels` transaction_id and label (0, 1 or null), one row each.
    """
    fired = decided.select("transaction_id", F.explode("rules_fired").alias("rule_id"))
    met = fired.join(labels.select("transaction_id", "label"), "transaction_id", "left")
    return met.groupBy("rule_id").agg(F.count("*").alias("fired"), F.count("label").alias("labelled"),
                                      F.count_if(F.col("label") == 1).alias("fraud"), F.avg("label").alias("precision"))


def _bin(score: Column, bins: int) -> Column:
    """Scores below 0 fall in the first part, those from 1 on in the last."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(score * bins)))


def score_drift(scored: DataFrame, days: int = 1, bins: int = BINS) -> DataFrame:
    """Rows per day and the population stability index of its scores against the day `days` before, null without one.

    `scored` has ms and score; null scores are left out of the index and counted apart. Every part of a day counts half a
    row more, so that empty parts give a number.
    """
    part = _bin(F.col("score"), bins)
    counts = scored.groupBy(F.floor(F.col("ms") / 86_400_000).alias("day")).agg(
        F.count("score").alias("rows"), F.count_if(F.col("score").isNull()).alias("without_score"),
        *[F.count_if(part == k).alias(f"n{k}") for k in range(bins)])
    before = counts.select((F.col("day") + days).alias("day"), F.col("rows").alias("b_rows"),
                           *[F.col(f"n{k}").alias(f"b{k}") for k in range(bins)])

    def term(k: int) -> Column:
        now, then = [(F.col(n) + 0.5) / (F.col(rows) + 0.5 * bins) for n, rows in ((f"n{k}", "rows"), (f"b{k}", "b_rows"))]
        return (now - then) * F.ln(now / then)

    return counts.join(before, "day", "left").select("day", "rows", "without_score", sum((term(k) for k in range(1, bins)), term(0)).alias("psi"))


def decision_rates(decided: DataFrame, segment: str) -> DataFrame:
    """Decisions per value of `segment`, and over all of them (whole = 1)."""
    d = F.col("decision")
    return decided.select(F.col(segment).alias("segment"), "decision").rollup("segment").agg(
        F.grouping("segment").cast("int").alias("whole"), F.count("*").alias("total"),
        *[F.count_if(d == x).alias(x) for x in ("approve", "review", "decline")],
        F.avg(d.eqNullSafe("decline").cast("int")).alias("decline_rate"))


def explore(decided: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """`decided` with `explored`: a fixed share of declines, told by a hash of the id, is let through to learn from."""
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    least = f"{int(share * 2 ** 32):08x}"
    chosen = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "transaction_id")), 1, 8) < least
    explored = F.coalesce((F.col("decision") == "decline") & chosen, F.lit(False))
    return decided.withColumn("explored", explored).withColumn("decision", F.when(F.col("explored"), "approve").otherwise(F.col("decision")))


def threshold_costs(scored: DataFrame, per_decline: float, keys: Sequence[str] = (), grid: int = GRID) -> DataFrame:
    """For every threshold on the grid at which a score lies: declines, false declines, fraud let through and its cost.

    Rows need score, label and amount_base; those without score or label take no part. A good payment that is declined
    costs `per_decline`, a fraud let through its amount. `best` marks the cheapest threshold, the highest of equal ones.
    Sums are per part of the grid before they run over thresholds, so a key has at most `grid` rows there.
    """
    known = scored.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    parts = known.groupBy(*keys, _bin(F.col("score"), grid).cast("int").alias("part")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("good"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("amount_base"))), F.lit(0.0)).alias("fraud"))
    own = Window.partitionBy(*keys)
    above = own.orderBy("part").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    swept = parts.select(*keys, (F.col("part") / grid).alias("threshold"), F.sum("n").over(above).alias("declines"),
                         F.sum("good").over(above).alias("false_declines"),
                         F.coalesce(F.sum("fraud").over(below), F.lit(0.0)).alias("missed"))
    swept = swept.withColumn("cost", F.col("missed") + F.col("false_declines") * per_decline)
    first = F.row_number().over(own.orderBy("cost", F.desc("threshold")))
    return swept.withColumn("best", first == 1)

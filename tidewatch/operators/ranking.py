"""Quantiles, ranks and fixed-size samples without gathering rows in one place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import times
from tidewatch.functions.times import DAY_MS
from tidewatch.functions.values import ratio
from tidewatch.operators.skew import SkewPolicy, all_lanes, running


def score_groups(scored: DataFrame, score: str = "score", label: str = "label",
                 amount: str = "amount_base", policy: SkewPolicy | None = None) -> DataFrame:
    """One row per distinct score with outcome counts and amounts, and the counts below that score.

    Rows without a score cannot be ranked and are left out; `unscored` counts them.
    """
    fraud = F.col(label) == 1
    money = F.col(amount) if amount in scored.columns else F.lit(0.0)
    groups = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(fraud).alias("pos"), F.count_if(~fraud).alias("neg"),
        F.sum(F.when(fraud, money)).alias("pos_amount"), F.sum(F.when(~fraud, money)).alias("neg_amount"))
    lanes = running(all_lanes(groups, ["score"], policy), [], ["score"],
                    {"pos_below": ("sum", F.col("pos")), "neg_below": ("sum", F.col("neg"))})
    return lanes.map(lambda df, by: df.fillna(0, ["pos_below", "neg_below"])).done()


def unscored(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """How many rows, and how many positives, the ranking measures leave out for want of a score."""
    missing = F.col(score).isNull()
    return scored.agg(F.count_if(missing).alias("unscored"), F.count_if(missing & (F.col(label) == 1)).alias("unscored_positives"))


def totals(groups: DataFrame) -> tuple[int, int]:
    row = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return row.p or 0, row.n or 0


def quantile(groups: DataFrame, share: float) -> float | None:
    """Linearly interpolated quantile: reads the two order statistics around it."""
    n = sum(totals(groups))
    if n == 0:
        return None
    place = (n - 1) * share
    low, high = math.floor(place), math.ceil(place)
    below = F.col("pos_below") + F.col("neg_below")
    upto = below + F.col("pos") + F.col("neg")
    found = (groups.filter(((below <= low) & (upto > low)) | ((below <= high) & (upto > high)))
             .select("score").orderBy("score").collect())
    first, last = found[0].score, found[-1].score
    return first + (place - low) * (last - first)


def roc_auc(positives: int, negatives: int) -> Column:
    """Chance that a positive outranks a negative; a tie counts half."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return F.try_divide(wins, F.lit(float(positives * negatives)))


def average_precision(positives: int, negatives: int) -> Column:
    """Precision at every distinct score, weighted by the positives found there."""
    hits = positives - F.col("pos_below")
    flagged = hits + negatives - F.col("neg_below")
    return F.sum(F.try_divide(hits * F.col("pos"), flagged.cast("double"))) / float(max(positives, 1))


def ranking_quality(scored: DataFrame, policy: SkewPolicy | None = None, **columns) -> DataFrame:
    groups = score_groups(scored, policy=policy, **columns)
    p, n = totals(groups)
    return groups.agg(roc_auc(p, n).alias("roc_auc"), average_precision(p, n).alias("pr_auc"),
                         F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def confusion_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "fpr": ratio(fp, fp + tn)}


def metrics_at_budget(scored: DataFrame, budget: float, policy: SkewPolicy | None = None,
                      **columns) -> DataFrame:
    """Quality with the top `budget` share of scores flagged; ties at the threshold are all flagged."""
    groups = score_groups(scored, policy=policy, **columns)
    p, n = totals(groups)
    threshold = quantile(groups, 1.0 - budget)
    hit = F.col("score") >= F.lit(threshold)
    sums = groups.agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        average_precision(p, n).alias("pr_auc"), roc_auc(p, n).alias("roc_auc"),
        F.coalesce(F.sum(F.when(hit, F.col("pos_amount"))), F.lit(0.0)).alias("gbp_caught"),
        F.coalesce(F.sum(F.when(hit, F.col("neg_amount"))), F.lit(0.0)).alias("gbp_false_decline"))
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return sums.withColumns({
        **confusion_rates(*cells), "threshold": F.lit(threshold).cast("double"),
        "flagged": cells[0] + cells[1]})


def top_share(scored: DataFrame, budget: float, score: str = "score",
              policy: SkewPolicy | None = None) -> DataFrame:
    """The rows at or above the (1 - budget) quantile of their score."""
    groups = score_groups(scored.withColumn("_label", F.lit(0)), score, "_label", policy=policy)
    return scored.filter(F.col(score) >= F.lit(quantile(groups, 1.0 - budget)))


HEX = 3   # digits per step: 4,096 counts come to the driver at a time


def fixed_sample(rows: DataFrame, key: str, size: int, seed: int = 42, small: int = 10_000) -> DataFrame:
    """Exactly `size` rows (or all), the ones with the smallest hash of key and seed.

    The cut is found digit by digit from counts per hash prefix; only rows under the last prefix,
    at most about `small`, are ordered against each other.
    """
    tagged = rows.withColumn("_hash", F.md5(F.concat(F.col(key), F.lit(f":{seed}"))))
    kept, prefix, need = F.lit(False), "", size
    while True:
        under = F.col("_hash").startswith(prefix)
        counted = (tagged.filter(under).groupBy(F.substring("_hash", 1, len(prefix) + HEX).alias("p"))
                   .count().orderBy("p").collect())
        if not prefix and sum(r["count"] for r in counted) <= size:
            return rows
        for row in counted:
            if row["count"] > need:
                break
            need -= row["count"]
        else:
            row = None
        if row is None or need == 0:
            bound = row.p if row is not None else prefix + "g"
            return tagged.filter(F.col("_hash") < bound).drop("_hash")
        prefix = row.p
        if row["count"] <= small or len(prefix) + HEX > 32:
            edge = tagged.filter(F.col("_hash").startswith(prefix)).orderBy("_hash", key).limit(need)
            return tagged.filter(F.col("_hash") < prefix).unionByName(edge).drop("_hash")


def zscores(rows: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Standard scores with the population deviation; a constant column scores 0."""
    stats = rows.agg(*[f(c).alias(f"{c}_{i}") for c in columns
                       for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    return {c: (F.lit(0.0) if not stats[f"{c}_1"] else (F.col(c) - stats[f"{c}_0"]) / stats[f"{c}_1"])
            for c in columns}


def ranks(rows: DataFrame, order: list[str], policy: SkewPolicy | None = None) -> DataFrame:
    """Position of every row in a total order, from 1; `order` must not tie."""
    lanes = running(all_lanes(rows, order, policy), [], order, {"rank": ("sum", F.lit(1))})
    return lanes.done().withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long") + 1)


OLDEST = -(1 << 62)


def newest_rows(rows: DataFrame, size: int, time: str = "ms", tie: str = "transaction_id",
                widths: tuple[int, ...] = (DAY_MS, 60_000)) -> DataFrame:
    """The `size` rows of the greatest `time`, ties by the smaller `tie`; rows without a time are the oldest.

    Counts per day find the day of the cut, counts per minute of that day the minute. Only rows of that minute are
    ordered against one another; later ones stay as they lie, without a shuffle.
    """
    at = F.coalesce(F.col(time), F.lit(OLDEST))
    edge, low, need = None, None, size                  # rows from `edge` on stay; the cut is in [low, edge)
    for width in widths:
        bucket = times.floor_div(at, width)
        inside = rows if low is None else rows.filter((at >= low) & (at < edge))
        counted = inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()   # days, minutes
        for row in counted:
            if row.n > need:
                low, edge = row.b * width, (row.b + 1) * width
                break
            need -= row.n
        else:
            return rows if low is None else rows.filter(at >= low)
    last = rows.filter((at >= low) & (at < edge)).orderBy(at.desc(), tie).limit(need)
    return rows.filter(at >= edge).unionByName(last)

"""Decision quality against outcomes: confusion counts, rates, rolling windows, data expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import times
from tidewatch.functions.values import ratio
from tidewatch.operators.ranking import confusion_rates, ranking_quality, zscores

# Counter bucket and rolling window.
BUCKET_MS, WINDOW_MS = 2_000, 20_000
CELLS = ("tp", "fp", "fn", "tn")


def decision_at(score: Column, threshold: float | Column) -> Column:
    return F.when(score >= threshold, "decline").otherwise("approve")


def cell(decision: Column, label: Column) -> Column:
    """Only a decline flags a transaction; review and approve do not."""
    flagged = decision.eqNullSafe("decline")
    return (F.when(flagged & (label == 1), "tp").when(flagged, "fp").when(label == 1, "fn").otherwise("tn"))


def cell_counts(name: str = "cell") -> list[Column]:
    return [F.count_if(F.col(name) == c).alias(c) for c in CELLS]


def money(name: str = "cell", amount: str = "amount_base") -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(name) == c, F.col(amount))), F.lit(0.0)).alias(alias)
            for c, alias in (("tp", "gbp_caught"), ("fp", "gbp_false_decline"))]


def with_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", cell(F.col("decision"), F.col("label")))


def confusion(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_cells(rows).groupBy(*keys).agg(*cell_counts(), *money())


def counters(rows: DataFrame, width_ms: int = BUCKET_MS) -> DataFrame:
    """Confusion counts and amounts per model version and bucket."""
    bucket = times.floor_div(F.col("ms"), width_ms).alias("bucket")
    return with_cells(rows).groupBy("model_version", bucket).agg(*cell_counts(), *money())


def rolling(buckets: DataFrame, width_ms: int = BUCKET_MS, window_ms: int = WINDOW_MS) -> DataFrame:
    """Counters of the last `window_ms` at every bucket that has anything in its window.

    Each pre-aggregated bucket joins the windows it belongs to, so no version is confined to one task.
    """
    n = max(1, window_ms // width_ms)
    names = [*CELLS, "gbp_caught", "gbp_false_decline"]
    spread = buckets.withColumn("bucket", F.explode(F.sequence(F.col("bucket"), F.col("bucket") + n - 1)))
    return with_rates(spread.groupBy("model_version", "bucket").agg(*[F.sum(c).alias(c) for c in names]))


def with_rates(cells: DataFrame) -> DataFrame:
    return cells.withColumns(confusion_rates(*[F.col(c) for c in CELLS]))


def frame(buckets: DataFrame, producers: DataFrame, champion: str, challenger: str, at: Column,
          feedback_ms: int | None = None, width_ms: int = BUCKET_MS,
          window_ms: int = WINDOW_MS) -> DataFrame:
    """One row that compares champion and challenger over the last window before `at` (epoch ms)."""
    last = times.floor_div(at, width_ms)
    n = max(1, window_ms // width_ms)
    inside = buckets.filter((F.col("bucket") <= last) & (F.col("bucket") > last - n))

    def of(version: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("model_version") == version, F.col(column))), F.lit(0))

    sides = {"champion": champion, "challenger": challenger}
    sums = inside.agg(
        *[of(v, c).alias(f"{side}_{c}") for side, v in sides.items() for c in CELLS],
        of(challenger, "gbp_caught").alias("gbp_caught"),
        of(challenger, "gbp_false_decline").alias("gbp_false_decline"))
    made = {"ts": at.cast("long"), "window_sec": F.lit(window_ms // 1000),
            "feedback_ts": F.lit(feedback_ms).cast("long"), "active": F.lit(feedback_ms is not None)}
    for side, version in sides.items():
        made[f"{side}_version"] = F.lit(version)
        rates = confusion_rates(*[F.col(f"{side}_{c}") for c in CELLS])
        made.update({f"{side}_{k}": v for k, v in rates.items()})
    events = sum((F.col(f"{side}_{c}") for side in sides for c in CELLS), F.lit(0))
    made["tps"] = F.round(events / (window_ms / 1000.0), 1)
    writers = producers.agg(F.count_distinct("producer").alias("n")).first().n
    made["instances"] = F.lit(max(1, writers)).cast("long")
    return sums.withColumns(made)


def blunt_rule(rows: DataFrame, feature: str = "device_distinct_customers", limit: float = 2) -> DataFrame:
    """The rule `feature > limit` as a predictor."""
    judged = rows.withColumn("decision", F.when(F.col(feature) > limit, "decline").otherwise("approve"))
    return (with_rates(confusion(judged)).withColumn("flagged", F.col("tp") + F.col("fp"))
            .select("recall", "precision", "fpr", "gbp_caught", "gbp_false_decline", "flagged"))


JOINT = ("velocity_ratio_1h", "device_surge", "bene_surge", "bene_distinct_senders_90d", "new_payee",
         "device_distinct_customers")


def expectations(rows: DataFrame, joint: Sequence[str] = JOINT, blunt: str = "device_distinct_customers",
                 limit: float = 2) -> DataFrame:
    """Whether labelled data is imbalanced, learnable and harder than the blunt rule."""
    z = zscores(rows, list(joint))
    scored = rows.withColumns({"_joint": sum(z.values(), F.lit(0.0)), "_blunt": F.col(blunt).cast("double")})
    aucs = {name: ranking_quality(scored, score=column).first().roc_auc
            for name, column in (("joint_auc", "_joint"), ("blunt_only_auc", "_blunt"))}
    fraud, fires = F.col("label") == 1, F.col(blunt) > limit
    checks = scored.agg(
        F.avg(F.col("label").cast("double")).alias("fraud_rate"),
        ratio(F.count_if(fires & fraud), F.count_if(fires), None).alias("blunt_rule_precision"),
        ratio(F.count_if(fires & fraud), F.count_if(fraud), None).alias("blunt_rule_recall"),
        ratio(F.count_if(F.col("kind") == "lookalike"), F.greatest(F.lit(1), F.count_if(~fraud)))
         .alias("lookalike_frac_of_legit"))
    checks = checks.withColumns({k: F.lit(v).cast("double") for k, v in aucs.items()})
    # The names of the checks and their limits.
    tests = {
        "imbalance_realistic": F.col("fraud_rate").between(0.003, 0.03),
        "joint_learnable": F.col("joint_auc").between(0.80, 0.985),
        "joint_beats_blunt": F.col("joint_auc") - F.col("blunt_only_auc") > 0.08,
        "blunt_rule_imprecise": F.col("blunt_rule_precision") < 0.5,
        "blunt_rule_incomplete": F.col("blunt_rule_recall") < 0.85,
        "lookalikes_exist": F.col("lookalike_frac_of_legit") > 0.02,
    }
    checks = checks.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    ok = F.lit(True)
    for name in tests:
        ok = ok & F.col(name)
    return checks.withColumn("ok", ok)



"""Outcome labels: records, maturity, trusted entities, weak labels and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.values import starts_with

FRAUD, LEGIT = "confirmed_fraud", "confirmed_legit"
# Sources whose fraud labels may block an entity, entries per batch, label rates.
TRUSTED = ("chargeback", "manual_review", "simulation")
ENTRIES_PER_BATCH = 500
FRAUD_RATE, LEGIT_RATE = 0.85, 0.05


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def label_records(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Normalised labels; the label time defaults to now."""
    moment = now_ms() if at is None else at

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")

    given = F.col("labeled_at_ms") if "labeled_at_ms" in rows.columns else F.lit(None).cast("long")
    return rows.select("transaction_id", "label", "source",
                       F.coalesce(given, moment).cast("long").alias("labeled_at_ms"),
                       F.col("txn_ts_ms").cast("long").alias("txn_ts_ms"),
                       text("receiver_account").alias("receiver_account"),
                       text("device_fingerprint").alias("device_fingerprint"))


def is_matured(at: Column, maturation_ms: int) -> Column:
    """Fraud counts once labelled; legit only after the maturation time since the transaction."""
    fraud = (F.col("label") == FRAUD) & (F.col("labeled_at_ms") <= at)
    legit = (F.col("label") == LEGIT) & (F.col("txn_ts_ms") + maturation_ms <= at)
    return F.coalesce(fraud | legit, F.lit(False))


def latest_matured(labels: DataFrame, at: Column, maturation_ms: int = 0) -> DataFrame:
    """One label per transaction: the latest of its matured ones. Copies are folded before the shuffle."""
    newest = F.max_by("label", F.struct("labeled_at_ms", "label")).alias("label")
    return labels.filter(is_matured(at, maturation_ms)).groupBy("transaction_id").agg(newest)


def block_candidates(labels: DataFrame) -> DataFrame:
    """Payees and devices of trusted fraud labels, with the amount of evidence and its earliest time."""
    trusted = labels.filter((F.col("label") == FRAUD) & F.col("source").isin(*TRUSTED))
    entries = F.array(
        F.struct(F.lit("bl_accounts").alias("list_name"), F.col("receiver_account").alias("member")),
        F.struct(F.lit("bl_devices").alias("list_name"), F.col("device_fingerprint").alias("member")))
    return (trusted.select("labeled_at_ms", F.inline(entries))
            .filter(F.col("member").isNotNull() & (F.col("member") != ""))
            .groupBy("list_name", "member")
            .agg(F.count("*").alias("evidence"), F.min("labeled_at_ms").alias("since_ms")))


def strongest(candidates: DataFrame, limit: int | None = ENTRIES_PER_BATCH) -> DataFrame:
    """At most `limit` entries per list (None: all), most evidence first: a guard against poisoned label feeds."""
    if limit is None:
        return candidates
    parts = [candidates.filter(F.col("list_name") == name).orderBy(F.desc("evidence"), "member").limit(limit)
             for name in ("bl_accounts", "bl_devices")]
    return parts[0].unionByName(parts[1])


def is_fraud_entity(payee: Column, device: Column) -> Column:
    return starts_with(payee, "mule_") | starts_with(device, "farm_")


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on key and seed, so reruns draw the same rows."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(2 ** 32)


def weak_labels(events: DataFrame, seed: int = 0, fraud_rate: float = FRAUD_RATE,
                legit_rate: float = LEGIT_RATE, is_fraud: Column | None = None) -> DataFrame:
    """Labels for a sample of transactions: most of the fraud, a few of the rest."""
    fraud = (is_fraud_entity(F.col("receiver_account"), F.col("device_fingerprint"))
             if is_fraud is None else is_fraud)
    drawn = events.withColumns({"_fraud": fraud, "_draw": unit_draw(F.col("transaction_id"), seed)})
    kept = drawn.filter(F.col("_draw") < F.when(F.col("_fraud"), fraud_rate).otherwise(legit_rate))
    return kept.withColumns({
        "label": F.when(F.col("_fraud"), FRAUD).otherwise(LEGIT),
        "source": F.when(F.col("_fraud"), "chargeback").otherwise("manual_review"),
    }).drop("_fraud", "_draw")

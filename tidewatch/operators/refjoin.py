"""Profiles, networks and lists joined to transactions.

Nothing here asks for a broadcast: reference tables grow with the business, and the planner already
broadcasts the ones it measures as small and splits skewed keys of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.values import age_days, ip_prefix


def members(lists: DataFrame, name: str, column: str, flag: str) -> DataFrame:
    """One row per member of a list with the time its first entry starts to count."""
    return (lists.filter(F.col("list_name") == name).filter(F.col("member").isNotNull())
            .groupBy(F.col("member").alias(column)).agg(F.min("valid_from").alias(f"_{flag}_from"))
            .withColumn(f"_{flag}", F.lit(True)))


def with_flag(rows: DataFrame, lists: DataFrame, name: str, column: str, flag: str,
              dated: bool = False) -> DataFrame:
    """True when `column` is on list `name`; with `dated`, only from after the entry's own time."""
    joined = rows.join(members(lists, name, column, flag), column, "left")
    on_list = F.coalesce(F.col(f"_{flag}"), F.lit(False))
    if dated:
        start = F.col(f"_{flag}_from")
        on_list = on_list & (start.isNull() | (start < F.col("ts")))
    return joined.withColumn(flag, on_list).drop(f"_{flag}", f"_{flag}_from")


# List name, the column it is about, the flag it sets.
LIST_FLAGS = (
    ("vip_customers", "customer_id", "vip_customer"),
    ("watchlist", "customer_id", "watchlist"),
    ("bl_accounts", "receiver_account", "bl_account"),
    ("bl_devices", "device_fingerprint", "bl_device"),
    ("proxy_ips", "ip_address", "ip_proxy"),
)


def with_list_flags(rows: DataFrame, lists: DataFrame, dated: bool = False, about: str | None = None) -> DataFrame:
    """The flags of all lists, or of those that are `about` one column."""
    for name, column, flag in LIST_FLAGS:
        if about in (None, column):
            rows = with_flag(rows, lists, name, column, flag, dated)
    return rows


def with_account_age(rows: DataFrame, customers: DataFrame) -> DataFrame:
    profile = customers.select("customer_id", "account_open_date").dropDuplicates(["customer_id"])
    return (rows.join(profile, "customer_id", "left")
            .withColumn("account_age_days", age_days(F.col("account_open_date"), F.col("ts")))
            .drop("account_open_date"))


def with_payee_country(rows: DataFrame, payees: DataFrame) -> DataFrame:
    profile = payees.select("receiver_account", "beneficiary_country").dropDuplicates(["receiver_account"])
    return rows.join(profile, "receiver_account", "left")


def with_ip_country(rows: DataFrame, networks: DataFrame) -> DataFrame:
    """Country of the address; an unknown address counts as domestic."""
    prefixes = networks.select("ip_prefix", F.col("country").alias("_ip_country")).dropDuplicates(["ip_prefix"])
    return (rows.withColumn("ip_prefix", ip_prefix(F.col("ip_address")))
            .join(prefixes, "ip_prefix", "left")
            .withColumn("ip_country", F.coalesce("_ip_country", "customer_portfolio_country"))
            .drop("_ip_country", "ip_prefix"))


def cross_border(payee_country: Column, customer_country: Column) -> Column:
    """1.0 only when the payee country is known and differs."""
    differs = payee_country.isNotNull() & ~payee_country.eqNullSafe(customer_country)
    return F.when(differs, 1.0).otherwise(0.0)


def with_request_fields(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "local_hour": F.hour("ts"),
        "cross_border": cross_border(F.col("beneficiary_country"), F.col("customer_portfolio_country"))})


def merge_features(features: DataFrame, signals: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One feature row per transaction; where both sides have a column the signal side wins."""
    clash = [c for c in signals.columns if c in features.columns and c != key]
    return features.drop(*clash).join(signals, key, "left")


def overlay(rows: DataFrame, lists: DataFrame, dated: bool = False) -> DataFrame:
    """A listed payee or device is declined whatever the decision was."""
    flagged = with_flag(with_flag(rows, lists, "bl_accounts", "receiver_account", "_acct", dated),
                        lists, "bl_devices", "device_fingerprint", "_dev", dated)
    return flagged.withColumn("decision", F.when(F.col("_acct") | F.col("_dev"), "decline")
                              .otherwise(F.col("decision"))).drop("_acct", "_dev")


def new_entries(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (list_name, member, ...) that are not on their list yet."""
    return candidates.join(existing.select("list_name", "member").distinct(),
                           ["list_name", "member"], "left_anti")


def per_version(rows: DataFrame, versions: dict[str, Column]) -> DataFrame:
    """One row per transaction and model version with that version's decision."""
    made = F.array(*[F.struct(F.lit(v).alias("model_version"), d.alias("decision"))
                     for v, d in versions.items()])
    return rows.select(*[c for c in rows.columns if c not in ("model_version", "decision")], F.inline(made))


def stored_decision_first(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """A transaction that was decided before keeps its stored decision, with no rules and no snapshot."""
    kept = ["decision", "final_score", "model_score", "model_version"]
    memo = (stored.groupBy("customer_id", "transaction_id")
            .agg(F.min_by(F.struct(*kept), F.col("timestamp_epoch_ms")).alias("_memo")))
    known = F.col("_memo").isNotNull()
    joined = scored.join(memo, ["customer_id", "transaction_id"], "left")
    made = {c: F.when(known, F.col(f"_memo.{c}")).otherwise(F.col(c)) for c in kept}
    made["rules_fired"] = F.when(known, F.array().cast("array<string>")).otherwise(F.col("rules_fired"))
    made["degraded"] = F.when(known, False).otherwise(F.col("degraded"))
    if "feature_snapshot_json" in scored.columns:
        made["feature_snapshot_json"] = F.when(known, "{}").otherwise(F.col("feature_snapshot_json"))
    return joined.withColumns(made).drop("_memo")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

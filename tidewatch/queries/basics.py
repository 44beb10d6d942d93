"""Scalars, reference joins, rollups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import times, values
from tidewatch.operators import aggregates as agg, refjoin
from tidewatch.operators.signals import with_safe_defaults
from tidewatch.queries.common import LISTS, PROFILES, SCORED, order_sql, prior, txn_sql
from tidewatch.sources.tables import (customer_profiles, event_transactions, ip_countries, listed,
                                      order_transactions, payee_profiles, scored_events)

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def on_events(build, **fold):
    return lambda spark, folder: build(event_transactions(spark, folder, **fold))


# --- scalars -------------------------------------------------------------------------------------

register("fx_to_base", on_events(lambda t: t.select(
    "transaction_id", F.round("amount_base", 6).alias("amount_base"),
    F.round(values.to_base(F.when(F.col("declined") == 0, F.col("amount")), F.lower("currency")), 6).alias("lower_case"),
    F.round(values.to_base(F.col("amount"), F.lit(None).cast("string")), 6).alias("no_currency"))), f"""
WITH {txn_sql()}
SELECT transaction_id, round(amount_base, 6) AS amount_base,
  round(CASE WHEN declined = 0 THEN amount_base ELSE 0 END, 6) AS lower_case, round(amount, 6) AS no_currency FROM txn""")

register("utc_buckets", on_events(lambda t: t.select(
    "transaction_id", F.hour("ts").cast("bigint").alias("local_hour"),
    times.label(F.col("ts"), "hour").alias("hour_label"), times.label(F.col("ts"), "day").alias("day_label"),
    times.label(F.col("ts"), "month").alias("month_label"),
    *[times.index(F.col("ms"), u).alias(f"{u}_index") for u in ("tick", "hour", "day", "week", "month")],
    F.date_format(times.utc_date(F.col("ms")), "yyyy-MM-dd").alias("dt"))), f"""
WITH {txn_sql()}
SELECT transaction_id, hour(ts) AS local_hour, strftime(ts, '%Y-%m-%dT%H') AS hour_label,
  strftime(ts, '%Y-%m-%d') AS day_label, strftime(ts, '%Y%m') AS month_label, tick AS tick_index,
  h AS hour_index, d AS day_index, w AS week_index, mon AS month_index, strftime(ts, '%Y-%m-%d') AS dt FROM txn""")

register("bucket_labels", on_events(lambda t: t.select(
    "transaction_id",
    F.concat_ws(",", times.labels_between(F.col("ts") - F.expr("interval 3 hours"), F.col("ts"), "hour")).alias("hours"),
    F.concat_ws(",", times.labels_between(F.col("ts") - F.expr("interval 2 days"), F.col("ts"), "day")).alias("days"))), f"""
WITH {txn_sql()}
SELECT transaction_id,
  array_to_string(list_transform(generate_series(date_trunc('hour', ts - INTERVAL 3 HOUR), date_trunc('hour', ts),
    INTERVAL 1 HOUR), lambda x: strftime(x, '%Y-%m-%dT%H')), ',') AS hours,
  array_to_string(list_transform(generate_series(date_trunc('day', ts - INTERVAL 2 DAY)::TIMESTAMP,
    date_trunc('day', ts)::TIMESTAMP, INTERVAL 1 DAY), lambda x: strftime(x, '%Y-%m-%d')), ',') AS days
FROM txn""")

register("hot_warm_tier", on_events(lambda t: t.select("transaction_id", agg.tier(
    F.col("ts"), F.lit("2024-01-30 00:00:00").cast("timestamp")).alias("tier"))), f"""
WITH {txn_sql()}
SELECT transaction_id, CASE WHEN ts >= TIMESTAMP '2024-01-30 00:00:00' THEN '1h' ELSE '1d' END AS tier FROM txn""")

register("entity_prefixes", on_events(lambda t: t.select(
    "transaction_id", (values.starts_with(F.col("receiver_account"), "9")
                       | values.starts_with(F.col("device_fingerprint"), "1")).alias("is_fraud_entity"))), f"""
WITH {txn_sql()}
SELECT transaction_id, coalesce(receiver_account LIKE '9%', false) OR coalesce(device_fingerprint LIKE '1%', false)
  AS is_fraud_entity FROM txn""")

register("safe_signal_defaults", on_events(lambda t: with_safe_defaults(t.select(
    "transaction_id", F.when(F.col("declined") == 1, F.col("ms") % 7).alias("customer_declines_24h"),
    F.when(F.col("declined") == 0, F.round("amount", 2)).alias("hod_share_now"),
    F.when(F.col("declined") == 0, F.round("amount", 2)).alias("interarrival_cv")),
    F.col("transaction_id") != "17")), f"""
WITH {txn_sql()}
SELECT transaction_id,
  CASE WHEN declined = 1 AND transaction_id <> '17' THEN ms % 7 ELSE 0 END AS customer_declines_24h,
  CASE WHEN declined = 0 AND transaction_id <> '17' THEN round(amount, 2) ELSE 1.0::DOUBLE END AS hod_share_now,
  CASE WHEN declined = 0 AND transaction_id <> '17' THEN round(amount, 2) ELSE 999.0::DOUBLE END AS interarrival_cv
FROM txn""")

# --- reference joins -----------------------------------------------------------------------------


def reference_fields(spark, folder):
    t = event_transactions(spark, folder)
    t = refjoin.with_account_age(t, customer_profiles(spark, folder))
    t = refjoin.with_payee_country(t, payee_profiles(spark, folder))
    t = refjoin.with_request_fields(refjoin.with_ip_country(t, ip_countries(spark, folder)))
    return t.select("transaction_id", F.col("account_age_days").cast("bigint").alias("account_age_days"),
                    "beneficiary_country", "ip_country", "cross_border",
                    values.ip_prefix(F.col("ip_address")).alias("ip_prefix"))


register("reference_fields", reference_fields, f"""
WITH {txn_sql()}, {PROFILES},
x AS (SELECT *, split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2) AS ip_prefix FROM txn)
SELECT t.transaction_id, date_diff('day', p.account_open_date, CAST(t.ts AS DATE)) AS account_age_days,
  b.beneficiary_country, coalesce(n.country, t.customer_portfolio_country) AS ip_country,
  CASE WHEN b.beneficiary_country IS NOT NULL AND b.beneficiary_country <> t.customer_portfolio_country
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cross_border, t.ip_prefix
FROM x t LEFT JOIN profiles p ON p.customer_id = t.customer_id
  LEFT JOIN payees b ON b.receiver_account = t.receiver_account LEFT JOIN networks n ON n.ip_prefix = t.ip_prefix""")

FLAGS = ["vip_customer", "watchlist", "bl_account", "bl_device", "ip_proxy"]


def flags_sql(dated):
    when = "AND l.from_ms < t.ms" if dated else ""
    parts = ", ".join(f"EXISTS (SELECT 1 FROM lists l WHERE l.list_name = '{n}' AND l.member = t.{c} {when}) AS {f}"
                      for n, c, f in refjoin.LIST_FLAGS)
    return f"WITH {txn_sql()}, {LISTS} SELECT t.transaction_id, {parts} FROM txn t"


for _name, _dated in (("membership_flags", False), ("dated_membership_flags", True)):
    register(_name, lambda spark, folder, dated=_dated: refjoin.with_list_flags(
        event_transactions(spark, folder), listed(spark, folder), dated).select("transaction_id", *FLAGS),
        flags_sql(_dated))


def merged_features(spark, folder):
    t = event_transactions(spark, folder)
    features = t.select("transaction_id", "amount_base", F.lit(0).cast("bigint").alias("declines"))
    found = t.select("transaction_id", F.col("declined").cast("bigint").alias("declines"),
                     F.hour("ts").cast("bigint").alias("hour"))
    merged = refjoin.merge_features(features, found)
    return merged.withColumn("amount_base", F.round("amount_base", 6))


register("merge_features_and_signals", merged_features, f"""
WITH {txn_sql()} SELECT transaction_id, round(amount_base, 6) AS amount_base, CAST(declined AS BIGINT) AS declines,
  hour(ts) AS hour FROM txn""")


def blacklist_overlay(spark, folder):
    e = scored_events(spark, folder).withColumn("decision", F.when(F.col("score") >= 0.9, "decline").otherwise("approve"))
    return refjoin.overlay(e, listed(spark, folder)).select("transaction_id", "decision")


register("blacklist_overlay", blacklist_overlay, f"""
WITH {SCORED}, {LISTS}
SELECT transaction_id, CASE WHEN score >= 0.9
  OR EXISTS (SELECT 1 FROM entries l WHERE l.list_name = 'bl_accounts' AND l.member = e.receiver_account)
  OR EXISTS (SELECT 1 FROM entries l WHERE l.list_name = 'bl_devices' AND l.member = e.device_fingerprint)
  THEN 'decline' ELSE 'approve' END AS decision FROM ev e""")


def versions(spark, folder):
    e = scored_events(spark, folder)
    return refjoin.per_version(e, {
        "rules-v0": F.when(F.col("device_distinct_customers") > 2, "decline").otherwise("approve"),
        "fb-model": F.when(F.col("score") >= 0.8, "decline").otherwise("approve"),
    }).select("transaction_id", "model_version", "decision")


register("decisions_per_version", versions, f"""
WITH {SCORED}
SELECT transaction_id, 'rules-v0' AS model_version,
  CASE WHEN device_distinct_customers > 2 THEN 'decline' ELSE 'approve' END AS decision FROM ev
UNION ALL SELECT transaction_id, 'fb-model', CASE WHEN score >= 0.8 THEN 'decline' ELSE 'approve' END FROM ev""")


def stored_decisions(spark, folder):
    t = event_transactions(spark, folder)
    scored = t.select("customer_id", "transaction_id", F.lit("review").alias("decision"), F.lit(0.5).alias("final_score"),
                      F.lit(None).cast("double").alias("model_score"), F.lit("rules-v1").alias("model_version"),
                      F.array(F.lit("R1")).alias("rules_fired"), F.lit(True).alias("degraded"))
    stored = (t.filter(F.col("declined") == 1)
              .select("customer_id", "transaction_id", F.lit("decline").alias("decision"), F.lit(1.0).alias("final_score"),
                      F.lit(0.25).alias("model_score"), F.lit("m0").alias("model_version"),
                      F.explode(F.array(F.col("ms"), F.col("ms") + 5)).alias("timestamp_epoch_ms")))
    out = refjoin.stored_decision_first(scored, stored)
    return out.withColumn("rules_fired", F.concat_ws(",", "rules_fired"))


register("stored_decision_first", stored_decisions, f"""
WITH {txn_sql()}
SELECT customer_id, transaction_id, CASE WHEN declined = 1 THEN 'decline' ELSE 'review' END AS decision,
  CASE WHEN declined = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS final_score,
  CASE WHEN declined = 1 THEN 0.25::DOUBLE END AS model_score,
  CASE WHEN declined = 1 THEN 'm0' ELSE 'rules-v1' END AS model_version,
  CASE WHEN declined = 1 THEN '' ELSE 'R1' END AS rules_fired, declined = 0 AS degraded FROM txn""")

# --- rollups -------------------------------------------------------------------------------------

KEYS = {
    "customer": ("customer_id",), "payee": ("receiver_account",), "pair": ("customer_id", "receiver_account"),
    "country": ("customer_portfolio_country",), "tpp": ("tpp_name_ud",),
    "payee_country": ("receiver_account", "customer_portfolio_country"),
    "tpp_country": ("tpp_name_ud", "customer_portfolio_country"), "device": ("device_fingerprint",),
}


def _stats(df, *keys):
    return df.select(*keys, "bucket", "cnt", *[F.round(c, 4).alias(c) for c in ("sum", "sumsq", "min", "max")])


for _label, _keys in KEYS.items():
    for _unit, _column in (("hour", "h"), ("day", "d")):
        register(f"rollup_{_label}_{_unit}", on_events(
            lambda t, keys=_keys, unit=_unit: _stats(agg.rollup(t, keys, unit), *keys)), f"""
WITH {txn_sql()}
SELECT {', '.join(_keys)}, {_column} AS bucket, count(*) AS cnt, round(sum(amount_base), 4) AS sum,
  round(sum(amount_base * amount_base), 4) AS sumsq, round(min(amount_base), 4) AS min,
  round(max(amount_base), 4) AS max FROM txn GROUP BY {', '.join(_keys)}, {_column}""")

register("combine_rollups", lambda spark, folder: agg.combine(
    agg.rollup(order_transactions(spark, folder), ["customer_id"], "day"), ["customer_id"]).select(
    "customer_id", "cnt", *[F.round(c, 6).alias(c) for c in ("sum", "mean", "stddev")]), f"""
WITH {order_sql()}
SELECT customer_id, count(*) AS cnt, round(sum(amount_base), 6) AS sum, round(avg(amount_base), 6) AS mean,
  round(stddev_pop(amount_base), 6) AS stddev FROM txn GROUP BY 1""")

for _label, _key, _width in (("velocity_hour", "customer_id", 3_600_000), ("velocity_5m", "customer_id", 300_000),
                             ("surge_device_5m", "device_fingerprint", 300_000),
                             ("surge_payee_5m", "receiver_account", 300_000)):
    register(f"rollup_{_label}", on_events(
        lambda t, key=_key, width=_width: agg.counts(t, [key], width)), f"""
WITH {txn_sql()}
SELECT {_key}, ms // {_width} * {_width} AS bucket_ms, count(*) AS cnt FROM txn GROUP BY 1, 2""")

register("rollup_weekly_amount", on_events(lambda t: agg.weekly_amounts(t).withColumn("sum", F.round("sum", 4))), f"""
WITH {txn_sql()}
SELECT customer_id, w * 604800000 AS week_ms, round(sum(amount_base), 4) AS sum, count(*) AS cnt FROM txn GROUP BY 1, 2""")

register("last_event_per_type", on_events(agg.last_events), f"""
WITH {txn_sql()}
SELECT customer_id, event_kind, max(ms) AS last_ms, arg_max(transaction_id, (ms, transaction_id)) AS last_id
FROM txn GROUP BY 1, 2""")

for _label, _key, _n in (("last_50_per_customer", "customer_id", 50), ("last_64_per_payee", "receiver_account", 64)):
    register(_label, on_events(lambda t, key=_key, n=_n: agg.latest(t, [key], n).select(
        key, "transaction_id", F.col("position").cast("bigint").alias("position"))), f"""
WITH {txn_sql()}, r AS (SELECT {_key}, transaction_id,
  row_number() OVER (PARTITION BY {_key} ORDER BY ms DESC, transaction_id DESC) AS position FROM txn)
SELECT * FROM r WHERE position <= {_n}""")

register("members_per_entity", lambda spark, folder: agg.distinct_members(
    order_transactions(spark, folder), "receiver_account", "customer_id"), f"""
WITH {order_sql()} SELECT receiver_account, count(DISTINCT customer_id) AS members FROM txn GROUP BY 1""")

register("approx_members_4_months", lambda spark, folder: agg.sketch_window(agg.member_sketches(
    order_transactions(spark, folder), "receiver_account", "customer_id"), "receiver_account"))

# --- sets ----------------------------------------------------------------------------------------


def deduplicated(spark, folder):
    t = event_transactions(spark, folder).select("transaction_id", "ms", "customer_id", "declined")
    copies = t.unionByName(t.withColumn("ms", F.col("ms") + 7)).unionByName(
        t.filter(F.col("declined") == 1).withColumn("ms", F.col("ms") - 3))
    return agg.first_of_each(copies, ["transaction_id"], ["ms"]).drop("declined")


register("first_per_transaction", deduplicated, f"""
WITH {txn_sql()} SELECT transaction_id, ms - 3 * declined AS ms, customer_id FROM txn""")

"""Schemas at the edges: requests, scored transactions, labels."""

from __future__ import annotations

from pyspark.sql import types as T

from tidewatch.config import MODEL_FEATURES

REQUEST = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_portfolio_country", T.StringType()),
    T.StructField("receiver_account", T.StringType()),
    T.StructField("tpp_name_ud", T.StringType()),
    T.StructField("device_fingerprint", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
])

SAMPLE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("expected_decision", T.StringType()),
    T.StructField("expected_trigger", T.StringType()),
    T.StructField("request", REQUEST),
])

SCORED = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("receiver_account", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("model_score", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("amount_base", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("customer_portfolio_country", T.StringType()),
    T.StructField("timestamp_epoch_ms", T.LongType()),
    T.StructField("device_fingerprint", T.StringType()),
    T.StructField("tpp_name_ud", T.StringType()),
    T.StructField("rules_fired", T.ArrayType(T.StringType())),
    T.StructField("feature_snapshot_json", T.StringType()),
])
AUDIT = T.StructType([*SCORED.fields, T.StructField("dt", T.StringType())])

LABEL = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("labeled_at_ms", T.LongType()),
    T.StructField("txn_ts_ms", T.LongType()),
    T.StructField("receiver_account", T.StringType()),
    T.StructField("device_fingerprint", T.StringType()),
])

ENTRY = T.StructType([
    T.StructField("list_name", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("valid_from", T.TimestampType()),
])

CUSTOMER = "customer_id string, customer_portfolio_country string, account_open_date date, risk_segment string"
PAYEE = "receiver_account string, country string, is_mule_pattern boolean"
TPP = "tpp_name_ud string, typical_country string"

# Rows of simulated or replayed training data: the model's features, ids, outcome, kind of behaviour and round.
SIMULATED = T.StructType([
    *[T.StructField(f, T.DoubleType()) for f in MODEL_FEATURES],
    *[T.StructField(n, T.StringType()) for n in ("transaction_id", "customer_id", "receiver_account", "device_fingerprint", "tpp_name_ud")],
    T.StructField("timestamp_epoch_ms", T.LongType()),
    T.StructField("label", T.ByteType()),
    T.StructField("kind", T.StringType()),
    T.StructField("round", T.IntegerType()),
])

"""File readers, over documents that Spark first writes from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.operators.ranking import newest_rows, ranks
from tidewatch.queries.common import LISTS, PROFILES, SCORED, txn_sql
from tidewatch.session import scratch
from tidewatch.sources import files
from tidewatch.sources.tables import (customer_profiles, event_transactions, ip_countries, listed, payee_profiles,
                                      scored_events)

QUERIES, ORACLE = {}, {}
PER_DOCUMENT = 5_000


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def as_documents(rows: DataFrame, name: str) -> str:
    """JSON arrays of a bounded number of rows, one array per file."""
    path = scratch(rows.sparkSession, name)
    documents = max(1, -(-rows.count() // PER_DOCUMENT))
    numbered = rows.withColumn("doc", F.pmod(F.xxhash64(*rows.columns), F.lit(documents)))
    arrays = numbered.groupBy("doc").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("doc").write.partitionBy("doc").text(path)
    return path


def customers(spark, folder):
    rows = customer_profiles(spark, folder).withColumn("customer_portfolio_country", F.lit("GB"))
    return (files.customers(spark, as_documents(rows, "customers"))
            .select("customer_id", F.date_format("account_open_date", "yyyy-MM-dd").alias("opened"), "risk_segment"))


register("customer_master_scan", customers, f"""
WITH {PROFILES} SELECT customer_id, strftime(account_open_date, '%Y-%m-%d') AS opened, risk_segment FROM profiles""")


def payees(spark, folder):
    rows = payee_profiles(spark, folder).withColumnRenamed("beneficiary_country", "country")
    return files.payees(spark, as_documents(rows, "payees")).drop("doc")


register("payee_master_scan", payees, f"WITH {PROFILES} SELECT * FROM payees")


def members(spark, folder):
    """Documents of member arrays: one array per list, split so that no document grows with a list."""
    rows = listed(spark, folder).select("list_name", "member")
    part = F.pmod(F.xxhash64("member"), F.lit(max(1, -(-rows.count() // PER_DOCUMENT)))).alias("doc")
    names = ["bl_accounts", "bl_devices", "vip_customers", "watchlist", "proxy_ips"]
    path = scratch(spark, "lists")
    arrays = rows.groupBy(part).agg(*[
        F.collect_list(F.when(F.col("list_name") == n, F.col("member"))).alias(n) for n in names])
    arrays.select("doc", F.to_json(F.struct(*names)).alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    return files.member_lists(spark, path, names).select("list_name", "member")


register("member_list_scan", members, f"WITH {LISTS} SELECT list_name, member FROM entries")


def networks(spark, folder):
    path = scratch(spark, "geo")
    rows = ip_countries(spark, folder)
    pairs = F.map_from_entries(F.collect_list(F.struct("ip_prefix", "country")))
    # At most one entry per nation.
    rows.agg(F.to_json(F.struct(pairs.alias("prefixes"))).alias("value")).write.text(path)
    return files.ip_networks(spark, path)


register("ip_network_scan", networks, f"WITH {PROFILES} SELECT ip_prefix, country FROM networks")


def as_requests(t: DataFrame) -> DataFrame:
    return t.select("transaction_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
                    "customer_id", "customer_portfolio_country", "receiver_account", "tpp_name_ud",
                    "device_fingerprint", "ip_address", "amount", "currency")


def json_lines(spark, folder):
    path = scratch(spark, "jsonl")
    as_requests(event_transactions(spark, folder)).write.json(path)
    return files.transactions(spark, path).select("transaction_id", "ms", F.round("amount_base", 6).alias("amount_base"))


register("transaction_json_lines_scan", json_lines, f"""
WITH {txn_sql()} SELECT transaction_id, ms, round(amount_base, 6) AS amount_base FROM txn""")


def samples(spark, folder):
    t = as_requests(event_transactions(spark, folder))
    rows = t.select(F.concat(F.lit("case "), "transaction_id").alias("label"), F.lit("review").alias("expected_decision"),
                    F.struct(*t.columns).alias("request"))
    return files.sample_requests(spark, as_documents(rows, "samples")).select(
        "label", "expected_decision", "transaction_id", "receiver_account", "ms")


register("sample_request_scan", samples, f"""
WITH {txn_sql()} SELECT 'case ' || transaction_id AS label, 'review' AS expected_decision, transaction_id,
  receiver_account, ms FROM txn""")


def newest_events(spark, folder):
    """Retention by count: the newest 1,000 events, found from counts per day and minute, then ranked among themselves."""
    kept = newest_rows(scored_events(spark, folder).select("transaction_id", "ms"), 1000)
    return ranks(kept.withColumn("age", -F.col("ms")), ["age", "transaction_id"]).select("transaction_id", "rank")


register("newest_event_retention", newest_events, f"""
WITH {SCORED} SELECT transaction_id, row_number() OVER (ORDER BY ms DESC, transaction_id) AS rank FROM ev
QUALIFY rank <= 1000""")


def time_split(spark, folder):
    """Past for training, future for the holdout; nothing is shuffled across the cut."""
    cut = 1_705_000_000_000
    e = scored_events(spark, folder)
    return e.groupBy((F.col("ms") >= cut).alias("holdout")).agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"), F.min("ms").alias("first"), F.max("ms").alias("last"))


register("time_ordered_split", time_split, f"""
WITH {SCORED} SELECT ms >= 1705000000000 AS holdout, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, min(ms) AS first,
  max(ms) AS last FROM ev GROUP BY 1""")

"""Views of the sample tables as transactions and reference data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.values import to_base

COUNTRIES = ("US", "GB", "DE", "SG", "BR")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def most_rows(spark: SparkSession, folder: str, names: tuple[str, ...] = ("events", "lineitem")) -> int:
    """Rows of the larger of the tables that transactions are made from, as their files state them; a missing one has none."""
    def rows(name: str) -> int:
        try:
            return table(spark, folder, name).count()
        except AnalysisException:
            return 0
    return max(map(rows, names))


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)


def finish(raw: DataFrame) -> DataFrame:
    """Adds epoch milliseconds and the base amount to request columns."""
    return raw.withColumns({"ms": F.unix_millis("ts"),
                            "amount_base": to_base(F.col("amount"), F.col("currency"))})


def event_transactions(spark: SparkSession, folder: str, customers: int | None = None,
                       devices: int | None = None) -> DataFrame:
    """The event stream as payments; `customers` and `devices` fold ids into fewer, busier entities."""
    events = table(spark, folder, "events")
    user, event = F.col("user_id"), F.col("event_id")
    currency = (F.when(F.col("event_type") == "click", "USD").when(F.col("event_type") == "view", "EUR")
                .when(F.col("event_type") == "purchase", "SGD").when(F.col("event_type") == "signup", "XXX")
                .otherwise("GBP"))
    network = F.when(event % 20 == 0, event % 40 / 20 + 5).otherwise(user % 5 + 1).cast("int")
    return finish(events.select(
        event.cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (user if customers is None else user % customers).cast("string").alias("customer_id"),
        pick(COUNTRIES, user).alias("customer_portfolio_country"),
        F.get_json_object("props", "$.k").alias("receiver_account"),
        F.col("event_type").alias("tpp_name_ud"),
        (F.floor(user / 2) if devices is None else user % devices).cast("string").alias("device_fingerprint"),
        F.concat_ws(".", F.lit("51"), network.cast("string"), (user % 3).cast("string"),
                    (event % 9).cast("string")).alias("ip_address"),
        F.col("value").alias("amount"),
        currency.alias("currency"),
        (F.col("event_type") == "error").cast("int").alias("declined"),
        F.col("event_type").alias("event_kind"),
    ))


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as payments of a customer to a supplier; many share one instant.

    No few columns identify a line, so its whole row does.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return finish(joined.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in lines.columns]).alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        pick(COUNTRIES, F.col("o_custkey")).alias("customer_portfolio_country"),
        F.col("l_suppkey").cast("string").alias("receiver_account"),
        F.col("o_orderpriority").alias("tpp_name_ud"),
        (F.col("l_partkey") % 1000).cast("string").alias("device_fingerprint"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("GBP").alias("currency"),
        (F.col("l_returnflag") == "R").cast("int").alias("declined"),
        F.lit("payment").alias("event_kind"),
    ))


def customer_profiles(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") * 7 % 90).cast("int"))
         .alias("account_open_date"),
        F.lower("c_mktsegment").alias("risk_segment"))


def payee_profiles(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("receiver_account"),
        pick(COUNTRIES, F.col("s_nationkey")).alias("beneficiary_country"),
        (F.col("s_suppkey") % 10 == 0).alias("is_mule_pattern"))


def ip_countries(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return n.filter(F.col("n_nationkey") < 5).select(
        F.concat(F.lit("51."), (F.col("n_nationkey") + 1).cast("string")).alias("ip_prefix"),
        pick(COUNTRIES, F.col("n_nationkey")).alias("country"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the five lists, with the time from which each entry counts."""
    c, s, e = (table(spark, folder, t) for t in ("customer", "supplier", "events"))

    def entries(df: DataFrame, name: str, member: Column) -> DataFrame:
        return df.select(F.lit(name).alias("list_name"), member.cast("string").alias("member"))

    whole = (entries(c.filter(F.col("c_acctbal") > 9000), "vip_customers", F.col("c_custkey"))
             .unionByName(entries(c.filter(F.col("c_acctbal") < -900), "watchlist", F.col("c_custkey")))
             .unionByName(entries(s.filter(F.col("s_acctbal") < -900), "bl_accounts", F.col("s_suppkey")))
             .unionByName(entries(e.filter((F.col("event_type") == "error") & (F.col("value") > 300)),
                                  "bl_devices", F.floor(F.col("user_id") / 2)))
             .unionByName(entries(e.filter(F.col("value") > 250), "proxy_ips",
                                  F.concat(F.lit("51.5."), (F.col("user_id") % 3).cast("string"),
                                           F.lit(".0")))))
    start = F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    days = F.pmod(F.length("member") * 7 + F.length("list_name"), F.lit(30)).cast("long")
    return whole.distinct().withColumn("valid_from", F.timestamp_millis(start + days * 86_400_000))


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a score in [0, 1), an outcome and two model versions' view, for evaluation."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.get_json_object("props", "$.k").alias("receiver_account"),
        F.floor(F.col("user_id") / 2).cast("string").alias("device_fingerprint"),
        (F.pmod(F.round(F.col("value") * 37), F.lit(100)) / 100).alias("score"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 50)).cast("int").alias("label"),
        F.col("value").alias("amount_base"),
        (F.col("event_id") % 5).alias("device_distinct_customers"),
        (F.col("event_id") % 10).cast("int").alias("round"),
        F.concat(F.lit("writer-"), (F.col("user_id") % 7).cast("string")).alias("producer"))

"""SQL views that state the sample transactions a second time, independently of the Spark code."""

from __future__ import annotations

# The base amount: GBP 1, USD .79, EUR .86, SGD .58, BRL .16, anything else unchanged.
RATE = ("CASE upper(currency) WHEN 'GBP' THEN 1.0::DOUBLE WHEN 'USD' THEN 0.79::DOUBLE "
        "WHEN 'EUR' THEN 0.86::DOUBLE WHEN 'SGD' THEN 0.58::DOUBLE WHEN 'BRL' THEN 0.16::DOUBLE "
        "ELSE 1.0::DOUBLE END")


def txn_sql(customers: int | None = None, devices: int | None = None) -> str:
    """`txn` over events."""
    user = "user_id" if customers is None else f"user_id % {customers}"
    device = "user_id // 2" if devices is None else f"user_id % {devices}"
    return f"""
    raw AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts, epoch_us(ts) // 1000 AS ms,
        CAST({user} AS VARCHAR) AS customer_id,
        list_extract(['US','GB','DE','SG','BR'], CAST(user_id % 5 + 1 AS INTEGER)) AS customer_portfolio_country,
        json_extract_string(props, '$.k') AS receiver_account, event_type AS tpp_name_ud,
        CAST({device} AS VARCHAR) AS device_fingerprint,
        '51.' || CASE WHEN event_id % 20 = 0 THEN (event_id % 40) // 20 + 5 ELSE user_id % 5 + 1 END
          || '.' || (user_id % 3) || '.' || (event_id % 9) AS ip_address,
        value AS amount,
        CASE event_type WHEN 'click' THEN 'USD' WHEN 'view' THEN 'EUR' WHEN 'purchase' THEN 'SGD'
          WHEN 'signup' THEN 'XXX' ELSE 'GBP' END AS currency,
        CAST(event_type = 'error' AS INTEGER) AS declined, event_type AS event_kind
      FROM events),
    txn AS MATERIALIZED (SELECT *, coalesce(amount, 0) * {RATE} AS amount_base, ms // 300000 AS tick, ms // 3600000 AS h,
        ms // 86400000 AS d, ms // 604800000 AS w, year(ts) * 12 + month(ts) - 1 AS mon FROM raw)"""


def order_sql() -> str:
    """`txn` over order lines."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    key = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"""
    txn AS MATERIALIZED (SELECT concat_ws('|', {key}, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS transaction_id,
        epoch_us(o_orderdate) // 1000 AS ms, CAST(o_custkey AS VARCHAR) AS customer_id,
        CAST(l_suppkey AS VARCHAR) AS receiver_account, o_orderpriority AS tpp_name_ud,
        list_extract(['US','GB','DE','SG','BR'], CAST(o_custkey % 5 + 1 AS INTEGER)) AS customer_portfolio_country,
        CAST(l_partkey % 1000 AS VARCHAR) AS device_fingerprint,
        l_extendedprice AS amount_base, CAST(l_returnflag = 'R' AS INTEGER) AS declined,
        (epoch_us(o_orderdate) // 1000) // 86400000 AS d, (epoch_us(o_orderdate) // 1000) // 3600000 AS h,
        (epoch_us(o_orderdate) // 1000) // 604800000 AS w, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS mon
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# Reference views, from the same tables.
PROFILES = """
    profiles AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
        DATE '2024-01-01' - CAST(c_custkey * 7 % 90 AS INTEGER) AS account_open_date,
        lower(c_mktsegment) AS risk_segment FROM customer),
    payees AS (SELECT CAST(s_suppkey AS VARCHAR) AS receiver_account,
        list_extract(['US','GB','DE','SG','BR'], CAST(s_nationkey % 5 + 1 AS INTEGER)) AS beneficiary_country,
        s_suppkey % 10 = 0 AS is_mule_pattern FROM supplier),
    networks AS (SELECT '51.' || (n_nationkey + 1) AS ip_prefix,
        list_extract(['US','GB','DE','SG','BR'], CAST(n_nationkey + 1 AS INTEGER)) AS country
      FROM nation WHERE n_nationkey < 5)"""

LISTS = """
    entries AS (
      SELECT 'vip_customers' AS list_name, CAST(c_custkey AS VARCHAR) AS member FROM customer WHERE c_acctbal > 9000
      UNION SELECT 'watchlist', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < -900
      UNION SELECT 'bl_accounts', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < -900
      UNION SELECT 'bl_devices', CAST(user_id // 2 AS VARCHAR) FROM events WHERE event_type = 'error' AND value > 300
      UNION SELECT 'proxy_ips', '51.5.' || (user_id % 3) || '.0' FROM events WHERE value > 250),
    lists AS (SELECT list_name, member, epoch_ms(TIMESTAMP '2024-01-01') +
        ((length(member) * 7 + length(list_name)) % 30) * 86400000 AS from_ms FROM entries)"""

SCORED = """
    ev AS MATERIALIZED (SELECT CAST(event_id AS VARCHAR) AS transaction_id, epoch_us(ts) // 1000 AS ms,
        json_extract_string(props, '$.k') AS receiver_account, CAST(user_id // 2 AS VARCHAR) AS device_fingerprint,
        (CAST(round(value * 37) AS BIGINT) % 100) / 100.0::DOUBLE AS score,
        CAST(event_type = 'purchase' AND value > 50 AS INTEGER) AS label, value AS amount_base,
        event_id % 5 AS device_distinct_customers, CAST(event_id % 10 AS INTEGER) AS round,
        'writer-' || (user_id % 7) AS producer FROM events)"""


def prior(p: str = "p", t: str = "t") -> str:
    """Row p came before row t."""
    return f"({p}.ms < {t}.ms OR ({p}.ms = {t}.ms AND {p}.transaction_id < {t}.transaction_id))"

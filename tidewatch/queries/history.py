"""Point-in-time features. Each SQL text is the plain self-join the Spark plan avoids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.config import Config, MetricDef, WindowDef
from tidewatch.operators import signals
from tidewatch.operators.history import ARRIVAL, attach
from tidewatch.operators.metrics import key_sets, with_metrics
from tidewatch.operators.signals import CUSTOMER, Guards, heavy_keys
from tidewatch.operators.skew import placed
from tidewatch.operators.windows import (replay_decisions, with_idle_count, with_idle_members,
                                         with_recent_count, with_recent_members)
from tidewatch.queries.common import order_sql, prior, txn_sql
from tidewatch.session import pinned
from tidewatch.sources.tables import event_transactions, order_transactions

BUSY = 10    # customers, for signals that need a busy history
SHARED = 4   # devices, likewise


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select("transaction_id", *[
        F.round(F.col(n), digits).alias(n) if dict(df.dtypes)[n] == "double"
        else F.col(n).cast("bigint").alias(n) for n in names])


def metric_query(*metrics: MetricDef, windows=(), orders: bool = False, digits: int = 6):
    config = Config(windows=(*Config().windows, *windows), metrics=metrics)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        txns = order_transactions(spark, folder) if orders else event_transactions(spark, folder)
        return rounded(with_metrics(txns, txns, config, heavy_keys(txns, key_sets(config))), *[m.metric_id for m in metrics],
                       digits=digits)
    return run


def aggregate(name, agg, entity=("customer_id",), window="last_24h", sub=None, field="amount_base"):
    return MetricDef(name, entity, "streaming_aggregate", window, agg=agg, field=field, sub_window_sec=sub)


QUERIES, ORACLE = {}, {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# --- configured metrics --------------------------------------------------------------------------

register("customer_txn_count_1h", metric_query(aggregate("customer_txn_count_1h", "count", sub=3600)), f"""
WITH {txn_sql()}
SELECT t.transaction_id, count(p.ms) AS customer_txn_count_1h
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()}
  AND p.h >= (t.ms - 3600000) // 3600000
GROUP BY 1""")

register("customer_amount_stats_1d", metric_query(
    aggregate("amount_count_1d", "count"), aggregate("amount_sum_1d", "sum"),
    aggregate("amount_mean_1d", "mean"), aggregate("customerid_stddev_sendertransactionamo_1d", "stddev"),
    digits=8), f"""
WITH {txn_sql()}
SELECT t.transaction_id, count(p.ms) AS amount_count_1d, round(coalesce(sum(p.amount_base), 0), 8) AS amount_sum_1d,
  round(avg(p.amount_base), 8) AS amount_mean_1d,
  round(stddev_pop(p.amount_base), 8) AS customerid_stddev_sendertransactionamo_1d
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.h >= t.h - 24
GROUP BY 1""")

register("customer_amount_sum_90m", metric_query(
    aggregate("amount_sum_90m", "sum", sub=5400), aggregate("amount_count_90m", "count", sub=5400)), f"""
WITH {txn_sql()}
SELECT t.transaction_id, round(coalesce(sum(p.amount_base), 0), 6) AS amount_sum_90m,
  count(p.ms) AS amount_count_90m
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()}
  AND p.h >= (t.ms - 5400000) // 3600000
GROUP BY 1""")

register("aged_daily_metrics", metric_query(
    aggregate("aged_count", "count", window="aged_24h_90d"), aggregate("aged_sum", "sum", window="aged_24h_90d"),
    aggregate("aged_mean", "mean", window="aged_24h_90d"), orders=True), f"""
WITH {order_sql()},
daily AS (SELECT customer_id, d, count(*) AS n, sum(amount_base) AS s FROM txn GROUP BY 1, 2),
aged AS (SELECT t.customer_id, t.d, coalesce(sum(b.n), 0) AS n, sum(b.s) AS s
  FROM (SELECT DISTINCT customer_id, d FROM txn) t LEFT JOIN daily b
    ON b.customer_id = t.customer_id AND b.d BETWEEN t.d - 90 AND t.d - 1 GROUP BY 1, 2)
SELECT t.transaction_id, CAST(a.n AS BIGINT) AS aged_count, round(coalesce(a.s, 0), 6) AS aged_sum,
  round(a.s / a.n, 6) AS aged_mean
FROM txn t JOIN aged a ON a.customer_id = t.customer_id AND a.d = t.d""")


def _entity_metrics():
    made = []
    for label, entity in (("payee", ("receiver_account",)), ("device", ("device_fingerprint",)),
                          ("tpp", ("tpp_name_ud",)), ("country", ("customer_portfolio_country",)),
                          ("payee_country", ("receiver_account", "customer_portfolio_country")),
                          ("tpp_country", ("tpp_name_ud", "customer_portfolio_country")),
                          ("pair", ("customer_id", "receiver_account"))):
        made.append((label, entity, aggregate(f"{label}_count_1h", "count", entity, sub=3600)))
    return made


_ENTITY_SQL = ", ".join(
    f"(SELECT count(*) FROM txn p WHERE {' AND '.join(f'p.{c} = t.{c}' for c in entity)} "
    f"AND {prior()} AND p.h >= t.h - 1) AS {label}_count_1h" for label, entity, _ in _entity_metrics())
register("entity_counts_1h", metric_query(*[m for _, _, m in _entity_metrics()]),
         f"WITH {txn_sql()} SELECT t.transaction_id, {_ENTITY_SQL} FROM txn t")


def third_last_payment(spark, folder):
    txns = event_transactions(spark, folder, customers=BUSY)
    third = MetricDef("third_last_1d", ("customer_id",), "positional", "last_24h", position=2, sub_window_sec=86_400)
    out = with_metrics(txns, txns, Config(metrics=(third,)), heavy_keys(txns))
    return out.select("transaction_id", F.unix_millis("third_last_1d").alias("third_last_1d"))


register("third_last_payment", third_last_payment, f"""
WITH {txn_sql(BUSY)},
z AS (SELECT transaction_id, ms, lag(ms, 3) OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS third FROM txn)
SELECT transaction_id, CASE WHEN third >= ms - 86400000 THEN third END AS third_last_1d FROM z""")

register("time_since_last_event", metric_query(
    MetricDef("hours_since_error", ("customer_id",), "time_since_last_event", "last_24h", event_type="error")), f"""
WITH {txn_sql()}
SELECT t.transaction_id, round(((t.ms - max(p.ms)) // 1000) / 3600.0::DOUBLE, 6) AS hours_since_error
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.event_kind = 'error'
GROUP BY t.transaction_id, t.ms""")

# --- pairs and distinct members ------------------------------------------------------------------


def pair_state(spark, folder):
    txns = event_transactions(spark, folder)
    return rounded(signals.with_pair_state(txns, heavy_keys(txns)), "pair_txn_count_90d", "pair_amount_sum",
                   "pair_first_seen_ms", "new_payee")


register("pair_state", pair_state, f"""
WITH {txn_sql()}
SELECT t.transaction_id, count(p.ms) AS pair_txn_count_90d,
  round(coalesce(sum(p.amount_base), 0), 6) AS pair_amount_sum, min(p.ms) AS pair_first_seen_ms,
  CASE WHEN count(p.ms) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new_payee
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND p.receiver_account = t.receiver_account AND {prior()}
GROUP BY 1""")


def order_pair_state(spark, folder):
    txns = order_transactions(spark, folder)
    return rounded(signals.with_pair_state(txns, heavy_keys(txns)), "pair_txn_count_90d", "pair_amount_sum",
                   "pair_first_seen_ms", digits=3)


register("order_pair_state", order_pair_state, f"""
WITH {order_sql()}
SELECT transaction_id, count(*) OVER w AS pair_txn_count_90d,
  round(coalesce(sum(amount_base) OVER w, 0), 3) AS pair_amount_sum, min(ms) OVER w AS pair_first_seen_ms
FROM txn WINDOW w AS (PARTITION BY customer_id, receiver_account ORDER BY ms, transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


def distinct_query(keys, distincts, prepare, **fold):
    def run(spark, folder):
        txns = event_transactions(spark, folder, **fold)
        heavy = heavy_keys(txns)
        return rounded(attach(prepare(txns, heavy), txns, keys, signals.amount_measures()[:1], (), distincts, heavy),
                       *[d.name for d in distincts])
    return run


def members_sql(entity, member, parts, **fold):
    counts = ", ".join(f"count(DISTINCT CASE WHEN {cond} THEN p.{member} END) AS {name}" for name, cond in parts)
    return f"""WITH {txn_sql(**fold)}
SELECT t.transaction_id, {counts}
FROM txn t LEFT JOIN txn p ON p.{entity} = t.{entity} AND {prior()} GROUP BY 1"""


register("payee_distinct_senders", distinct_query(
    signals.PAYEE, (signals.SENDERS_24H, signals.SENDERS_90D), signals.with_pair_state),
    members_sql("receiver_account", "customer_id", (("bene_distinct_senders_24h", "p.h >= t.h - 24"),
                                                    ("bene_distinct_senders_90d", "p.mon >= t.mon - 3"))))
register("customer_distinct_payees", distinct_query(
    signals.CUSTOMER, (signals.PAYEES_24H, signals.PAYEES_90D), signals.with_pair_state),
    members_sql("customer_id", "receiver_account", (("customer_distinct_bene_24h", "p.h >= t.h - 24"),
                                                    ("customer_distinct_bene_90d", "p.mon >= t.mon - 3"))))
register("device_distinct_customers", distinct_query(
    signals.DEVICE, (signals.DEVICE_USERS,), signals.with_device_sightings, devices=SHARED),
    members_sql("device_fingerprint", "customer_id", (("device_distinct_customers", "p.d >= t.d - 95"),),
                devices=SHARED))


def order_distinct_senders(spark, folder):
    # Lines and orders are joined once, and what the counts need is written: the line's text as its id is most of it.
    txns = pinned(order_transactions(spark, folder).select(
        "transaction_id", "ms", "customer_id", "receiver_account", "device_fingerprint", "amount_base"))
    heavy = heavy_keys(txns)
    rows = signals.with_pair_state(placed(txns, signals.PAYEE, heavy), heavy)
    return rounded(attach(rows, txns, signals.PAYEE, signals.amount_measures()[:1], (), (signals.SENDERS_90D,),
                          heavy, local=not heavy.of(signals.PAYEE)), "bene_distinct_senders_90d")


# Months before the current one come from (payee, month) sets, the running month row by row.
register("order_distinct_senders_90d", order_distinct_senders, f"""
WITH {order_sql()},
months AS (SELECT DISTINCT receiver_account, mon, customer_id FROM txn),
older AS (SELECT t.receiver_account, t.mon, b.customer_id FROM (SELECT DISTINCT receiver_account, mon FROM txn) t
  JOIN months b ON b.receiver_account = t.receiver_account AND b.mon BETWEEN t.mon - 3 AND t.mon - 1 GROUP BY 1, 2, 3),
base AS (SELECT receiver_account, mon, count(*) AS n FROM older GROUP BY 1, 2),
firsts AS (SELECT t.transaction_id, t.receiver_account, t.mon, t.ms,
    CASE WHEN o.customer_id IS NULL AND row_number() OVER (PARTITION BY t.receiver_account, t.mon, t.customer_id
      ORDER BY t.ms, t.transaction_id) = 1 THEN 1 ELSE 0 END AS fresh
  FROM txn t LEFT JOIN older o ON o.receiver_account = t.receiver_account AND o.mon = t.mon
    AND o.customer_id = t.customer_id)
SELECT f.transaction_id, CAST(coalesce(b.n, 0) + coalesce(sum(f.fresh) OVER (PARTITION BY f.receiver_account, f.mon
  ORDER BY f.ms, f.transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS bene_distinct_senders_90d
FROM firsts f LEFT JOIN base b ON b.receiver_account = f.receiver_account AND b.mon = f.mon""")

# --- customer signals ----------------------------------------------------------------------------


def customer_signal(*names, fold=None, **guards):
    def run(spark, folder):
        txns = event_transactions(spark, folder, customers=fold)
        out = signals.with_customer_signals(txns, txns, heavy_keys(txns), Guards(**guards), distinct=False)
        return rounded(out, *names)
    return run


register("customer_declines", customer_signal("customer_declines_24h", "customer_declines_90d"), f"""
WITH {txn_sql()}
SELECT t.transaction_id,
  CAST(coalesce(sum(CASE WHEN p.h >= t.h - 24 THEN p.declined END), 0) AS BIGINT) AS customer_declines_24h,
  CAST(coalesce(sum(CASE WHEN p.mon >= t.mon - 3 THEN p.declined END), 0) AS BIGINT) AS customer_declines_90d
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()} GROUP BY 1""")

register("amount_zscore_90d", customer_signal("amount_zscore_90d"), f"""
WITH {txn_sql()},
s AS (SELECT t.transaction_id, t.amount_base AS x, count(p.ms) AS n, avg(p.amount_base) AS m,
    stddev_pop(p.amount_base) AS sd
  FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.mon >= t.mon - 3 GROUP BY 1, 2)
SELECT transaction_id, round(CASE WHEN n >= 5 AND sd > 0 THEN (x - m) / sd ELSE 0 END, 6) AS amount_zscore_90d
FROM s""")

register("txn_rates", customer_signal("customer_txn_rate_5m", "customer_txn_rate_1h", fold=BUSY), f"""
WITH {txn_sql(BUSY)}
SELECT t.transaction_id, count(CASE WHEN p.tick * 300000 >= t.ms - 300000 THEN 1 END) AS customer_txn_rate_5m,
  count(CASE WHEN p.h * 3600000 >= t.ms - 3600000 THEN 1 END) AS customer_txn_rate_1h
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.h >= t.h - 1 GROUP BY 1""")

register("velocity_baseline", customer_signal("velocity_ratio_1h", "velocity_elevated_hours", "hod_share_now",
                                              fold=BUSY), f"""
WITH {txn_sql(BUSY)},
b AS (SELECT t.transaction_id, t.ms, t.h AS now_h, p.h, count(*) AS c
  FROM txn t JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.h * 3600000 >= t.ms - 604800000
  GROUP BY 1, 2, 3, 4),
m AS (SELECT *, count(*) OVER (PARTITION BY transaction_id) AS filled,
    avg(c) OVER (PARTITION BY transaction_id) AS base FROM b),
s AS (SELECT transaction_id, max(filled) AS filled, max(base) AS base,
    coalesce(sum(CASE WHEN h * 3600000 >= ms - 3600000 THEN c END), 0) AS rate,
    count(CASE WHEN h * 3600000 >= ms - 21600000 AND c > 2 * base THEN 1 END) AS high,
    coalesce(sum(CASE WHEN h % 24 = now_h % 24 THEN c END), 0) AS same, sum(c) AS total
  FROM m GROUP BY 1)
SELECT t.transaction_id, round(CASE WHEN filled >= 24 THEN rate / base ELSE 0 END, 6) AS velocity_ratio_1h,
  CAST(CASE WHEN filled >= 24 THEN high ELSE 0 END AS BIGINT) AS velocity_elevated_hours,
  round(CASE WHEN filled >= 24 THEN same / total ELSE 1 END, 6) AS hod_share_now
FROM txn t LEFT JOIN s ON s.transaction_id = t.transaction_id""")

register("amount_trend", customer_signal("amount_trend", trend_weeks=3), f"""
WITH {txn_sql()},
b AS (SELECT t.transaction_id, p.w, avg(p.amount_base) AS y
  FROM txn t JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.w * 604800000 >= t.ms - 56 * 86400000::BIGINT
  GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY w) - 1 AS x FROM b),
s AS (SELECT transaction_id, count(*) AS n, regr_slope(y, x) AS slope, avg(y) AS m FROM o GROUP BY 1)
SELECT t.transaction_id, round(CASE WHEN n >= 3 AND m > 0 THEN slope / m ELSE 0 END, 6) AS amount_trend
FROM txn t LEFT JOIN s ON s.transaction_id = t.transaction_id""")

register("dormancy_days", customer_signal("dormancy_days"), f"""
WITH {txn_sql()}
SELECT t.transaction_id, round(coalesce((t.ms - max(p.ms)) / 86400000.0::DOUBLE, 0), 6) AS dormancy_days
FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND {prior()} GROUP BY t.transaction_id, t.ms""")


def order_trend(spark, folder):
    txns = order_transactions(spark, folder)
    out = signals.with_customer_signals(txns, txns, heavy_keys(txns), Guards(trend_weeks=2), distinct=False)
    return rounded(out, "amount_trend", digits=4)


# Order dates fall on bucket edges, where a week that starts exactly 56 days ago still counts.
register("order_amount_trend", order_trend, f"""
WITH {order_sql()},
b AS (SELECT t.transaction_id, p.w, avg(p.amount_base) AS y
  FROM txn t JOIN txn p ON p.customer_id = t.customer_id AND {prior()} AND p.w * 604800000 >= t.ms - 56 * 86400000::BIGINT
  GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY w) - 1 AS x FROM b),
s AS (SELECT transaction_id, count(*) AS n, regr_slope(y, x) AS slope, avg(y) AS m FROM o GROUP BY 1)
SELECT t.transaction_id, round(CASE WHEN n >= 2 AND m > 0 THEN slope / m ELSE 0 END, 4) AS amount_trend
FROM txn t LEFT JOIN s ON s.transaction_id = t.transaction_id""")


def interarrival_cv(spark, folder):
    txns = event_transactions(spark, folder, customers=BUSY)
    return rounded(signals.with_cadence(txns, heavy=heavy_keys(txns)), "interarrival_cv")


register("interarrival_cv", interarrival_cv, f"""
WITH {txn_sql(BUSY)},
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS gap FROM txn),
s AS (SELECT transaction_id,
    count(*) OVER (PARTITION BY customer_id ORDER BY ms, transaction_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS n,
    avg(gap) OVER w AS m, stddev_pop(gap) OVER w AS sd
  FROM g WINDOW w AS (PARTITION BY customer_id ORDER BY ms, transaction_id ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))
SELECT transaction_id, round(CASE WHEN n >= 5 AND m > 0 THEN sd / m ELSE 999 END, 6) AS interarrival_cv FROM s""")


# --- surges --------------------------------------------------------------------------------------

def surge_sql(entity, name, least, **fold):
    return f"""
WITH {txn_sql(**fold)},
b AS (SELECT t.transaction_id, t.ms, p.tick, count(*) AS c
  FROM txn t JOIN txn p ON p.{entity} = t.{entity} AND {prior()} AND p.tick * 300000 >= t.ms - 21600000
  GROUP BY 1, 2, 3),
s AS (SELECT transaction_id, count(*) AS filled, avg(c) AS m,
    coalesce(sum(CASE WHEN tick * 300000 >= ms - 300000 THEN c END), 0) AS now FROM b GROUP BY 1)
SELECT t.transaction_id, round(CASE WHEN filled >= {least} THEN now / m ELSE 0 END, 6) AS {name}
FROM txn t LEFT JOIN s ON s.transaction_id = t.transaction_id"""


def device_surge(spark, folder):
    txns = event_transactions(spark, folder, devices=SHARED)
    return rounded(signals.with_device_signals(txns, txns, heavy_keys(txns), distinct=False), "device_surge")


def payee_surge(spark, folder):
    txns = event_transactions(spark, folder)
    return rounded(signals.with_payee_signals(txns, txns, heavy_keys(txns), Guards(surge_buckets=2), distinct=False),
                   "bene_surge")


register("device_surge", device_surge, surge_sql("device_fingerprint", "device_surge", 12, devices=SHARED))
register("payee_surge", payee_surge, surge_sql("receiver_account", "bene_surge", 2))

# --- exact windows and idle gaps -----------------------------------------------------------------


def exact_windows(spark, folder):
    txns = event_transactions(spark, folder)
    heavy = heavy_keys(txns)
    rows = with_recent_count(txns, ["customer_id"], 3_600_000, "count_1h", heavy)
    rows = with_recent_members(rows, "receiver_account", "customer_id", 86_400_000, "senders_24h", heavy)
    return rounded(rows, "count_1h", "senders_24h")


register("exact_recent_windows", exact_windows, f"""
WITH {txn_sql()}
SELECT t.transaction_id,
  (SELECT count(*) FROM txn p WHERE p.customer_id = t.customer_id AND {prior()} AND p.ms >= t.ms - 3600000) AS count_1h,
  (SELECT count(DISTINCT p.customer_id) FROM txn p WHERE p.receiver_account = t.receiver_account AND {prior()}
    AND p.ms >= t.ms - 86400000) AS senders_24h
FROM txn t""")


def idle_expiry(spark, folder):
    txns = event_transactions(spark, folder)
    heavy = heavy_keys(txns)
    rows = with_idle_count(txns, ["customer_id"], 86_400_000, "declines_idle_24h", F.col("declined") == 1, heavy)
    rows = with_idle_members(rows, "customer_id", "receiver_account", 28_800_000, "payees_idle_8h", heavy)
    return rounded(rows, "declines_idle_24h", "payees_idle_8h")


register("idle_gap_expiry", idle_expiry, f"""
WITH {txn_sql()},
g AS (SELECT *, lag(ms) OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS last FROM txn),
i AS (SELECT *, sum(CASE WHEN last IS NULL OR ms - last >= 28800000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS stretch FROM g),
dg AS (SELECT *, lag(ms) OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS last_d FROM txn WHERE declined = 1),
di AS (SELECT *, sum(CASE WHEN last_d IS NULL OR ms - last_d >= 86400000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS run FROM dg),
lastd AS (SELECT t.transaction_id, t.customer_id, t.ms, max(p.ms) AS last_at, max(p.run) AS run
  FROM txn t LEFT JOIN di p ON p.customer_id = t.customer_id AND {prior()} GROUP BY 1, 2, 3)
SELECT t.transaction_id,
  CASE WHEN l.last_at IS NULL OR t.ms - l.last_at >= 86400000 THEN 0 ELSE (SELECT count(*) FROM di p
    WHERE p.customer_id = t.customer_id AND p.run = l.run AND {prior()}) END AS declines_idle_24h,
  CASE WHEN t.last IS NULL OR t.ms - t.last >= 28800000 THEN 0 ELSE (SELECT count(DISTINCT p.receiver_account)
    FROM i p WHERE p.customer_id = t.customer_id AND p.stretch = t.stretch AND {prior()}) END AS payees_idle_8h
FROM i t JOIN lastd l ON l.transaction_id = t.transaction_id""")


def closed_loop(spark, folder):
    txns = event_transactions(spark, folder)
    rows = txns.select(*CUSTOMER, *ARRIVAL, (F.pmod(F.round(F.col("amount") * 7), F.lit(100)) / 100).alias("base_score"),
                       F.lit(False).alias("hard_block"), F.lit(False).alias("hard_allow"))
    out = replay_decisions(rows, heavy=heavy_keys(txns))
    return rounded(out, "customer_declines_24h", "customer_declines_90d", "final_score").join(
        out.select("transaction_id", "decision"), "transaction_id")


# Each customer's k-th row in turn, with the hours and months of the declines so far.
register("closed_loop_replay", closed_loop, f"""
WITH RECURSIVE {txn_sql()},
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ms, transaction_id) AS k,
  (CAST(round(amount * 7) AS BIGINT) % 100) / 100.0::DOUBLE AS base FROM txn),
loop AS (
  SELECT transaction_id, customer_id, k, CAST(0 AS BIGINT) AS d24, CAST(0 AS BIGINT) AS d90, base AS final,
    CASE WHEN base >= 0.7 THEN [h] ELSE CAST([] AS BIGINT[]) END AS hours, CASE WHEN base >= 0.7 THEN [mon] ELSE CAST([] AS BIGINT[]) END AS months
  FROM r WHERE k = 1
  UNION ALL
  SELECT transaction_id, customer_id, k, d24, d90, final, CASE WHEN final >= 0.7 THEN list_append(hours, h) ELSE hours END,
    CASE WHEN final >= 0.7 THEN list_append(months, mon) ELSE months END
  FROM (SELECT *, least(1.0::DOUBLE, base + CASE WHEN d90 >= 3 THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN d24 >= 3 THEN 0.45::DOUBLE ELSE 0 END) AS final
    FROM (SELECT r.transaction_id, r.customer_id, r.k, r.base, r.h, r.mon, l.hours, l.months,
        CAST(len(list_filter(l.hours, lambda x: x >= r.h - 24)) AS BIGINT) AS d24,
        CAST(len(list_filter(l.months, lambda x: x >= r.mon - 3)) AS BIGINT) AS d90
      FROM loop l JOIN r ON r.customer_id = l.customer_id AND r.k = l.k + 1)))
SELECT transaction_id, d24 AS customer_declines_24h, d90 AS customer_declines_90d, round(final, 6) AS final_score,
  CASE WHEN final >= 0.7 THEN 'decline' WHEN final >= 0.3 THEN 'review' ELSE 'approve' END AS decision FROM loop""")

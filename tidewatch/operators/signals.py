"""Behavioural signals of customers, payees, devices and pairs, as seen before each transaction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import times
from tidewatch.functions.values import quotient
from tidewatch.operators.history import (ARRIVAL, TICK, Distinct, Feature, Measure, Stored, amount_now, attach,
                                         between, bucket_sum, earlier_in, merged, now, past, zero)
from tidewatch.operators.skew import BORROWED, HeavyKeys, find_heavy, into_lanes, lend, running

CUSTOMER = ("customer_id",)
PAYEE = ("receiver_account",)
DEVICE = ("device_fingerprint",)
PAIR = ("customer_id", "receiver_account")
DEVICE_CUSTOMER = ("device_fingerprint", "customer_id")
KEY_SETS = (CUSTOMER, PAYEE, DEVICE, PAIR, DEVICE_CUSTOMER)

# What a signal shows when there is no history to judge by.
SAFE_DEFAULTS = {
    "customer_declines_24h": 0, "customer_distinct_bene_24h": 0, "customer_declines_90d": 0,
    "customer_distinct_bene_90d": 0, "bene_distinct_senders_90d": 0, "amount_zscore_90d": 0.0,
    "customer_txn_rate_5m": 0, "customer_txn_rate_1h": 0, "velocity_ratio_1h": 0.0,
    "velocity_elevated_hours": 0, "hod_share_now": 1.0, "interarrival_cv": 999.0,
    "amount_trend": 0.0, "dormancy_days": 0.0, "device_surge": 0.0, "bene_surge": 0.0,
}


@dataclass(frozen=True)
class Guards:
    """How much history a signal needs before it speaks. Fixed values as defaults."""

    baseline_hours: int = 24
    surge_buckets: int = 12
    trend_weeks: int = 4
    gap_events: int = 5
    amount_samples: int = 5
    event_memory: int = 64
    elevated_factor: float = 2.0


def heavy_keys(txns: DataFrame, more: Sequence[Sequence[str]] = (), **policy) -> HeavyKeys:
    """Heavy keys of all signal entities and of `more` key sets."""
    return find_heavy(txns, *dict.fromkeys([*KEY_SETS, *map(tuple, more)]), **policy)


def amount() -> Column:
    return F.col("amount_base")


def amount_measures() -> list[Measure]:
    return [Measure("n", "sum", F.lit(1)), Measure("s", "sum", amount()),
            Measure("q", "sum", amount() * amount())]


# --- pairs ---------------------------------------------------------------------------------------

def running_with(rows: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, Column]], columns: dict[str, str],
                 heavy: HeavyKeys, stored: Stored | None) -> DataFrame:
    """Running measures per key; `columns` names the stored column that each goes on from."""
    out = running(into_lanes(rows, keys, ARRIVAL, heavy), keys, ARRIVAL, measures).done()
    if stored is None:
        return out
    old = stored.pairs(keys).select(*keys, *[F.col(c).alias(f"_k_{name}") for name, c in columns.items()])
    joined = out.join(old, list(keys), "left")
    return joined.withColumns({name: merged(fn, F.col(name), F.col(f"_k_{name}")) for name, (fn, _) in measures.items()}) \
                 .drop(*[f"_k_{name}" for name in columns])


def with_pair_state(txns: DataFrame, heavy: HeavyKeys = HeavyKeys(), stored: Stored | None = None) -> DataFrame:
    """First time, count and sum of earlier payments of the same customer to the same payee."""
    out = running_with(txns, PAIR, {
        "pair_txn_count_90d": ("sum", F.lit(1)),
        "pair_amount_sum": ("sum", amount()),
        "pair_first_seen_ms": ("min", F.col("ms")),
        "pair_last_ms": ("max", F.col("ms")),
    }, {"pair_txn_count_90d": "n", "pair_amount_sum": "amount_sum", "pair_first_seen_ms": "first_ms", "pair_last_ms": "last_ms"},
        heavy, stored)
    known = F.col("customer_id").isNotNull() & F.col("receiver_account").isNotNull()
    count = F.when(known, zero(F.col("pair_txn_count_90d"))).otherwise(F.lit(0))
    return (out.withColumns({"pair_txn_count_90d": count,
                             "pair_amount_sum": F.coalesce("pair_amount_sum", F.lit(0.0))})
            .withColumn("new_payee", F.when(F.col("pair_txn_count_90d") == 0, 1.0).otherwise(0.0)))


def with_device_sightings(txns: DataFrame, heavy: HeavyKeys = HeavyKeys(), stored: Stored | None = None) -> DataFrame:
    """Last earlier use of the device by the same customer."""
    return running_with(txns, DEVICE_CUSTOMER, {"device_customer_last_ms": ("max", F.col("ms"))},
                        {"device_customer_last_ms": "last_ms"}, heavy, stored)


# --- arrival order of one customer -----------------------------------------------------------------

def with_cadence(txns: DataFrame, positions: dict[str, tuple[int, int | None]] | None = None,
                 heavy: HeavyKeys = HeavyKeys(), guards: Guards = Guards(), stored: Stored | None = None) -> DataFrame:
    """`interarrival_cv` over the last events, and the time of the n-th last payment per name.

    `positions` maps a name to (position counted from 0, oldest age in seconds or None).
    """
    positions = positions or {}
    memory = max([guards.event_memory, *[p + 1 for p, _ in positions.values()]])
    ms = F.col("ms")
    known = F.col("customer_id").isNotNull()            # rows without a customer are no one's arrivals
    out = {"interarrival_cv": F.when(known & (F.col("_events") >= guards.gap_events) & (F.col("_mean") > 0),
                                     quotient(F.col("_spread"), F.col("_mean")))
           .otherwise(SAFE_DEFAULTS["interarrival_cv"])}
    for name, (_, age) in positions.items():
        at = F.when(known, F.col(f"_at_{name}"))
        out[name] = F.timestamp_millis(at if age is None else F.when(at >= ms - age * 1000, at))

    def gaps(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by, *CUSTOMER).orderBy(*ARRIVAL)
        recent = order.rowsBetween(-(guards.event_memory - 1), -1)
        made = {"_events": F.count("ms").over(order.rowsBetween(-guards.event_memory, -1)),
                "_spread": F.stddev_pop("_gap").over(recent), "_mean": F.avg("_gap").over(recent)}
        made.update({f"_at_{name}": F.lag("ms", position + 1).over(order)
                     for name, (position, _) in positions.items()})
        return (df.withColumn("_gap", ms - F.lag("ms").over(order)).withColumns(made)
                .filter(~F.col(BORROWED)).withColumns(out).drop("_gap", BORROWED, *made))

    lent = lend(into_lanes(txns, CUSTOMER, ARRIVAL, heavy), CUSTOMER, ARRIVAL, memory)
    if stored is not None:
        lent = lent.with_borrowed(stored.arrivals(), CUSTOMER)
    return lent.map(gaps).done()


# --- customers -------------------------------------------------------------------------------------

def _decline_features(keys) -> list[Feature]:
    made = []
    for name, unit, back in (("customer_declines_24h", "hour", 24), ("customer_declines_90d", "month", 3)):
        made.append(Feature(name, zero(F.col(f"_b_{name}")) + amount_now("d"),
                            {f"_b_{name}": bucket_sum(keys, "d", unit, -back, 0)}))
    return made


def _zscore_feature(keys, guards: Guards) -> Feature:
    part = {f"_zs_{m}": bucket_sum(keys, m, "month", -3, 0) for m in ("n", "s", "q")}
    n, s, q = [zero(F.col(f"_zs_{m}")) + amount_now(m) for m in ("n", "s", "q")]
    mean = quotient(s, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), quotient(q, n) - mean * mean))
    row = F.when((n >= guards.amount_samples) & (spread > 0), quotient(amount() - mean, spread)).otherwise(0.0)
    return Feature("amount_zscore_90d", row, part)


def filled_mark(keys, unit: str) -> Column:
    """1 on the first table row with traffic of each bucket of `unit`, else 0."""
    earlier = zero(F.sum("n").over(earlier_in(keys, unit)))
    return F.when((F.col("n") > 0) & (earlier == 0), 1).otherwise(0)


def _velocity_features(keys, guards: Guards) -> list[Feature]:
    """Rates, and the rate against the customer's own last seven days of populated hours."""
    ms = F.col("ms")
    same_hour = (Window.partitionBy(*keys, F.pmod("_hour", F.lit(24))).orderBy("_hour")
                 .rangeBetween(-167, -1))
    bucket = {
        "_vh_mark": filled_mark(keys, "hour"),
        "_vh_now": zero(F.sum("n").over(earlier_in(keys, "hour"))),
        "_v5_prev": bucket_sum(keys, "n", "tick", -1, -1),
        "_vh_sum": bucket_sum(keys, "n", "hour", -167, -1),
        "_vh_edge": bucket_sum(keys, "n", "hour", -168, -168),
        "_vh_hod": zero(F.sum("n").over(same_hour)),
        **{f"_vh_{i}": bucket_sum(keys, "n", "hour", -i, -i) for i in range(1, 7)},
    }
    late = {"_vh_cnt": bucket_sum(keys, "_vh_mark", "hour", -167, -1)}
    # A bucket that starts exactly one window ago still counts, which only a boundary instant can meet.
    hour_edge = times.on_boundary(ms, "hour")
    edge = F.when(hour_edge, zero(F.col("_vh_edge"))).otherwise(0)
    current = zero(F.col("_vh_now")) + amount_now("n")
    total = zero(F.col("_vh_sum")) + edge + current
    populated = zero(F.col("_vh_cnt")) + (edge > 0).cast("int") + (current > 0).cast("int")
    rate_1h = current + F.when(hour_edge, zero(F.col("_vh_1"))).otherwise(0)
    rate_5m = amount_now("n") + F.when(times.on_boundary(ms, "tick"), zero(F.col("_v5_prev"))).otherwise(0)
    baseline = quotient(total, populated)
    speaks = (populated >= guards.baseline_hours) & (total > 0)
    limit = baseline * guards.elevated_factor
    high = (current > limit).cast("int") + (hour_edge & (zero(F.col("_vh_6")) > limit)).cast("int")
    for i in range(1, 6):
        high = high + (zero(F.col(f"_vh_{i}")) > limit).cast("int")
    return [
        Feature("customer_txn_rate_5m", rate_5m, bucket, late, ("_vh_mark",)),
        Feature("customer_txn_rate_1h", rate_1h),
        Feature("velocity_ratio_1h", F.when(speaks, quotient(rate_1h, baseline)).otherwise(0.0)),
        Feature("velocity_elevated_hours", F.when(speaks, high).otherwise(0)),
        Feature("hod_share_now", F.when(speaks, quotient(zero(F.col("_vh_hod")) + edge + current, total))
                .otherwise(SAFE_DEFAULTS["hod_share_now"])),
    ]


def _dormancy_feature(keys) -> Feature:
    last = F.greatest(now("last"), F.col("_last"))
    return Feature("dormancy_days", F.coalesce((F.col("ms") - last) / float(times.DAY_MS), F.lit(0.0)),
                   {"_last": F.max("last").over(past(keys))})


def _trend_feature(keys, guards: Guards) -> Feature:
    """Slope of the weekly average amount over the populated weeks of 56 days, as a share of its mean.

    The table holds the sums of the seven weeks before; the running week joins at the end, and a week
    that starts exactly 56 days ago at the front, which moves every later week up by one.
    """
    weeks = range(7, 0, -1)
    bucket = {f"_wk_{m}{i}": bucket_sum(keys, m, "week", -i, -i) for m in ("n", "s") for i in (8, *weeks)}
    bucket["_wk_n"] = zero(F.sum("n").over(earlier_in(keys, "week")))
    bucket["_wk_s"] = F.coalesce(F.sum("s").over(earlier_in(keys, "week")), F.lit(0.0))

    def mean(i: int) -> Column:
        return F.coalesce(quotient(F.col(f"_wk_s{i}"), F.col(f"_wk_n{i}")), F.lit(0.0))

    def filled(i: int) -> Column:
        return (F.col(f"_wk_n{i}") > 0).cast("int")

    place, sum_y, sum_xy = F.lit(0), F.lit(0.0), F.lit(0.0)
    for i in weeks:
        sum_y = sum_y + mean(i)
        sum_xy = sum_xy + mean(i) * place
        place = place + filled(i)
    late = {"_wk_cnt": place, "_wk_y": sum_y, "_wk_xy": sum_xy, "_wk_first": mean(8), "_wk_edge": filled(8)}

    edge = times.on_boundary(F.col("ms"), "week") & (zero(F.col("_wk_edge")) == 1)
    n_now, s_now = zero(F.col("_wk_n")) + amount_now("n"), zero(F.col("_wk_s")) + amount_now("s")
    y_now = F.coalesce(quotient(s_now, n_now), F.lit(0.0))
    before = zero(F.col("_wk_cnt")) + edge.cast("int")
    old_y = zero(F.col("_wk_y"))
    count = (before + (n_now > 0).cast("int")).cast("double")
    sum_y = old_y + F.when(edge, F.col("_wk_first")).otherwise(0.0) + y_now
    sum_xy = zero(F.col("_wk_xy")) + F.when(edge, old_y).otherwise(0.0) + y_now * before
    sum_x = count * (count - 1) / 2
    sum_xx = count * (count - 1) * (2 * count - 1) / 6
    slope = quotient(count * sum_xy - sum_x * sum_y, count * sum_xx - sum_x * sum_x)
    row = F.when((count >= guards.trend_weeks) & (sum_y > 0), quotient(slope * count, sum_y)).otherwise(0.0)
    return Feature("amount_trend", row, bucket, late,
                   [f"_wk_{m}{i}" for m in ("n", "s") for i in (8, *weeks)])


def customer_measures() -> list[Measure]:
    return [*amount_measures(), Measure("d", "sum", F.col("declined")), Measure("last", "max", F.col("ms"))]


PAYEES_24H = Distinct("customer_distinct_bene_24h", "receiver_account", "hour", 24, "pair_last_ms")
PAYEES_90D = Distinct("customer_distinct_bene_90d", "receiver_account", "month", 3, "pair_last_ms")
SENDERS_24H = Distinct("bene_distinct_senders_24h", "customer_id", "hour", 24, "pair_last_ms")
SENDERS_90D = Distinct("bene_distinct_senders_90d", "customer_id", "month", 3, "pair_last_ms")
DEVICE_USERS = Distinct("device_distinct_customers", "customer_id", "day", 95, "device_customer_last_ms")


def with_customer_signals(rows: DataFrame, source: DataFrame, heavy: HeavyKeys = HeavyKeys(),
                          guards: Guards = Guards(), more: Sequence[Feature] = (),
                          more_measures: Sequence[Measure] = (), distinct: bool = True,
                          stored: Stored | None = None, local: bool = False) -> DataFrame:
    """Declines, amount anomaly and trend, velocity and dormancy; distinct payees need the pair state."""
    features = [*_decline_features(CUSTOMER), _zscore_feature(CUSTOMER, guards),
                *_velocity_features(CUSTOMER, guards), _dormancy_feature(CUSTOMER),
                _trend_feature(CUSTOMER, guards), *more]
    return attach(rows, source, CUSTOMER, [*customer_measures(), *more_measures], features,
                  (PAYEES_24H, PAYEES_90D) if distinct else (), heavy, stored, local)


# --- payees and devices ----------------------------------------------------------------------------

def _surge_feature(name: str, keys, guards: Guards) -> Feature:
    """Count of the running five minutes against the mean filled five minutes of six hours."""
    bucket = {
        "_sg_sum": bucket_sum(keys, "n", "tick", -71, -1),
        "_sg_cnt": zero(F.sum(F.when(F.col("n") > 0, 1)).over(between(keys, "tick", -71, -1))),
        "_sg_edge": bucket_sum(keys, "n", "tick", -72, -72),
        "_sg_prev": bucket_sum(keys, "n", "tick", -1, -1),
    }
    on_edge = times.on_boundary(F.col("ms"), "tick")
    edge = F.when(on_edge, zero(F.col("_sg_edge"))).otherwise(0)
    inside = amount_now("n")
    filled = zero(F.col("_sg_cnt")) + (edge > 0).cast("int") + (inside > 0).cast("int")
    mean = quotient(zero(F.col("_sg_sum")) + edge + inside, filled)
    current = inside + F.when(on_edge, zero(F.col("_sg_prev"))).otherwise(0)
    known = F.col(keys[0]).isNotNull() & (F.trim(F.col(keys[0])) != "")
    row = F.when(known & (filled >= guards.surge_buckets) & (mean > 0), quotient(current, mean)).otherwise(0.0)
    return Feature(name, F.coalesce(row, F.lit(0.0)), bucket)


def with_payee_signals(rows: DataFrame, source: DataFrame, heavy: HeavyKeys = HeavyKeys(),
                       guards: Guards = Guards(), distinct: bool = True, stored: Stored | None = None,
                       local: bool = False) -> DataFrame:
    return attach(rows, source, PAYEE, [Measure("n", "sum", F.lit(1))],
                  [_surge_feature("bene_surge", PAYEE, guards)],
                  (SENDERS_24H, SENDERS_90D) if distinct else (), heavy, stored, local)


def with_device_signals(rows: DataFrame, source: DataFrame, heavy: HeavyKeys = HeavyKeys(),
                        guards: Guards = Guards(), distinct: bool = True, stored: Stored | None = None,
                       local: bool = False) -> DataFrame:
    return attach(rows, source, DEVICE, [Measure("n", "sum", F.lit(1))],
                  [_surge_feature("device_surge", DEVICE, guards)],
                  (DEVICE_USERS,) if distinct else (), heavy, stored, local)


def with_safe_defaults(rows: DataFrame, ok: Column | None = None) -> DataFrame:
    """Fills missing signals; where `ok` is false every signal falls back to its default."""
    made = {}
    for name, value in SAFE_DEFAULTS.items():
        if name in rows.columns:
            default = F.lit(value).cast(rows.schema[name].dataType)
            kept = F.coalesce(F.col(name), default)
            made[name] = kept if ok is None else F.when(F.coalesce(ok, F.lit(False)), kept).otherwise(default)
    return rows.withColumns(made)

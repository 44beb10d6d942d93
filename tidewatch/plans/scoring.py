"""The full plan from transactions to decisions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.config import METRICS, Config, LinearModel
from tidewatch.operators import refjoin
from tidewatch.operators.history import Stored
from tidewatch.operators.metrics import check, entity_parts, positions, with_metrics
from tidewatch.operators.rules import linear_probability, with_decision, with_rules
from tidewatch.operators.signals import (CUSTOMER, DEVICE, PAYEE, SAFE_DEFAULTS, Guards, with_cadence, with_customer_signals,
                                         with_device_sightings, with_device_signals, with_pair_state,
                                         with_payee_signals, with_safe_defaults)
from tidewatch.operators.skew import HeavyKeys, placed

HELPERS = ("pair_amount_sum", "pair_first_seen_ms", "pair_last_ms", "device_customer_last_ms")


@dataclass(frozen=True)
class Reference:
    """`lists` has list_name, member, valid_from; with `dated_lists` an entry counts only after valid_from."""

    customers: DataFrame
    payees: DataFrame
    networks: DataFrame
    lists: DataFrame
    dated_lists: bool = True


def with_history(txns: DataFrame, config: Config = Config(), heavy: HeavyKeys = HeavyKeys(),
                 guards: Guards = Guards(), stored: Stored | None = None) -> DataFrame:
    """All metrics and signals of each transaction, from the transactions before it and from what is `stored`."""
    check(config)
    features, measures, distincts = entity_parts(config, CUSTOMER)
    if distincts:
        raise ValueError("customer distinct counts are signals already")

    def of_customers(rows: DataFrame, heavy: HeavyKeys) -> DataFrame:
        out = with_pair_state(placed(rows, CUSTOMER, heavy), heavy, stored)
        out = with_cadence(with_device_sightings(out, heavy, stored), positions(config), heavy, guards, stored)
        return with_customer_signals(out, rows, heavy, guards, features, [m for m in measures if m.name != "n"], stored=stored,
                                     local=not heavy.of(CUSTOMER))

    # One shuffle of the rows for all that a customer is part of, one for the payee's and one for the device's features;
    # heavy customers go by lanes, on their own.
    if heavy.of(CUSTOMER):
        light, wide = heavy.split(txns, CUSTOMER)
        rows = of_customers(light, heavy.but(CUSTOMER)).unionByName(of_customers(wide, heavy))
    else:
        rows = of_customers(txns, heavy)
    rows = with_payee_signals(placed(rows, PAYEE, heavy), txns, heavy, guards, stored=stored, local=not heavy.of(PAYEE))
    rows = with_device_signals(placed(rows, DEVICE, heavy), txns, heavy, guards, stored=stored, local=not heavy.of(DEVICE))
    # The standard payee and pair metrics are among the signals above.
    extra = further(config)
    if extra.metrics:
        rows = with_metrics(rows, txns, extra, heavy, stored)
    return rows.drop(*HELPERS)


def further(config: Config) -> Config:
    """The configured metrics that no signal covers."""
    return replace(config, metrics=tuple(m for m in config.metrics if m.entity != CUSTOMER and m not in METRICS))


def with_reference(rows: DataFrame, ref: Reference) -> DataFrame:
    """Joins by one key stand together: large reference tables cost one shuffle of the rows for each key, and none for
    the device, by which `with_history` leaves them."""
    def flagged(rows: DataFrame, about: str) -> DataFrame:
        return refjoin.with_list_flags(rows, ref.lists, ref.dated_lists, about)

    rows = flagged(rows, "device_fingerprint")
    rows = flagged(refjoin.with_account_age(rows, ref.customers), "customer_id")
    rows = flagged(refjoin.with_payee_country(rows, ref.payees), "receiver_account")
    rows = flagged(refjoin.with_ip_country(rows, ref.networks), "ip_address")
    return refjoin.with_request_fields(rows)


def prepared(txns: DataFrame, ref: Reference, config: Config = Config(), heavy: HeavyKeys = HeavyKeys(),
             guards: Guards = Guards()) -> DataFrame:
    """Transactions with all that rules and models read."""
    return with_reference(with_history(txns, config, heavy, guards), ref)


def feature_names(config: Config) -> list[str]:
    own = [m.metric_id for m in config.metrics]
    fixed = ["amount_base", "customer_portfolio_country", "beneficiary_country", "local_hour",
             "account_age_days", "ip_country", "ip_proxy", "vip_customer", "watchlist", "bl_account",
             "bl_device", "device_distinct_customers", "new_payee"]
    return list(dict.fromkeys([*own, *fixed, *SAFE_DEFAULTS]))


def degrade(rows: DataFrame, config: Config, feature_ok: Column, signal_ok: Column) -> DataFrame:
    """Drops features that failed to assemble; failed signals take their safe defaults."""
    plain = [c for c in feature_names(config) if c not in SAFE_DEFAULTS and c in rows.columns
             and c != "customer_portfolio_country"]
    ok = F.coalesce(feature_ok, F.lit(False))
    rows = rows.withColumn("signal_degraded", ~F.coalesce(signal_ok, F.lit(False)))
    rows = rows.withColumns({c: F.when(ok, F.col(c)) for c in plain})
    return with_safe_defaults(rows, signal_ok)


class Scorer(Protocol):
    """Any trained model: it has a version and adds a probability column."""

    version: str

    def with_probability(self, rows: DataFrame, name: str) -> DataFrame: ...


def decide(rows: DataFrame, config: Config = Config(), model: LinearModel | Scorer | None = None,
           feature_ok: Column | None = None) -> DataFrame:
    """Rules, then the model's probability where no hard rule fired, then the bands."""
    if model is not None and not isinstance(model, LinearModel):
        rows = model.with_probability(rows, "_probability")
        degraded = None if feature_ok is None else ~F.coalesce(feature_ok, F.lit(False))
        return with_decision(with_rules(rows, config.rules), config.bands, F.col("_probability"), model.version,
                             degraded).drop("_probability")
    probability = linear_probability(model) if model else None
    degraded = None if feature_ok is None else ~F.coalesce(feature_ok, F.lit(False))
    return with_decision(with_rules(rows, config.rules), config.bands, probability,
                         model.version if model else None, degraded)


def score(txns: DataFrame, ref: Reference, config: Config = Config(), model: LinearModel | Scorer | None = None,
          heavy: HeavyKeys = HeavyKeys(), guards: Guards = Guards(), feature_ok: str | None = None,
          signal_ok: str | None = None, ready: DataFrame | None = None) -> DataFrame:
    """Transactions with features, fired rules and decision.

    `feature_ok` and `signal_ok` name boolean columns that say whether a row's inputs could be read. `ready` is what
    `prepared` made of the same arguments, where a caller has it stored.
    """
    rows = prepared(txns, ref, config, heavy, guards) if ready is None else ready
    fine = F.lit(True)
    if feature_ok or signal_ok:
        rows = degrade(rows, config, F.col(feature_ok) if feature_ok else fine,
                       F.col(signal_ok) if signal_ok else fine)
    return decide(rows, config, model, F.col(feature_ok) if feature_ok else None)

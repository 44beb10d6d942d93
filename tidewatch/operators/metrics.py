"""Configured metrics as columns: bucketed aggregates, the n-th last payment, time since an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.config import Config, MetricDef, WindowDef
from tidewatch.functions import times
from tidewatch.functions.values import quotient
from tidewatch.operators.history import (Distinct, Feature, Measure, Stored, amount_now, attach, bucket_sum, now, past,
                                         zero)
from tidewatch.operators.signals import running_with, with_cadence, with_pair_state
from tidewatch.operators.skew import HeavyKeys

ENTITIES = (
    ("customer_id",), ("receiver_account",), ("customer_id", "receiver_account"),
    ("customer_portfolio_country",), ("tpp_name_ud",), ("receiver_account", "customer_portfolio_country"),
    ("tpp_name_ud", "customer_portfolio_country"), ("device_fingerprint",),
)
WIDTH_SEC = {"hour": 3600, "day": 86_400}


def offsets(window: WindowDef, metric: MetricDef) -> tuple[int, int]:
    start = -metric.sub_window_sec if metric.sub_window_sec is not None else window.start_sec
    return start, window.end_sec


def reach(seconds: int, width: int) -> list[int]:
    """Bucket offsets an instant `seconds` away can fall in: one for whole buckets, else two."""
    low = seconds // width
    return [low] if seconds % width == 0 else [low, low + 1]


def aggregate_feature(metric: MetricDef, window: WindowDef) -> Feature:
    """count, sum, mean or stddev over the buckets from floor(now + start) to floor(now + end)."""
    keys, unit = metric.entity, window.unit
    width = WIDTH_SEC[unit]
    start, end = offsets(window, metric)
    ms = F.col("ms")
    bucket: dict[str, Column] = {}
    totals: dict[str, Column] = {}
    measures = {"count": "n", "sum": "ns", "mean": "ns", "stddev": "nsq"}.get(metric.agg)
    if measures is None:
        raise ValueError(f"unknown aggregate {metric.agg!r} in {metric.metric_id}")
    cases = [(low, high) for low in reach(start, width) for high in reach(end, width)]
    here = times.index(ms, unit)
    for m in measures:
        value = None
        for low, high in cases:
            name = f"_{metric.metric_id}_{m}_{-low}_{-high}"
            column = f"{m}_{metric.field}" if m != "n" else m
            bucket[name] = bucket_sum(keys, column, unit, low, high)
            total = zero(F.col(name))
            if high == 0:
                total = total + amount_now(column)
            fits = ((times.index(ms + start * 1000, unit) - here == low)
                    & (times.index(ms + end * 1000, unit) - here == high))
            value = total if len(cases) == 1 else (
                F.when(fits, total) if value is None else value.when(fits, total))
        totals[m] = value
    n = totals["n"]
    if metric.agg == "count":
        row = n.cast("long")
    elif metric.agg == "sum":
        row = totals["s"].cast("double")
    elif metric.agg == "mean":
        row = F.when(n > 0, quotient(totals["s"], n))
    else:
        mean = quotient(totals["s"], n)
        row = F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), quotient(totals["q"], n) - mean * mean)))
    return Feature(metric.metric_id, row, bucket)


def field_measures(fields: Sequence[str]) -> list[Measure]:
    made = [Measure("n", "sum", F.lit(1))]
    for f in dict.fromkeys(fields):
        made += [Measure(f"s_{f}", "sum", F.col(f)), Measure(f"q_{f}", "sum", F.col(f) * F.col(f))]
    return made


def event_feature(metric: MetricDef) -> tuple[Feature, Measure]:
    """Whole seconds since the last event of a type, in hours; null when there was none."""
    name = f"last_{metric.event_type}"
    column = f"_at_{metric.metric_id}"
    last = F.greatest(now(name), F.col(column))
    hours = F.floor((F.col("ms") - last) / 1000.0) / 3600.0
    return (Feature(metric.metric_id, hours, {column: F.max(name).over(past(metric.entity))}),
            Measure(name, "max", F.when(F.col("event_kind") == metric.event_type, F.col("ms"))))


def distinct_spec(metric: MetricDef, window: WindowDef) -> Distinct:
    start, end = offsets(window, metric)
    width = WIDTH_SEC[window.unit]
    if end != 0 or start % width:
        raise ValueError(f"{metric.metric_id}: distinct counts take whole buckets up to now")
    return Distinct(metric.metric_id, metric.field, window.unit, -start // width,
                    f"_seen_{metric.metric_id}")


def entity_parts(config: Config, entity: tuple[str, ...]):
    """Features and measures of all configured aggregates of one entity, to be attached in one pass."""
    own = [m for m in config.metrics if m.entity == entity]
    plain = [m for m in own if m.type == "streaming_aggregate" and m.agg != "distinct_count"]
    features = [aggregate_feature(m, config.window(m.window_id)) for m in plain]
    measures = field_measures([m.field for m in plain if m.agg != "count"]) if plain else []
    for m in own:
        if m.type == "time_since_last_event":
            feature, measure = event_feature(m)
            features.append(feature)
            measures.append(measure)
    distincts = [distinct_spec(m, config.window(m.window_id)) for m in own
                 if m.type == "streaming_aggregate" and m.agg == "distinct_count"]
    return features, measures, distincts


def positions(config: Config) -> dict[str, tuple[int, int | None]]:
    return {m.metric_id: (m.position or 0, m.sub_window_sec) for m in config.metrics
            if m.type == "positional"}


def check(config: Config) -> None:
    for m in config.metrics:
        if m.entity not in ENTITIES:
            raise ValueError(f"unknown entity {m.entity} in {m.metric_id}")
        if m.type not in ("streaming_aggregate", "positional", "time_since_last_event"):
            raise ValueError(f"unknown metric type {m.type!r} in {m.metric_id}")


def key_sets(config: Config) -> list[tuple[str, ...]]:
    """Key sets whose heavy keys matter to the configured metrics."""
    sets = [m.entity for m in config.metrics]
    return [*sets, *[(*m.entity, m.field) for m in config.metrics if m.agg == "distinct_count"]]


def with_metrics(rows: DataFrame, source: DataFrame, config: Config = Config(),
                 heavy: HeavyKeys = HeavyKeys(), stored: Stored | None = None) -> DataFrame:
    """Adds every configured metric. The plain pair count has no expiry and comes from the pair state."""
    check(config)
    out = rows
    if positions(config):
        out = with_cadence(out, positions(config), heavy, stored=stored).drop("interarrival_cv")
    if any(m.metric_id == "pair_txn_count_90d" for m in config.metrics):
        out = with_pair_state(out, heavy, stored).drop("pair_amount_sum", "pair_first_seen_ms", "pair_last_ms")
    for entity in ENTITIES:
        named = Config(config.windows, tuple(m for m in config.metrics
                                             if m.metric_id != "pair_txn_count_90d"), (), config.bands)
        features, measures, distincts = entity_parts(named, entity)
        for d in distincts:
            pair = (*entity, d.member)
            out = running_with(out, pair, {d.previous_ms: ("max", F.col("ms"))}, {d.previous_ms: "last_ms"}, heavy, stored)
        if features or distincts:
            out = attach(out, source, entity, measures or field_measures([]), features, distincts, heavy, stored)
            out = out.drop(*[d.previous_ms for d in distincts])
    return out

"""Bucket arithmetic on epoch milliseconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bucket widths in milliseconds.
TICK_MS = 300_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
WEEK_MS = 604_800_000

TICKS = {"tick": 1, "hour": 12, "day": 288, "week": 2016}
WIDTH_MS = {"tick": TICK_MS, "hour": HOUR_MS, "day": DAY_MS, "week": WEEK_MS}
LABEL_FORMAT = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyyMM"}


def floor_div(value: Column, width: int) -> Column:
    """Quotient rounded down. Doubles are exact enough here: bucket numbers stay far below 2^53 / width."""
    return F.floor(value / F.lit(float(width)))


def index(ms: Column, unit: str) -> Column:
    """Number of the bucket that holds `ms`; weeks count from the epoch, so they start on a Thursday."""
    if unit == "month":
        return month_of_date(F.date_from_unix_date(floor_div(ms, DAY_MS).cast("int")))
    return floor_div(ms, WIDTH_MS[unit])


def month_of_date(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("long")


def index_of_tick(tick: Column, unit: str) -> Column:
    """Coarser bucket number of a five-minute bucket."""
    if unit == "month":
        return month_of_date(F.date_from_unix_date(floor_div(tick, TICKS["day"]).cast("int")))
    return floor_div(tick, TICKS[unit])


def first_tick(bucket: Column, unit: str) -> Column:
    """First five-minute bucket of a coarser bucket."""
    if unit == "month":
        start = F.make_date(F.call_function("div", bucket, F.lit(12)).cast("int"),
                            (F.pmod(bucket, F.lit(12)) + 1).cast("int"), F.lit(1))
        return F.unix_date(start).cast("long") * TICKS["day"]
    return bucket * TICKS[unit]


def on_boundary(ms: Column, unit: str) -> Column:
    return F.pmod(ms, F.lit(WIDTH_MS[unit])) == 0


def label(ts: Column, unit: str) -> Column:
    return F.date_format(ts, LABEL_FORMAT[unit])


def labels_between(start: Column, end: Column, unit: str) -> Column:
    """Every bucket label from the bucket of `start` to the bucket of `end`, both included."""
    step = F.expr(f"interval 1 {unit}")
    starts = F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, end), step)
    return F.when(start <= end, F.transform(starts, lambda t: label(t, unit))) \
            .otherwise(F.array().cast("array<string>"))


def utc_date(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))

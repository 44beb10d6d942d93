"""Scalar expressions on one transaction: currency, network address, age, defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

BASE_CURRENCY = "GBP"
# One unit of each currency in the base currency.
TO_BASE = {"GBP": 1.0, "USD": 0.79, "EUR": 0.86, "SGD": 0.58, "BRL": 0.16}


def to_base(amount: Column, currency: Column, rates: Mapping[str, float] | None = None) -> Column:
    """Amount in the base currency; a missing or unknown currency leaves the amount as it is."""
    table = TO_BASE if rates is None else rates
    pairs = [F.lit(x) for code, rate in table.items() for x in (code.upper(), float(rate))]
    rate = F.element_at(F.create_map(*pairs), F.upper(currency))
    return F.coalesce(amount, F.lit(0.0)) * F.coalesce(rate, F.lit(1.0))


def ip_prefix(ip: Column) -> Column:
    """First two dot-separated parts, null when there are fewer."""
    return F.when(F.size(F.split(ip, r"\.")) >= 2, F.substring_index(ip, ".", 2))


def age_days(opened: Column, ts: Column) -> Column:
    return F.datediff(F.to_date(ts), opened)


def sigmoid(z: Column) -> Column:
    return (F.when(z < -60, 0.0).when(z > 60, 1.0)
            .otherwise(1.0 / (1.0 + F.exp(-z))))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part ÷ whole, or `empty` when whole is not positive."""
    return F.when(whole > 0, quotient(part, whole)).otherwise(F.lit(empty).cast("double"))


def quotient(part: Column, whole: Column) -> Column:
    """part ÷ whole as a double, null when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def json_number(document: Column, name: str) -> Column:
    """A number out of a JSON text; anything missing or not a number counts as 0."""
    return F.coalesce(F.get_json_object(document, f"$.{name}").try_cast("double"), F.lit(0.0))


def starts_with(value: Column, prefix: str) -> Column:
    return F.coalesce(value.startswith(prefix), F.lit(False))

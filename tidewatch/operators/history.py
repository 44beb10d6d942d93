"""Point-in-time features from five-minute bucket tables.

A feature of a row sees only the earlier rows of its entity. It is split in two parts: everything up
to the start of the row's five-minute bucket comes from a pre-aggregated table with one row per
(entity, bucket), and the rest from a running aggregate inside that bucket. Frames therefore run over
buckets, never over raw history, and coarser windows are floored to their own bucket width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidewatch.functions import times
from tidewatch.operators.skew import HeavyKeys, Lanes, into_lanes, running

TICK = "_tick"
COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}
UNITS = ("hour", "day", "week", "month")
ARRIVAL = ("ms", "transaction_id")


@dataclass(frozen=True)
class Measure:
    """A value per row that is combined with sum, min or max."""

    name: str
    fn: str
    value: Column


@dataclass(frozen=True)
class Feature:
    """`bucket` columns are windows over the bucket table; `late` columns are windows over those.

    In `row`, `now(m)` is the running part of measure m and the table's columns appear under their names.
    """

    name: str
    row: Column
    bucket: Mapping[str, Column] = field(default_factory=dict)
    late: Mapping[str, Column] = field(default_factory=dict)
    hidden: Sequence[str] = ()   # bucket columns that only `late` reads


@dataclass(frozen=True)
class Distinct:
    """Distinct `member`s of an entity seen in the last `lookback` units and the running one."""

    name: str
    member: str
    unit: str
    lookback: int
    previous_ms: str   # column with the time of the last earlier row of (entity, member)


class Stored(Protocol):
    """What is kept of the rows before a batch, for the entities that the batch touches."""

    def buckets(self, keys: Sequence[str]) -> DataFrame:
        """Keys, _tick, and the measures and membership changes of each five-minute bucket."""

    def pairs(self, keys: Sequence[str]) -> DataFrame:
        """Keys, n, amount_sum, first_ms, last_ms."""

    def arrivals(self) -> DataFrame:
        """customer_id, ms, transaction_id of every customer's last payments."""


def now(measure: str) -> Column:
    return F.col(f"_p_{measure}")


def amount_now(measure: str) -> Column:
    return F.coalesce(now(measure), F.lit(0))


# --- windows over the bucket table -------------------------------------------------------------

def between(keys: Sequence[str], unit: str, low: int, high: int) -> WindowSpec:
    """Whole buckets of `unit` from `low` to `high` relative to the current one."""
    column = TICK if unit == "tick" else f"_{unit}"
    return Window.partitionBy(*keys).orderBy(column).rangeBetween(low, high)


def earlier_in(keys: Sequence[str], unit: str) -> WindowSpec:
    """Earlier five-minute buckets inside the current bucket of `unit`."""
    return (Window.partitionBy(*keys, f"_{unit}").orderBy(TICK)
            .rowsBetween(Window.unboundedPreceding, -1))


def past(keys: Sequence[str], through: int = -1) -> WindowSpec:
    return (Window.partitionBy(*keys).orderBy(TICK)
            .rowsBetween(Window.unboundedPreceding, through))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def bucket_sum(keys: Sequence[str], measure: str, unit: str, low: int, high: int) -> Column:
    """Sum over buckets low..high of `unit`; a `high` of 0 takes the current one as far as it is known."""
    whole = zero(F.sum(measure).over(between(keys, unit, low, min(high, -1)))) if low < 0 else F.lit(0)
    return whole if high < 0 else whole + zero(F.sum(measure).over(earlier_in(keys, unit)))


# --- the table ---------------------------------------------------------------------------------

def membership_changes(source: DataFrame, entity: Sequence[str], specs: Sequence[Distinct],
                       stored: "Stored | None" = None) -> DataFrame:
    """When members enter (`_a_`) and leave (`_z_`) each distinct window: single steps of (entity, five minutes).

    A member covers its entity from a sighting until `lookback` units after that sighting's unit.
    Overlapping covers are merged by pairing every sighting with the one before it, so the number of
    members at any time is entries so far minus exits so far and no member set is ever collected.
    Stored sightings are taken as made before: they give no steps again, and older ones of `source` give none.
    """
    member = specs[0].member
    finest = "hour" if any(s.unit == "hour" for s in specs) else "day"
    seen = (source.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*entity, member)]))
            .withColumn("_unit", times.index(F.col("ms"), finest))
            .groupBy(*entity, member, "_unit").agg(F.min("ms").alias("_first")))
    if stored is not None:
        old = stored.pairs((*entity, member)).select(
            *entity, member, times.index(F.col("last_ms"), finest).alias("_unit"), F.lit(None).cast("long").alias("_first"))
        seen = seen.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)))
    order = Window.partitionBy(*entity, member).orderBy("_unit")
    seen = seen.withColumn("_prev", F.lag("_unit").over(order if stored is None else Window.partitionBy(
        *entity, member).orderBy("_unit", F.desc("_old"))))
    if stored is not None:
        known = F.max(F.when(F.col("_old"), F.col("_unit"))).over(Window.partitionBy(*entity, member))
        seen = seen.withColumn("_known", known).filter(~F.col("_old") & (F.col("_known").isNull() | (F.col("_unit") > F.col("_known"))))
    seen = seen.withColumn(TICK, times.index(F.col("_first"), "tick"))
    width = times.TICKS[finest]
    steps = []
    for s in specs:
        unit = times.index_of_tick(F.col("_unit") * width, s.unit)
        before = times.index_of_tick(F.col("_prev") * width, s.unit)
        fresh = before.isNull() | (before != unit)
        enters = before.isNull() | (before < unit - s.lookback)
        steps += [
            (fresh & enters, F.col(TICK), s.name, 1, 0),
            (fresh, times.first_tick(unit + s.lookback + 1, s.unit), s.name, 0, -1),
            (fresh & ~enters, times.first_tick(before + s.lookback + 1, s.unit), s.name, 0, 1),
        ]
    made = [F.when(cond, F.struct(
        tick.cast("long").alias(TICK),
        *[F.lit(a if s.name == name else 0).cast("long").alias(f"_a_{s.name}") for s in specs],
        *[F.lit(z if s.name == name else 0).cast("long").alias(f"_z_{s.name}") for s in specs]))
        for cond, tick, name, a, z in steps]
    return seen.select(*entity, F.inline(F.array_compact(F.array(*made))))


def bucket_table(source: DataFrame, keys: Sequence[str], measures: Sequence[Measure],
                 distincts: Sequence[Distinct] = (), stored: "Stored | None" = None) -> DataFrame:
    """One row per (entity, five-minute bucket) with its measures and membership changes."""
    # Values are projected first: partial aggregation then reads plain columns. Rows and steps are summed up in one shuffle.
    table = source.select(*keys, times.index(F.col("ms"), "tick").alias(TICK), *[m.value.alias(m.name) for m in measures])
    for member in sorted({d.member for d in distincts}):
        changes = membership_changes(source, keys, [d for d in distincts if d.member == member], stored)
        table = table.unionByName(changes, allowMissingColumns=True)
    steps = [c for d in distincts for c in (f"_a_{d.name}", f"_z_{d.name}")]
    return table.groupBy(*keys, TICK).agg(*[COMBINE[m.fn](m.name).alias(m.name) for m in measures],
                                          *[F.sum(c).alias(c) for c in steps])


def with_stored(table: DataFrame, keys: Sequence[str], measures: Sequence[Measure], distincts: Sequence[Distinct],
                stored: "Stored") -> DataFrame:
    """Batch buckets and stored buckets as one table; what was stored of a bucket is also in `_k_` columns."""
    steps = [c for d in distincts for c in (f"_a_{d.name}", f"_z_{d.name}")]
    every = {**{m.name: m.fn for m in measures}, **{c: "sum" for c in steps}}
    before = {f"_k_{m.name}": (m.name, m.fn) for m in measures} | {f"_k_in_{d.name}": (f"_a_{d.name}", "sum") for d in distincts}
    old = stored.buckets(keys).select(*keys, TICK, *every, *[F.col(c).alias(name) for name, (c, _) in before.items()])
    return table.unionByName(old, allowMissingColumns=True).groupBy(*keys, TICK).agg(
        *[COMBINE[fn](c).alias(c) for c, fn in every.items()], *[COMBINE[fn](name).alias(name) for name, (_, fn) in before.items()])


def merged(fn: str, a: Column, b: Column) -> Column:
    """Two partial results as one; either may be null."""
    if fn == "sum":
        return F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
    return (F.least if fn == "min" else F.greatest)(a, b)


def enters_now(d: Distinct, keys: Sequence[str]) -> Column:
    """1 when this row brings a new member into the window of its entity."""
    unit = times.index(F.col("ms"), d.unit)
    before = times.index(F.col(d.previous_ms), d.unit)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, d.member)])
    return F.when(known & (before.isNull() | (before < unit - d.lookback)), 1).otherwise(0)


def distinct_feature(d: Distinct, keys: Sequence[str]) -> Feature:
    inside = (zero(F.sum(f"_a_{d.name}").over(past(keys)))
              + zero(F.sum(f"_z_{d.name}").over(past(keys, 0))))
    return Feature(d.name, zero(F.col(f"_b_{d.name}")) + amount_now(f"in_{d.name}"),
                   {f"_b_{d.name}": inside})


def attach(rows: DataFrame, source: DataFrame, keys: Sequence[str], measures: Sequence[Measure],
           features: Sequence[Feature], distincts: Sequence[Distinct] = (),
           heavy: HeavyKeys = HeavyKeys(), stored: "Stored | None" = None, local: bool = False) -> DataFrame:
    """Adds `features` of the entity `keys` to `rows`. `source` is the full history the rows are part of, or, with
    `stored`, what came since then; a stored bucket counts as earlier, as a whole. `local` says that `rows` are placed
    by `keys`: the table is then made and joined where they are, without a shuffle of its own."""
    lanes = into_lanes(rows.withColumn(TICK, times.index(F.col("ms"), "tick")), keys, ARRIVAL, heavy)
    more = (keys, measures, features, distincts, stored)
    if lanes.wide is None:
        return _attached(lanes, source, *more, local)
    light, wide = heavy.split(source, keys)
    return (_attached(Lanes(lanes.light.repartition(*keys)), light, *more, True)
            .unionByName(_attached(Lanes(None, lanes.wide), wide, *more, False)))


def _attached(lanes: Lanes, source: DataFrame, keys: Sequence[str], measures: Sequence[Measure], features: Sequence[Feature],
              distincts: Sequence[Distinct], stored: "Stored | None", local: bool) -> DataFrame:
    table = bucket_table(source.repartition(*keys) if local else source, keys, measures, distincts, stored)
    if stored is not None:
        table = with_stored(table, keys, measures, distincts, stored)
    table = table.withColumns({f"_{u}": times.index_of_tick(F.col(TICK), u) for u in UNITS})
    if not local:       # placed once by entity: every frame below then works on local data
        table = table.repartition(*keys)
    every = [*features, *[distinct_feature(d, keys) for d in distincts]]
    early = {name: column for f in every for name, column in f.bucket.items()}
    late = {name: column for f in every for name, column in f.late.items()}
    hidden = {name for f in every for name in f.hidden}
    table = table.withColumns(early)
    if late:
        table = table.withColumns(late)
    bucket_columns = [c for c in (*early, *late) if c not in hidden]
    before = [] if stored is None else [f"_k_{m.name}" for m in measures] + [f"_k_in_{d.name}" for d in distincts]
    bucket_columns += before
    if distincts and any(m.name == "n" for m in measures):
        table = table.filter(F.col("n").isNotNull())        # buckets in which members only leave are no row's
    table = table.select(*keys, TICK, *bucket_columns)
    if not local:       # as the rows are
        table = table.repartition(*keys, TICK)

    # rows without a key are no entity: they see no bucket and none of one another
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    here = {f"_p_{m.name}": (m.fn, F.when(known, m.value)) for m in measures}
    here.update({f"_p_in_{d.name}": ("sum", enters_now(d, keys)) for d in distincts})
    joined = (running(lanes, [*keys, TICK], ARRIVAL, here).done()
              .join(table, [*keys, TICK], "left"))
    if before:
        joined = joined.withColumns({p: merged(fn, F.col(p), F.col(p.replace("_p_", "_k_", 1))) for p, (fn, _) in here.items()})
    return (joined.withColumns({f.name: f.row for f in every})
            .drop(TICK, *here, *bucket_columns))

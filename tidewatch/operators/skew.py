"""Ordered work over keys of very uneven size.

A window over one key runs in one task. That is right for ordinary keys and fatal for a key that
holds a large share of all rows. Keys found to be heavy are range-partitioned on (key, order), so
that one key spreads over many *lanes*; a lane is computed on its own and receives what came before
it through a carry with at most one row per lane boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import pinned

LANE = "_lane"
BORROWED = "_borrowed"
# Rows of a lane, on average; with more rows there are more lanes than the policy or the session names.
LANE_ROWS = 100_000


@dataclass(frozen=True)
class SkewPolicy:
    """`min_rows`: a key estimated below this is left whole; `sample`: share of rows looked at."""

    min_rows: int = 2_000_000
    sample: float = 0.001
    lanes: int | None = None


def lane_count(df: DataFrame, policy: SkewPolicy) -> int:
    return policy.lanes or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class HeavyKeys:
    """Hashes of the heavy keys of several key sets, and about how many rows they have together. A hash clash only moves
    a light key to the lanes."""

    policy: SkewPolicy = field(default_factory=SkewPolicy)
    hashes: Mapping[tuple[str, ...], tuple[int, ...]] = field(default_factory=dict)
    rows: Mapping[tuple[str, ...], int] = field(default_factory=dict)

    def of(self, keys: Sequence[str]) -> tuple[int, ...]:
        return self.hashes.get(tuple(sorted(keys)), ())

    def but(self, keys: Sequence[str]) -> "HeavyKeys":
        """The same for rows that have no heavy key of one key set."""
        own = tuple(sorted(keys))
        return HeavyKeys(self.policy, {k: v for k, v in self.hashes.items() if k != own}, {k: v for k, v in self.rows.items() if k != own})

    def split(self, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """Rows of light keys, and those of heavy ones."""
        is_heavy = key_hash(keys).isin(*self.of(keys))
        return df.filter(~is_heavy), df.filter(is_heavy)

    def lanes(self, df: DataFrame, keys: Sequence[str]) -> int:
        """The lanes of the policy, or more where each would have more than LANE_ROWS rows."""
        return max(lane_count(df, self.policy), -(-self.rows.get(tuple(sorted(keys)), 0) // LANE_ROWS))


def key_hash(keys: Sequence[str]) -> Column:
    """The same for every order of the key columns."""
    return F.xxhash64(*sorted(keys))


def find_heavy(df: DataFrame, *key_sets: Sequence[str], policy: SkewPolicy | None = None) -> HeavyKeys:
    """One sampled count for all key sets.

    At most `2 x lanes` keys per set can be larger than half a shuffle partition, so no more are kept.
    """
    policy = policy or SkewPolicy()
    least = max(1.0, policy.min_rows * policy.sample)
    most = 2 * lane_count(df, policy)
    rows = df if policy.sample >= 1.0 else df.sample(fraction=policy.sample, seed=7)
    tagged = rows.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("set"), key_hash(keys).alias("hash"))
        for i, keys in enumerate(key_sets)])).alias("k"))
    rank = Window.partitionBy("set").orderBy(F.desc("n"), "hash")
    found = (tagged.groupBy("k.set", "k.hash").agg(F.count("*").alias("n"))
             .filter(F.col("n") >= least)
             .withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= most)
             .select("set", "hash", "n").collect())
    return HeavyKeys(policy, {
        tuple(sorted(keys)): tuple(r["hash"] for r in found if r["set"] == i)
        for i, keys in enumerate(key_sets)}, {
        tuple(sorted(keys)): int(sum(r["n"] for r in found if r["set"] == i) / min(1.0, policy.sample))
        for i, keys in enumerate(key_sets)})


@dataclass(frozen=True)
class Lanes:
    """Rows in two parts: `light` keys are whole, heavy keys (`wide`) are spread over lanes."""

    light: DataFrame | None
    wide: DataFrame | None = None

    def map(self, change: Callable[[DataFrame, list[str]], DataFrame]) -> "Lanes":
        """Applies `change(rows, by)` to both parts; windows partition by `by` and the key."""
        return Lanes(None if self.light is None else change(self.light, []),
                     None if self.wide is None else change(self.wide, [LANE]))

    def with_borrowed(self, earlier: DataFrame, keys: Sequence[str]) -> "Lanes":
        """Puts `earlier` rows (key and order columns) of each key in front of its rows, marked as borrowed."""
        def lent(df: DataFrame, by: list[str]) -> DataFrame:
            rows = earlier.withColumn(BORROWED, F.lit(True))
            if by:                      # the first lane of a heavy key has what was there before
                first = df.groupBy(*keys).agg(F.min(LANE).alias(LANE))
                rows = rows.join(first, list(keys))
            return df.unionByName(rows, allowMissingColumns=True)
        return self.map(lent)

    def done(self) -> DataFrame:
        parts = [p for p in (self.light, None if self.wide is None else self.wide.drop(LANE)) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ranged(df: DataFrame, order: Sequence[str], lanes: int) -> DataFrame:
    """Rows in `lanes` ranges of `order`; written once so that the ranges cannot move between reads."""
    written = pinned(df.repartitionByRange(lanes, *order).withColumn("_range", F.spark_partition_id()))
    return written.withColumn(LANE, F.col("_range") + 1).drop("_range")


def into_lanes(df: DataFrame, keys: Sequence[str], order: Sequence[str], heavy: HeavyKeys) -> Lanes:
    if not heavy.of(keys):
        return Lanes(df)
    # Both parts read the rows: what makes them would run for each, at every step of a chain once more than before.
    light, wide = heavy.split(pinned(df), keys)
    return Lanes(light, ranged(wide, [*keys, *order], heavy.lanes(df, keys)))


def placed(df: DataFrame, keys: Sequence[str], heavy: HeavyKeys) -> DataFrame:
    """Rows shuffled once by `keys` alone, where windows over those and further keys and joins on them then find their
    rows. Heavy keys would be one task each, so such rows stay where they are."""
    return df if heavy.of(keys) else df.repartition(*keys)


def all_lanes(df: DataFrame, order: Sequence[str], policy: SkewPolicy | None = None) -> Lanes:
    """One total order over all rows, for ranks and quantiles."""
    return Lanes(None, ranged(df, order, lane_count(df, policy or SkewPolicy())))


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(lanes: Lanes, keys: Sequence[str], order: Sequence[str],
            measures: Mapping[str, tuple[str, Column]]) -> Lanes:
    """Adds per row the sum, min or max of each measure over the earlier rows of its key.

    Null where there is no earlier row.
    """
    def local(df: DataFrame, by: list[str]) -> DataFrame:
        window = (Window.partitionBy(*by, *keys).orderBy(*order)
                  .rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumns({name: _COMBINE[fn](value).over(window) for name, (fn, value) in measures.items()})

    out = lanes.map(local)
    if lanes.wide is None:
        return out

    before = Window.partitionBy(*keys).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    totals = lanes.wide.groupBy(LANE, *keys).agg(
        *[_COMBINE[fn](value).alias(name) for name, (fn, value) in measures.items()],
        F.count("*").alias("_n"))
    # A range boundary cuts one key, so at most one key per lane has rows in earlier lanes.
    carry = totals.select(
        F.col(LANE).alias("_cl"), *[F.col(k).alias(f"_ck_{k}") for k in keys],
        *[_COMBINE[fn](name).over(before).alias(f"_c_{name}") for name, (fn, _) in measures.items()],
        F.sum("_n").over(before).alias("_cn")).filter(F.col("_cn") > 0)
    match = F.col(LANE) == F.col("_cl")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    joined = out.wide.join(F.broadcast(carry), match, "left")
    merged = {}
    for name, (fn, _) in measures.items():
        here, there = F.col(name), F.col(f"_c_{name}")
        if fn == "sum":
            merged[name] = F.when(here.isNull(), there).otherwise(here + F.coalesce(there, F.lit(0)))
        else:
            merged[name] = (F.least if fn == "min" else F.greatest)(here, there)
    extra = ["_cl", "_cn", *[f"_ck_{k}" for k in keys], *[f"_c_{name}" for name in measures]]
    return Lanes(out.light, joined.withColumns(merged).drop(*extra))


def lend(lanes: Lanes, keys: Sequence[str], order: Sequence[str], k: int) -> Lanes:
    """Puts the last `k` earlier rows of each key in front of every lane, marked as borrowed.

    Frames of at most `k` preceding rows are then right inside one lane; drop borrowed rows after use.
    Borrowed rows carry key and order columns only.
    """
    own = lanes.map(lambda df, by: df.withColumn(BORROWED, F.lit(False)))
    if lanes.wide is None:
        return own
    latest = Window.partitionBy(LANE, *keys).orderBy(*[F.desc(c) for c in order])
    tails = (lanes.wide.select(LANE, *keys, *order).withColumn("_r", F.row_number().over(latest))
             .filter(F.col("_r") <= k).groupBy(LANE, *keys)
             .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_tail")))
    # Every lane of a key holds at least one of its rows, so the k lanes before are enough.
    earlier = Window.partitionBy(*keys).orderBy(LANE).rowsBetween(-k, -1)
    held = F.size("_all")
    lent = (tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(earlier)))
            .filter(held > 0)
            .withColumn("_all", F.slice("_all", -F.greatest(F.least(held, F.lit(k)), F.lit(1)), F.lit(k)))
            .select(LANE, *keys, F.inline("_all")).withColumn(BORROWED, F.lit(True)))
    return Lanes(own.light, own.wide.unionByName(lent, allowMissingColumns=True))

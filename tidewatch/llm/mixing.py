"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996).

A source's documents, in a fixed random order, are cut into blocks of equal size. With weight w, its k-th block (from 0)
is released at floor(k / w) and due at ceil((k + 1) / w); in every slot the released block with the earliest deadline goes
next. No source is then ever a whole block ahead of or behind its weight. Weights are exact fractions, so this holds after
any number of slots. The driver runs through the slots once, with one number for each source, and notes the state every
SEGMENT slots; tasks work out the segments from there, and blocks find their slots by a join.
When a source runs out, the others go on with the same weights relative to each other, as a new phase; no row is dropped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import kept
from tidewatch.llm.text import map_batches, values

#: Bytes of text of a block, documents summed as one step, slots that one task works out (more with many sources).
BLOCK, STEP, SEGMENT = 1 << 20, 4000, 1 << 16


def whole_parts(weights: dict) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights (int, float or Fraction, all above 0)."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * scale) for s, w in exact.items()}
    least = math.gcd(*whole.values()) if whole else 1
    return {s: w // least for s, w in whole.items()}


def release(k: int, part: int, total: int) -> int:
    return k * total // part


def deadline(k: int, part: int, total: int) -> int:
    return -(-(k + 1) * total // part)


def slots(parts: list[int], begun: list[int], slot: int) -> Iterator[int]:
    """Whose block every slot from `slot` on takes: earliest deadline first among released blocks, ties to the first source.

    `begun` has every source's number of blocks so far and is kept up to date.
    """
    total = sum(parts)
    waiting = [(release(k, p, total), i) for i, (k, p) in enumerate(zip(begun, parts))]
    ready: list[tuple[int, int]] = []
    heapq.heapify(waiting)
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(begun[i], parts[i], total), i))
        _, i = heapq.heappop(ready)
        begun[i] += 1
        heapq.heappush(waiting, (release(begun[i], parts[i], total), i))
        yield i
        slot += 1


def phases(blocks: dict[str, int], parts: dict[str, int]) -> list[dict]:
    """For every phase its sources and their parts, the blocks they had before, its first slot, its length, and the number
    of blocks of every source at the start of each segment."""
    left, had, base, out = {s: n for s, n in sorted(blocks.items()) if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        names = list(left)
        own, begun, states, length = [parts[s] for s in names], [0] * len(names), [], 0
        often = max(SEGMENT, 16 * len(names))
        goal = [left[s] for s in names]
        for i in slots(own, begun, 0):
            if length % often == 0:
                states.append([b - (j == i) for j, b in enumerate(begun)])
            length += 1
            if begun[i] == goal[i]:
                break
        out.append({"sources": names, "parts": own, "had": [had[s] for s in names], "base": base, "length": length,
                    "often": often, "states": states})
        for s, b in zip(names, begun):
            had[s] += b
            left[s] -= b
            if not left[s]:
                del left[s]
        base += length
    return out


def planned(spark, plan: list[dict]) -> DataFrame:
    """source, block, slot, release, deadline of every block, worked out segment by segment."""
    segments = [(p, at) for p, phase in enumerate(plan) for at in range(len(phase["states"]))]
    schema = "p_source string, p_block long, slot long, release long, deadline long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for number in values(batch, "id"):
                p, at = segments[number]
                phase = plan[p]
                parts, begun, first = phase["parts"], list(phase["states"][at]), at * phase["often"]
                total, base = sum(parts), phase["base"]
                rows: list[tuple] = []
                for slot, i in enumerate(slots(parts, begun, first), first):
                    k = begun[i] - 1
                    rows.append((phase["sources"][i], phase["had"][i] + k, base + slot, base + release(k, parts[i], total),
                                 base + deadline(k, parts[i], total)))
                    last = slot + 1 >= min(phase["length"], first + phase["often"])
                    if last or len(rows) == 1 << 14:
                        yield dict(zip(("p_source", "p_block", "slot", "release", "deadline"), zip(*rows)))
                        rows = []
                    if last:
                        break

    return map_batches(spark.range(0, len(segments), 1, max(1, len(segments))), work, schema)


def mixed(docs: DataFrame, weights: dict | None = None, smoothing: float = 0.5, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """row (all columns of `docs` as a struct), source, block, place, slot, release, deadline for every row of `docs`.

    Needs doc_id, text and source. Sorted by (slot, place) the rows are in mixed order. A block holds the rows that begin
    within `block` bytes of its source; a longer document fills the blocks after it, whose slots then are empty. Without
    `weights` (numbers above 0, taken exactly), a source weighs its bytes to the power of `smoothing`; a source missing in
    `weights` weighs as little as the least of them. A null source is the empty one. A null or empty text counts as one
    byte. The order in a source is by a hash of doc_id and text; equal rows are copies and keep their own places. An empty
    table gives an empty one. Hot sources are summed in steps, so none is one task. The driver holds a few numbers for
    each source and does one step for each block.
    """
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(1)), F.lit(1)).cast("long")
    steps = max(1, -(-docs.count() // STEP))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("source"), size.alias("size"),
                       F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = rows.withColumn("step", F.pmod("h", F.lit(steps)))
    sums = rows.groupBy("source", "step").agg(F.sum("size").alias("bytes"))
    totals = {r.source: r.bytes for r in sums.groupBy("source").agg(F.sum("bytes").alias("bytes")).collect()}    # a row for each source
    known = {s: float(b) ** smoothing for s, b in totals.items()} if weights is None else \
        {s: weights.get(s, min(weights.values())) for s in totals}
    table = kept(planned(spark, phases({s: -(-b // block) for s, b in totals.items()}, whole_parts(known))), "slots")
    before = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(F.col("source").alias("b_source"), F.col("step").alias("b_step"),
                        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begun"))
    rows = rows.join(begun, (F.col("source") == F.col("b_source")) & (F.col("step") == F.col("b_step")))
    own = Window.partitionBy("source", "step").orderBy("h", "size")
    at = F.col("begun") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("place", at).withColumn("block", F.floor(F.col("place") / block))
    rows = rows.join(table, (F.col("source") == F.col("p_source")) & (F.col("block") == F.col("p_block")))
    return rows.select("row", "source", "block", "place", "slot", "release", "deadline")


def in_order(mixed_rows: DataFrame) -> DataFrame:
    """The rows that mixed() got, with their columns, written in mixed order file after file and row after row."""
    count = int(mixed_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed_rows.select("slot", "place", "row").repartitionByRange(count, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")

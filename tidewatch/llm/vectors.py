"""Whole-number vectors: reading them from a column, and streaming a set of queries past blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import map_batches

#: Candidates of one group: what a task holds, 32 MB at 64 components. Fewer candidates are dealt over the cores.
GROUP, LEAST = 1 << 16, 1 << 10


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    good = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def whole(column: str, scale: int) -> Column:
    """The components as floor(scale * x)."""
    return F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows; a shorter vector is followed by zeros."""
    flat = np.asarray(column.flatten(), np.int64)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < np.asarray(pc.list_value_length(column))[:, None]] = flat
    return out


def past_groups(queries: DataFrame, candidates: DataFrame, search: Callable[[Iterator], Iterator[dict]], schema: str) -> DataFrame:
    """What `search` yields for every group of candidates and all queries.

    Candidates are dealt over groups of at most about GROUP rows by hash; queries, which must be few beside them, are
    sent to every group. In a group the candidates come first and the queries stream past what was built from them, so a
    task holds one group and one batch. Each table has vec_id and v, and may have a number `label`; queries may have a
    column `more`. `search` gets an iterator of (batch of candidates or None, batch of queries or None, first of its
    group), with the columns grp, kind, vec_id, label, v, more.
    """
    spark = candidates.sparkSession
    count = candidates.count()
    groups = max(1, -(-count // GROUP), min(spark.sparkContext.defaultParallelism, -(-count // LEAST)))
    more = queries.schema["more"].dataType.simpleString() if "more" in queries.columns else "int"

    def side(df: DataFrame, group: Column, kind: int) -> DataFrame:
        label = F.col("label").cast("long") if "label" in df.columns else F.lit(0).cast("long")
        extra = F.col("more") if kind and "more" in df.columns else F.lit(None).cast(more)
        return df.select(group.alias("grp"), F.lit(kind).alias("kind"), "vec_id", label.alias("label"), "v", extra.alias("more"))

    given = side(candidates, F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int"), 0)
    asked = side(queries, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), 1)
    both = given.unionByName(asked).repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "kind", "vec_id")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for batch in batches:
            group = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for low, high in zip(edges[:-1], edges[1:]):
                if high > low:
                    own, kind = divmod(int(group[low]), 2)
                    part = batch.slice(low, high - low)
                    yield (part, None, own != last) if kind == 0 else (None, part, own != last)
                    last = own

    return map_batches(both, lambda batches: search(parts(batches)), schema)

"""Exact top-k search by inner product: sorted lists per component, read without random access (Fagin et al., 2001).

Candidates are dealt over groups, and queries stream past each group, whose lists are sorted once. A query reads the lists
side by side from the top, depth by depth: what was read of a candidate gives a lower bound (the rest at its list's least
value) and an upper bound (the rest at the value last read). A candidate whose upper bound is below the k-th lower bound
goes. Reading stops when the few left cost less than the next depth; only their unread components are then multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import values
from tidewatch.llm.vectors import matrix, past_groups

#: Parts of the lists that are read before the bounds are looked at.
DEPTHS = (0.6, 0.85, 1.0)
#: Candidates whose bounds are worked out at once.
CHUNK = 1024


def whole_components(vectors: DataFrame, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the rows whose vector has finite components only."""
    good = F.col(column).isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))


class SortedLists:
    """The candidates of a group by every component, from the least value up; `read` counts the components read."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.read = ids, rows, 0
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)        # a list for every component
        self.sorted = np.take_along_axis(np.ascontiguousarray(rows.T), self.order, axis=1)
        self.place = np.empty(self.order.shape, np.uint16 if len(rows) < 1 << 16 else np.int64)
        np.put_along_axis(self.place, self.order, np.arange(len(rows)).astype(self.place.dtype)[None, :], axis=1)
        self.most = int(np.abs(rows).max(initial=0))
        # doubles are exact for whole numbers below 2^53, and faster
        self.doubles = self.sorted.astype(np.float64)
        self.room = [np.empty((rows.shape[1], CHUNK), kind) for kind in (np.int64, np.float64)]     # for all queries

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but `own`, ties to the smaller id."""
        count, dims, up = len(self.ids), len(query), query >= 0
        left = np.flatnonzero(self.ids != own)
        if not len(left) or not dims:
            best = left[np.argsort(self.ids[left], kind="stable")][:k]
            return self.ids[best], np.zeros(len(best), np.int64)
        exact = self.most * int(np.abs(query).sum()) < 1 << 53
        lists = self.doubles if exact else self.sorted
        query_ = query.astype(lists.dtype)
        known, done, place = np.zeros(count, lists.dtype), 0, self.place[:, left]
        worst = np.where(up, lists[:, 0], lists[:, -1]) * query_
        ends = [max(1, int(count * depth)) for depth in DEPTHS]
        for end, next_end in zip(ends, [*ends[1:], count]):
            for d in range(dims if end > done else 0):
                part = slice(count - end, count - done) if up[d] else slice(done, end)
                known[self.order[d, part]] += lists[d, part] * query_[d]        # a list has every candidate once
            self.read += (end - done) * dims
            done = end
            edge = np.where(up, lists[:, count - done], lists[:, done - 1]) * query_        # the value last read
            # below the depth: not yet read in lists that are read from the top, read in the others
            below = place < np.where(up, count - done, done).astype(self.place.dtype)[:, None]
            ends_ = np.stack([worst, edge])
            sums = np.empty((2, len(left)), lists.dtype)
            for at in range(0, len(left), CHUNK):               # in pieces that stay in the processor's cache
                piece = self.room[exact][:, :min(CHUNK, len(left) - at)]
                np.copyto(piece, below[:, at:at + CHUNK])
                np.matmul(np.where(up, ends_, -ends_), piece, out=sums[:, at:at + CHUNK])
            low, high = known[left] + ends_[:, ~up].sum(axis=1)[:, None] + sums
            if len(left) > k:
                stay = high >= np.partition(low, len(left) - k)[len(left) - k]
                left = left[stay]
                place = self.place[:, left]
            if len(left) * (count - done) <= (next_end - done) * count:
                break
        unread = ((self.place[:, left] < np.where(up, count - done, done).astype(self.place.dtype)[:, None]) == up[:, None]).T
        final = known[left].astype(np.int64) + (self.rows[left] * unread) @ query
        self.read += int(unread.sum())
        best = np.lexsort([self.ids[left], -final])[:k]
        return self.ids[left][best], final[best]


def _lists(parts: list) -> dict[int, SortedLists]:
    """Sorted lists for every number of components among the candidates of a group."""
    out: dict[int, list] = {}
    for part in parts:
        ids, sizes = np.asarray(part.column(2), np.int64), part.column(4).value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dims)
            out.setdefault(dims, []).append((ids[own], matrix(part.column(4).take(own), dims)))
    return {dims: SortedLists(*(np.concatenate(side) for side in zip(*found))) for dims, found in out.items()}


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of every query with the other rows.

    Both tables have vec_id and v array<long>, neither null; other columns are ignored. A query never meets a row of its own
    id. Ties go to the smaller vec_id; repeated rows of one id are candidates each and queries once. Vectors meet vectors of
    as many components. Fewer than k candidates are returned all; empty tables give an empty result. Sums must fit 64 bits.
    """
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))

    def search(parts: Iterator[tuple]) -> Iterator[dict]:
        lists, waiting = None, []
        for given, query_rows, first in parts:
            if first:
                lists, waiting = None, []
            if given is not None:
                waiting.append(given)
                continue
            if lists is None:
                lists, waiting = _lists(waiting), []
            out: dict = {"query_id": [], "vec_id": [], "score": []}
            for own, query in zip(values(query_rows, "vec_id"), values(query_rows, "v")):
                if len(query) in lists:
                    ids, scores = lists[len(query)].top(np.array(query, np.int64), own, k)
                    out["query_id"].extend([own] * len(ids))
                    out["vec_id"].extend(ids)
                    out["score"].extend(scores)
            yield out

    found = past_groups(asked, candidates.select("vec_id", "v"), search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")   # k rows for each group of candidates
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

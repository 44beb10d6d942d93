"""Hard negatives by BOND, a branch-and-bound scan of vertically stored vectors (de Vries et al., 2002).

Candidates are kept column by column. An anchor reads the columns in falling order of its own magnitudes and adds each
one's part of the score for the candidates that its bitmap still holds. What unread columns can add lies between their
least and greatest values times the anchor's; with that, a candidate that cannot reach the result leaves the bitmap, and
later columns are read for the others only. Positives are a top-k search, negatives one search for all score windows of
an anchor. Groups of candidates are searched apart, and their few best rows are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import kept
from tidewatch.llm.text import values
from tidewatch.llm.vectors import finite, matrix, past_groups, whole

#: Columns read between two looks at the bounds.
STEP = 8


class Columns:
    """The candidates of one group: ids, labels and a column for every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(rows.T)
        self.least = self.columns.min(axis=1, initial=np.iinfo(np.int64).max)
        self.most = self.columns.max(axis=1, initial=np.iinfo(np.int64).min)
        self.read = 0                                   # components read so far

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of candidates of `bitmap`, among them the k best of every window [low, high].

        A window's end may be None for no end. Ties stay in.
        """
        alive = np.flatnonzero(bitmap)
        part = np.zeros(len(alive), np.int64)
        if not len(alive):
            return alive, part
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([self.least[order], self.most[order]]) * anchor[order]
        floor, ceil = ends.min(axis=0), ends.max(axis=0)
        left_low, left_high = int(floor.sum()), int(ceil.sum())
        for at in range(0, len(order), STEP):
            dims = order[at:at + STEP]
            all_of = len(alive) == self.columns.shape[1]
            for d in dims:
                part += (self.columns[d] if all_of else self.columns[d][alive]) * anchor[d]
            self.read += len(dims) * len(alive)
            left_low -= int(floor[at:at + STEP].sum())
            left_high -= int(ceil[at:at + STEP].sum())
            low, high = part + left_low, part + left_high
            stay = np.zeros(len(alive), bool)
            for start, end in windows:
                may, sure = np.ones(len(alive), bool), np.ones(len(alive), bool)
                if start is not None:
                    may &= high >= start
                    sure &= low >= start
                if end is not None:
                    may &= low <= end
                    sure &= high <= end
                known = low[sure]
                if len(known) > k:
                    may &= high >= np.partition(known, len(known) - k)[len(known) - k]
                stay |= may
            alive, part = alive[stay], part[stay]
            if not len(alive):
                break
        return alive, part

    def best(self, places: np.ndarray, scores: np.ndarray, window: tuple[int | None, int | None], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best in a window, ties to the smaller id."""
        inside = np.ones(len(places), bool)
        if window[0] is not None:
            inside &= scores >= window[0]
        if window[1] is not None:
            inside &= scores <= window[1]
        ids, scores = self.ids[places[inside]], scores[inside]
        first = np.lexsort([ids, -scores])[:k]
        return ids[first], scores[first]


def _block(parts: list) -> Columns:
    """The candidates of a group from its batches; a vector shorter than the longest is followed by zeros."""
    dims = max((int(part.column(4).value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for part in parts), default=0)
    ids, labels = (np.concatenate([np.zeros(0, np.int64), *[np.asarray(part.column(at), np.int64) for part in parts]]) for at in (2, 3))
    return Columns(ids, labels, np.concatenate([np.zeros((0, dims), np.int64), *[matrix(part.column(4), dims) for part in parts]]))


def _asked(parts: Iterator[tuple]) -> Iterator[tuple]:
    """(columns, id, label, vector, more) for every anchor that streams past a group."""
    block, waiting = None, []
    for given, asked, first in parts:
        if first:
            block, waiting = None, []
        if given is not None:
            waiting.append(given)
            continue
        if block is None:
            block, waiting = _block(waiting), []
        dims = len(block.columns)
        for own, label, vector, more in zip(*(values(asked, n) for n in ("vec_id", "label", "v", "more"))):
            yield block, own, label, np.array([*vector[:dims], *[0] * (dims - len(vector))], np.int64), more


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    `vectors` has vec_id, label and v array<long>, none null; `anchors` says which rows ask. An anchor's positives are its
    best `positives` other rows of the same label by integer inner product. For each of them the best `negatives` rows of
    another label follow whose score is at least `low` and at most `high` percent of the positive's. Ties go to the
    smaller vec_id; what there is less of is returned whole, an anchor without a positive or negative gives no row. Rows
    that repeat an id are candidates each, never of their own id; as anchor the least of them asks. Components that a
    shorter vector lacks count as zero. Empty tables give an empty result. Scores must fit 64 bits.
    """
    asking = vectors.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v")

    def near(parts: Iterator[tuple]) -> Iterator[dict]:
        for block, own, label, anchor, _ in _asked(parts):
            whole_line = (None, None)
            places, scores = block.scan(anchor, (block.labels == label) & (block.ids != own), [whole_line], positives)
            ids, scores = block.best(places, scores, whole_line, positives)
            yield {"anchor_id": [own] * len(ids), "positive_id": ids, "positive_score": scores}

    found = past_groups(asking.withColumn("more", F.array().cast("array<bigint>")), vectors, near,
                        "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")    # few rows for each group
    found = found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives)
    found = kept(found, "positives")

    def hard(parts: Iterator[tuple]) -> Iterator[dict]:
        for block, own, label, anchor, scores_of in _asked(parts):
            windows = [(-(-low * s // 100), high * s // 100) for s in scores_of]
            places, scores = block.scan(anchor, (block.labels != label) & (block.ids != own), windows, negatives)
            for score, window in zip(scores_of, windows):
                ids, best = block.best(places, scores, window, negatives)
                yield {"anchor_id": [own] * len(ids), "positive_score": [score] * len(ids), "negative_id": ids, "negative_score": best}

    asked = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("more")).join(asking, "vec_id")
    missed = past_groups(asked, vectors, hard, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    missed = missed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.join(missed, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def labelled_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (components as floor(scale * x)) of the rows that have an id, a label and a finite vector."""
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole("embedding", scale).alias("v"))

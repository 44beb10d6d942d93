"""Benchmark decontamination: word pairs of test items seed the join, local alignment scores the copies.

Items are cut into pieces of bounded length. A text's keys are its pairs of words that stand side by side or have one word
between them. Alignments (Smith and Waterman, 1981) replace, drop and add words at a cost of one point each, and an equal
word brings two: so one that scores `threshold` or more of a piece of n words has n * threshold - 1 neighbouring equal words
with one edit between them at most, all of them common keys. Windows that share fewer keys with a piece are left out, the
others are aligned with it. Keys that are frequent in the corpus needn't be joined as long as they are fewer than that
number; it falls by each. The result is that of aligning every piece with every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import kept
from tidewatch.llm.text import LETTER_WORDS, map_batches, mixed, values, word_columns

#: Items of fewer words are left out.
GRAM = 3
#: Words of a piece; longer items are cut at half that distance.
PIECE = 64
#: Alignment: points for an equal word, a replaced word, a dropped or added word.
MATCH, REPLACE, GAP = 2, -1, -1
#: Share of the points of a verbatim copy from which a document counts as contaminated.
THRESHOLD = 0.5
#: Odd factor of a pair's first word.
FIRST = np.uint64(0xD6E8FEB86659FD93)
#: Bits that tell which pairs may be keys: 512 KB whatever the number of items.
BITS = 1 << 22
#: Bits that tell which windows are aligned: 4 MB whatever the number of documents.
WINDOW_BITS = 1 << 25
#: Alignments made at a time.
LOT = 256


def _pieces(benchmark: DataFrame) -> DataFrame:
    """item_id, piece (id), words of every piece of an item with at least GRAM words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"item_id": [], "part": [], "words": []}
            items = values(batch, "item_id")
            for first, ids, bounds in word_columns(batch.column(1), LETTER_WORDS):
                for k in range(len(bounds) - 1):
                    own = ids[bounds[k]:bounds[k + 1]].astype(np.int64)
                    for part, start in enumerate(range(0, max(1, len(own) - PIECE // 2), PIECE // 2)):
                        if len(own) >= GRAM:
                            out["item_id"].append(items[first + k])
                            out["part"].append(part)
                            out["words"].append(own[start:start + PIECE])
            yield out

    cut_items = map_batches(benchmark.select(F.col("item_id").cast("long"), "text"), cut, "item_id long, part int, words array<bigint>")
    return cut_items.distinct().withColumn("piece", F.xxhash64("item_id", "part", "words"))


def _pairs(ids: np.ndarray, gap: int) -> np.ndarray:
    """The id of every pair of words `gap` places apart, in order of the first; the same two words have one id for any gap."""
    return mixed(ids[:-gap] * FIRST + ids[gap:]) if len(ids) > gap else np.empty(0, np.uint64)


def _keys(pieces: DataFrame) -> DataFrame:
    """piece, gram, weight: the keys of every piece and the number of places that hold one."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"piece": [], "gram": [], "weight": []}
            for piece, words in zip(values(batch, "piece"), values(batch, "words")):
                own = np.array(words, np.int64).astype(np.uint64)
                found, weight = np.unique(np.concatenate([_pairs(own, 1), _pairs(own, 2)]), return_counts=True)
                out["piece"].extend([piece] * len(found))
                out["gram"].extend(found.astype(np.int64).tolist())
                out["weight"].extend(weight.tolist())
            yield out

    return map_batches(pieces.select("piece", "words"), make, "piece long, gram long, weight long")


def _bits(grams: DataFrame, size: int = BITS) -> np.ndarray:
    bit = F.pmod(F.col("gram"), F.lit(size)) + 1
    rows = grams.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()            # a row of 4 KB for 32,768 bits
    out = np.zeros(size // 8, np.uint8)
    for row in rows:
        out[(row["at"] - 1) * 4096:row["at"] * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _marked(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (found & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _marked_pairs(column: pa.Array, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of word_columns() with the pairs that may be keys: their ids, documents (of the slice) and first words."""
    for first, ids, bounds in word_columns(column, LETTER_WORDS):
        gram, place, doc = [], [], []
        for gap in (1, 2):
            every = _pairs(ids, gap)
            at = np.flatnonzero(_marked(every, bits))
            own = np.searchsorted(bounds, at, "right") - 1
            inside = at + gap < bounds[own + 1]
            gram.append(every[at[inside]])
            place.append(at[inside])
            doc.append(own[inside])
        yield first, ids, bounds, np.concatenate(gram), np.concatenate(doc), np.concatenate(place)


def _seeds(docs: DataFrame, pieces: DataFrame, threshold: float) -> DataFrame:
    """gram, piece, weight, need: the keys to join, and the places of them that a window must hold.

    The most frequent keys of a piece that make up half of what an alignment needs are left out, and need is less by them.
    """
    keys = kept(_keys(pieces), "keys")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [np.empty(0, np.uint64), *[x[3] for x in _marked_pairs(batch.column(0), bits.value)]]
            gram, number = np.unique(np.concatenate(found), return_counts=True)
            yield {"gram": gram.astype(np.int64), "number": number}

    places = map_batches(docs.select("text"), count, "gram long, number long").groupBy("gram").agg(F.sum("number").alias("number"))
    known = keys.join(places, "gram").join(pieces.select("piece", F.size("words").alias("size")).distinct(), "piece")
    own = Window.partitionBy("piece").orderBy(F.desc("number"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * threshold - 1 - 1e-9))         # a piece has 2 * PIECE keys at most
    ranked = known.withColumn("need", need).withColumn("upto", F.sum("weight").over(own))
    out = F.col("upto") <= F.floor(F.col("need") / 2)
    left = F.col("need") - F.sum(F.when(out, F.col("weight")).otherwise(0)).over(Window.partitionBy("piece"))
    return ranked.withColumn("out", out).withColumn("need", left).where(~F.col("out")).select("gram", "piece", "weight", "need")


def align(pieces: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of every piece with its region, and where in the region it ends.

    Both are matrices of word ids, filled up with 0 (pieces) and 1 (regions). Linear gaps let a row of the table be
    finished by a running maximum.
    """
    lots, length = regions.shape
    fall = -GAP * np.arange(length + 1, dtype=np.int32)
    row = np.zeros((lots, length + 1), np.int32)
    best, end = np.zeros(lots, np.int32), np.zeros(lots, np.int64)
    for k in range(pieces.shape[1]):
        word = pieces[:, k:k + 1]
        step = np.where(regions == word, MATCH, REPLACE).astype(np.int32)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + step, row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + fall, axis=1) - fall
        new[word[:, 0] == 0] = 0                        # past the piece's end
        top = new.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], new[better].argmax(axis=1)
        row = new
    return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, end_word of every document and item whose best alignment reaches `threshold`.

    score is the alignment's share of a verbatim copy's points; of an item in pieces the best piece counts. Words are
    runs of ASCII digits, letters (A-Z lowered) and signs beyond ASCII. Null, empty and short texts (below GRAM words)
    are in no row, on either side. Documents that share an id count as one, and a null id is one id; of repeated rows the
    best counts, ties go to the earlier place. Empty tables give an empty result; further columns are ignored. Nothing is
    missed as long as a piece's words times `threshold` are more than 1. Texts are read whole, in overlapping windows.
    """
    pieces = kept(_pieces(benchmark), "pieces")
    seeds = kept(_seeds(docs, pieces, threshold), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(seeds))
    # an alignment has no more equal words than the piece, and fewer errors than pay for them: some window holds it whole
    step = max(1, math.ceil(PIECE * (3 - 2 * threshold)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"doc_id": [], "start": [], "gram": [], "print": []}
            ids_ = batch.column(0)
            for first, ids, bounds, gram, doc, place in _marked_pairs(batch.column(1), bits.value):
                base = bounds[doc]
                part = (place - base) // step
                # a pair stands in the window that starts with its part and in the one before
                both = np.concatenate([np.stack([doc, part]), np.stack([doc, part - 1])[:, part > 0]], axis=1)
                grams = np.concatenate([gram, gram[part > 0]])
                order = np.lexsort((grams, both[1], both[0]))
                both, grams = both[:, order], grams[order]
                fresh = np.append(True, (both[:, 1:] != both[:, :-1]).any(axis=0) | (grams[1:] != grams[:-1])) if len(grams) else []
                both, grams = both[:, fresh], grams[fresh]
                start = both[1] * step
                sums = np.append(np.uint64(0), np.cumsum(ids, dtype=np.uint64))
                low = bounds[both[0]] + start
                high = np.minimum(bounds[both[0] + 1], low + 2 * step)
                out["doc_id"].append(ids_.take(pa.array(first + both[0])))
                out["start"].append(start)
                out["gram"].append(grams.astype(np.int64))
                out["print"].append((sums[high] - sums[low]).astype(np.int64))
            if out["start"]:
                yield {"doc_id": pa.concat_arrays(out["doc_id"]), **{k: np.concatenate(out[k]) for k in ("start", "gram", "print")}}

    # windows of rows that share an id are told apart by the sum of their words' ids
    place = F.struct("doc_id", "start", "print")
    met = map_batches(docs, hits, "doc_id long, start long, gram long, print long").join(seeds, "gram")
    met = met.groupBy("piece", "doc_id", "start", "print").agg(F.sum("weight").alias("weight"), F.first("need").alias("need"))
    asked = kept(met.where(F.col("weight") >= F.col("need")).select("piece", F.xxhash64(place).alias("place"), "print"), "asked")
    wanted = docs.sparkSession.sparkContext.broadcast(_bits(asked.select(F.col("print").alias("gram")), WINDOW_BITS))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            names = values(batch, "doc_id")
            for first, ids, bounds in word_columns(batch.column(1), LETTER_WORDS):
                number = -(-np.diff(bounds) // step)
                doc = np.repeat(np.arange(len(number)), number)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * step
                sums = np.append(np.uint64(0), np.cumsum(ids, dtype=np.uint64))
                low = bounds[doc] + start
                high = np.minimum(bounds[doc + 1], low + 2 * step)
                prints = sums[high] - sums[low]
                at = np.flatnonzero(_marked(prints, wanted.value))
                yield {"doc_id": [names[first + k] for k in doc[at].tolist()], "start": start[at], "print": prints[at].astype(np.int64),
                       "region": [ids[i:j].astype(np.int64) for i, j in zip(low[at].tolist(), high[at].tolist())]}

    cut = map_batches(docs, windows, "doc_id long, start long, print long, region array<bigint>")
    pairs = cut.withColumn("place", F.xxhash64(place)).join(asked.select("piece", "place"), "place")
    pairs = pairs.join(pieces.select("piece", "item_id", "words"), "piece").select("doc_id", "item_id", "start", "region", "words")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            region, words = (batch.column(k) for k in (3, 4))
            for low in range(0, len(batch), LOT):
                r = [np.asarray(x.values) for x in region[low:low + LOT]]
                w = [np.asarray(x.values) for x in words[low:low + LOT]]
                left, right = np.zeros((len(w), max(map(len, w))), np.int64), np.ones((len(r), max(map(len, r))), np.int64)
                for k, (x, y) in enumerate(zip(w, r)):
                    left[k, :len(x)], right[k, :len(y)] = x, y
                best, end = align(left, right)
                share = best / (MATCH * np.array([len(x) for x in w]))
                yield {"doc_id": batch.column(0)[low:low + LOT], "item_id": batch.column(1)[low:low + LOT], "score": share,
                       "end_word": np.array(batch.column(2)[low:low + LOT]) + end}

    scored = map_batches(pairs, score, "doc_id long, item_id long, score double, end_word long").where(F.col("score") >= threshold)
    top = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "end_word")).alias("t"))
    return top.select("doc_id", "item_id", (-F.col("t.s")).alias("score"), "t.end_word")

"""Quality classifier: supervised subword embeddings (Joulin et al., 2016).

A text is the mean of learned vectors of its word and character n-grams, both hashed; a softmax over
that mean gives the probability of each class. Vectors and softmax are learned together by plain stochastic gradient
descent in numpy, from a sample of the labelled texts whose size is a parameter. Features of the sample and scores of all
texts are worked out where the rows are; one task learns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import map_batches, mixed, values

#: Hashed vectors, their length, and the lengths of the character n-grams, blanks around a word included.
SLOTS, DIMS, GRAMS = 1 << 16, 10, (2, 3, 4)
#: Labelled texts that are learned from, at most, taken by hash of their id; steps of learning; size of the first step.
SAMPLE, STEPS, RATE = 4000, 12_000, 20.0
SEED = 13
#: Code points handled at a time. A longer text is cut at blanks, a longer word where the slice ends.
SLICE = 1 << 18
_BLANK, _ODD, _AGAIN = np.uint32(32), np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, pieces of text) of about SLICE code points; only texts beyond that are cut."""
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = len(text)
            if end - at > SLICE:
                blank = text.rfind(" ", at + 1, at + SLICE)
                end = blank if blank > 0 else at + SLICE
            rows.append(row)
            pieces.append(text[at:end])
            size, at = size + end - at, end
            if size >= SLICE:
                yield rows, pieces
                rows, pieces, size = [], [], 0
            if at >= len(text):
                break
    if rows:
        yield rows, pieces


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of every feature of the texts, slice by slice.

    Words stand between code points up to the blank; case and signs are kept. An n-gram of characters lies in a word and
    the blanks around it; an n-gram of words is two neighbours, and one vector stands for any word that follows itself.
    """
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    for rows, pieces in _slices(texts):
        signs = np.frombuffer((" ".join(pieces) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = np.concatenate([[_BLANK], np.maximum(signs, _BLANK)])
        owner = np.repeat(rows, [len(p) + 1 for p in pieces])
        owner = np.append(owner[:1], owner)
        full, wide = signs != _BLANK, signs.astype(np.uint64)
        key, inside = wide, np.ones(len(signs), bool)
        for n in range(2, max(GRAMS) + 1):              # key: the n code points from each place on
            count = len(signs) - n + 1
            if count <= 0:
                break
            key = key[:count] * _ODD + wide[n - 1:]
            inside = inside[:count] & full[n - 2:n - 2 + count] if n > 2 else inside[:count]
            if n in GRAMS:
                at = np.flatnonzero(inside & (full[:count] | full[n - 1:]))
                yield owner[at + 1], (mixed(key[at] + np.uint64(n)) >> shift).astype(np.int64)
        first, last = np.flatnonzero(full[1:] & ~full[:-1]) + 1, np.flatnonzero(full[:-1] & ~full[1:]) + 1
        if len(first):
            place = np.arange(len(signs)) - np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(signs)]])))
            sums = np.append(np.uint64(0), np.cumsum(mixed((place.astype(np.uint64) << np.uint64(32)) + wide), dtype=np.uint64))
            word, own = mixed(sums[last] - sums[first]), owner[first]
            yield own, (word >> shift).astype(np.int64)
            pair = np.where(word[1:] == word[:-1], _AGAIN, word[:-1] * _ODD + word[1:])
            same = own[1:] == own[:-1]
            yield own[1:][same], (mixed(pair[same]) >> shift).astype(np.int64)


@dataclass
class QualityModel:
    """A vector for every slot, and the softmax over a text's mean vector."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def pulls(self) -> np.ndarray:
        """By how much a feature speaks for class 1: its part of the difference of the two logits."""
        return self.vectors.astype(np.float64) @ (self.output[1] - self.output[0])


def learn(examples: list[tuple[int, np.ndarray, np.ndarray]], steps: int, rate: float, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent over (class, slots, counts), one text a step, in a new order every round.

    Whole rounds are made, at least `steps` steps in all, whose size shrinks to nothing in a straight line. Without
    examples both classes are equally likely.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (SLOTS, DIMS)).astype(np.float32)
    output, bias = np.zeros((2, DIMS)), np.zeros(2)
    rounds = -(-steps // len(examples)) if examples else 0
    step, steps = 0, max(1, rounds * len(examples))
    for _ in range(rounds):
        for k in rng.permutation(len(examples)):
            label, slots, counts = examples[k]
            now = rate * (1 - step / steps)
            step += 1
            share = (counts / counts.sum()).astype(np.float32) if len(slots) else counts.astype(np.float32)
            own = vectors[slots]
            mean = (share @ own).astype(np.float64)
            logits = output @ mean + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            vectors[slots] = own - np.outer(share, (now * (error @ output))).astype(np.float32)
            output -= 0.05 * now * np.outer(error, mean)
            bias -= 0.005 * now * error
    return QualityModel(vectors, output, bias)


def _counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text by text its distinct slots and how often each occurs."""
    for text in texts:
        every = [slots for _, slots in features([text])]
        yield np.unique(np.concatenate(every) if every else np.zeros(0, np.int64), return_counts=True)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS, rate: float = RATE) -> QualityModel:
    """A model learned from `sample` labels (doc_id, quality) at most and the whole texts that belong to them.

    Labels other than 0 and 1 and labels or texts without an id are left out; of rows of `docs` (doc_id, text) that repeat
    an id, one is learned from. The sample takes the smallest hashes of doc_id, so it does not depend on partitions. What
    reaches the one learning task is at most SLOTS counts for each sampled label.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")          # `sample` ids
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = list(_counted(values(batch, "text")))
            yield {"doc_id": batch.column(0).cast(pa.int64()), "label": batch.column(1), "slots": [s.astype("<u4").tobytes() for s, _ in found],
                   "counts": [c.astype("<u4").tobytes() for _, c in found]}

    def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(values(batch, name) for name in ("doc_id", "label", "slots", "counts")))
        rows.sort(key=lambda row: row[:2])
        model = learn([(label, np.frombuffer(slots, "<u4"), np.frombuffer(counts, "<u4")) for _, label, slots, counts in rows], steps, rate)
        yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (model.vectors, model.output, model.bias)],
                                         names=["vectors", "output", "bias"])

    counted = map_batches(texts, count, "doc_id long, label int, slots binary, counts binary")
    rows = counted.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "vectors binary, output binary, bias binary").collect()      # one row of 2.6 MB
    if not rows:
        return learn([], steps, rate)
    return QualityModel(np.frombuffer(rows[0].vectors, np.float32).reshape(SLOTS, DIMS), np.frombuffer(rows[0].output).reshape(2, DIMS),
                        np.frombuffer(rows[0].bias))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of `docs` (doc_id, text; nothing else is read), from whole texts.

    score is the probability of class 1, predicted is 1 from `threshold` on. A null or empty text has no feature: its
    score is that of the softmax alone, 0.5 if nothing was learned. Repeated rows and null ids keep their rows; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.pulls(), float(model.bias[1] - model.bias[0])))     # 512 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pulls, base = shared.value
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for rows, slots in features(values(batch, "text")):
                total += np.bincount(rows, pulls[slots], batch.num_rows)
                count += np.bincount(rows, minlength=batch.num_rows)
            chance = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + base, -500, 500)))
            yield {"doc_id": batch.column(0), "score": chance, "predicted": (chance >= threshold).astype(int)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")

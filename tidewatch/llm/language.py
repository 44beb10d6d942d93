"""Language identification of mixed documents: n-gram likelihoods, expectation-maximisation, penalised language sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import map_batches, mixed, release, slices, values

#: Hashed letter trigrams of the model, trigrams of one window, and code points handled at a time.
SLOTS, WINDOW, PIECE = 1 << 15, 32, 1 << 20
CHUNK = 1 << 12
#: Added to every count; price of one more language in units of the logarithm of the number of windows.
SMOOTH, PRICE = 0.05, 4.0
ROUNDS = 30
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case form of every letter, a blank for every other code point."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Slots of the letter trigrams of a whole text, piece by piece; runs of other signs count as one blank."""
    last = np.array([32], np.uint32)
    for start in range(0, len(text), PIECE):
        signs = _letters()[np.frombuffer(text[start:start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        signs = np.concatenate([last, signs] + ([np.array([32], np.uint32)] if start + PIECE >= len(text) else []))
        signs = signs[np.append(True, (signs[1:] != 32) | (signs[:-1] != 32))]
        if len(signs) >= 3:
            wide = signs.astype(np.uint64)
            yield (mixed(wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42)) >> np.uint64(49)).astype(np.int32)
        last = signs[-2:]


@dataclass
class LanguageModel:
    """Log-likelihood of every trigram slot (rows) in every language (columns)."""

    languages: list[str]
    table: np.ndarray


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from training; one without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame) -> LanguageModel:
    """Trigram counts of all texts of `docs` (text, lang) that have both, added up by Spark. Rows are not sampled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            for text, lang in zip(values(batch, "text"), values(batch, "lang")):
                total = totals.setdefault(lang, np.zeros(SLOTS, np.int64))
                for slots in trigrams(text):
                    total += np.bincount(slots, minlength=SLOTS)
        for lang, total in totals.items():
            for chunk in range(SLOTS // CHUNK):
                part = total[chunk * CHUNK:(chunk + 1) * CHUNK]
                slots = np.flatnonzero(part)
                if len(slots):
                    yield {"lang": [lang], "chunk": [chunk], "slots": [slots.astype("<u2").tobytes()], "counts": [part[slots].astype("<i8").tobytes()]}

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for part in parts:
            for slots, counts in zip(values(part, "slots"), values(part, "counts")):
                total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["lang", "chunk", "total"])

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    parts = map_batches(known, count, "lang string, chunk int, slots binary, counts binary")
    counts: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "chunk").applyInArrow(add, "lang string, chunk int, total binary").collect():  # 8 rows a language
        counts.setdefault(row.lang, np.zeros(SLOTS))[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.total, np.int64)
    languages = sorted(counts)
    table = np.array([np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * SLOTS)) for x in languages], np.float32)
    return LanguageModel(languages, np.ascontiguousarray(table.T) if languages else np.zeros((SLOTS, 0), np.float32))


def windows(text: str, model: LanguageModel) -> tuple[np.ndarray, int]:
    """Log-likelihood of every window of trigrams in every language, and the number of trigrams."""
    parts, count = [], 0
    for slots in trigrams(text):
        parts.append(np.add.reduceat(model.table[slots], np.arange(0, len(slots), WINDOW), axis=0).astype(np.float64))
        count += len(slots)
    return (np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))), count


def fit(likelihood: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages by expectation-maximisation, and the log-likelihood they reach."""
    own = likelihood[:, chosen]
    top = own.max(axis=1, keepdims=True)
    own = np.exp(own - top)
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(ROUNDS):
        joint = own * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < 1e-6
        share = new
        if done:
            break
    return share, float((np.log((own * share).sum(axis=1)) + top[:, 0]).sum())


def mixture(likelihood: np.ndarray) -> dict[int, float]:
    """The language set of greatest penalised likelihood, grown one language at a time, with its proportions.

    A window's mixture is never likelier than its best language. Where that bound cannot pay for a second language,
    none is tried; this changes no result.
    """
    sums = likelihood.sum(axis=0)
    best = int(np.argmax(sums))
    price = PRICE * np.log(max(2, len(likelihood)))
    if likelihood.max(axis=1).sum() - sums[best] <= price:
        return {best: 1.0}
    chosen, share, reached = [best], np.ones(1), float(sums[best])
    while len(chosen) < likelihood.shape[1]:
        tries = [(fit(likelihood, [*chosen, k]), k) for k in range(likelihood.shape[1]) if k not in chosen]
        (new, value), k = max(tries, key=lambda t: (t[0][1], -t[1]))
        if value - reached <= price:
            break
        chosen, share, reached = [*chosen, k], new, value
    return dict(zip(chosen, share.tolist()))


def judge(text: str | None, model: LanguageModel) -> tuple[str, float, str, float]:
    """(language, score, all languages with their shares, mean log-likelihood gain over chance per trigram)."""
    if not text or not model.languages:
        return UNKNOWN, 0.0, "", 0.0
    likelihood, count = windows(text, model)
    if not count:
        return UNKNOWN, 0.0, "", 0.0
    found = mixture(likelihood)
    best = max(found, key=lambda k: (found[k], -k))
    sums = likelihood.sum(axis=0)
    sure = 1 / np.exp(np.clip(sums - sums[best], None, 50)).sum() if len(found) == 1 else 1.0
    named = ",".join(f"{model.languages[k]}:{found[k]:.3f}" for k in sorted(found, key=lambda k: (-found[k], k)))
    gain = float(likelihood.max(axis=1).sum() / count + np.log(SLOTS))
    return model.languages[best], float(min(1.0, found[best] * sure)), named, gain


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, languages, gain of every row of `docs` (doc_id, text; nothing else is read).

    `und` with score 0 for a null text, one without a letter, or when nothing was learned. Equal likelihoods go to the
    first language by name. gain is how much likelier than chance a trigram is; it is at most 0 for text that no
    learned language explains. Repeated rows and null ids keep their rows; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 128 KB for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [judge(t, shared.value) for t in values(batch, "text")]
            columns = list(zip(*found)) or [[], [], [], []]
            yield {"doc_id": values(batch, "doc_id"), **dict(zip(("lang_pred", "score", "languages", "gain"), columns))}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, languages string, gain double")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs`, all columns, whose text some learned language explains better than chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in (part for whole in batches for part in slices(whole)):
                found = [judge(t, shared.value) for t in values(batch, "text")]
                yield batch.filter(pa.array([lang != UNKNOWN and gain > 0 for lang, _, _, gain in found], pa.bool_()))
        finally:
            release()

    return docs.mapInArrow(run, docs.schema)

"""Word and run ids of raw text, computed over whole Arrow columns at a time; shared by the operators on text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes handled at a time. A longer text is cut at blanks, so memory does not follow its length.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Odd factors of the words of a run, by place.
_PLACE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, SLICE), _powers(pow(_BASE, -1, 1 << 64), SLICE)


def _codes(inside: Callable[[int], bool]) -> np.ndarray:
    """A code for every byte: 0 for what separates words, else the byte with A-Z lowered; NUL takes A's free place."""
    table = np.array([b if inside(b) else 0 for b in range(256)], np.uint8)
    table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1]
    if inside(0):
        table[0] = ord("A")
    return table


#: Words between the six ASCII blanks, and words of digits, letters and everything beyond ASCII.
BLANK_WORDS = _codes(lambda b: b != 0x20 and not 9 <= b <= 13)
LETTER_WORDS = _codes(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(0x7FB5D329728EA185)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x81DADEF4BC2DD44D)
    values ^= values >> np.uint64(33)
    return values


def _hashed(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a slice; no word goes over a cut."""
    full = codes != 0
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = cuts[(cuts > 0) & (cuts < len(codes))]
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = (_UP, _DOWN) if len(codes) <= SLICE else (_powers(_BASE, len(codes)), _powers(pow(_BASE, -1, 1 << 64), len(codes)))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between words."""
    at = 0
    while len(codes) - at > SLICE:
        gaps = np.flatnonzero(codes[at:at + SLICE] == 0)
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:                                   # one word longer than a slice stays whole
            rest = np.flatnonzero(codes[at + SLICE:] == 0)
            end = at + SLICE + int(rest[0]) + 1 if len(rest) else len(codes)
        yield codes[at:end]
        at = end
    yield codes[at:]


def word_columns(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word ids, bounds) for slices of a string column; row k of a slice has ids[bounds[k]:bounds[k + 1]].

    A null text has no words.
    """
    column = pc.fill_null(column.cast(pa.binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        codes = table[data[offsets[row]:offsets[end]]]
        if end == row + 1:
            ids = [_hashed(piece, np.empty(0, np.int64))[0] for piece in _pieces(codes)]
            ids = np.concatenate(ids)
            yield row, ids, np.array([0, len(ids)])
        else:
            cuts = offsets[row:end + 1] - offsets[row]
            ids, starts = _hashed(codes, cuts)
            yield row, ids, np.searchsorted(starts, cuts)
        row = end


def words_of(text: bytes | str | None, table: np.ndarray = BLANK_WORDS) -> np.ndarray:
    """The word ids of one text."""
    column = pa.array([text.encode() if isinstance(text, str) else text], pa.binary())
    return next(word_columns(column, table))[1]


def runs(ids: np.ndarray, width: int) -> np.ndarray:
    """The id of every run of `width` words, in order of place; empty if there are fewer words."""
    count = len(ids) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    value = np.full(count, width, np.uint64)
    for k in range(width):
        value += ids[k:k + count] * _PLACE[k]
    return mixed(value)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Row by row the distinct run ids of a text, sorted; a shorter text's word sequence is one; without words, none."""
    for _, ids, bounds in word_columns(column, BLANK_WORDS):
        every = runs(ids, width)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= width:
                found = np.sort(every[low:high - width + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            else:
                yield runs(ids[low:high], high - low) if high > low else np.empty(0, np.uint64)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: What a worker process keeps from task to task, by name, with how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns. A worker that is reused drops all it has kept but `keeps`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            for columns in run(batches):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kind], schema=kind)
        finally:
            release()

    return df.mapInArrow(call, schema)


def drop_kept(keeps: str | None) -> None:
    for name in [n for n in KEPT if n != keeps]:
        KEPT.pop(name)()


def release() -> None:
    """Give memory that a task no longer needs back to the system; its worker process lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # where the C library has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what is made of it at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

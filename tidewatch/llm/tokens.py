"""Token-ID output: raw id payloads in shards, with a minimal perfect hash index from document key to offset.

A shard is two files. `shard-N.ids` holds the ids of its documents one after the other, little-endian, two bytes each
when the vocabulary allows it, else four. `shard-N.idx` holds, as length-prefixed arrays: a header, the level sizes and
bits of the perfect hash, by slot the fingerprint, the document number and the number of copies of a key; then the
offsets and keys in document order. The manifest, a Parquet table, has one row per shard.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import mph
from tidewatch.llm.text import KEPT, map_batches, raw, slices, values
from tidewatch.session import scratch

MAGIC = 0x54574944
#: Bytes of text for one shard, on average.
SHARD_BYTES = 48 << 20
#: Encoded words that a worker keeps, twice, some 40 MB each time; longer words are never kept. Both change speed only.
#: They stay while its tasks write tokens, and go with the first task of another kind.
CACHE_WORDS, CACHE_BYTES, ENCODER = 250_000, 48, "encoder"
#: Bytes of text whose new words are encoded in one call.
TOGETHER = 1 << 19
#: A full stop or comma after an ASCII letter or digit, or a letter of U+00C0 to U+00FF, that ends a word; a blank before it
#: changes no id, since signs never join letters.
WORD_END = re.compile(rb"([.,])(?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))(?=[ \n])")
#: Bytes read at a time when a shard is read back.
READ_BYTES = 8 << 20
MANIFEST = "shard int, path string, docs long, tokens long, first_key long, last_key long, id_bytes int"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def lowered(text: bytes, low: bytes) -> list[bytes]:
    """The words of a text that is not all ASCII, with ASCII letters lowered where that is sure to be what the tokenizer does.

    A letter may join the mark that follows it before it is lowered or after, with another outcome. Where neither form of
    the whole text has anything to join, its words are those of `low`; else words of ASCII alone are lowered.
    """
    if unicodedata.is_normalized("NFC", text.decode()) and unicodedata.is_normalized("NFC", low.decode()):
        return WORD_END.sub(rb" \1", low).split()
    return [w.lower() if w.isascii() else w for w in WORD_END.sub(rb" \1", text).split()]


class Encoder:
    """Ids of whole texts, word by word where that gives the same ids.

    `by_blank` states that the tokenizer drops white space and never joins over it, as word-end vocabularies do: then
    the ids of a text are those of its blank-separated words, and repeated words are encoded once. A text that holds the
    string of an added token, in any case, is encoded whole.
    """

    made: dict[tuple, "Encoder"] = {}

    def __init__(self, path: str, by_blank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        added = self.tool.get_added_tokens_decoder()
        self.added = [t.content.encode().lower() for t in added.values()]
        # one that takes nothing around it along
        self.mark_id, self.mark = next(((k, t.content) for k, t in added.items() if not (t.lstrip or t.rstrip or t.single_word)), (0, None))
        self.kind = "<u2" if self.tool.get_vocab_size() <= 1 << 16 else "<u4"
        self.by_blank = by_blank
        self.width = np.dtype(self.kind).itemsize
        self.model = self.tool.model if by_blank and self._whole() else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self) -> bool:
        """Whether a run of the letters a-z comes to the model as it is, in one piece, whatever letters meet in it."""
        letters = "abcdefghijklmnopqrstuvwxyz"
        word = "".join(a + b for a in letters for b in letters)
        if self.tool.normalizer is not None and self.tool.normalizer.normalize_str(word) != word:
            return False
        return self.tool.pre_tokenizer is not None and [p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(word)] == [word]

    @classmethod
    def of(cls, path: str, by_blank: bool) -> "Encoder":
        key = (path, by_blank)
        if key not in cls.made:
            cls.made[key] = cls(path, by_blank)
        KEPT[ENCODER] = cls.forget
        return cls.made[key]

    @classmethod
    def forget(cls) -> None:
        """Drop the kept words; the tokenizers themselves stay with the worker."""
        for own in cls.made.values():
            own.known, own.older = {}, {}

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of words without an added token, in one call: such a token between two words keeps them apart."""
        if self.mark is None or len(words) == 1:
            return self.packed(words)
        ids = np.array(self.tool.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, self.kind)
        cuts, data, width = np.flatnonzero(ids == self.mark_id), ids.tobytes(), ids.itemsize
        return [data[low * width:high * width] for low, high in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text; the words that are new in any of them are encoded together."""
        plan: list[list[bytes] | bytes] = []
        new: dict[bytes, None] = {}
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for text in texts:
            low = text.lower()                          # of bytes, so ASCII letters only
            if not self.by_blank or any(t in low for t in self.added):
                plan.append(self.packed([text.decode()])[0])
                continue
            # fewer words are new once letters are lowered
            words = WORD_END.sub(rb" \1", low).split() if text.isascii() else lowered(text, low)
            plan.append(words)
            for word in set(words).difference(known):
                if word in older:
                    known[word] = older[word]
                else:
                    new[word] = None
        rare, fresh = {}, list(new)
        if self.model is not None:          # words that normalizing and cutting would leave alone go to the model itself
            tokenize, width = self.model.tokenize, self.width
            for word in [w for w in fresh if w.isalpha() and w.islower()]:         # of bytes, so a-z only
                (known if len(word) <= CACHE_BYTES else rare)[word] = b"".join([t.id.to_bytes(width, "little") for t in tokenize(word.decode())])
            fresh = [w for w in fresh if w not in known and w not in rare]
        for start in range(0, len(fresh), 4096):
            part = fresh[start:start + 4096]
            for word, ids in zip(part, self.each([w.decode() for w in part])):
                (known if len(word) <= CACHE_BYTES else rare)[word] = ids
        if rare:
            return [p if isinstance(p, bytes) else b"".join([known[w] if w in known else rare[w] for w in p]) for p in plan]
        return [p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in plan]


def together(texts: list[bytes], size: int = TOGETHER) -> Iterator[list[bytes]]:
    """Runs of texts of about `size` bytes; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > size:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def _store(uri: str):
    """The file system of a folder that driver and executors share, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, write) -> None:
    """Write under a name of this attempt, then rename: a repeated task leaves one whole file."""
    store, folder = _store(uri)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        write(out)
    store.move(own, f"{folder}/{name}")


def _put_arrays(uri: str, name: str, arrays: list[np.ndarray]) -> None:
    def write(out) -> None:
        for a in arrays:
            out.write(np.array([a.nbytes], "<i8").tobytes())
            out.write(a.tobytes())

    _put(uri, name, write)


class ShardIndex:
    """The index file of one shard."""

    def __init__(self, folder: str, shard: int):
        store, path = _store(folder)
        with store.open_input_stream(f"{path}/shard-{shard:06d}.idx") as f:
            data = f.read()
        parts, at = [], 0
        while at < len(data):
            size = int(np.frombuffer(data, "<i8", 1, at)[0])
            parts.append(data[at + 8:at + 8 + size])
            at += 8 + size
        kinds = ["<i8", "<i8", "u1", "<u4", "<i8", "<i8", "<i8", "<i8", "u1"]
        head, sizes, bits, self.marks, self.numbers, self.copies, self.offsets, self.keys, self.named = (
            np.frombuffer(p, k) for p, k in zip(parts, kinds))
        if head[0] != MAGIC:
            raise ValueError(f"shard {shard} of {folder} is not an index")
        self.kind = f"<u{head[1]}"
        self.index = mph.Index(sizes, bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key (int64), or -1 where the stored fingerprint is another one."""
        own = keys.astype("<i8").view("<u8")
        slots = self.index.slots(own)
        if not len(self.marks):
            return slots
        return np.where((slots >= 0) & (self.marks[slots] == mph.fingerprints(own)), slots, -1)


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, by_blank: bool = True, end_id: int = 1,
                 order: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode doc_id, text of `docs`, write shards below `folder` and return the manifest.

    Documents stand in ascending `order` (default doc_id; nulls first, ties by a hash of the text), `end_id` closes
    each. A null text is an empty one. Repeated keys stand together; the index has the first and their number. A null
    key keeps its document but cannot be looked up. Rows are dealt by range on (order, hash, a row number), so no key
    is too frequent for one task. An empty table writes no shard. Further columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    keys = order or ["doc_id"]
    dealt = docs.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.xxhash64("text").alias("_h"),
                        F.monotonically_increasing_id().alias("_r"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = [F.col(f"_{i}").asc_nulls_first() for i in range(len(keys))] + [F.col("_h"), F.col("_r")]
    dealt = dealt.repartitionByRange(shards, *by).sortWithinPartitions(*by).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = Encoder.of(vocabulary, by_blank)
        close = np.array([end_id], encoder.kind).tobytes()
        width = len(close)
        docs_, lengths = [], []

        def payload(out) -> None:
            for batch in (part for whole in batches for part in slices(whole)):
                found = (ids for run in together([t or b"" for t in raw(batch, "text")]) for ids in encoder.ids_of(run))
                for doc, ids in zip(values(batch, "doc_id"), found):
                    out.write(ids)
                    out.write(close)
                    docs_.append(doc)
                    lengths.append(len(ids) // width + 1)

        _put(folder, f"shard-{shard:06d}.ids", payload)
        if not docs_:
            return
        named = np.array([d is not None for d in docs_], "u1")
        order_ = np.array([d or 0 for d in docs_], "<i8")
        count = np.array(lengths, "<i8")
        offset = np.append(0, np.cumsum(count)).astype("<i8")
        there = np.flatnonzero(named)
        key, first, copies = np.unique(order_[there], return_index=True, return_counts=True)
        sizes, bits = mph.build(key.view("<u8"))
        slot = mph.Index(sizes, bits).slots(key.view("<u8"))
        marks, number, many = np.zeros(len(key), "<u4"), np.zeros(len(key), "<i8"), np.zeros(len(key), "<i8")
        marks[slot], number[slot], many[slot] = mph.fingerprints(key.view("<u8")), there[first], copies
        _put_arrays(folder, f"shard-{shard:06d}.idx",
                    [np.array([MAGIC, width], "<i8"), sizes, bits, marks, number, many, offset, order_, named])
        yield {"shard": [shard], "path": [folder], "docs": [len(docs_)], "tokens": [int(count.sum())],
               "first_key": [int(key[0]) if len(key) else None], "last_key": [int(key[-1]) if len(key) else None], "id_bytes": [width]}

    path = f"{folder}/manifest"
    map_batches(dealt, write, MANIFEST, keeps=ENCODER).write.parquet(path)
    return docs.sparkSession.read.schema(MANIFEST).parquet(path)


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, from the files alone.

    Each document is found through the perfect hash: its key's slot gives offset and length, copies of a key follow.
    start counts the ids of all documents before it; ids_crc32 is over its ids as little-endian 32-bit integers.
    """
    start = manifest.withColumn("start", F.sum("tokens").over(       # one row per shard
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    start = start.repartition(F.col("shard"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for shard, folder, base in zip(values(batch, "shard"), values(batch, "path"), values(batch, "start")):
                index = ShardIndex(folder, shard)
                width, named = int(index.kind[2]), index.named == 1
                slots = index.find(index.keys)
                if np.any((slots < 0) & named):
                    raise ValueError(f"shard {shard}: a key is missing from its index")
                place = np.arange(len(slots))
                fresh = np.append(True, (index.keys[1:] != index.keys[:-1]) | (named[1:] != named[:-1]))
                copy = place - np.maximum.accumulate(np.where(fresh, place, 0))
                number = np.where(named, index.numbers[slots] + copy, place) if len(index.numbers) else place
                at, size = index.offsets[number], index.offsets[number + 1] - index.offsets[number]
                store, path = _store(folder)
                with store.open_input_file(f"{path}/shard-{shard:06d}.ids") as f:
                    held, held_at = b"", 0
                    for low in range(0, len(place), 10_000):
                        crcs, part = [], slice(low, low + 10_000)
                        for a, n in zip((at[part] * width).tolist(), size[part].tolist()):
                            if a < held_at or a + n * width > held_at + len(held):
                                f.seek(a)
                                held_at, held = a, f.read(max(READ_BYTES, n * width))
                            crcs.append(zlib.crc32(np.frombuffer(held, index.kind, n, a - held_at).astype("<u4").tobytes()))
                        yield {"doc_id": pa.array(index.keys[part], mask=~named[part]), "start": base + at[part],
                               "n_tokens": size[part], "ids_crc32": crcs, "shard": np.full(len(crcs), shard, np.int32)}

    return map_batches(start, read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def look_up(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """key, shard, offset, n_tokens, copies, ids for every row of `keys` (key long) that the shards have.

    Only the index of the shards whose key range holds a key is read, and of their payload only the ids asked for.
    """
    ranges = manifest.select("shard", "path", "first_key", "last_key").where("first_key IS NOT NULL")
    asked = keys.select(F.col("key").cast("long").alias("key")).join(
        ranges, (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key")))
    asked = asked.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "path", "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index, now = None, None
        for batch in batches:
            out: dict = {k: [] for k in ("key", "shard", "offset", "n_tokens", "copies", "ids")}
            for shard, folder, key in zip(values(batch, "shard"), values(batch, "path"), values(batch, "key")):
                if now != (shard, folder):
                    index, now = ShardIndex(folder, shard), (shard, folder)
                    store, path = _store(folder)
                slot = int(index.find(np.array([key], "<i8"))[0])
                if slot < 0 or index.keys[number := int(index.numbers[slot])] != key:
                    continue
                at, end = int(index.offsets[number]), int(index.offsets[number + 1])
                with store.open_input_file(f"{path}/shard-{shard:06d}.ids") as f:
                    f.seek(at * int(index.kind[2]))
                    ids = np.frombuffer(f.read((end - at) * int(index.kind[2])), index.kind).astype(np.int64)
                for name, value in zip(out, (key, shard, at, end - at, int(index.copies[slot]), ids)):
                    out[name].append(value)
            yield out

    return map_batches(asked, read, "key long, shard int, offset long, n_tokens long, copies long, ids array<bigint>")


def token_shards(docs: DataFrame, vocabulary: str | None = None, by_blank: bool = True, order: list[str] | None = None) -> DataFrame:
    """Write `docs` as shards in a fresh shared folder and read them back, one row per document."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_back(write_shards(docs, folder, vocabulary, by_blank, order=order))


def vocabulary_of(spark: SparkSession) -> str:
    """The tokenizer file: spark.conf tidewatch.vocabulary, else the word vocabulary of the installed files."""
    return spark.conf.get("tidewatch.vocabulary", None) or default_vocabulary()

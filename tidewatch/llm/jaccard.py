"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

The steps: (1) a fixed-size counter table gives every shingle a frequency class; shingles are ordered by class, then
hash, which is one order for the whole corpus. (2) Documents with the same set size and the same prefix fall into one
group, and only groups post their prefix. (3) Postings that no other group shares go. (4) Groups that meet in a shingle of few groups
become candidates if they pass the size and position filters and share as many prefix shingles as a link must: of a
prefix's tokens all but (size - needed overlap) are common to both, where shingles of many groups, which are not
paired here, count as common. (5) A shingle of many groups links each of them to the one where it stands first.
(6) Candidates are expanded to members and verified; links form first components, so a large family of copies costs as
many checks as it has members. (7) Pairs that share a shingle of many groups, pass the filters and still lie in
different components are verified. (8) Components give the classes.

Every link is verified itself or joins two members of one component, so no component is split. The counter table and
PAIRED change the order of work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.store import kept
from tidewatch.llm.text import map_batches, shingle_sets, slices, values

#: Counters of the frequency table: 4 MB whatever the corpus size. Their chunks are summed by Spark.
SLOTS, CHUNK = 1 << 20, 1 << 14
#: Bits of the table that tells which sets must be kept for verification: 1 MB whatever the corpus size.
NEEDED_BITS = 1 << 23
#: A shingle of at most so many groups pairs them directly; others go by way of components.
PAIRED = 64


def _counters(docs: DataFrame, width: int) -> np.ndarray:
    """In how many texts a shingle of each slot occurs, over all texts."""
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, waiting, size = np.zeros(SLOTS, np.uint64), [], 0
        for batch in batches:
            for found in shingle_sets(batch.column(0), width):
                waiting.append((found >> shift).astype(np.int64))
                size += len(waiting[-1])
                if size > SLOTS:
                    total += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.uint64)
                    waiting, size = [], 0
        if size:
            total += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.uint64)
        for chunk in range(SLOTS // CHUNK):
            part = total[chunk * CHUNK:(chunk + 1) * CHUNK]
            slots = np.flatnonzero(part)
            if len(slots):
                yield {"chunk": [chunk], "slots": [slots.astype("<u2").tobytes()], "counts": [part[slots].astype("<u4").tobytes()]}

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint64)
        for part in parts:
            for slots, counts in zip(values(part, "slots"), values(part, "counts")):
                total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["chunk", "total"])

    parts = map_batches(docs.select("text"), count, "chunk int, slots binary, counts binary")
    table = np.zeros(SLOTS, np.uint64)
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, total binary").collect():   # 64 rows at most
        table[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.total, np.uint64)
    return table


def _classes(table: np.ndarray) -> np.ndarray:
    """Per slot the power of two by which its count stands out from the usual count of a slot."""
    usual = float(np.median(table))
    excess = table.astype(np.float64) - usual - 4 * np.sqrt(usual) - 1
    return np.where(excess > 1, np.floor(np.log2(np.maximum(excess, 1))) + 1, 0).astype(np.uint64)


def ordered(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as tokens whose numeric order is (frequency class, hash), ascending."""
    slot = (found >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
    return np.sort((classes[slot] << np.uint64(57)) | (found >> np.uint64(7))).astype(np.int64)


def _needed(nodes: DataFrame) -> np.ndarray:
    bit = F.pmod(F.col("node"), F.lit(NEEDED_BITS)) + 1
    found = nodes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()           # 256 rows of 4 KB at most
    flags = np.zeros(NEEDED_BITS // 8, np.uint8)
    for row in found:
        flags[(row["at"] - 1) * 4096:row["at"] * 4096] = np.frombuffer(row.bits, np.uint8)
    return flags


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id long, text string; other columns are ignored).

    Words are what stands between ASCII blanks after lower-casing A-Z. Two documents link when
    100 * |intersection| >= percent * |union| of their distinct shingles of `width` words; a shorter text is one
    shingle. component_id is the smallest doc_id that links reach. A null, empty or blank text has no shingles, links
    with nothing and has its own doc_id. Repeated rows are copies of one another and each keeps its row; a null doc_id
    counts as no id: its component is the smallest id of the others, or null. An empty table gives an empty one.
    Shingles are compared by 57 bits of a 64-bit hash.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(_classes(_counters(docs, width)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict = {k: [] for k in ("doc_id", "n", "node", "grp", "prefix")}
            for doc, found in zip(values(batch, "doc_id"), shingle_sets(batch.column(1), width)):
                tokens = ordered(found, classes.value)
                prefix = tokens[:len(tokens) - (percent * len(tokens) + 99) // 100 + 1]
                out["doc_id"].append(doc)
                out["n"].append(len(tokens))
                out["node"].append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
                out["grp"].append(xxhash.xxh64_intdigest(prefix.tobytes(), seed=len(tokens)) - (1 << 63))
                out["prefix"].append(prefix if len(tokens) else [])
            yield out

    rows = kept(map_batches(docs.select("doc_id", "text"), digest,
                            "doc_id long, n int, node long, grp long, prefix array<bigint>"), "sets")
    nodes = kept(rows.where("n > 0").groupBy("node", "n", "grp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = rows.where("n > 0").groupBy("grp", "n").agg(F.first("prefix").alias("prefix"))
    posted = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    posted = kept(posted.join(shared, "token").select("token", "many", "grp", "n", "pos"), "shared")

    def needed(na: str, nb: str) -> F.Column:
        """The least overlap of two linked sets of these sizes."""
        return F.floor((percent * (F.col(na) + F.col(nb)) + 99 + percent) / (100 + percent))

    def passes(na: str, pa_: str, nb: str, pb: str) -> F.Column:
        """Size filter, and whether the tokens from the shared one on can still make up the needed overlap."""
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & \
            (F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) >= needed(na, nb))

    # shingles of few groups: all pairs that share enough of them
    few = posted.where(F.col("many") <= PAIRED).join(
        posted.groupBy("grp").agg(F.sum((F.col("many") > PAIRED).cast("int")).alias("frequent")), "grp")
    few = few.select("token", "grp", "n", "pos", "frequent")
    met = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.grp") < F.col("y.grp"))
                              & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    met = met.groupBy(F.col("x.grp").alias("g"), F.col("y.grp").alias("h"), F.col("x.n").alias("ng"), F.col("y.n").alias("nh"),
                      F.least("x.frequent", "y.frequent").alias("frequent")).agg(
        F.count("*").alias("both"), F.max(passes("x.n", "x.pos", "y.n", "y.pos")).alias("passes"))

    def beyond(n: str) -> F.Column:
        """How many tokens a prefix has beyond those a partner may lack."""
        prefix = F.col(n) - F.floor((percent * F.col(n) + 99) / 100) + 1
        return prefix - F.col(n) + needed("ng", "nh")

    pairs = met.where("passes").where(F.col("both") + F.col("frequent") >= F.least(beyond("ng"), beyond("nh"))).select("g", "h")
    # frequent shingles: every group against the one where the shingle stands first
    often = posted.where(F.col("many") > PAIRED)
    lead = often.groupBy("token").agg(F.min(F.struct("pos", "n", "grp")).alias("lead"))
    star = often.join(lead, "token").where("grp != lead.grp").where(passes("n", "pos", "lead.n", "lead.pos")) \
        .select(F.col("grp").alias("g"), F.col("lead.grp").alias("h")).distinct()
    # groups to members; groups of several sets: every member against the first
    member = nodes.select("grp", "node")
    face = member.groupBy("grp").agg(F.min("node").alias("face"), F.count("*").alias("sets"))
    star = star.join(face.select(F.col("grp").alias("g"), F.col("face").alias("a")), "g") \
        .join(face.select(F.col("grp").alias("h"), F.col("face").alias("b")), "h").select("a", "b")
    pairs = pairs.join(member.select(F.col("grp").alias("g"), F.col("node").alias("a")), "g") \
        .join(member.select(F.col("grp").alias("h"), F.col("node").alias("b")), "h").select("a", "b")
    inside = member.join(face.where("sets > 1"), "grp").where("node != face").select(F.col("node").alias("a"), F.col("face").alias("b"))
    first = kept(star.union(pairs).union(inside).distinct(), "first")

    members = first.select(F.explode(F.array("a", "b")).alias("node")).union(
        often.select("grp").distinct().join(member, "grp").select("node")).union(
        member.join(face.where("sets > 1"), "grp").select("node"))
    wanted = spark.sparkContext.broadcast(_needed(members))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict = {"node": [], "tokens": []}
            for found in shingle_sets(batch.column(0), width):
                tokens = ordered(found, classes.value)
                node = xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)
                bit = node % NEEDED_BITS
                if len(tokens) and wanted.value[bit >> 3] >> (bit & 7) & 1 and node not in seen:
                    if len(seen) < 200_000:       # leaves out copies of one partition; a full set only costs rows
                        seen.add(node)
                    out["node"].append(node)
                    out["tokens"].append(tokens)
            yield out

    found = map_batches(docs.select("text"), sets, "node long, tokens array<bigint>")
    found = kept(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(found.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a") \
            .join(found.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        both = F.size(F.array_intersect("ta", "tb"))
        return met.withColumn("both", both).where(
            100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")

    links = kept(verified(first), "links")
    root = components(links)

    # what is left: pairs in different components
    placed = nodes.join(root, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))
    left = often.select("token", "grp", "n", "pos").join(placed, "grp")
    split = left.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    left = kept(left.join(split, "token"), "left")
    x, y = left.alias("x"), left.alias("y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                    & (F.col("x.root") != F.col("y.root")) & passes("x.n", "x.pos", "y.n", "y.pos")) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    mates = placed.alias("x").join(placed.alias("y"), (F.col("x.grp") == F.col("y.grp"))
                                   & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = kept(verified(across.union(mates).distinct()), "links")
    root = components(links.union(more))

    placed = nodes.join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", F.col("n_shingles").cast("long"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

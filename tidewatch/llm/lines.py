"""Line dedup: a segment-partition edit join of distinct lines (Pass-Join, Li et al., 2011), in DataFrame functions only.

Of two lines within `threshold` edits, the shorter one cut into threshold + 1 segments has a segment that stands in the
longer one, near its own place. The shorter line's length sets the threshold of a pair. So every line posts its segments under (segment number, its length), and probes, for its
own length and each length up to `threshold` less, the few substrings that can match a segment (multi-match-aware
selection). Of lines that meet, neither may have more than `threshold` common letters beyond the other's; the others are
never paired. Pairs are verified by a band of 2 * threshold + 1 diagonals, kept as the bits of one number per error count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.store import kept

#: Edits between lines, and between lines of which one is shorter than MIN_CHARS code points.
THRESHOLD, SHORT, MIN_CHARS = 2, 1, 16
#: Letters whose numbers are compared before two lines are paired; each is kept modulo 32, in 5 bits of one long.
LETTERS = "eatonrishdlu"


def all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of every non-empty line of `docs` (doc_id, text); lines end at line feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("line <> ''")


def _segment(length: Column, number: Column, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of a line of this length; the last ones are longer by one."""
    longer = F.pmod(length, F.lit(threshold + 1))
    base = F.floor((length - longer) / (threshold + 1)).cast("int")
    later = F.greatest(F.lit(0), number - (F.lit(threshold + 1) - longer))
    return base * number + later, base + (number >= F.lit(threshold + 1) - longer).cast("int")


def _posted(lines: DataFrame, threshold: int, low: int, high: int) -> DataFrame:
    """key, a, ca: one row for every segment of a line of `low` to `high` code points."""
    every = lines.where(F.col("chars").between(low, high)).select("line", "chars", F.col("id").alias("a"), F.col("counts").alias("ca"),
                         F.explode(F.array(*[F.lit(i) for i in range(threshold + 1)])).alias("i"))
    start, size = _segment(F.col("chars"), F.col("i"), threshold)
    return every.select(F.xxhash64("i", "chars", F.substring("line", start + 1, size)).alias("key"), "a", "ca")


def _probes(threshold: int) -> list[int]:
    """What a line probes: how much shorter the other line is, the other's segment, and how far it is shifted here.

    Each is packed as ((less * 16 + segment) * 32 + shift + 16), so one small expression serves all; spelled out one by
    one, they make a method that the JVM doesn't compile.
    """
    return [(less * 16 + i) * 32 + shift + 16 for less in range(threshold + 1) for i in range(threshold + 1)
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)]


def _probed(lines: DataFrame, threshold: int, low: int, high: int) -> DataFrame:
    """key, equal (the other line is of the same length), b, cb: one row for every substring by which a line probes for
    lines of `low` to `high` code points, none longer than itself."""
    if not 0 <= threshold < 16:
        raise ValueError("threshold must be from 0 to 15")
    every = lines.where(F.col("chars").between(low, high + threshold)).select("line", "chars", F.col("id").alias("b"), F.col("counts").alias("cb"),
                         F.explode(F.array(*[F.lit(p) for p in _probes(threshold)])).alias("p"))
    number, less = F.shiftright("p", 5).bitwiseAND(15), F.shiftright("p", 9)
    start, size = _segment(F.col("chars") - less, number, threshold)
    at = start + F.col("p").bitwiseAND(31) - 16
    fits = (at >= 0) & (at + size <= F.col("chars")) & (F.col("chars") - less).between(low, high)
    key = F.xxhash64(number, F.col("chars") - less, F.substring("line", at + 1, size))
    return every.where(fits).select(key.alias("key"), (less == 0).alias("equal"), "b", "cb")


def _letter_counts() -> Column:
    """Each letter is taken out of what the letters before it have left, so later ones read less."""
    left, counts = F.col("line"), []
    for x in LETTERS:
        rest = F.replace(left, F.lit(x), F.lit(""))
        counts.append(((F.octet_length(left) - F.octet_length(rest)) % 32).cast("long"))
        left = rest
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c, 5 * k) for k, c in enumerate(counts)])


def _near_counts(a: str, b: str, threshold: int) -> Column:
    """Whether neither line has more than `threshold` letters beyond the other's, as an edit adds and removes one at most."""
    def differ(k: int) -> Column:
        return (F.shiftright(a, 5 * k).bitwiseAND(31) - F.shiftright(b, 5 * k).bitwiseAND(31) + 16).bitwiseAND(31) - 16

    def beyond(sign: int) -> Column:
        return reduce(lambda x, y: x + y, [F.greatest(sign * differ(k), F.lit(0)) for k in range(len(LETTERS))])

    return (beyond(1) <= threshold) & (beyond(-1) <= threshold)


def within_edits(left: str, right: str, threshold: int) -> Column:
    """Whether two strings are within `threshold` insertions, deletions and replacements of code points.

    After j signs of `right`, bit k of number e tells that the first j - threshold + k signs of `left` match with at most e
    errors. A step shifts the diagonals of a match, adds replacements, insertions and deletions from the number before, and
    costs a few operations on whole numbers whatever the band's width.
    """
    width = 2 * threshold + 1
    whole = (1 << width) - 1
    first = F.array(*[F.lit(((1 << e + 1) - 1) << threshold) for e in range(threshold + 1)])

    def step(now: Column, match: Column) -> Column:
        out = [now[0].bitwiseAND(match)]
        for e in range(1, threshold + 1):
            moved = now[e].bitwiseAND(match).bitwiseOR(now[e - 1]).bitwiseOR(F.shiftright(now[e - 1], 1))
            out.append(moved.bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(F.lit(whole)))
        return F.array(*out)

    def last(signs: Column) -> Column:
        masks = F.transform(signs["b"], lambda c, j: reduce(
            lambda x, y: x.bitwiseOR(y),
            [F.when(F.get(signs["a"], j - threshold + k) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]))
        return F.aggregate(masks, first, step)[threshold]

    # the one-element array has the strings split once, not once for every sign
    split = F.array(F.struct(F.array_remove(F.split(left, ""), "").alias("a"), F.array_remove(F.split(right, ""), "").alias("b")))
    # the bit of the diagonal that ends both strings; there is none if their lengths differ by more
    bit = F.get(F.array(*[F.lit(1 << k) for k in range(width)]), F.length(left) - F.length(right) + threshold)
    return F.coalesce(F.transform(split, last)[0].bitwiseAND(bit) != 0, F.lit(False))


def _classes(docs: DataFrame, threshold: int, min_chars: int, short: int) -> DataFrame:
    """id (hash), first (place), copies, links and head (the class's first place) of every distinct line."""
    found = all_lines(docs).groupBy("line").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    lines = kept(found.select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("chars"), "copies", "first",
                              _letter_counts().alias("counts")), "lines")
    sizes = [(threshold, max(min_chars, threshold + 1), (1 << 31) - 1 - threshold), (short, short + 1, min_chars - 1)]
    sizes = [(edits, low, high) for edits, low, high in sizes if edits and low <= high]

    def met(edits: int, low: int, high: int) -> DataFrame:
        index, probe = _posted(lines, edits, low, high), _probed(lines, edits, low, high)
        return index.join(probe, "key").where((F.col("a") < F.col("b")) | (~F.col("equal") & (F.col("a") != F.col("b")))) \
            .where(_near_counts("ca", "cb", edits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(edits).alias("edits"))

    none = lines.where(F.lit(False)).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("edits"))
    pairs = kept(reduce(DataFrame.union, [met(*s) for s in sizes] or [none]).distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = kept(lines.join(asked, "id", "left_semi").select("id", "line"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a") \
        .join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    near = reduce(lambda x, y: x | y, [(F.col("edits") == edits) & within_edits("la", "lb", edits) for edits, _, _ in sizes] or [F.lit(False)])
    links = kept(both.where(near).select("a", "b"), "links")
    number = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    linked = components(links).join(lines.select("id", "first"), F.col("node") == F.col("id")).select("id", "root", "first")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    classed = linked.join(heads, "root").join(number, "id").select("id", "head", "links")
    out = lines.select("id", "first", "copies").join(classed, "id", "left")
    return out.select("id", "first", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("head", "first").alias("head"))


def _row(doc_id: Column, line_no: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), line_no.cast("long").alias("line_no"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"),
            F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").cast("long").alias("class_line_no")]


def near_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short: int = SHORT) -> DataFrame:
    """One row for every distinct line of `docs`: its first place, number of copies and links, and its class.

    doc_id and line_no are its first place (smallest doc_id, then line; a null doc_id comes first). Lines link when they lie
    within `threshold` edits, or within `short` edits if the shorter has under `min_chars` code points; lines of no more
    code points than edits are compared for equality only. class_doc_id and class_line_no are the first place of any line
    that links reach. A null, empty or blank-free text has no lines but its non-empty ones; repeated
    rows are copies. Lines are told apart by a 64-bit hash. Other columns are ignored, an empty table gives an empty one.
    """
    return _classes(docs, threshold, min_chars, short).select(*_row(F.col("first.doc_id"), F.col("first.line_no")))


def line_places(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short: int = SHORT) -> DataFrame:
    """near_lines() with one row for every place of a line, each with its own doc_id and line_no.

    n_copies and n_links are the line's, so the places of a copied line agree in them and in their class.
    """
    places = all_lines(docs).select(F.xxhash64("line").alias("id"), "doc_id", "line_no")
    classes = _classes(docs, threshold, min_chars, short).select("id", "copies", "links", "head")
    return places.join(classes, "id").select(*_row(F.col("doc_id"), F.col("line_no")))

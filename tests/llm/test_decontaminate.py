import random
import re

import numpy as np

from tidewatch.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (d.MATCH if x == y else d.REPLACE), row[j + 1] + d.GAP, new[j] + d.GAP))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(2, 7, (9, 12)), rng.integers(2, 7, (9, 30))
        for k in range(9):
            a[k, rng.integers(1, 13):], b[k, rng.integers(1, 31):] = 0, 1
        got, _ = d.align(a, b)
        assert got.tolist() == [smith_waterman([x for x in p if x], [y for y in q if y != 1]) for p, q in zip(a.tolist(), b.tolist())]


def edited(rng, words, share):
    out = []
    for w in words:
        roll = rng.random()
        out += [] if roll < share / 3 else [w, f"n{rng.randrange(999)}"] if roll < 2 * share / 3 else [f"r{rng.randrange(999)}"] if roll < share else [w]
    return out


def test_against_all_pairs(spark):
    rng = random.Random(8)
    item = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([15, 40, 60]))] for _ in range(12)]
    docs = []
    for k in range(150):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(400))]
        if k % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, item[rng.randrange(12)], rng.choice([0, 0.1, 0.25]))
        docs.append((k, " ".join(words)))
    bench = [(k, " ".join(w)) for k, w in enumerate(item)] + [(90, None), (91, ""), (92, "w1 w2")]
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in d.contaminated(
        spark.createDataFrame(docs + [(500, None), (501, "")], "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS score").repartition(3),
        spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "2 AS words")).collect()}
    want = {}
    for k, text in docs:
        for i, words in enumerate(item):
            share = smith_waterman(words, text.split()) / (d.MATCH * len(words))
            if share >= d.THRESHOLD:
                want[k, i] = round(share, 6)
    assert got == want and len(want) >= 40


def test_long_items_and_odd_rows(spark):
    rng = random.Random(2)
    long_ = [f"v{rng.randrange(5000)}" for _ in range(300)]
    docs = [(1, "x " * 20 + " ".join(long_[100:200])), (1, "x"), (None, " ".join(long_)), (2, "y " * 50_000 + " ".join(long_[:70])), (3, "y x " * 99)]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = d.contaminated(make(docs, "doc_id long, text string"), make([(7, " ".join(long_)), (7, " ".join(long_))], "item_id long, text string"))
    assert sorted((str(r.doc_id), r.item_id, r.score) for r in got.collect()) == [("1", 7, 1.0), ("2", 7, 1.0), ("None", 7, 1.0)]
    empty = make([], "doc_id long, text string")
    assert d.contaminated(empty, make([(7, "a b c d")], "item_id long, text string")).collect() == []
    assert d.contaminated(make(docs, "doc_id long, text string"), make([], "item_id long, text string")).collect() == []


def test_evenly_spread_edits_of_single_copies(spark):
    """Every copy of the table of all pairs is found: each item has one, whose edits leave few runs of words whole."""
    rng = random.Random(5)
    edits = [lambda w, k, n: [f"r{k}"] if k % n == n - 1 else [w], lambda w, k, n: [] if k % n == n - 1 else [w],
             lambda w, k, n: [w, f"n{k}"] if k % n == n - 1 else [w]]
    docs, bench = [], []
    for number, (edit, n) in enumerate([(e, n) for e in edits for n in (1, 2, 3, 4, 5)]):
        for size in (3, 4, 24, 37, 60, 64, 100):
            item = len(bench)
            words = [f"i{item}x{k}" if k % 5 else "the" for k in range(size)]
            copy = [x for k, w in enumerate(words) for x in edit(w, k, n)]
            around = [f"o{rng.randrange(99)}" for _ in range(rng.choice([0, 70, 120, 127, 128, 200]))]
            docs.append((item, " ".join(around + copy + ["end"] * 40)))
            bench.append((item, " ".join(words)))
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in d.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for item, text in bench:
        words = text.split()
        for start in range(0, max(1, len(words) - d.PIECE // 2), d.PIECE // 2):
            piece = words[start:start + d.PIECE]
            share = smith_waterman(piece, docs[item][1].split()) / (d.MATCH * len(piece))
            if share >= d.THRESHOLD:
                want[item, item] = max(want.get((item, item), 0), round(share, 6))
    assert got == want and len(want) > 70

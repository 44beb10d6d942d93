import random

from tidewatch.llm import jaccard
from tidewatch.llm.jaccard import jaccard_components


def brute(rows, percent=80):
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 AS node", "2 AS token", "text AS prefix", "3 AS component_id")
    return sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        yield " ".join(text)


def test_matches_all_pairs(spark):
    rng = random.Random(5)
    texts = [t for size, words, edits in ((40, 60, 4), (25, 12, 1), (30, 200, 12), (8, 6, 1)) for t in family(rng, size, words, edits)]
    shared = " ".join(f"p{k}" for k in range(60))
    texts += [f"{shared} {' '.join(f'q{rng.randrange(99)}' for _ in range(rng.randrange(5, 90)))}" for _ in range(30)]
    texts += ["a b", "A b", "a b c d e", "a\tb\nc d e", "b a", "long " * 5000, "long " * 5001, "É é", "é é"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_frequent_shingles_go_by_way_of_components(spark, monkeypatch):
    """With hardly a shingle paired directly, stars and pairs across components find the same classes."""
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    rng = random.Random(15)
    texts = [t for size, words, edits in ((30, 60, 5), (25, 12, 1), (12, 150, 12), (9, 6, 1)) for t in family(rng, size, words, edits)]
    passage = [f"p{k}" for k in range(40)]
    for _ in range(40):                 # a passage that many texts share, beside own words: near copies in several groups
        own = [f"q{rng.randrange(60)}" for _ in range(rng.choice([3, 6, 20]))]
        texts.append(" ".join(rng.choice([passage + own, own + passage, passage[:35] + own])))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (9, "two three"), (None, "alone here")]
    assert run(spark, rows, extra=True) == brute(rows)
    assert run(spark, []) == []

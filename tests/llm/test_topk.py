import numpy as np

from tidewatch.llm import topk, vectors


def plain(queries, rows, k):
    out = []
    for qid, q in sorted(set(queries)):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 60)
    monkeypatch.setattr(vectors, "LEAST", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-9, 10, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, [3] * 8) for i in range(150)] + [(2000, [1, 2]), (2001, [5, 5]), (2002, [-1, 0]), (5, rows[5][1])]
    queries = rows[:400:25] + [(1000, [3] * 8), (2000, [1, 2]), (5, rows[5][1])]
    make = lambda r: spark.createDataFrame(r, "vec_id long, v array<bigint>").selectExpr("*", "'x' AS grp", "1.5 AS rank")
    got = sorted(tuple(r) for r in topk.top_k(make(queries), make(rows), 10).collect())
    assert got == plain([(i, tuple(v)) for i, v in queries], rows, 10)
    assert topk.top_k(make([]), make(rows)).collect() == [] == topk.top_k(make(queries), make([])).collect()


def test_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [None, 1.0]), (6, []), (None, [1.0])]
    got = topk.whole_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v")).collect()
    assert sorted((r.vec_id, r.v) for r in got) == [(1, [512, -1]), (6, [])]


def test_lists_are_not_read_to_the_end():
    """On clustered vectors reading stops early; the result is that of the full product."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 60, (20, 16))
    rows = np.floor(centres[rng.integers(0, 20, 3000)] * (0.5 ** np.arange(16)) + rng.normal(0, 1, (3000, 16))).astype(np.int64)
    lists = topk.SortedLists(np.arange(3000), rows)
    for own in range(0, 400, 20):
        ids, scores = lists.top(rows[own], own, 10)
        every = rows @ rows[own]
        best = sorted((-int(s), i) for i, s in enumerate(every) if i != own)[:10]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == best
    assert lists.read < 0.85 * 20 * rows.size


def test_no_join_of_blocks(spark):
    df = spark.createDataFrame([(i, [i, 1]) for i in range(50)], "vec_id long, v array<bigint>")
    assert "Join" not in topk.top_k(df.where("vec_id % 10 = 0"), df)._jdf.queryExecution().optimizedPlan().toString()

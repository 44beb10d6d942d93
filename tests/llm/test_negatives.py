import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import negatives, vectors


def plain(rows, asks, positives, count, low, high):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for own, label, v in sorted({i: (i, label, v) for i, label, v in sorted(rows, reverse=True) if asks(i)}.values()):
        near = sorted((-dot(v, w), i) for i, other, w in rows if i != own and other == label)[:positives]
        hard = sorted((-dot(v, w), i) for i, other, w in rows if i != own and other != label)
        for s, p in near:
            fit = [(-t, i) for t, i in hard if low * -s <= 100 * -t <= high * -s][:count]
            out += [(own, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 90)
    monkeypatch.setattr(vectors, "LEAST", 50)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-9, 12, 20).tolist()) for i in range(500)]
    rows += [(1000 + i, i % 3, [2] * 20) for i in range(90)]                    # ties
    rows += [(20, rows[20][1], rows[20][2]), (31, *rows[31][1:]), (2000, 9, [1] * 20), (2010, 1, [3, 4]), (2020, 2, []), (2030, 0, [0] * 20)]
    make = lambda r: spark.createDataFrame(r, "vec_id long, label long, v array<bigint>").selectExpr("*", "1 AS grp", "2 AS more")
    for positives, count, low, high in [(5, 10, 30, 90), (3, 2, -50, 120)]:
        got = negatives.mine(make(rows).repartition(5), F.col("vec_id") % 10 == 0, positives, count, low, high).drop("positive_rank")
        assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, positives, count, low, high)
    assert negatives.mine(make(rows[:0]), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(make(rows), F.lit(False)).collect() == []


def test_columns_are_left_unread():
    """With clustered vectors the bounds end the reading of most candidates; the result is that of a full product."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 60, (20, 64))
    rows = np.floor(centres[rng.integers(0, 20, 4000)] * (0.6 ** np.arange(64)) + rng.normal(0, 2, (4000, 64))).astype(np.int64)
    block = negatives.Columns(np.arange(4000), np.zeros(4000, np.int64), rows)
    for anchor in rows[:20]:
        scores = rows @ anchor
        window = (int(0.5 * scores.max()), int(0.9 * scores.max()))
        for windows in ([(None, None)], [window], [window, (None, 0)]):
            places, found = block.scan(anchor, np.ones(4000, bool), windows, 10)
            assert (found == scores[places]).all()
            for w in windows:
                every = block.best(np.arange(4000), scores, w, 10)
                assert [x.tolist() for x in block.best(places, found, w, 10)] == [x.tolist() for x in every]
    assert block.read < 0.5 * 60 * 4000 * 64


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [nan]), (5, 1, [-inf, 1.0]), (6, 1, [None]), (None, 1, [1.0]), (7, 2, [])]
    got = negatives.labelled_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS v"))
    assert sorted((r.vec_id, r.label, r.v) for r in got.collect()) == [(1, 1, [128, -1]), (7, 2, [])]

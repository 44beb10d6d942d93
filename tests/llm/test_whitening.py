import numpy as np

from tidewatch.llm import whitening


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS n", "'x' AS label").repartition(4)


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for dims, rank in [(1, 1), (7, 7), (8, 3), (33, 33), (5, 0)]:
        rows = rng.normal(size=(200, rank)) @ rng.normal(size=(rank, dims)) * 10.0 ** rng.integers(-6, 6)
        a = rows.T @ rows
        factor = whitening.pivoted_cholesky(a)
        order = np.argsort([np.flatnonzero(np.abs(row) > 0)[-1] if row.any() else dims for row in factor], kind="stable") if rank else []
        assert factor.shape == (dims, rank) and np.allclose(factor @ factor.T, a, rtol=1e-12, atol=1e-12 * np.abs(a).max(initial=0))
        assert not len(order) or np.allclose(np.triu(factor[order][:rank], 1), 0)
        values, vectors = whitening.jacobi(factor)
        expected = np.linalg.eigvalsh(a)[::-1][:rank]
        assert np.allclose(values, expected, rtol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * np.abs(a).max(initial=0))


def test_against_plain_numpy(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=6) * [3, 2, 1, .5, .2, .1] + 7).tolist()) for i in range(300)]
    good += [good[5], (1000, good[7][1]), (None, good[9][1])] + [(2000 + i, good[0][1]) for i in range(50)]
    nan, inf = float("nan"), float("inf")
    got = whitening.whiten(make(spark, good + [(1, None), (2, [nan] * 6), (3, [inf] * 6), (4, [None] * 6)])).collect()
    x = np.floor(256 * np.array([np.float32(v).astype(float) for _, v in good])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    assert len(got) == 4 * len(good)
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    for k in range(4):
        value, vector = values[-1 - k], vectors[:, -1 - k]
        expected = (x - sums / n) @ vector / np.sqrt(value)
        first = by[k + 1][good[0][0]][0].whitened
        sign = np.sign(first * expected[0])
        for (own, _), row, e in zip(good, x, expected):
            r = by[k + 1][own][0]
            assert abs(r.whitened - sign * e) < 1e-9 and r.n == n and r.deviation == int(((n * row - sums) ** 2).sum())
            assert abs(r.explained - value / values.sum()) < 1e-12 and r.identity_error < 1e-12


def test_small_tables(spark):
    assert whitening.whiten(make(spark, [])).collect() == []
    assert whitening.whiten(make(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []      # no variance
    assert whitening.whiten(make(spark, [(1, []), (2, None)])).collect() == []
    line = whitening.whiten(make(spark, [(k, [float(k), 2.0 * k]) for k in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and line[0].identity_error < 1e-12
    ragged = whitening.whiten(make(spark, [(1, [1.0]), (2, [1.0, 3.0]), (3, [2.0, 0.0])])).collect()
    assert {r.vec_id for r in ragged} == {1, 2, 3}
    huge = whitening.whiten(make(spark, [(1, [3e16, 0.0]), (2, [-3e16, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None} and len(huge) >= 3

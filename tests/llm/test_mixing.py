import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import mixing


def replay(blocks, weights):
    """Earliest deadline first, looked up slot by slot over all sources, with exact fractions; a new phase when a source ends."""
    left, had, out, base = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), [], 0
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        share = {s: Fraction(weights[s]) / total for s in left}
        done, slot = dict.fromkeys(left, 0), 0
        while all(done[s] < left[s] for s in left):
            free = [s for s in left if math.floor(done[s] / share[s]) <= slot]
            s = min(free, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s))
            out.append((s, had[s] + done[s], base + slot, base + math.floor(done[s] / share[s]), base + math.ceil((done[s] + 1) / share[s])))
            done[s] += 1
            slot += 1
        base += slot
        for s in list(left):
            had[s] += done[s]
            left[s] -= done[s]
            if not left[s]:
                del left[s]
    return out


def order_of(plan):
    out = []
    for phase in plan:
        total = sum(phase["parts"])
        for at, state in enumerate(phase["states"]):
            begun, first = list(state), at * phase["often"]
            for slot, i in zip(range(first, min(phase["length"], first + phase["often"])), mixing.slots(phase["parts"], begun, first)):
                k, p = begun[i] - 1, phase["parts"][i]
                out.append((phase["sources"][i], phase["had"][i] + k, phase["base"] + slot, phase["base"] + mixing.release(k, p, total),
                            phase["base"] + mixing.deadline(k, p, total)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(0, 60), st.one_of(st.integers(1, 9), st.floats(0.01, 9))), min_size=1),
       st.sampled_from([7, 100]))
def test_whole_order_against_a_plain_replay(sources, often):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    before, mixing.SEGMENT = mixing.SEGMENT, often
    try:
        plan = mixing.phases(blocks, mixing.whole_parts(weights))
    finally:
        mixing.SEGMENT = before
    got = order_of(plan)
    assert got == replay(blocks, weights)
    assert all(r <= slot < d for _, _, slot, r, d in got)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": Fraction(1, 7), "b": Fraction(6, 7)}, {"a": math.sqrt(2), "b": math.pi, "c": 1e-3}])
def test_never_a_block_from_the_exact_weight(weights):
    parts = list(mixing.whole_parts(weights).values())
    count, total = 300_000, sum(parts)
    who = np.fromiter((i for _, i in zip(range(count), mixing.slots(parts, [0] * len(parts), 0))), int, count)
    for i, part in enumerate(parts):
        have = np.cumsum(who == i)
        assert all(abs(int(h) * total - (t + 1) * part) < total for t, h in enumerate(have.tolist()))


def table(spark):
    rng = random.Random(7)
    rows = [(k, "x" * rng.randrange(1, 90), rng.choice(["hot"] * 5 + ["b", "c", None])) for k in range(4000)]
    rows += [(9000, None, "b"), (9001, "", "b"), (None, "y", "c"), (9002, "z" * 5000, "c"), (5, "same", "hot"), (5, "same", "hot")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS slot", "2 AS row").repartition(6)


def test_rows_and_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 300)
    monkeypatch.setattr(mixing, "SEGMENT", 50)
    rows, df = table(spark)
    weights = {"hot": 0.5, "b": 0.25, "c": 0.2, "": 0.05}
    got = mixing.mixed(df, weights, block=400).collect()
    assert sorted((str(r.row.doc_id), str(r.row.text), r.source) for r in got) == sorted((str(a), str(b), c or "") for a, b, c in rows)
    size = {s: sum(max(1, len(t or "")) for _, t, x in rows if (x or "") == s) for s in weights}
    plan = {(s, k): rest for s, k, *rest in replay({s: -(-n // 400) for s, n in size.items()}, weights)}
    assert all([r.slot, r.release, r.deadline] == plan[r.source, r.block] for r in got)
    whole = min(-(-size[s] // 400) / w for s, w in weights.items())         # slots until the first source runs out
    for t in range(1, int(whole)):
        for s, w in weights.items():
            blocks = len({r.block for r in got if r.source == s and r.slot < t})
            assert abs(blocks - t * w) < 1 + (13 if s == "c" else 0)         # the long document of c leaves slots empty
    assert mixing.mixed(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mixed(df, {"hot": 0.0})


def test_written_order(spark, tmp_path):
    rows, df = table(spark)
    mixing.in_order(mixing.mixed(df, block=2000)).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == df.columns and out.count() == len(rows)

import numpy as np
import pytest

from tidewatch.llm import quality


def plain(text):
    """Features of a text, one by one, as strings."""
    signs = "".join(c if c > " " else " " for c in " " + (text or "") + " ")
    out = [signs[i:i + n] for n in quality.GRAMS for i in range(len(signs) - n + 1)
           if " " not in signs[i + 1:i + n - 1] and (signs[i] != " " or signs[i + n - 1] != " ")]
    words = signs.split(" ")
    words = [w for w in words if w]
    return out, words, ["again" if a == b else (a, b) for a, b in zip(words, words[1:])]


TEXTS = ["Ab, ab", "", None, "a", "x\ny  z\t ", "über groß 中文 中文 é", "one two one two two two", "\x00a \x1fb", "a\U0001F600b c"]


def test_features_of_each_text():
    rows, slots = map(np.concatenate, zip(*quality.features(TEXTS)))
    same = {}
    for row, text in enumerate(TEXTS):
        grams, words, pairs = plain(text)
        own = slots[rows == row]
        assert len(own) == len(grams) + len(words) + len(pairs)
        kinds = [("g", g) for g in grams] + [("w", w) for w in words] + [("p", p) for p in pairs]
        alone = np.concatenate([s for _, s in quality.features([text])] or [np.zeros(0, int)])
        assert sorted(own) == sorted(alone)
        assert len(set(own.tolist())) == len(set(kinds))                    # equal features share a slot, no others here
        same.update({k: None for k in kinds})
    assert len(set(slots.tolist())) == len(same)


def test_long_texts_are_read_whole(monkeypatch):
    text = "Word an other word, again again " * 300
    whole = np.sort(np.concatenate([s for _, s in quality.features([text])]))
    monkeypatch.setattr(quality, "SLICE", 64)
    parts = np.sort(np.concatenate([s for _, s in quality.features(["x", text, None])]))
    assert len(parts) > 0.95 * len(whole) and set(whole) <= set(parts)      # a pair of words is lost at a cut
    assert sum(len(s) for r, s in quality.features(["é" * 1000]) if len(r)) > 2900


def rows_of(spark):
    rng = np.random.default_rng(5)
    words = "the of and that with from have were their which would about river stone garden paper".split()
    docs, labels = [], []
    for k in range(400):
        text = " ".join(rng.choice(words, rng.integers(5, 60)))
        label = int(k % 6 != 0)
        if not label:
            text = [text.upper() + " BUY!!", " ".join(w + "$$$" for w in text.split()), " ".join(w + " " + w + " " + w for w in text.split())][k // 6 % 3]
        docs.append((k, text))
        labels.append((k, label))
    docs += [(1000, None), (1001, ""), (None, "the river"), (3, docs[3][1]), (3, "another text"), (1002, "stone garden " * 30_000)]
    labels += [(1000, 1), (1001, 0), (None, 1), (5, None), (6, 7), (7, 1), (7, 1), (9999, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0.5 AS score", "1 AS label", "'x' AS slots").repartition(5),
            spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "1 AS label", "'y' AS text"))


def test_learns_and_scores_every_row(spark):
    docs, labels = rows_of(spark)
    model = quality.train(docs, labels.where(~quality.held_out()))
    got = quality.score(docs, model).join(labels.where("doc_id < 400 AND quality IN (0, 1)").select("doc_id", "quality").distinct(), "doc_id", "left").collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = [r for r in got if r.quality is not None]
    assert sum(r.predicted == r.quality for r in known) >= 0.97 * len(known)
    assert {r.score for r in got if r.doc_id == 1000} == {r.score for r in got if r.doc_id == 1001}
    assert [r.predicted for r in got if r.doc_id in (None, 1002)] == [1, 1]
    again = quality.train(docs.repartition(2), labels.where(~quality.held_out()))
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.output, again.output)
    assert quality.score(docs.limit(0), model).collect() == []


def test_scores_are_the_softmax_of_the_mean(spark):
    docs, labels = rows_of(spark)
    model = quality.train(docs, labels, sample=50, steps=100)
    for r in quality.score(docs.where("doc_id < 20"), model).join(docs.where("doc_id < 20").select("doc_id", "text"), "doc_id").collect():
        if r.doc_id == 3:
            continue
        slots = np.concatenate([s for _, s in quality.features([r.text])])
        logits = model.output @ model.vectors[slots].astype(float).mean(axis=0) + model.bias
        assert r.score == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), rel=1e-9)


def test_nothing_learned(spark):
    docs, labels = rows_of(spark)
    model = quality.train(docs, labels.limit(0))
    empty = [r.score for r in quality.score(docs.where("doc_id IN (1000, 1001)"), model).collect()]
    assert empty == [0.5, 0.5]


def test_held_out_accuracy(spark, folder):
    from tidewatch.llm.queries import op13_quality_classifier

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op13_quality_classifier(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.85 * len(rows)       # some sixty labels

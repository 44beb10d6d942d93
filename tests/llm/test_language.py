import numpy as np

from tidewatch.llm import language

EN = "the thing that they thought about whether there was another weather "
DE = "und der die das nicht über schließlich zwischen ungefähr müssen "


def model_of(spark):
    rows = [(1, EN * 5, "en"), (2, DE * 5, "de"), (3, None, "en"), (4, "x", None), (5, "", "fr")]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixtures(spark):
    model = model_of(spark)
    assert model.languages == ["de", "en"]                     # no text of "fr" has a letter
    rows = [(1, EN), (1, EN), (2, DE * 3), (None, EN.upper()), (3, None), (4, ""), (5, "12 34 !"), (6, EN * 9 + DE * 4), (7, EN * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'de' AS lang", "'x' AS lang_pred", "1 AS score")
    got = {(r.doc_id, r.lang_pred): (r.score, r.languages) for r in language.predict(df, model).collect()}
    assert {k[1] for k in got if k[0] in (3, 4, 5)} == {"und"} and (1, "en") in got and (None, "en") in got and (2, "de") in got
    score, named = got[6, "en"]
    assert abs(score - len(EN) * 9 / (len(EN) * 9 + len(DE) * 4)) < 0.06 and named.startswith("en:") and "de:" in named
    assert all(0 <= s <= 1 for s, _ in got.values())
    assert language.predict(df.limit(0), model).collect() == []
    assert {r.doc_id for r in language.keep_known(df, model).collect()} == {1, 2, None, 6, 7}


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert language.predict(df, language.train(df)).first().lang_pred == "und"


def test_one_language_is_exact():
    """Leaving out the search when the bound forbids a second language gives what the search gives."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        likelihood = rng.normal(-100, rng.choice([0.5, 5, 30]), (rng.integers(1, 9), 3))
        found = language.mixture(likelihood)
        best = int(np.argmax(likelihood.sum(axis=0)))
        price = language.PRICE * np.log(max(2, len(likelihood)))
        gains = [language.fit(likelihood, [best, k])[1] - likelihood.sum(axis=0)[best] for k in range(3) if k != best]
        assert (len(found) == 1) == (max(gains) <= price)
        assert abs(sum(found.values()) - 1) < 1e-9


def test_pieces_join(monkeypatch):
    text = "Ab, cd 12 éf " * 50
    whole = np.concatenate(list(language.trigrams(text)))
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.array_equal(whole, np.concatenate(list(language.trigrams(text))))


def test_held_out_accuracy(spark, folder):
    from tidewatch.llm.queries import op6_language_mixture

    got = op6_language_mixture(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def plain_trigrams(text):
    signs, out = " ", []
    for c in text + " ":
        c = c.lower()[0] if c.isalpha() else " "
        if not (c == " " and signs[-1] == " "):
            signs += c
    return [signs[i:i + 3] for i in range(len(signs) - 2)]


def plain_inference(text, counts):
    """The language set by penalised likelihood, grown greedily, with shares by expectation-maximisation, all in plain loops."""
    from math import exp, log

    names = sorted(counts)
    chance = {x: lambda t, c=counts[x], n=sum(counts[x].values()): log((c.get(t, 0) + language.SMOOTH) / (n + language.SMOOTH * language.SLOTS)) for x in names}
    grams = plain_trigrams(text)
    parts = [grams[i:i + language.WINDOW] for i in range(0, len(grams), language.WINDOW)]
    like = [{x: sum(chance[x](t) for t in part) for x in names} for part in parts]

    def em(chosen):
        share = {x: 1 / len(chosen) for x in chosen}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(chosen, 0.0)
            for w in like:
                top = max(w[x] for x in chosen)
                total = sum(share[x] * exp(w[x] - top) for x in chosen)
                for x in chosen:
                    new[x] += share[x] * exp(w[x] - top) / total / len(like)
            moved, share = max(abs(new[x] - share[x]) for x in chosen), new
            if moved < 1e-6:
                break
        reached = sum(log(sum(share[x] * exp(w[x] - max(w[y] for y in chosen)) for x in chosen)) + max(w[y] for y in chosen) for w in like)
        return share, reached

    chosen = [max(names, key=lambda x: (sum(w[x] for w in like), -names.index(x)))]
    share, reached = {chosen[0]: 1.0}, sum(w[chosen[0]] for w in like)
    while len(chosen) < len(names):
        tries = [(em([*chosen, x]), x) for x in names if x not in chosen]
        (new, value), x = max(tries, key=lambda t: (t[0][1], -names.index(t[1])))
        if value - reached <= language.PRICE * log(max(2, len(like))):
            break
        chosen, share, reached = [*chosen, x], new, value
    return share


def test_against_plain_inference(spark):
    """Counts, windows, shares and language sets are those of plain loops over strings."""
    import random

    rng = random.Random(4)
    words = {"xx": "abra cada bra dabra".split(), "yy": "mona lona pono mola".split(), "zz": "zikzi kizik kiki zizki abra".split()}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    train = [(k, say(x, 30), x) for k, x in enumerate(list(words) * 6)]
    counts = {}
    for _, text, x in train:
        for t in plain_trigrams(text):
            counts.setdefault(x, {}).setdefault(t, 0)
            counts[x][t] += 1
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    texts = [say("xx", 40), say("yy", 60) + ". " + say("zz", 50), " ".join(say(x, 45) for x in words), "abra", say("zz", 3) + say("xx", 200),
             "Mona-Lona 12 pono!", say("yy", 5) + " qq ww"]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        want = plain_inference(text, counts)
        named = dict(part.split(":") for part in got[k].languages.split(","))
        assert set(named) == set(want) and all(abs(float(named[x]) - want[x]) < 2e-3 for x in want), (text, named, want)
        assert want[got[k].lang_pred] > max(want.values()) - 1e-3

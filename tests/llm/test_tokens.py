import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import mph, tokens
from tidewatch.session import scratch

PATH = tokens.default_vocabulary()


def plain(text):
    tool = tokens.Encoder.of(PATH, True).tool
    return tool.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0'sStTé̸́ΣσςİKÅ<|>endoftext3½"),
                         st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_by_word_equals_whole_text(text):
    assert np.frombuffer(tokens.Encoder.of(PATH, True).ids_of([text.encode()])[0], "<u2").tolist() == plain(text)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 50, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        index = mph.Index(*mph.build(keys))
        assert sorted(index.slots(keys)) == list(range(len(keys)))


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["of", "Été", "x,y.", "ß12", "🙂 z"]) for _ in range(rng.randrange(60)))) for k in range(400)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (None, None), (1000, None), (1001, ""), (-5, "word " * 40_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'x' AS path", "2 AS start")
    folder = scratch(spark, "t")
    manifest = tokens.write_shards(df.repartition(5), folder, PATH, shard_bytes=30_000)
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_back(manifest).collect())
    assert manifest.count() > 3 and len(got) == len(rows)
    want = sorted(((k if k is not None else -99), len(plain(t or "")) + 1, zlib.crc32(np.array(plain(t or "") + [1], "<u4").tobytes())) for k, t in rows)
    assert sorted((a, c, d) for a, _, c, d in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(r[0] for r in got if r[0] == -99) + sorted(r[0] for r in got if r[0] != -99)
    found = tokens.look_up(manifest, spark.createDataFrame([(7,), (1001,), (5_000,), (-5,), (None,)], "key long")).collect()
    assert {(r.key, r.copies, r.n_tokens) for r in found} == {(7, 3, found[[r.key for r in found].index(7)].n_tokens), (1001, 1, 1), (-5, 1, 40_001)}


def test_empty_table(spark):
    assert tokens.token_shards(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_text_mode():
    whole = tokens.Encoder.of(PATH, False)
    assert np.frombuffer(whole.ids_of(["Some té xt".encode()])[0], whole.kind).tolist() == plain("Some té xt")


def test_strings_of_added_tokens():
    """The ids of a tokenizer as its file makes it, also where a text spells one of its added tokens."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    names = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert names
    texts = ["end <|endoftext|> start", *[f(n) for n in names for f in (str, str.upper, lambda n: f"End,{n}. É {n}{n} x", lambda n: f"a{n.title()}b {n}", lambda n: n[:-1])]]
    for by_blank in (True, False):
        for text in texts:
            got = np.frombuffer(tokens.Encoder.of(PATH, by_blank).ids_of([text.encode()])[0], "<u2").tolist()
            assert got == fresh.encode(text, add_special_tokens=False).ids, text


def test_texts_together_are_texts_apart():
    encoder = tokens.Encoder(PATH, True)
    texts = ["Stone stone garden.", "", "garden, stone <|endoftext|> x", "über Stone 中文 garden", "stone " * 50, "a" * 200 + " b", "b"]
    apart = [tokens.Encoder(PATH, True).ids_of([t.encode()])[0] for t in texts]
    assert [i for run in tokens.together([t.encode() for t in texts], 30) for i in encoder.ids_of(run)] == apart
    assert [np.frombuffer(a, "<u2").tolist() for a in apart] == [plain(t) for t in texts]
    assert [len(r) for r in tokens.together([b"x" * n for n in (5, 5, 50, 5, 25, 1)], 30)] == [2, 1, 2, 1]


def test_kept_words_go_with_another_kind_of_task():
    from tidewatch.llm import text

    encoder = tokens.Encoder.of(PATH, True)
    encoder.ids_of([b"stone garden"])
    assert encoder.known and text.KEPT[tokens.ENCODER]
    text.drop_kept(tokens.ENCODER)
    assert encoder.known
    text.drop_kept(None)
    assert not encoder.known and not encoder.older


def test_plain_words_go_to_the_model_itself():
    """op1: new words of a-z went through normalizer and pre-tokenizer, which took most of the time; ids stay the same."""
    encoder = tokens.Encoder(PATH, True)
    seen, each = [], encoder.each
    encoder.each = lambda words: seen.extend(words) or each(words)
    texts = ["Plain words, and l'eau.", "café. déjà, ». …. 1. x.. H̱ello T̈. İx İ. ×. ÷, ÿ.", "z" * 300]
    got = encoder.ids_of([t.encode() for t in texts])
    assert [np.frombuffer(g, encoder.kind).tolist() for g in got] == [plain(t) for t in texts]
    assert not [w for w in seen if w.isascii() and w.isalpha()]
    assert "café" in seen and "café." not in seen


def test_a_tokenizer_that_cuts_letters_is_asked_as_a_whole():
    from tokenizers import Regex, pre_tokenizers

    encoder = tokens.Encoder(PATH, True)
    assert encoder.model is not None
    encoder.tool.pre_tokenizer = pre_tokenizers.Split(Regex("zq"), "isolated")
    assert not encoder._whole()


def test_kept_words_are_few():
    """pipeline: kept words took a worker's memory past its share."""
    assert tokens.CACHE_WORDS <= 250_000

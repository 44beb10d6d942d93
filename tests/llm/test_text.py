import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import text

LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text("aAbZ \n\t\x0b\x00\x1cé9_[🙂", max_size=12), max_size=8))
def test_words(rows):
    for table, split in ((text.BLANK_WORDS, lambda b: b.lower().split()), (text.LETTER_WORDS, lambda b: LETTERS.findall(b.lower()))):
        plain = [split((r or "").encode()) for r in rows]
        seen, got = {}, {}
        for first, ids, bounds in text.word_columns(pa.array(rows, pa.string()), table):
            for k in range(len(bounds) - 1):
                got[first + k] = ids[bounds[k]:bounds[k + 1]].tolist()
        assert [len(got[k]) for k in range(len(rows))] == [len(p) for p in plain]
        for k, words in enumerate(plain):
            for word, value in zip(words, got[k]):
                assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words(monkeypatch):
    rows = ["one two " * 300, "x" * 700 + " y", "a", None, "two " * 9]
    whole = [i.tolist() for _, ids, b in text.word_columns(pa.array(rows), text.BLANK_WORDS) for i in np.split(ids, b[1:-1])]
    monkeypatch.setattr(text, "SLICE", 64)
    cut = [i.tolist() for _, ids, b in text.word_columns(pa.array(rows), text.BLANK_WORDS) for i in np.split(ids, b[1:-1])]
    assert whole == cut and [len(w) for w in whole] == [600, 2, 1, 0, 9]


def test_sets():
    rows = ["a b c d e f a b c d e", "A B", "", None, "a  b\nc d e"]
    assert [len(s) for s in text.shingle_sets(pa.array(rows))] == [6, 1, 0, 0, 1]
    assert len(np.intersect1d(*[list(text.shingle_sets(pa.array(rows)))[k] for k in (0, 4)])) == 1

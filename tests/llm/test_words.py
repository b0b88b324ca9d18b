"""The Arrow tokeniser and the marks of words."""

import re

import pyarrow as pa

from lumenry.llm.words import tokenised, word_marks, word_sets


def plain(text):
    return re.sub(r"[^a-z0-9\s']", "", text.lower()).split()


def test_tokenised_as_plain_python():
    texts = ["T-shirt 2's!", "café au lait", "", "   ", "?!", "a b", "x\ny\tz", "…", "ÀÉ word", "it’s", "a" * 100]
    assert tokenised(pa.array([*texts, None])).to_pylist() == [*map(plain, texts), []]
    assert tokenised(pa.array([], pa.string())).to_pylist() == []


def test_marks_of_beginnings():
    words = ["harbour", "harb", "h", "x" * 70]
    marks, begun = word_marks(words)
    found = {(words[i], int(m)) for at, ms in begun for i, m in zip(at, ms)}
    assert ("harbour", int(marks[1])) in found and ("harbour", int(marks[2])) in found and ("harb", int(marks[2])) in found
    assert len(set(marks.tolist())) == 4


def test_word_sets_are_equal_for_equal_words():
    texts = ["b a c a", "C, b! A", "", None, "a b", "?!", "x" * 90 + " y", "y " + "x" * 90]
    found = word_sets(pa.array(texts)).to_pylist()
    assert [sorted(f.split()) for f in found] == [sorted(set(plain(t or ""))) for t in texts]
    assert found[0] == found[1] and found[6] == found[7] and word_sets(pa.array([None, ""], pa.string())).to_pylist() == ["", ""]

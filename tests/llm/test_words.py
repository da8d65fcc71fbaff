import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm.words import Words, distinct_by_text

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aB1 _图表\n.é", max_size=40)), max_size=6))
def test_words_are_those_of_the_definition(texts):
    w = Words(texts)
    for i, t in enumerate(texts):
        low = (t or "").lower()
        spans = [m.span() for m in WORD.finditer(low)]
        a, b = w.offsets[i], w.offsets[i + 1]
        assert b - a == len(spans)
        assert [(int(x - w.starts[i]), int(y - w.starts[i])) for x, y in zip(w.at[a:b], w.end[a:b])] == spans


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab图 ", max_size=30), max_size=5))
def test_equal_words_have_equal_hashes_and_grams_follow(texts):
    w = Words(texts)
    seen = {}
    for i, t in enumerate(texts):
        for word, h in zip(WORD.findall(t.lower()), w.hashes[w.offsets[i] : w.offsets[i + 1]]):
            assert seen.setdefault(word, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)
    grams, at = distinct_by_text(*w.grams(2))
    for i, t in enumerate(texts):
        own = WORD.findall(t.lower())
        assert at[i + 1] - at[i] == len(set(zip(own, own[1:])))

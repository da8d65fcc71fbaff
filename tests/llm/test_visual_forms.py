import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm.visual_forms import same_look_pairs, visual_form, visual_forms, with_visual_form

SAME = [("Ｗｈｏ？", "Who?"), ("café", "café"), ("ﬁle", "file"), ("асе", "ace"), ("a​b­", "ab"), (" a　 b\n", "a b"), ("⾥", "里"), ("⻓", "长"), ("4‐step", "4-step"), ("e​́", "é")]
OTHER = [("Who", "who"), ("café", "cafe"), ("2", "²"), ("3", "③"), ("why?", "why!"), ("…", "?"), ("a b", "ab")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert visual_form(a) == visual_form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert visual_form(a) != visual_form(b)


def test_nothing_shown_and_folding():
    assert visual_form(None) is None and visual_form("") is None and visual_form("​ 　") is None
    assert visual_form("Straße", fold=True) == visual_form("STRASSE", fold=True)
    assert visual_form(visual_form("Ｗｈｏ")) == visual_form("Who")


def test_pairs_and_columns(spark):
    rows = [(1, "Who", "x"), (2, "Ｗho", "x"), (3, "Who", "x"), (3, "Who", "x"), (4, "who", "x"), (5, None, "x"), (6, " ", "x"), (None, "Ｗho", "x"), (7, "a" * 30_000, None), (8, "a" * 29_999 + "а", None)]
    df = spark.createDataFrame(rows, "question_id long, original_query string, form string")
    got = {(r.key_a, r.key_b) for r in same_look_pairs(df, "question_id", "original_query").collect()}
    assert got == {(1, 2), (2, 3), (7, 8)}
    out = with_visual_form(df, "original_query")
    assert out.count() == len(rows) and out.columns == ["question_id", "original_query", "form", "visual_form", "visual_folded"]
    assert same_look_pairs(df.limit(0), "question_id", "original_query").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text("e\u0301\u200b \uffffАﬁ", max_size=8)), min_size=1, max_size=5))
def test_a_batch_gives_what_each_text_gives(texts):
    assert visual_forms(texts) == [visual_form(t) for t in texts]
    assert visual_forms(texts, fold=True) == [visual_form(t, fold=True) for t in texts]
    once = visual_forms(texts)
    assert visual_forms(once) == once

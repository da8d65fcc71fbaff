import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.llm.splitting import boundaries, split_oversized, split_text


def check(text, limit, overlap):
    cut = split_text(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(cut, cut[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b, _ in cut)
    return cut


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n#。\ŕ", min_size=0, max_size=600), st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_the_text_within_limit_and_overlap(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_stand_at_the_strongest_boundary_of_the_window():
    topic = lambda w: " ".join(f"{w}{k % 7}" for k in range(150)) + ". "
    text = topic("a") + "\n\n" + topic("b") + "\n\n# Next\n\n" + topic("c") + "\n\n" + topic("d")
    kinds = boundaries(text)
    assert kinds[text.index("# Next")] == "heading"
    cut = check(text, 1000, 100)
    assert cut[0][2] in ("paragraph", "heading")


def test_a_text_without_boundaries_is_cut_at_the_limit():
    assert [(a, b) for a, b, _ in split_text("x" * 2500, 1000, 100)] == [(0, 1000), (900, 1900), (1800, 2500)]
    assert check("\U0001f600" * 7000, 6000, 960)[0][1] == 6000


def test_table(spark):
    rng = random.Random(0)
    long = "\n\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(80)) + "." for _ in range(40))
    rows = [(1, "a", long, ["S"], "x"), (2, "a", long, ["T"], "x"), (3, "b", "short", None, "x"), (4, "c", None, None, None), (5, None, long, None, None), (6, "d", long, None, "x"), (7, "e", "y" * 6000, [], "x")]
    df = spark.createDataFrame(rows, "id long, key string, t string, path array<string>, piece string")
    out = split_oversized(df, F.col("key"), F.col("id"), F.col("t"), F.col("path")).toPandas().sort_values(["key", "piece"])
    assert set(out.key) == {"a", "d"}
    for _, f in out.groupby("key"):
        assert (f.pieces == len(f)).all() and f.char_start.iloc[0] == 0 and f.char_end.iloc[-1] == len(long)
        assert all(long[a:b] == c for a, b, c in zip(f.char_start, f.char_end, f.content)) and (f.boundary.iloc[:-1] == "paragraph").all()
    assert list(out[out.key == "a"].section_path.iloc[0]) == ["S"]
    assert split_oversized(df.limit(0), F.col("key"), F.col("id"), F.col("t"), F.col("path")).count() == 0


def test_a_deep_valley_at_a_paragraph_beats_a_heading_inside_a_topic():
    topic = lambda w: " ".join(f"{w}{k % 7}" for k in range(70)) + "."
    text = f"{topic('a')}\n\n{topic('a')}\n\n{topic('b')}\n\n# More\n\n{topic('b')}\n\n{topic('b')}\n\n{topic('b')}"
    valley, heading = text.index("b0"), text.index("# More")
    limit = heading + 40
    assert valley > limit // 2 and boundaries(text)[valley] == "paragraph"
    assert check(text, limit, 0)[0][1:] == (valley, "paragraph")
    plain = f"{topic('a')}\n\n{topic('a')}\n\n{topic('a')}\n\n# More\n\n{topic('a')}\n\n{topic('a')}"
    assert check(plain, plain.index("# More") + 40, 0)[0][2] == "heading"

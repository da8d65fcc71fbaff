import random

from chunkloom.llm.reading_level import level_profile, prose, reading_levels

EASY = ["cat", "dog", "sun", "box", "red", "run", "sit", "big"]
HARD = ["epistemological", "parameterization", "incommensurable", "heterogeneity", "operationalize", "disambiguation"]
MIDDLE = ["record", "index", "answer", "summary", "compare", "section"]


def text(rng, level, n=12):
    mix = {1: (1, 0, 0), 2: (0.5, 0.5, 0), 3: (0, 1, 0), 4: (0, 0.5, 0.5), 5: (0, 0, 1)}[level]
    words = lambda: rng.choice(rng.choices([EASY, MIDDLE, HARD], mix)[0])
    return " ".join((" ".join(words() for _ in range(4 + 2 * level))).capitalize() + "." for _ in range(n))


def test_prose_leaves_out_what_is_not_prose():
    got = prose("# Head\n\nOne short line.\n\n```\ncode here\n```\n\n| a | b |\n|---|---|\n\n- An item [label](http://x.y/z) here\n- Next https://a.b/c\n\nWrapped\nline of text. 第一句。第二句。")
    assert got == ["One short line.", "An item label here", "Next", "Wrapped\nline of text." if "Wrapped\nline of text." in got else "Wrapped line of text.", "第一句。", "第二句。"]


def test_levels_on_held_out_documents(spark):
    rng = random.Random(1)
    levels = [rng.randint(1, 5) for _ in range(300)]
    docs = [(k, text(rng, v), "clash") for k, v in enumerate(levels)] + [(900, None, ""), (901, "", ""), (902, "```\nx\n```", ""), (903, text(rng, 5, 3000), "")]
    labels = [(k, v, "r", None) for k, v in enumerate(levels[:200])] + [(0, levels[0], "r", None), (1, None, "r", None), (5000, 3, "r", None), (None, 2, "r", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, level string")
    g = spark.createDataFrame(labels, "doc_id long, reading_level int, rater string, rated_at timestamp")
    out = {r.doc_id: r for r in reading_levels(d, g).collect()}
    assert len(out) == len(docs)
    held = range(200, 300)
    assert sum((out[k].demanding >= 0.5) == (levels[k] >= 4) for k in held) >= 90
    assert out[900].level == out[901].level == out[902].level == 0 and out[900].demanding == 0 and out[903].level == 5
    assert reading_levels(d, g.limit(0)).count() == reading_levels(d.limit(0), g).count() == 0


def test_profile(spark):
    levels = spark.createDataFrame([(1, 10, 4), (2, 20, 4), (3, 0, 0), (4, 5, 1)], "doc_id long, words int, level int")
    docs = spark.createDataFrame([(1, "a", "EN"), (2, "a", "en-US"), (3, None, None), (4, "a", "中文"), (None, "a", "en")], "doc_id long, domain string, lang string")
    got = {(r.domain, r.language, r.level, r.documents, r.words) for r in level_profile(levels, docs).collect()}
    assert got == {("a", "en", 4, 2, 30), ("unknown", "und", 0, 1, 0), ("a", "zh", 1, 1, 5)}

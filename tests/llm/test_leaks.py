import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm.leaks import leaked_items, myers_distance

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for t in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != t), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=64), st.lists(st.integers(1, 4), max_size=80))
def test_bit_parallel_distance_is_the_edit_distance(pattern, text):
    got = myers_distance(np.array([pattern] * 2, np.uint64), np.array([text] * 2, np.uint64).reshape(2, len(text)))
    assert list(got) == [distance(pattern, text)] * 2


def brute(docs, items):
    out = set()
    for item, text, lang in items:
        run = 32 if lang == "zh" else 16
        words = WORD.findall((text or "").lower())
        windows = {tuple(words[k : k + run]) for k in range(len(words) - run + 1)}
        for doc, body in docs:
            own = WORD.findall((body or "").lower())
            if any(tuple(own[k : k + run]) in windows for k in range(len(own) - run + 1)):
                out.add((doc, item))
    return out


def test_found_is_what_brute_force_finds(spark):
    rng = random.Random(5)
    word = lambda: rng.choice([f"w{k}" for k in range(60)] + list("图表里长"))
    items = [(k, " ".join(word() for _ in range(rng.randint(10, 70))), rng.choice(["en", "zh", None])) for k in range(30)]
    items += [(90, None, "en"), (91, "", "en"), (92, items[0][1], "en"), (92, items[0][1], "en"), (None, items[0][1], "en")]
    docs = [(0, None), (1, ""), (2, items[0][1])]
    for k in range(3, 80):
        source = rng.choice(items[:30])[1].split()
        a, n = rng.randrange(len(source)), rng.choice([8, 15, 16, 17, 20, 31, 32, 40])
        docs.append((k, " ".join([*(word() for _ in range(rng.randint(0, 20))), *source[a : a + n], *(word() for _ in range(5))]).replace(" w", rng.choice([" w", "\n_w", ", W"]))))
    d = spark.createDataFrame([(*x, "clash") for x in docs] + [(2, items[0][1], "clash")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, lang string")
    rows = leaked_items(d, i).collect()
    want = brute(docs, [x for x in items if x[0] is not None])
    assert {(r.doc_id, r.item_id) for r in rows if r.distance == 0} == want and len(want) > 10
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    assert leaked_items(d.limit(0), i).count() == leaked_items(d, i.limit(0)).count() == 0


def test_one_edit_is_within_the_budget(spark):
    words = [f"w{k}" for k in range(16)]
    edits = {1: [*words[:3], "x", *words[4:]], 2: words[:12] + words[13:], 3: [*words[:5], "x", *words[5:]], 4: [*words[:3], "x", *words[4:9], "y", *words[10:]]}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in edits.items()], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words), "en")], "item_id long, text string, lang string")
    assert {(r.doc_id, r.distance) for r in leaked_items(d, i).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_one_edit_is_found_wherever_the_passage_begins(spark):
    docs, items = [], []
    for lang, run in (("en", 16), ("zh", 32)):
        words = [f"{lang}{k}" for k in range(3 * run)]
        items.append((run, " ".join(words), lang))
        for start in range(2 * run + 1):
            for at in (0, 3, run // 2, run - 1):
                passage = words[start : start + run]
                edited = [[*passage[:at], "x", *passage[at + 1 :]], passage[:at] + passage[at + 1 :], [*passage[:at], "x", *passage[at:]]]
                docs += [(len(docs) + k, " ".join(["a", *e, "b"]), run) for k, e in enumerate(edited)]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string, lang string")
    rows = leaked_items(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, run) for k, _, run in docs}
    assert all(r.distance <= 1 for r in rows)

import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import byte_pairs, token_counts

needs = pytest.mark.skipif(not os.path.exists(byte_pairs.VOCABULARY), reason="no tokenizer files")


def brute(pieces, text):
    best = {0: (0.0, 0)}
    table = dict(pieces)
    for i in range(len(text)):
        here = best[i]
        options = [(p, s, 1) for p, s in table.items() if text.startswith(p, i)]
        if text[i] not in table:
            size = len(text[i].encode())
            options.append((text[i], token_counts.BYTE_SCORE * size, size))
        for p, s, n in options:
            new = (here[0] + s, here[1] + n)
            if i + len(p) not in best or new[0] > best[i + len(p)][0] + 1e-12:
                best[i + len(p)] = new
    return best[len(text)][1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ", max_size=14))
def test_count_only_viterbi_equals_the_best_path(text):
    pieces = [(p, -math.log(k + 2.3)) for k, p in enumerate(["a", "b", "▁", "ab", "abc", "▁a", "ba", "bab", "▁ab", "c"])]
    joined = token_counts.SPACE + text.replace(" ", token_counts.SPACE)
    assert token_counts.Counter(token_counts.DoubleArray(pieces)).text(text) == (brute(pieces, joined) if text else 0)


@needs
def test_estimate_is_close_to_the_tokenizer(spark):
    import sentencepiece

    texts = ["The shared sections improve the big tokens outside the main index.", "在多数小项目里，长的片段改进稳定的清单。", "Les mesures stables remplacent les synthèses vérifiées.", "x = {'a': 1}\n\nprint(x)"] * 5
    rows = [(f"c{k}", k, f"d{k % 3}", ["en", "EN", None, "zh-Hans"][k % 4], t, 1) for k, t in enumerate(texts)]
    rows += [("c0", 99, "d9", "de", texts[0], 1), ("n", 100, None, None, None, 1), ("e", 101, "d0", "en", "", 1), (None, 102, "d0", "en", "x", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, ord long, document_id string, lang string, text string, tokens int")
    counted = token_counts.record_tokens(df)
    got = {r.chunk_id: r for r in counted.collect()}
    assert len(got) == 22 and got["n"].tokens == got["e"].tokens == 0 and got["c0"].document_id == "d0" and got["n"].language == "und"
    exact = sum(len(x) for x in sentencepiece.SentencePieceProcessor(model_file=token_counts.VOCABULARY).encode(texts))
    assert abs(sum(r.tokens for r in got.values()) / exact - 1) < 0.08
    catalog = spark.createDataFrame([("d0", "x", 1), ("d0", "x", 1), ("d1", None, 1)], "document_id string, domain string, tokens int")
    slices = token_counts.slice_tokens(counted, catalog).collect()
    total = sum(r.tokens for r in got.values())
    for name in ("document", "language", "domain", "document and language"):
        assert sum(r.tokens for r in slices if r["slice"] == name) == total
    assert {r.domain for r in slices if r["slice"] == "domain"} == {"x", "unknown"}
    assert token_counts.slice_tokens(token_counts.record_tokens(df.limit(0)), catalog).count() == 0


@needs
@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aab bc 的图\n'st<|>", max_size=60)))
def test_ids_are_those_of_the_tokenizer(text):
    import base64

    import tiktoken

    global _pair
    if "_pair" not in globals():
        with open(byte_pairs.VOCABULARY, "rb") as f:
            data = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _pair = byte_pairs.PairIndex(data), tiktoken.Encoding("own", pat_str=byte_pairs.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert list(_pair[0].encode([text])[0]) == _pair[1].encode_ordinary(text)


@needs
def test_rows_of_ids(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "<|endoftext|>", 5), (3, "<|endoftext|>", 5), (4, long, 5)], "doc_id long, text string, ids int")
    out = byte_pairs.byte_pair_ids(df).collect()
    ids = {r.doc_id: list(r.ids) for r in out}
    assert len(out) == 5 and ids[1] == ids[2] == [] and len(ids[3]) > 1 and len(ids[4]) == 50_001
    assert byte_pairs.byte_pair_ids(df.limit(0)).count() == 0

import importlib.util
import math
import random
import re
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__
from chunkloom.functions import text as T
from chunkloom.operators import context, lexical, resolve, sequences, vectors
from chunkloom.plans import registry
from chunkloom.sources import tables

DATA = Path("/root/testdata/sf0.001")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(x):
        if x is None or x != x:
            return "~"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, str(DATA))
    oracle.execute(registry.SQL[name])
    columns = [d[0] for d in oracle.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(oracle.fetchall(), columns)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry_and_names():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(registry.QUERIES) <= set(names)
    if importlib.util.find_spec("chunkloom.llm") is None:
        assert set(names) == set(registry.QUERIES)


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokens_and_labels(spark):
    assert one(spark, T.tokens(F.col("t")), t="Step-Back 0.2369 v2") == ["step", "back", "0.2369", "v", "2"]
    label = lambda t: one(spark, T.visual_labels(F.col("t")), t=t)
    assert label("Table 2 vs 图1 and Fig. 2") == ["table:2", "figure:2", "figure:1"]
    assert label("Table 0") == [] and label("Table IV") == ["table:4"] and label("Fig. mix") == ["figure:1009"] and label("图3和表2") == ["figure:3", "table:2"]
    for numeral, value in {"IIII": 4, "VX": 5, "MCM": 1900}.items():
        assert one(spark, T.roman(F.col("t")), t=numeral) == value
    assert one(spark, T.squeezed(F.col("t")), t=" a　 b\n") == "a b"
    assert label("Figure. 3, tab.4 and Figures 5") == ["figure:3", "table:4"]
    assert one(spark, T.citation_ids(F.col("t")), t="[S1, S2][S9](S3)") == ["S1", "S2", "S9"]
    assert one(spark, T.citation_ids(F.col("t")), t="[S1；S2] [ S3、S4 ] [S5; key] [0]") == ["S1", "S2", "S3", "S4"]
    assert one(spark, T.code_identifiers(F.col("t")), t="中Max_tokens用 GraphRAG, a.b.c and 'top_k' `name` x1") == ["Max_tokens", "top_k", "a.b.c", "GraphRAG", "name"]
    assert one(spark, T.unquoted(F.col("t")), t="a 'b c' 《d》 \"e\"") == "a     \"e\""
    assert one(spark, T.completeness_hints(F.col("t")), t="Not more than the final step") == "negation,comparison,order"
    assert one(spark, T.words(F.col("t")), t="Straße 12a, 资料 x_y") == ["straße", "12a", "资", "料", "x", "y"]


def test_ordinals(spark):
    got = one(spark, T.ordinals(F.col("t")), t="第 3 位、第十二名、第二十章、第三十五、第两、第一二三四 Top rank, SECOND place 榜首")
    assert got == [3, 12, 20, 35, 2, 1, 2, 1]


def test_occurrences_stand_free_and_may_overlap(spark):
    at = lambda t, s: one(spark, T.occurrences(F.col("t"), F.col("s")), t=t, s=s)
    assert at("RAG and GraphRAG, RAG_x, RAG", "RAG") == [1, 26]
    assert at("a a a", "a a") == [1, 3] and at("", "a") == [] and at("a", "") == []
    assert one(spark, F.coalesce(F.size(T.occurrences(F.col("t"), F.col("s"))), F.lit(-7)), t=None, s="a") in (-1, -7)


def test_citation_check(spark):
    rows = spark.createDataFrame([(1, "[S1, S2][S9](S3)", ["S1", "S2", "S3"]), (2, None, ["S1"])], "id long, answer string, known array<string>")
    r = {x.id: x for x in context.citation_check(rows).collect()}
    assert (r[1].used, r[1].unknown, r[1].unused) == ("S1,S2,S9", "S9", "S3")


def test_fusion_is_the_mean_of_what_is_there(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q long, id string, rank int")
    b = spark.createDataFrame([(1, "a", 3)], "q long, id string, rank int")
    got = {r.id: r.score for r in vectors.fused(a, b, ["q", "id"]).collect()}
    assert got["a"] == pytest.approx((1 / 61 + 1 / 63) / 2, abs=1e-9) and got["b"] == pytest.approx(1 / 62, abs=1e-9)


def test_supplement_appends_and_never_reorders(spark):
    hits = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "query_id long, id string, rank int")
    more = spark.createDataFrame([(1, "c2", 9.0), (1, "c9", 8.0), (1, "c5", 7.0), (1, "c7", 6.0), (2, "c1", 1.0)], "query_id long, id string, score double")
    got = [(r.query_id, r.id, r["rank"]) for r in vectors.supplemented(hits, more, cap=4).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1", 1), (1, "c2", 2), (1, "c9", 3), (1, "c5", 4), (2, "c1", 1)]
    ranks = {(r.query_id, r.id): (r.source, r.lexical_rank) for r in vectors.supplemented(hits, more, cap=4).collect()}
    assert ranks == {(1, "c1"): ("vector", None), (1, "c2"): ("vector", 1), (1, "c9"): ("lexical", 2), (1, "c5"): ("lexical", 3), (2, "c1"): ("lexical", 1)}


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, k + 1, k, c) for k, c in enumerate([50, 70, 40, 10])], "case_id long, rank int, id long, cost long")
    assert sorted(r["rank"] for r in context.packed_greedy(rows, 100).collect()) == [1, 3, 4]


@pytest.mark.parametrize("sizes,want", [([100, 100, 50], [254]), ([300, 100], [402]), ([300, 300], [300, 300]), ([50], [50]), ([100, 200, 300, 10], [302, 312])])
def test_thin_merge(spark, sizes, want):
    rows = spark.createDataFrame([(1, "\n\n".join("x" * n for n in sizes))], "doc_id long, text string")
    assert [r.chars for r in sequences.merged_thin(rows).orderBy("n").collect()] == want


def test_overlapping_spans_cover_and_share(spark):
    rng = random.Random(4)
    sizes = [(k, rng.randint(0, 3000)) for k in range(40)]
    spans = sequences.overlapping_spans(spark.createDataFrame(sizes, "id long, n int"), limit=200, overlap=60).collect()
    for k, n in sizes:
        own = sorted((r.start, r.stop) for r in spans if r.id == k)
        assert own[0][0] == 0 and own[-1][1] == n and all(b - a <= 200 for a, b in own)
        assert all(0 <= b - c <= 60 for (_, b), (c, _) in zip(own, own[1:]))
    assert sequences.overlapping_spans(spark.createDataFrame([], "id long, n int"), limit=200, overlap=60).count() == 0


def test_maximal_spans(spark):
    rows = spark.createDataFrame([("a", 0, 3, 1), ("a", 1, 2, 2), ("a", 4, 6, 3), ("a", 4, 6, 4)], "id string, start int, stop int, tie int")
    assert sorted((r.start, r.stop, r.tie) for r in sequences.maximal_spans(rows).collect()) == [(0, 3, 1), (4, 6, 3)]


def test_interval_containment_over_cells(spark):
    spans = spark.createDataFrame([("a", 5, 9), ("a", 5, 30), ("b", 5, 9)], "id string, start long, stop long")
    claims = spark.createDataFrame([("a", 0, 20), ("a", 4, 10)], "id string, start long, stop long")
    got = {(r.id, r.start, r.stop): r.proven for r in context.covered(spans, claims, 8).collect()}
    assert got == {("a", 5, 9): True, ("a", 5, 30): False, ("b", 5, 9): False}


def test_bm25_drops_terms_of_half_the_records(spark):
    texts = spark.createDataFrame([("body", k, "d", t) for k, t in enumerate(["red fox", "red dog", "red cat", "red"])], "channel string, id int, document_id string, body string")
    queries = spark.createDataFrame([(1, "red red fox")], "query_id long, query string")
    one = 0.847298 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.75))
    got = lexical.bm25(queries, texts, k=10, longest=1).collect()
    assert [(r.id, r.score) for r in got] == [(0, pytest.approx(one, abs=1e-5))]
    got = lexical.bm25(queries, texts, k=10).collect()  # the run "red fox" is a term too
    assert [(r.id, r.score) for r in got] == [(0, pytest.approx(2 * one, abs=1e-5))]


def test_bm25_of_runs_and_scopes_equals_the_formula(spark):
    rng = random.Random(5)
    bodies = [(("body", "visual")[k % 2], k, f"d{k % 3}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    asked = [(1, "a b c d a b", "d0"), (2, "h g", "d1"), (3, "", "d1"), (4, "q", "d2"), (5, None, "d0")]
    terms = lambda t: {" ".join(t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)}
    tf = lambda t, x: t.count(x) if " " not in x else f" {' '.join(t)} ".count(f" {x} ")
    want = {}
    for channel in ("body", "visual"):
        own = [(k, d, b.split()) for c, k, d, b in bodies if c == channel]
        mean = sum(len(t) for _, _, t in own) / len(own)
        for q, text, scope in asked:
            for x in terms((text or "").split()):
                df = sum(tf(t, x) > 0 for _, _, t in own)
                idf = math.log((len(own) - df + 0.5) / (df + 0.5))
                for k, d, t in own:
                    if idf > 0 and d == scope and (n := tf(t, x)):
                        want[q, k] = want.get((q, k), 0) + idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t) / mean))
    texts = spark.createDataFrame(bodies, "channel string, id int, document_id string, body string")
    got = lexical.bm25(spark.createDataFrame(asked, "query_id long, query string, document_id string"), texts, k=None, scope="document_id").collect()
    assert {(r.query_id, r.id): r.score for r in got} == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()} and len(want) > 10


def test_bm25_topk_in_small_batches_equals_all_scores_and_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    bodies = [(("body", "visual")[k % 2], k, f"d{k % 3}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))).title()) for k in range(90)]
    texts = spark.createDataFrame([*bodies, ("body", 90, "d", "a b a b a b a b"), ("body", 91, "d", "")], "channel string, id long, document_id string, body string").repartition(3)
    asked = spark.createDataFrame([(1, "a b c d a b"), (2, "h g"), (3, ""), (4, "q"), (5, None), (6, "h g"), (7, "b a b A b")], "query_id long, query string")
    want = sorted((r.query_id, r.channel, r.id, f"{r.score:.5f}", r["rank"]) for r in lexical.bm25(asked, texts, k=None).collect() if r["rank"] <= 4)
    monkeypatch.setattr(lexical, "PACKED_TEXTS", 7)
    monkeypatch.setattr(lexical, "SCORED_TEXTS", 20)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(lexical, "found_terms", None)
    got = lexical.bm25(asked, texts, k=4).collect()
    assert sorted((r.query_id, r.channel, r.id, f"{r.score:.5f}", r["rank"]) for r in got) == want and len(want) == 4 * 2 * 4
    assert lexical.bm25(asked.filter("query_id = 5"), texts, k=4).count() == lexical.bm25(asked, texts.limit(0), k=4).count() == 0


def test_tokens_in_bytes_are_those_of_the_pattern():
    rng = random.Random(8)
    number = lexical._numbering()
    for _ in range(200):
        bodies = ["".join(rng.choice(["a", "b", "eightlet", "eightletters", "eightletx", "1", "22", ".", " ", "é", "中", "\0", "_", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        tokens = [re.findall(T.TOKEN, b) for b in bodies]
        some = sorted({t for own in tokens for t in own if rng.random() < 0.4} | {"eightletters"})
        words = {w: n for n, w in enumerate(rng.sample(some, len(some)))}
        at, lens = number(pa.array(["a 1. "] + [f"{b} " for b in bodies]).slice(1), *lexical._lookup(words))
        assert lens.tolist() == [len(own) for own in tokens] and at.tolist() == [words.get(t, -1) for own in tokens for t in own]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pack_top_n_takes_apart_only_the_channel_and_keeps_only_the_ranks_it_gives(spark, monkeypatch):
    seen, top = [], lexical._top
    monkeypatch.setattr(lexical, "_top", lambda queries, texts, k, longest: seen.append((texts, k)) or top(queries, texts, k, longest))
    registry.QUERIES["pack_top_n"](spark, str(DATA))
    assert [({r.channel for r in texts.select("channel").distinct().collect()}, k) for texts, k in seen] == [({"body"}, 5)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["pack_all", "rerank_input", "pack_greedy", "rerank_order", "pack_top_n"])
def test_few_results_meet_the_records_without_shuffling_them(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert sum("BroadcastHashJoin" in line for line in joins) >= 1 and not any("SortMergeJoin" in line and ("[id#" in line or "[chunk_id#" in line) and name != "rerank_order" for line in joins)


def test_scoped_search_in_blocks_equals_the_plain_one(spark):
    rng = random.Random(7)
    q = spark.createDataFrame([(k, rng.choice(["a", "a", "b", "c", None]), [rng.gauss(0, 1) for _ in range(4)]) for k in range(12)], "query_id long, s string, vector array<float>")
    c = spark.createDataFrame([(k, rng.choice(["a", "a", "a", "b", None]), [rng.gauss(0, 1) for _ in range(4)]) for k in range(200)], "id long, s string, vector array<float>")
    rows = lambda **o: {tuple(r) for r in vectors.top_in_scope(q, c, "s", k=3, **o).collect()}
    assert rows(block=7) == rows() and any(r[1] == "no_candidates" for r in rows())


def test_empty_groups_stay(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0])], "query_id long, s string, vector array<float>")
    c = spark.createDataFrame([(k, "a", [1.0, float(k)]) for k in range(5)], "id long, s string, vector array<float>")
    got = {(r.query_id, r.status, r.candidates, r["rank"], r.id) for r in vectors.top_in_scope(q, c, "s", k=2).collect()}
    assert got == {(1, "ok", 5, 1, 0), (1, "ok", 5, 2, 1), (2, "no_candidates", 0, None, None)}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.chunks.jsonl").write_text('{"chunk_id":"x","kind":"text","seq":1,"text":"t","metadata":{"document_id":"d"}}\n\n')
    rows = tables.json_lines(spark, str(tmp_path / "a.chunks.jsonl"))
    assert [(r.chunk_id, r.metadata.document_id) for r in rows.collect()] == [("x", "d")]
    (tmp_path / "bad.jsonl").write_text('{"chunk_id": \n')
    with pytest.raises(Exception):
        tables.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "catalog.json").write_text('{"documents": [{"document_id": "d", "include_in_index": true}]}')
    assert tables.json_list(spark, str(tmp_path / "catalog.json"), "documents", tables.CATALOG).first().include_in_index is True
    (tmp_path / "guide.md").write_text("# Head\n\nbody")
    assert tables.markdown(spark, str(tmp_path / "guide.md")).first().document_id == "guide"
    out = str(tmp_path / "table")
    tables.write_new(rows, out, tables.file_manifest(spark, str(tmp_path / "guide.md")))
    assert spark.read.parquet(out).count() == 1 and spark.read.json(out + ".manifest").count() == 1
    with pytest.raises(Exception):
        tables.write_new(rows, out)


def test_core_does_not_import_the_text_operators():
    root = Path(__file__).resolve().parent.parent / "chunkloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p


def test_clear_and_greedy_spans(spark):
    rows = spark.createDataFrame([("a", 0, 4, 1), ("a", 3, 6, 2), ("a", 6, 8, 3), ("a", 7, 9, 4), ("a", 9, 10, 5), ("b", 0, 9, 6), ("b", 1, 2, 7), ("b", 9, 10, 8)], "id string, start int, stop int, tie long")
    assert sorted(r.tie for r in sequences.clear_spans(rows).collect()) == [5, 8]
    assert sorted(r.tie for r in sequences.greedy_spans(rows).collect()) == [1, 3, 5, 6, 8]


def test_line_segments(spark):
    text = "# Head\r\n\nprose\nmore\n```py\n# code\n```\n| a |\n![x](y.png)"
    got = [(r.kind, r["first"], r.lines) for r in sequences.line_segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id", "segment").collect()]
    assert got == [("heading", 1, 1), ("blank", 2, 1), ("text", 3, 2), ("code", 5, 3), ("table", 8, 1), ("image", 9, 1), ("blank", 1, 1)]


def test_texts_inside_other_texts(spark):
    rng = random.Random(3)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(6)]
    texts = long + [t[a : a + 120] for t in long for a in (0, 37, 101)] + [long[0] + "。" + long[1], long[0], "", None, "alpha1", "资料检索系统的引用规则" * 2, "前言：资料检索系统的引用规则资料检索系统的引用规则。", "X " + long[2].upper() + " Y", long[2].upper()]
    rows = [*enumerate(texts), (3, texts[3])]
    first = {}
    for k, t in rows:
        if t is not None:
            first[t] = min(k, first.get(t, k))
    words = lambda t: len(re.findall(r"[一-鿿]|[^\W_一-鿿]+", t))
    want = {(first[a], first[b]) for a in first for b in first if a != b and words(a) >= 7 and a in b}
    got = {(r.inner, r.outer) for r in context.contained(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == want and len(want) > 20


def test_hot_spans_and_repeats_equal_the_plain_fold(spark):
    rng = random.Random(11)
    rows = []
    for k in range(300):
        a = rng.randint(0, 400)
        rows.append((rng.choice("aab"), a, a + rng.randint(0, 12), k))
    rows += [(i, a, b, t + 300) for i, a, b, t in rows[:80]]
    want = []
    for i in "ab":
        kept = []
        for _, a, b, t in sorted((r for r in rows if r[0] == i), key=lambda r: r[3]):
            if not any(x < b and a < y for x, y in kept):
                kept.append((a, b))
                want.append((i, a, b, t))
    got = [tuple(r) for r in sequences.greedy_spans(spark.createDataFrame(rows, "id string, start int, stop int, tie long"), width=16).collect()]
    assert sorted(got) == sorted(want)


def test_streams_over_several_batches_forget_and_stay_complete(spark, tmp_path):
    import datetime as dt

    from chunkloom.streaming import queue

    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    files = [[(1, "a", "open", day(0), day(0)), (2, "b", "open", day(1), day(1))], [(1, "a", "open", day(0), day(2)), (3, "c", "open", day(0), day(30))], [(4, "d", "open", day(1), day(31)), (3, "c", "open", day(0), day(31)), (None, "x", "open", None, day(31))]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "job_id long, query string, status string, created_at timestamp, received_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs.parquet"))
    path = str(tmp_path / "jobs.parquet")
    once = queue.drained(queue.submitted_once(queue.arriving(spark, path, files_each=1)).select("job_id", "query"), spark)
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    hours = queue.drained(queue.hourly_load(queue.arriving(spark, path, files_each=1)), spark, keys=["hour", "status"])
    assert sorted(r.jobs for r in hours.collect()) == [2, 4] and hours.columns == ["hour", "status", "jobs"]


def test_phrases_are_counted_without_overlap(spark):
    texts = spark.createDataFrame([("body", 1, "d", "x x x x"), ("body", 2, "d", "x y"), ("body", 3, "d", "")], "channel string, id long, document_id string, body string")
    wanted = spark.createDataFrame([(1, "x x"), (1, "y x")], "query_id long, phrase string")
    assert [(r.phrase, r.id, r.tf) for r in lexical.phrase_frequency(texts, wanted).collect()] == [("x x", 1, 1)]


def test_small_builders(spark):
    assert one(spark, T.image_target(F.col("t")), t='![x](img/a.png "Title")') == "img/a.png"
    assert one(spark, T.stem(F.col("t")), t="a/b.c/guide.v2.md") == "guide.v2"
    assert tuple(one(spark, T.span_of(F.col("t")), t="s12_40")) == (12, 40) and tuple(one(spark, T.span_of(F.col("t")), t="x")) == (None, None)
    assert one(spark, T.source_block(F.col("t")), t="A\nSOURCE:\nb\nSOURCE:\nc") == "b\nSOURCE:\nc"
    assert one(spark, T.masked(F.col("t"), 20), t='Traceback (most recent)\n  File "x", line 1\nkey ' + "k" * 40 + " ended here now") == "key *** ended here n"
    assert one(spark, T.shown(F.col("t")), t="See ![a](b.png)it [S1] .") == "See it."
    assert one(spark, T.shown(F.col("t")), t="[S1] [S2]的原图 ，x [S1, S2]") == "对应证据的原图，x [S1, S2]"
    assert one(spark, T.escaped(F.col("t")), t="a*b\n (c) ") == "a\\*b (c)"
    assert one(spark, T.safe_url(F.col("t")), t="javascript:x") is None
    assert one(spark, T.bounded(F.col("t"), F.col("w")), t="top_k is (k) 10", w="k") and not one(spark, T.bounded(F.col("t"), F.col("w")), t="top_k is 10", w="k")


def chunks_by_hand(text, least=220):
    paragraphs = [p.strip(" \t\n") for p in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text)]
    only = lambda t: all(x == "" or x.startswith("#") for x in t.split("\n"))
    groups, skip = [], False
    for p in filter(None, paragraphs):
        if p.startswith("#"):
            skip = bool(re.match(sequences.REFERENCES, p)) or (skip and not re.match(sequences.APPENDIX, p))
        if skip:
            continue
        if not groups or (p.startswith("#") and not (len(groups[-1]) < least or only(groups[-1]))):
            groups.append(p)
        else:
            groups[-1] += "\n\n" + p
    if len(groups) > 1 and (len(groups[-1]) < least or only(groups[-1])):
        last = groups.pop()
        groups[-1] += "\n\n" + last
    return groups


def test_chunker_equals_the_rule(spark):
    rng = random.Random(9)
    part = lambda: rng.choice(["# Head", "## References", "# Appendix A", "x" * rng.randint(1, 300), "y " * 60, "## Sub\n### Subsub"])
    texts = [(k, "\n\n".join(part() for _ in range(rng.randint(0, 14)))) for k in range(80)] + [(90, None)]
    got = {}
    for r in sequences.chunked(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.body)
        assert r.chunk_id == f"{r.doc_id}::text::{r.seq:04d}"
    for k, t in texts:
        assert got.get(k, []) == (chunks_by_hand(t) if t else [])


def test_values_carried_over_blocks_are_those_of_one_window(spark):
    from pyspark.sql.window import Window

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 60), k, rng.choice([None, None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, seq int, ord long, v long")
    w = Window.partitionBy("key").orderBy("seq", "ord")
    plain = {
        ("back", False): F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)), ("back", True): F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        ("on", False): F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), ("on", True): F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    }
    block = F.floor(F.col("seq") / 7)
    for (way, strict), column in plain.items():
        got = {r.ord: r.x for r in sequences.carried(df, "key", block, ["seq", "ord"], F.col("v"), "x", strict=strict, backward=way == "back").collect()}
        assert got == {r.ord: r.x for r in df.withColumn("x", column).collect()}
    for total in (F.sum, F.max, F.min):
        for strict in (False, True):
            got = {r.ord: r.x for r in sequences.running(df, "key", block, ["seq", "ord"], F.col("v"), "x", total=total, strict=strict).collect()}
            assert got == {r.ord: r.x for r in df.withColumn("x", total("v").over(w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0))).collect()}


def test_names_of_which_a_text_has_every_word(spark):
    texts = spark.createDataFrame([(1, "The Foo guide, please"), (2, "guide"), (3, None), (4, "bar GUIDE of notes")], "id long, text string")
    names = spark.createDataFrame([("a", "Foo guide"), ("b", "Bar Guide"), ("c", "guide"), ("c", "guide"), ("d", None), ("e", "资料"), ("f", "Foo notes")], "owner string, name string")
    got = sorted((r.id, r.owner) for r in resolve.named_whole(texts, names).collect())
    assert got == [(1, "a"), (1, "c"), (2, "c"), (4, "b"), (4, "c")]


def test_layers_hold_where_they_are_not_null(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "z")], "id long, t string, l string")
    one_ = spark.createDataFrame([(1, None, "y"), (2, "c", None), (9, "q", "q")], "id long, t string, l string")
    two = spark.createDataFrame([(2, "d"), (3, "e")], "id long, t string")
    assert sorted(tuple(r) for r in context.overlaid(base, [one_, two], "id").collect()) == [(1, "a", "y"), (2, "d", None), (3, "e", "z")]


def test_merge_by_key_then_by_identity(spark):
    rows = spark.createDataFrame([("a", 1, "i"), ("a", 2, "j"), ("b", 3, "i"), ("c", 4, "k"), ("d", 5, "l"), ("d", 6, "l")], "key string, o long, same string")
    got = sorted(tuple(r) for r in context.merged(rows, "key", "o", "same").collect())
    assert got == [(1, 2, 3, "a,b"), (5, 1, 2, "d")]


def test_all_or_nothing_and_pairs_of_a_case(spark):
    cases = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 99)], "case_id long, base long")
    items = spark.createDataFrame([(1, 40), (1, 50), (2, 91), (4, 1)], "case_id long, cost long")
    assert {r.case_id: (r["items"], r.cost, r.status) for r in context.packed_all(cases, items, 98).collect()} == {1: (2, 100, "refused"), 2: (1, 101, "refused"), 3: (0, 10, "fits"), 4: (1, 100, "envelope over budget")}
    line = "a line of twenty characters"
    texts = [(1, 1, 10, f"{line}\nx"), (1, 2, 11, f"{line}\nx"), (1, 3, 12, f"y\n{line}\nx"), (1, 4, 13, f"z\r\n{line}"), (1, 5, 14, ""), (2, 1, 15, line)]
    got = {(r["first"], r.second): (r.exact, r.contained, r.shared_lines) for r in context.pair_overlaps(spark.createDataFrame(texts, "case_id long, rank int, id long, text string")).filter("second <> 14").collect()}
    assert got == {(10, 11): (True, False, 0), (10, 12): (False, True, 1), (11, 12): (False, True, 1), (10, 13): (False, False, 1), (11, 13): (False, False, 1), (12, 13): (False, False, 1)}


def test_unit_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>")
    assert {r.id: r.u for r in rows.select("id", vectors.unit(F.col("v")).alias("u")).collect()} == {1: [0.6, 0.8], 2: None, 3: None}

"""Queries over the record table: scoping, ranking, linking, lineage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import context, lexical, sequences, vectors
from ..sources.tables import content_manifest, json_lines, kept, shared_folder, spread, table, write_json_lines, write_new
from .queries import Registered

TOKENS_SQL = r"regexp_extract_all(lower({0}), '[0-9]+(?:\.[0-9]+)+|[a-z]+|[0-9]+')"
BODY_SQL = "coalesce(CASE WHEN kind = 'visual_description' THEN retrieval_text ELSE text END, '')"
CHANNEL_SQL = f"SELECT CASE WHEN kind = 'text' THEN 'body' ELSE 'visual' END AS channel, ord AS id, document_id, {TOKENS_SQL.format(BODY_SQL)} AS t FROM records WHERE NOT (kind = 'text' AND coalesce(reference_only, false))"
RUN_SQL = "list_transform(range(1, len(t) - {0} + 2), lambda i: array_to_string(t[i:i + {0} - 1], ' '))"
PHRASES_SQL = f"list_concat({RUN_SQL.format(2)}, list_concat({RUN_SQL.format(3)}, {RUN_SQL.format(4)}))"
USABLE_SQL = "SELECT ord, min(vector) AS vector FROM {0} WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ord"
query = Registered()
QUERIES, SQL = query.queries, query.sql


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records are found by; taking it apart is the work, so it is spread over all cores."""
    return lexical.channels(spread(_records(spark, sf_dir).select("ord", "kind", "document_id", "text", "retrieval_text", "reference_only")))


@query("""SELECT chunk_id, ord, document_title, lang FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, ord DESC) AS n FROM records) WHERE n = 1""")
def latest_records(spark, sf_dir):
    """The last delivery of each chunk."""
    rows = _records(spark, sf_dir).select("chunk_id", "ord", "document_title", "lang", "loaded_at")
    return context.latest(rows, "chunk_id", ["loaded_at", "ord"]).drop("loaded_at")


@query("""SELECT ord, document_id, row_number() OVER (PARTITION BY document_id ORDER BY seq, ord) AS place FROM records""")
def document_order(spark, sf_dir):
    """Each record's place in its document."""
    return sequences.document_places(_records(spark, sf_dir).select("ord", "document_id", "seq"))


@query(f"""WITH ch AS ({CHANNEL_SQL}) SELECT channel, id, len(t) AS tokens FROM ch""")
def tok_counts(spark, sf_dir):
    """Lexical tokens of each record."""
    return _texts(spark, sf_dir).select("channel", "id", F.size(T.tokens(F.col("body"))).alias("tokens"))


@query(f"""WITH ch AS ({CHANNEL_SQL}) SELECT channel, count(*) AS n, sum(len(t)) AS total_len, round(sum(len(t)) / count(*), 6) AS avgdl FROM ch GROUP BY channel""")
def avgdl(spark, sf_dir):
    """Size of each channel and its average length."""
    return lexical.collection(_texts(spark, sf_dir)).withColumn("avgdl", F.round(F.col("total_len") / F.col("n"), 6))


@query(f"""WITH ch AS ({CHANNEL_SQL}) SELECT channel, term, count(DISTINCT id) AS df FROM (SELECT channel, id, unnest(t) AS term FROM ch) GROUP BY channel, term""")
def df_by_channel(spark, sf_dir):
    """Document frequency of every term."""
    return lexical.document_frequency(lexical.postings(_texts(spark, sf_dir)))


@query(f"""WITH ch AS ({CHANNEL_SQL}), d AS (SELECT channel, term, count(DISTINCT id) AS df FROM (SELECT channel, id, unnest(t) AS term FROM ch) GROUP BY 1, 2),
n AS (SELECT channel, count(*) AS n FROM ch GROUP BY 1)
SELECT channel, term, round(ln((n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d JOIN n USING (channel) WHERE ln((n - df + 0.5) / (df + 0.5)) > 0""")
def idf_positive(spark, sf_dir):
    """Terms that count in ranking."""
    texts = _texts(spark, sf_dir)
    df = lexical.document_frequency(lexical.postings(texts)).join(F.broadcast(lexical.collection(texts)), "channel")
    return df.select("channel", "term", lexical.idf(F.col("n"), F.col("df")).alias("idf")).filter("idf > 0").withColumn("idf", F.round("idf", 6))


@query(f"""WITH ch AS ({CHANNEL_SQL}), p AS (SELECT channel, id, unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS phrase FROM ch WHERE len(t) >= 2)
SELECT channel, phrase, count(*) AS df FROM p GROUP BY 1, 2 HAVING count(*) > 1""")
def ngram_df(spark, sf_dir):
    """Pairs of tokens that more than one record has."""
    return lexical.phrases(_texts(spark, sf_dir), 2).filter("df > 1")


_SEARCH = "SELECT question_id AS query_id, original_query AS query FROM questions WHERE question_id % 100 = 0 AND original_query IS NOT NULL"


def bm25_sql(search: str, scope: str = "") -> str:
    """BM25 of the queries (query_id, query, and the scope) over the records: tokens and runs of up to four."""
    on = f", {scope}" if scope else ""
    return f"""WITH ch AS MATERIALIZED ({CHANNEL_SQL}), qt AS (SELECT query_id{on}, {TOKENS_SQL.format('query')} AS t FROM ({search})), q AS MATERIALIZED (SELECT query_id{on}, unnest(list_distinct(list_concat(t, {PHRASES_SQL}))) AS term FROM qt),
p AS MATERIALIZED (SELECT channel, id, document_id, len, term, count(*) AS tf FROM (SELECT channel, id, document_id, len(t) AS len, unnest(t) AS term FROM ch) SEMI JOIN q USING (term) GROUP BY ALL UNION ALL
SELECT channel, id, document_id, len, term, (length(padded) - length(replace(padded, ' ' || term || ' ', ''))) // (length(term) + 2) AS tf FROM (SELECT DISTINCT id, term FROM (SELECT id, unnest({PHRASES_SQL}) AS term FROM ch) SEMI JOIN q USING (term)) JOIN (SELECT channel, id, document_id, len(t) AS len, ' ' || array_to_string(t, ' ') || ' ' AS padded FROM ch) USING (id)),
st AS (SELECT channel, count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM ch GROUP BY 1), d AS (SELECT channel, term, count(*) AS df FROM p GROUP BY 1, 2),
w AS (SELECT channel, term, avgdl, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM d JOIN st USING (channel)),
s AS (SELECT query_id, channel, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN w USING (term) JOIN p USING (channel, term{on}) WHERE idf > 0 GROUP BY 1, 2, 3)
SELECT query_id, channel, id, score, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS rank FROM s"""


_BM25_SQL = bm25_sql(_SEARCH)


def _search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of all searches: every question whose id is divisible by 100."""
    q = table(spark, sf_dir, "questions").filter("question_id % 100 = 0 AND original_query IS NOT NULL")
    return q.select(F.col("question_id").alias("query_id"), F.col("original_query").alias("query"), "document_id")


@query(f"SELECT * FROM ({_BM25_SQL}) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best records by BM25 in each channel, against all records."""
    return _best(spark, sf_dir, 10)


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.bm25(_search_queries(spark, sf_dir), _texts(spark, sf_dir), k=k)


def _small(rows: DataFrame) -> DataFrame:
    """Rows to be joined with the records, written once and counted: broadcast where they are few, so that the records' texts are not shuffled."""
    rows = kept(rows)
    return F.broadcast(rows) if rows.count() <= lexical.BROADCAST_TERMS else rows


_VEC_SQL = f"""WITH v AS (SELECT u.ord, r.document_id, u.vector FROM ({USABLE_SQL.format('body_vectors')}) u JOIN (SELECT ord, document_id FROM records) r USING (ord)),
qv AS (SELECT u.ord, r.document_id, u.vector FROM ({USABLE_SQL.format('description_vectors')}) u JOIN (SELECT ord, document_id FROM records) r USING (ord) WHERE u.ord % 100 = 0),
b AS (SELECT qv.ord AS query_id, v.ord AS id, round(list_dot_product(qv.vector::DOUBLE[], v.vector::DOUBLE[]) / sqrt(list_dot_product(qv.vector::DOUBLE[], qv.vector::DOUBLE[]) * list_dot_product(v.vector::DOUBLE[], v.vector::DOUBLE[])), 6) AS score FROM qv JOIN v USING (document_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS candidates FROM b)
SELECT qv.ord AS query_id, CASE WHEN t.id IS NULL THEN 'no_candidates' ELSE 'ok' END AS status, coalesce(t.candidates, 0) AS candidates, t.rank, t.id, t.score FROM qv LEFT JOIN t ON t.query_id = qv.ord AND t.rank <= 10"""


def _vectors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    owners = _records(spark, sf_dir).select("ord", "document_id")
    return vectors.usable(table(spark, sf_dir, name)).join(owners, "ord")


@query(_VEC_SQL)
def vec_topk(spark, sf_dir):
    """The ten body vectors most similar to each hundredth visual's, within its document; visuals without candidates stay."""
    asked = _vectors(spark, sf_dir, "description_vectors").filter("ord % 100 = 0").withColumnRenamed("ord", "query_id")
    return vectors.top_in_scope(asked, _vectors(spark, sf_dir, "body_vectors").withColumnRenamed("ord", "id"), "document_id", k=10)


@query("""SELECT CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 64 THEN 'size' WHEN len(list_filter(vector, lambda x: isnan(x))) > 0 THEN 'nan' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'zero'
WHEN abs(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) - 1) > 1e-3 THEN 'not unit' ELSE 'fine' END AS problem, count(*) AS rows FROM (SELECT vector FROM body_vectors UNION ALL SELECT vector FROM description_vectors) GROUP BY 1""")
def vec_norm_audit(spark, sf_dir):
    """What is wrong with the vectors."""
    both = table(spark, sf_dir, "body_vectors").select("vector").unionByName(table(spark, sf_dir, "description_vectors").select("vector"))
    return vectors.audit(both)


_POOL_SQL = f"SELECT u.ord AS id, r.document_id, r.chunk_id, u.vector FROM ({USABLE_SQL.format('body_vectors')}) u JOIN records r USING (ord) WHERE r.kind = 'text' AND NOT coalesce(r.reference_only, false)"
_VISUAL_SQL = f"SELECT u.ord AS query_id, r.document_id, {BODY_SQL} AS query, u.vector FROM ({USABLE_SQL.format('description_vectors')}) u JOIN records r USING (ord) WHERE u.ord % 100 = 0"
_COSINE_SQL = "round(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) / sqrt(list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[]) * list_dot_product(b.vector::DOUBLE[], b.vector::DOUBLE[])), 6)"
_TWO_SQL = f"""pool AS MATERIALIZED ({_POOL_SQL}), asked AS MATERIALIZED ({_VISUAL_SQL}),
v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.query_id, b.id, {_COSINE_SQL} AS score FROM asked a JOIN pool b USING (document_id))),
l AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, channel, id, score FROM ({bm25_sql('SELECT query_id, document_id, query FROM asked', 'document_id')})) JOIN (SELECT id, chunk_id FROM pool) USING (id) WHERE channel = 'body')"""


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Visuals asked for (query_id, document_id, query, vector), the text records they may find, and both searches of the one pool: by vector and by words."""
    records = _records(spark, sf_dir)
    body = T.retrievable(F.col("kind"), F.col("text"), F.col("retrieval_text"))
    visuals = vectors.usable(table(spark, sf_dir, "description_vectors").filter("ord % 100 = 0")).join(records.select("ord", "document_id", body.alias("query")), "ord")
    asked = kept(visuals.withColumnRenamed("ord", "query_id"))
    rankable = records.filter("kind = 'text' AND NOT coalesce(reference_only, false)").select("ord", "document_id", "chunk_id")
    pool = vectors.usable(table(spark, sf_dir, "body_vectors")).join(rankable, "ord").withColumnRenamed("ord", "id")
    by_vector = vectors.top_in_scope(asked.drop("query"), pool.drop("chunk_id"), "document_id", k=20).filter("status = 'ok'").select("query_id", "id", "rank", "score")
    texts = _texts(spark, sf_dir).filter("channel = 'body'")
    by_words = lexical.bm25(asked.select("query_id", "query", "document_id"), texts, k=None, scope="document_id").join(pool.select("id", "chunk_id"), "id")
    return asked, pool, by_vector, by_words.select("query_id", "id", "chunk_id", "score")


@query(f"""WITH {_TWO_SQL} SELECT query_id, id, x.rank AS rank_1, y.rank AS rank_2, round((coalesce(1 / (60.0::DOUBLE + x.rank), 0) + coalesce(1 / (60.0::DOUBLE + y.rank), 0)) / ((x.rank IS NOT NULL)::INT + (y.rank IS NOT NULL)::INT), 9) AS score
FROM (SELECT query_id, id, rank FROM v WHERE rank <= 20) x FULL JOIN (SELECT query_id, id, rank FROM l WHERE rank <= 20) y USING (query_id, id)""")
def rrf_mean(spark, sf_dir):
    """Texts for each hundredth visual, within its document: the twenty best by vector and by words, fused."""
    _, _, by_vector, by_words = _two_rankings(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    words = by_words.withColumn("rank", F.row_number().over(order)).filter("rank <= 20").select("query_id", "id", "rank")
    return vectors.fused(by_vector.drop("score"), words, ["query_id", "id"])


@query(f"""WITH {_TWO_SQL}, h AS (SELECT query_id, id, rank FROM v WHERE rank <= 10), n AS (SELECT query_id, max(rank) AS n FROM h GROUP BY 1),
x AS (SELECT l.query_id, l.id, coalesce(n.n, 0) + row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS rank, l.rank AS lexical_rank FROM l ANTI JOIN h ON h.query_id = l.query_id AND h.id = l.id LEFT JOIN n ON n.query_id = l.query_id),
o AS (SELECT h.query_id, h.id, h.rank, 'vector' AS source, l.rank AS lexical_rank FROM h LEFT JOIN l USING (query_id, id) UNION ALL SELECT query_id, id, rank, 'lexical', lexical_rank FROM x WHERE rank <= 15)
SELECT o.query_id, o.id, o.rank, o.source, o.lexical_rank, {_COSINE_SQL} AS score FROM o JOIN asked a ON a.query_id = o.query_id JOIN pool b ON b.id = o.id""")
def hybrid_supplement(spark, sf_dir):
    """The ten texts most similar to each hundredth visual by vector, within its document, supplemented up to fifteen by the best of the same pool by words; ranks go on, and every row has its cosine."""
    asked, pool, by_vector, by_words = _two_rankings(spark, sf_dir)
    both = vectors.supplemented(by_vector.filter("rank <= 10"), by_words, cap=15, tie="chunk_id")
    both = both.join(asked.select("query_id", F.col("vector").alias("a")), "query_id").join(pool.select("id", F.col("vector").alias("b")), "id")
    return both.select("query_id", "id", "rank", "source", "lexical_rank", vectors.cosine(F.col("a"), F.col("b")).alias("score"))


@query("""SELECT q.question_id, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'no_candidates' ELSE 'ok' END AS status FROM questions q LEFT JOIN (SELECT document_id, count(*) AS n FROM records WHERE kind = 'text' AND NOT reference_only GROUP BY 1) r USING (document_id)""")
def scope_source(spark, sf_dir):
    """How many rankable text records the document of each question has; questions without any stay."""
    n = _records(spark, sf_dir).filter("kind = 'text' AND NOT reference_only").groupBy("document_id").agg(F.count("*").alias("n"))
    q = table(spark, sf_dir, "questions").select("question_id", "document_id").join(n, "document_id", "left")
    return q.select("question_id", F.coalesce("n", F.lit(0)).alias("candidates"), F.when(F.col("n").isNull(), "no_candidates").otherwise("ok").alias("status"))


_ROMAN = "list_sum(list_transform(string_split({0}, ''), lambda c, i: [1, 5, 10, 50, 100, 500, 1000][strpos('ivxlcdm', c)] * CASE WHEN [1, 5, 10, 50, 100, 500, 1000][strpos('ivxlcdm', c)] < coalesce(list_max(list_transform(string_split({0}, '')[i + 1:], lambda d: [1, 5, 10, 50, 100, 500, 1000][strpos('ivxlcdm', d)])), 0) THEN -1 ELSE 1 END))"




def labels_sql(source: str) -> str:
    """(key, label, place): the labels in the texts (key, txt), each once for a key, placed in the order of visual_labels."""
    return rf"""WITH m AS (SELECT key, 1 AS part, unnest(l) AS m, unnest(range(len(l))) AS i FROM (SELECT key, list_transform(regexp_extract_all(lower(txt), '(?:^|[^\p{{L}}\p{{N}}_])(?:fig(?:ure)?|tab(?:le)?)\.?[\s\p{{Z}}]*(?:[0-9]+|[ivxlcdm]+)(?:[^\p{{L}}\p{{N}}_]|$)'), lambda x: regexp_extract(x, '(?:fig|tab)[a-z.]*[\s\p{{Z}}]*(?:[0-9]+|[ivxlcdm]+)')) AS l FROM ({source}))
UNION ALL SELECT key, 2, unnest(l), unnest(range(len(l))) FROM (SELECT key, regexp_extract_all(txt, '[图表][\s\p{{Z}}]*[0-9]+') AS l FROM ({source}))),
n AS (SELECT key, part, i, CASE WHEN m[1] IN ('f', '图') THEN 'figure:' ELSE 'table:' END AS kind, CASE WHEN regexp_matches(m, '[0-9]+$') THEN regexp_extract(m, '[0-9]+$')::BIGINT ELSE {_ROMAN.format("regexp_extract(m, '(?:figure|fig|table|tab)[.]?[\\s\\p{Z}]*([ivxlcdm]+)$', 1)")} END AS v FROM m)
SELECT key, kind || v::BIGINT::VARCHAR AS label, min(part * 1000 + i) AS place FROM n WHERE v >= 1 GROUP BY 1, 2"""


_ASKED_LABELS = labels_sql("SELECT question_id AS key, original_query AS txt FROM questions")
_CARRIED_LABELS = labels_sql("SELECT ord AS key, label AS txt FROM records WHERE kind <> 'text' AND label IS NOT NULL")


@query(f"SELECT key AS question_id, string_agg(label, ',' ORDER BY place) AS labels FROM ({_ASKED_LABELS}) GROUP BY 1")
def label_parse(spark, sf_dir):
    """Labels named in each question: Latin forms with digits or Roman numerals first, then CJK forms."""
    q = table(spark, sf_dir, "questions").filter("original_query IS NOT NULL")
    return q.select("question_id", F.array_join(T.visual_labels(F.col("original_query")), ",").alias("labels")).filter("labels <> ''")


@query(f"""WITH k AS (SELECT document_id, label, key AS ord FROM ({_CARRIED_LABELS}) JOIN (SELECT ord AS key, document_id FROM records) USING (key)), w AS (SELECT key AS question_id, document_id, label FROM ({_ASKED_LABELS}) JOIN (SELECT question_id AS key, document_id FROM questions) USING (key))
SELECT question_id, label AS key, count(k.ord) AS candidates FROM w LEFT JOIN k USING (document_id, label) GROUP BY 1, 2""")
def scope_label(spark, sf_dir):
    """For the labels named in each question, how many visuals of its document carry them; labels that none carries stay."""
    carried = _records(spark, sf_dir).filter("kind <> 'text'").select("document_id", F.explode(T.visual_labels(F.col("label"))).alias("key"), "ord").distinct()
    wanted = table(spark, sf_dir, "questions").select("question_id", "document_id", F.explode(T.visual_labels(F.col("original_query"))).alias("key"))
    return wanted.join(carried, ["document_id", "key"], "left").groupBy("question_id", "key").agg(F.count("ord").alias("candidates"))


@query("""SELECT document_id, count(*) FILTER (kind = 'text' AND NOT coalesce(reference_only, false)) AS body, count(*) FILTER (kind = 'visual_description') AS visual, count(*) FILTER (kind = 'text' AND reference_only) AS reference_only FROM records GROUP BY 1""")
def ref_only_antijoin(spark, sf_dir):
    """Rankable text, visual and readable-only records of each document."""
    count = lambda c: F.count(F.when(c, 1))
    text, only = F.col("kind") == "text", F.coalesce("reference_only", F.lit(False))
    return _records(spark, sf_dir).groupBy("document_id").agg(count(text & ~only).alias("body"), count(F.col("kind") == "visual_description").alias("visual"), count(text & only).alias("reference_only"))


_CAPTIONS = "SELECT DISTINCT chunk_id AS owner, unnest(caption_chunk_ids) AS caption FROM records WHERE kind <> 'text'"


@query(f"""WITH c AS ({_CAPTIONS}), t AS (SELECT chunk_id, min(text) AS text, bool_or(coalesce(reference_only, false)) AS readable_only FROM records WHERE kind = 'text' GROUP BY 1)
SELECT caption, count(*) AS owners, bool_or(t.chunk_id IS NOT NULL) AS present, bool_or(coalesce(readable_only, false)) AS readable_only FROM c LEFT JOIN t ON t.chunk_id = c.caption GROUP BY 1""")
def caption_backlinks(spark, sf_dir):
    """Which visuals point to each caption, and whether the caption is there."""
    rows = _records(spark, sf_dir)
    owners = rows.filter("kind <> 'text'").select(F.col("chunk_id").alias("owner"), F.explode("caption_chunk_ids").alias("caption")).distinct()
    texts = rows.filter("kind = 'text'").groupBy("chunk_id").agg(F.bool_or(F.coalesce("reference_only", F.lit(False))).alias("r"))
    both = owners.join(texts.select(F.col("chunk_id").alias("caption"), "r", F.lit(True).alias("there")), "caption", "left")
    return both.groupBy("caption").agg(F.count("*").alias("owners"), F.bool_or(F.coalesce("there", F.lit(False))).alias("present"), F.bool_or(F.coalesce("r", F.lit(False))).alias("readable_only"))


@query(f"""WITH c AS ({_CAPTIONS}), v AS (SELECT chunk_id, min(ord) AS ord, min(text) AS text FROM records WHERE kind <> 'text' GROUP BY 1), t AS (SELECT chunk_id, min(text) AS text FROM records WHERE kind = 'text' GROUP BY 1)
SELECT c.owner, c.caption, coalesce(contains(v.text, t.text), false) AS contained, CASE WHEN t.chunk_id IS NULL THEN 'missing' WHEN contains(v.text, t.text) THEN 'remove' ELSE 'keep' END AS decision
FROM c JOIN v ON v.chunk_id = c.owner LEFT JOIN t ON t.chunk_id = c.caption""")
def caption_inventory(spark, sf_dir):
    """Whether each caption only repeats what its visual's text says."""
    rows = _records(spark, sf_dir)
    links = rows.filter("kind <> 'text'").select(F.col("chunk_id").alias("owner"), F.explode("caption_chunk_ids").alias("caption")).distinct()
    v = rows.filter("kind <> 'text'").groupBy(F.col("chunk_id").alias("owner")).agg(F.min("text").alias("v"))
    t = rows.filter("kind = 'text'").groupBy(F.col("chunk_id").alias("caption")).agg(F.min("text").alias("t")).withColumn("there", F.lit(True))
    hit = F.coalesce(F.contains(F.col("v"), F.col("t")), F.lit(False))
    return links.join(v, "owner").join(t, "caption", "left").select("owner", "caption", hit.alias("contained"), F.when(F.col("there").isNull(), "missing").when(hit, "remove").otherwise("keep").alias("decision"))


@query("""SELECT id, before, after FROM (SELECT ord AS id, kind, last_value(CASE WHEN kind = 'text' THEN ord END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seq, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN kind = 'text' THEN ord END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seq, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM records) WHERE kind <> 'text'""")
def prev_next_text(spark, sf_dir):
    """The nearest text records before and after each visual."""
    return sequences.text_neighbours(_records(spark, sf_dir).select("ord", "document_id", "seq", "kind"))


@query("""SELECT ord AS id, last_value(CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' / ') END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seq, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM records""")
def asof_section(spark, sf_dir):
    """The section each record stands in, by the last record that names one."""
    return sequences.section_as_of(_records(spark, sf_dir).select("ord", "document_id", "seq", "section_path"))


_SPLIT_SQL = rf"""WITH RECURSIVE n AS (SELECT ord AS id, len(regexp_extract_all({BODY_SQL}, '[^ \t\r\n\f\x0b]+')) AS n FROM records), s AS (SELECT id, 0 AS start, n AS stop FROM n WHERE n > 200
UNION ALL SELECT id, unnest([start, (start + (stop - start) // 2) - least(60, stop - start - 2) // 2]) AS start, unnest([(start + (stop - start) // 2) + (least(60, stop - start - 2) + 1) // 2, stop]) AS stop FROM s WHERE stop - start > 200)
SELECT id, start, stop FROM s WHERE stop - start <= 200"""


def _long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.retrievable(F.col("kind"), F.col("text"), F.col("retrieval_text"))
    words = F.regexp_extract_all(body, F.lit(r"[^ \t\r\n\f\x0b]+"), F.lit(0))
    return _records(spark, sf_dir).select(F.col("ord").alias("id"), words.alias("w"))


@query(_SPLIT_SQL)
def overlap_split(spark, sf_dir):
    """Token spans of records of more than 200 white-space tokens, by halving with an overlap of 60."""
    return sequences.overlapping_spans(_long_records(spark, sf_dir).select("id", F.size("w").alias("n")).filter("n > 200"), limit=200, overlap=60)


@query(rf"""SELECT ord AS id, sha256(array_to_string(regexp_extract_all({BODY_SQL}, '[^ \t\r\n\f\x0b]+'), ' ')) AS digest, true AS whole FROM records WHERE len(regexp_extract_all({BODY_SQL}, '[^ \t\r\n\f\x0b]+')) > 200""")
def stitch_back(spark, sf_dir):
    """Split records put together again from their overlapping spans: the digest is the original's."""
    words = _long_records(spark, sf_dir).filter(F.size("w") > 200)
    part = lambda x: F.struct(x["start"].alias("start"), F.slice("w", x["start"] + 1, x["stop"] - x["start"]).alias("part"))
    spans = words.select("id", F.sha2(F.array_join("w", " "), 256).alias("own"), F.explode(F.transform(sequences.halved(F.size("w"), 200, 60), part)).alias("x"))
    order = F.array_sort(F.collect_list("x"))  # the spans of one record
    empty = F.expr("cast(array() as array<string>)")
    joined = F.aggregate(order, empty, lambda s, x: F.concat(s, F.slice(x["part"], F.size(s) - x["start"] + 1, F.size(x["part"]))))
    back = spans.groupBy("id", "own").agg(F.sha2(F.array_join(joined, " "), 256).alias("digest"))
    return back.select("id", "digest", (F.col("digest") == F.col("own")).alias("whole"))


@query("""WITH k AS (SELECT origin_chunk_id AS caption, chunk_id AS child, min(seq) AS seq FROM records WHERE origin_chunk_id IS NOT NULL AND origin_chunk_id <> chunk_id GROUP BY 1, 2),
c AS (SELECT ord, unnest(caption_chunk_ids) AS caption, unnest(range(1, len(caption_chunk_ids) + 1)) AS n FROM records WHERE kind <> 'text')
SELECT ord, string_agg(coalesce(child, caption), ',' ORDER BY n, seq, child) AS captions FROM c LEFT JOIN k USING (caption) GROUP BY 1""")
def remap_children(spark, sf_dir):
    """Caption lists with every split caption replaced by its pieces, in order."""
    rows = _records(spark, sf_dir)
    kids = rows.filter("origin_chunk_id IS NOT NULL AND origin_chunk_id <> chunk_id").groupBy(F.col("origin_chunk_id").alias("caption"), F.col("chunk_id").alias("child")).agg(F.min("seq").alias("seq"))
    links = rows.filter("kind <> 'text'").select("ord", F.posexplode("caption_chunk_ids").alias("n", "caption")).join(kids, "caption", "left")
    items = F.array_sort(F.collect_list(F.struct("n", "seq", F.coalesce("child", "caption").alias("id"))))  # one visual's captions
    return links.groupBy("ord").agg(F.array_join(F.transform(items, lambda x: x["id"]), ",").alias("captions"))


@query("""WITH c AS (SELECT chunk_id, parent_chunk_id, origin_chunk_id, min(e16_span.char_start) AS a, max(e16_span.char_end) AS b, min(e16_span.envelope_tokens) AS tokens FROM records WHERE parent_chunk_id IS NOT NULL OR origin_chunk_id IS NOT NULL OR e16_span IS NOT NULL GROUP BY 1, 2, 3)
SELECT chunk_id, (parent_chunk_id IS NOT NULL AND origin_chunk_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL) AS complete, coalesce(chunk_id = printf('%s::e16span::%06d-%06d', origin_chunk_id, a, b), false) AS named, coalesce(a < b AND tokens <= 1500, false) AS within FROM c""")
def lineage_check(spark, sf_dir):
    """Split records: all lineage fields or none, a name made of origin and span, a span within the limit."""
    rows = _records(spark, sf_dir).filter("parent_chunk_id IS NOT NULL OR origin_chunk_id IS NOT NULL OR e16_span IS NOT NULL")
    c = rows.groupBy("chunk_id", "parent_chunk_id", "origin_chunk_id").agg(F.min("e16_span.char_start").alias("a"), F.max("e16_span.char_end").alias("b"), F.min("e16_span.envelope_tokens").alias("tokens"))
    named = F.col("chunk_id") == F.format_string("%s::e16span::%06d-%06d", "origin_chunk_id", "a", "b")
    return c.select("chunk_id", F.expr("parent_chunk_id IS NOT NULL AND origin_chunk_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").alias("complete"), F.coalesce(named, F.lit(False)).alias("named"), F.coalesce(F.expr("a < b AND tokens <= 1500"), F.lit(False)).alias("within"))


_SPANS_SQL = "SELECT origin_chunk_id AS id, e16_span.char_start AS start, e16_span.char_end AS stop, ord AS tie FROM records WHERE e16_span IS NOT NULL AND origin_chunk_id IS NOT NULL"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).filter("e16_span IS NOT NULL AND origin_chunk_id IS NOT NULL")
    return rows.select(F.col("origin_chunk_id").alias("id"), F.col("e16_span.char_start").alias("start"), F.col("e16_span.char_end").alias("stop"), F.col("ord").alias("tie"))


@query(f"""WITH s AS ({_SPANS_SQL}) SELECT id, start, stop, tie FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id = a.id AND b.start <= a.start AND b.stop >= a.stop AND (b.start < a.start OR b.stop > a.stop OR b.tie < a.tie))""")
def span_maximal(spark, sf_dir):
    """Spans of split records that no other delivery of the same origin contains."""
    return sequences.maximal_spans(_spans(spark, sf_dir))


@query(f"""WITH s AS (SELECT DISTINCT id, start, stop FROM ({_SPANS_SQL})) SELECT a.id, a.start, a.stop, b.start AS next_start, a.stop - b.start AS shared FROM s a JOIN s b ON a.id = b.id AND a.start < b.start AND b.start < a.stop""")
def span_overlap(spark, sf_dir):
    """Overlapping spans of one origin, half-open: touching ones do not overlap."""
    s = _spans(spark, sf_dir).select("id", "start", "stop").distinct()
    other = s.select("id", F.col("start").alias("next_start"))
    return s.join(other, "id").filter("start < next_start AND next_start < stop").withColumn("shared", F.col("stop") - F.col("next_start"))


@query("""WITH s AS (SELECT DISTINCT origin_chunk_id AS id, e16_span.char_start::BIGINT AS start, e16_span.char_end::BIGINT AS stop FROM records WHERE e16_span IS NOT NULL AND origin_chunk_id IS NOT NULL), c AS (SELECT id, min(start) AS start, min(stop) AS stop FROM s GROUP BY 1)
SELECT s.id, s.start, s.stop, (c.start <= s.start AND s.stop <= c.stop) AS proven FROM s JOIN c USING (id)""")
def claims_in_span(spark, sf_dir):
    """Whether each span lies inside the first span of its origin: an interval containment join."""
    s = _spans(spark, sf_dir).select("id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).distinct()
    first = s.groupBy("id").agg(F.min("start").alias("start"), F.min("stop").alias("stop"))
    return context.covered(s, first, 4096)


@query("""WITH d AS (SELECT sha256(coalesce(text, '') || chr(31) || coalesce(retrieval_text, '')) AS body, source_path, array_to_string(section_path, '/') AS section, ord FROM records)
SELECT body, source_path, section, min(ord) AS kept, count(*) AS copies FROM d GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def dedup_locator(spark, sf_dir):
    """Records with the same text at the same place of the same source: the first is kept."""
    body = F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\x1f"), F.coalesce("retrieval_text", F.lit(""))), 256)
    rows = _records(spark, sf_dir).select(body.alias("body"), "source_path", F.array_join("section_path", "/").alias("section"), "ord")
    return context.first_seen(rows, ["body", "source_path", "section"], "ord").filter("copies > 1")


@query("""SELECT document_id, count(*) AS rows, sum(octet_length(encode(coalesce(text, '')))) AS bytes, sum(('0x' || sha256(coalesce(text, ''))[1:8])::BIGINT) AS digest FROM records GROUP BY 1""")
def manifest_hash(spark, sf_dir):
    """Rows, bytes and digest of each document's texts."""
    return content_manifest(_records(spark, sf_dir).select("document_id", "text"), "document_id", "text")


@query("""SELECT coalesce(r.chunk_id, v.chunk_id) AS chunk_id, CASE WHEN v.chunk_id IS NULL THEN 'no vector' WHEN r.chunk_id IS NULL THEN 'no record' WHEN r.kind <> v.kind THEN 'kind differs' ELSE 'ok' END AS state
FROM (SELECT chunk_id, min(kind) AS kind FROM records GROUP BY 1) r FULL JOIN (SELECT chunk_id, min(kind) AS kind FROM (SELECT chunk_id, 'text' AS kind FROM body_vectors UNION ALL SELECT chunk_id, 'visual_description' FROM description_vectors) GROUP BY 1) v ON r.chunk_id = v.chunk_id""")
def full_outer_compare(spark, sf_dir):
    """Records against vectors, both ways."""
    r = _records(spark, sf_dir).groupBy("chunk_id").agg(F.min("kind").alias("r"))
    v = table(spark, sf_dir, "body_vectors").select("chunk_id", F.lit("text").alias("v")).unionByName(table(spark, sf_dir, "description_vectors").select("chunk_id", F.lit("visual_description").alias("v")))
    both = r.join(v.groupBy("chunk_id").agg(F.min("v").alias("v")), "chunk_id", "full_outer")
    return both.select("chunk_id", F.when(F.col("v").isNull(), "no vector").when(F.col("r").isNull(), "no record").when(F.col("r") != F.col("v"), "kind differs").otherwise("ok").alias("state"))


@query("""WITH t AS (SELECT chunk_id, min(ord) AS ord FROM records WHERE kind = 'text' GROUP BY 1), v AS (SELECT ord, caption_chunk_ids[1] AS caption, prev_text_chunk_id AS prev, next_text_chunk_id AS next FROM records WHERE kind <> 'text')
SELECT v.ord, CASE WHEN c.ord IS NOT NULL THEN 'caption' WHEN p.ord IS NOT NULL THEN 'before' WHEN n.ord IS NOT NULL THEN 'after' ELSE 'none' END AS basis, coalesce(c.ord, p.ord, n.ord) AS source
FROM v LEFT JOIN t c ON c.chunk_id = v.caption LEFT JOIN t p ON p.chunk_id = v.prev LEFT JOIN t n ON n.chunk_id = v.next""")
def priority_left_join(spark, sf_dir):
    """The text each visual is explained by: its first caption, else the text before, else the text after."""
    rows = _records(spark, sf_dir)
    t = rows.filter("kind = 'text'").groupBy("chunk_id").agg(F.min("ord").alias("at"))
    side = lambda name: t.select(F.col("chunk_id").alias(name), F.col("at").alias(f"{name}_ord"))
    v = rows.filter("kind <> 'text'").select("ord", F.get("caption_chunk_ids", F.lit(0)).alias("c"), F.col("prev_text_chunk_id").alias("p"), F.col("next_text_chunk_id").alias("n"))
    joined = v.join(side("c"), "c", "left").join(side("p"), "p", "left").join(side("n"), "n", "left")
    basis = F.when(F.col("c_ord").isNotNull(), "caption").when(F.col("p_ord").isNotNull(), "before").when(F.col("n_ord").isNotNull(), "after").otherwise("none")
    return joined.select("ord", basis.alias("basis"), F.coalesce("c_ord", "p_ord", "n_ord").alias("source"))


@query(f"""WITH b AS (SELECT query_id, id, rank FROM ({_BM25_SQL}) WHERE rank <= 20 AND channel = 'body'), c AS (SELECT b.query_id AS case_id, rank, octet_length(encode(coalesce(text, ''))) AS cost FROM b JOIN records ON ord = id)
SELECT case_id, count(*) AS items, sum(cost) AS cost, sum(cost) <= 6000 AS fits FROM c WHERE rank <= 5 GROUP BY 1""")
def pack_top_n(spark, sf_dir):
    """The five best records of each search as context, with their bytes."""
    return context.packed_top(_cases(spark, sf_dir, 5), 5, 6000)


@query(f"""WITH RECURSIVE b AS (SELECT query_id, id, rank FROM ({_BM25_SQL}) WHERE rank <= 20 AND channel = 'body'), c AS (SELECT b.query_id AS case_id, rank, id, octet_length(encode(coalesce(text, ''))) AS cost FROM b JOIN records ON ord = id),
p AS (SELECT case_id, rank, id, cost, cost <= 6000 AS take, CASE WHEN cost <= 6000 THEN cost ELSE 0 END AS used FROM c WHERE rank = 1
UNION ALL SELECT c.case_id, c.rank, c.id, c.cost, p.used + c.cost <= 6000, CASE WHEN p.used + c.cost <= 6000 THEN p.used + c.cost ELSE p.used END FROM p JOIN c ON c.case_id = p.case_id AND c.rank = p.rank + 1)
SELECT case_id, rank, id, cost FROM p WHERE take""")
def pack_greedy(spark, sf_dir):
    """Context under a budget of 6,000 bytes: in rank order, each record that still fits."""
    return context.packed_greedy(_cases(spark, sf_dir, 20), 6000)


def _cases(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(case_id, rank, id, cost): the k best of the body's records, which alone are taken apart, as each channel is ranked by itself."""
    best = _small(lexical.bm25(_search_queries(spark, sf_dir), _texts(spark, sf_dir).filter("channel = 'body'"), k=k))
    size = _records(spark, sf_dir).select(F.col("ord").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    return best.join(size, "id").select(F.col("query_id").alias("case_id"), "rank", "id", "cost")


@query("""SELECT document_id, kind, count(*) AS records, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) FILTER (label IS NOT NULL) AS labelled FROM records GROUP BY 1, 2""")
def corpus_counts(spark, sf_dir):
    """What each document consists of."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return _records(spark, sf_dir).groupBy("document_id", "kind").agg(F.count("*").alias("records"), F.countDistinct("chunk_id").alias("chunks"), F.count(F.when(blank, 1)).alias("blank"), F.count("label").alias("labelled"))


@query("""WITH s AS (SELECT DISTINCT question_id AS id, epoch_us(created_at) AS start, epoch_us(finished_at) AS stop, job_id AS tie FROM jobs WHERE finished_at > created_at AND question_id IS NOT NULL)
SELECT id, start, stop, tie FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id = a.id AND b.tie <> a.tie AND b.start < a.stop AND a.start < b.stop)""")
def span_clear(spark, sf_dir):
    """Running times of jobs that clash with no other job of their question."""
    rows = table(spark, sf_dir, "jobs").filter("finished_at > created_at AND question_id IS NOT NULL")
    return sequences.clear_spans(rows.select(F.col("question_id").alias("id"), F.unix_micros("created_at").alias("start"), F.unix_micros("finished_at").alias("stop"), F.col("job_id").alias("tie")).distinct(), width=86_400_000_000)


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT id, start, stop, tie, row_number() OVER (PARTITION BY id ORDER BY tie, start, stop) AS n FROM ({_SPANS_SQL})),
f AS (SELECT id, n, start, stop, tie, true AS take, [{{'a': start, 'b': stop}}] AS kept FROM s WHERE n = 1 UNION ALL
SELECT s.id, s.n, s.start, s.stop, s.tie, len(list_filter(kept, lambda k: k.a < s.stop AND s.start < k.b)) = 0, CASE WHEN len(list_filter(kept, lambda k: k.a < s.stop AND s.start < k.b)) = 0 THEN list_append(kept, {{'a': s.start, 'b': s.stop}}) ELSE kept END FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1)
SELECT id, start, stop, tie FROM f WHERE take""")
def span_greedy(spark, sf_dir):
    """A subset of spans without overlap, the earlier record first."""
    return sequences.greedy_spans(_spans(spark, sf_dir))


@query(f"""WITH b AS (SELECT * FROM ({_BM25_SQL}) WHERE rank <= 10), h AS (SELECT query_id, channel, rank, chunk_id FROM b JOIN (SELECT ord AS id, chunk_id FROM records) USING (id)),
f AS (SELECT query_id, chunk_id, min(rank * 2 + (channel = 'visual')::INT) AS seen, count(*) AS hits FROM h GROUP BY 1, 2) SELECT query_id, chunk_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id) AS first_seen FROM f""")
def rerank_input(spark, sf_dir):
    """Candidates of each search from all channels, each chunk once, in the order first seen."""
    return _candidates(spark, sf_dir)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _small(_best(spark, sf_dir, 10))
    hits = best.join(_records(spark, sf_dir).select(F.col("ord").alias("id"), "chunk_id"), "id")
    seen = hits.groupBy("query_id", "chunk_id").agg(F.min(F.col("rank") * 2 + (F.col("channel") == "visual").cast("int")).alias("seen"), F.count("*").alias("hits"))
    return seen.withColumn("first_seen", F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "chunk_id"))).drop("seen")


@query(f"""WITH b AS (SELECT * FROM ({_BM25_SQL}) WHERE rank <= 10), h AS (SELECT query_id, channel, rank, chunk_id FROM b JOIN (SELECT ord AS id, chunk_id FROM records) USING (id)),
f AS (SELECT query_id, chunk_id, min(rank * 2 + (channel = 'visual')::INT) AS seen FROM h GROUP BY 1, 2), o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id) AS first_seen FROM f),
t AS (SELECT chunk_id, arg_min({BODY_SQL}, ord) AS body FROM records GROUP BY 1), s AS (SELECT query_id, chunk_id, first_seen, len(list_filter(list_distinct({TOKENS_SQL.format('query')}), lambda x: list_contains({TOKENS_SQL.format('body')}, x))) AS score FROM o JOIN ({_SEARCH}) USING (query_id) JOIN t USING (chunk_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM s""")
def rerank_order(spark, sf_dir):
    """Candidates reordered by a pair score (shared tokens stand in for a model), ties as first seen."""
    body = T.retrievable(F.col("kind"), F.col("text"), F.col("retrieval_text"))
    candidates = kept(_candidates(spark, sf_dir))
    wanted = _small(candidates.select("chunk_id").distinct())
    texts = _records(spark, sf_dir).join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min_by(body, "ord").alias("body"))
    pairs = candidates.join(_search_queries(spark, sf_dir).select("query_id", "query"), "query_id").join(texts, "chunk_id")
    scored = pairs.select("query_id", "chunk_id", "first_seen", F.size(F.array_intersect(T.tokens(F.col("query")), T.tokens(F.col("body")))).alias("score"))
    return scored.select("query_id", "chunk_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen")).alias("rank"))


@query(r"""SELECT ord, regexp_extract(text, '^(?:Fig(?:ure)?[.]?|Tab(?:le)?[.]?|TABLE|图|表) ?([0-9IVX]+)', 1) AS number, regexp_matches(text, '^(?:Fig(?:ure)?[.]?|Tab(?:le)?[.]?|TABLE|图|表) ?[0-9IVX]+ ?[.:：]') AS separated,
length(regexp_replace(text, '^(?:Fig(?:ure)?[.]?|Tab(?:le)?[.]?|TABLE|图|表) ?[0-9IVX]+ ?[.:：]? ?', '')) AS title_chars, regexp_matches(text, '[0-9]+[.][0-9]+') AS has_data, strpos(coalesce(retrieval_text, ''), chr(10) || 'SOURCE:' || chr(10)) AS source_at FROM records WHERE kind <> 'text' AND text IS NOT NULL""")
def caption_analysis(spark, sf_dir):
    """Captions of visuals taken apart: number, separator, length of the title, data inside; and where the source block of the retrieval text begins."""
    head = "^(?:Fig(?:ure)?[.]?|Tab(?:le)?[.]?|TABLE|图|表) ?[0-9IVX]+"
    rows = _records(spark, sf_dir).filter("kind <> 'text' AND text IS NOT NULL")
    return rows.select(
        "ord",
        F.regexp_extract("text", "^(?:Fig(?:ure)?[.]?|Tab(?:le)?[.]?|TABLE|图|表) ?([0-9IVX]+)", 1).alias("number"),
        F.col("text").rlike(head + " ?[.:：]").alias("separated"),
        F.length(F.regexp_replace("text", head + " ?[.:：]? ?", "")).alias("title_chars"),
        F.col("text").rlike("[0-9]+[.][0-9]+").alias("has_data"),
        F.instr(F.coalesce("retrieval_text", F.lit("")), "\nSOURCE:\n").alias("source_at"),
    )


@query("""SELECT chunk_id, count(*) AS deliveries, count(DISTINCT coalesce(document_title, '')) AS titles, count(DISTINCT coalesce(lang, '')) AS langs, count(DISTINCT sha256(coalesce(text, ''))) AS texts, arg_max(ord, (loaded_at, ord)) AS last FROM records GROUP BY 1 HAVING count(*) > 1""")
def delivery_changes(spark, sf_dir):
    """What changed between the deliveries of a chunk."""
    distinct = lambda c: F.countDistinct(F.coalesce(c, F.lit("")))
    g = _records(spark, sf_dir).select("chunk_id", "document_title", "lang", "loaded_at", "ord", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")).groupBy("chunk_id")
    return g.agg(F.count("*").alias("deliveries"), distinct("document_title").alias("titles"), distinct("lang").alias("langs"), F.countDistinct("t").alias("texts"), F.max_by("ord", F.struct("loaded_at", "ord")).alias("last")).filter("deliveries > 1")


@query("""WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2), v AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT vec_id, label, sum(x * c) / sqrt(sum(x * x) * sum(c * c)) AS cos FROM v JOIN c USING (label, i) GROUP BY 1, 2) SELECT label, count(*) AS vectors, round(min(cos), 5) AS least, round(avg(cos), 5) AS mean, count(*) FILTER (cos < 0.1) AS far FROM s GROUP BY 1""")
def vec_compare_cosine(spark, sf_dir):
    """Each vector against the centre of its label: least and mean cosine, and how many are far off."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = e.groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("c"))  # as many as the vector is long
    centre = centre.select("label", F.transform("c", lambda x: x["c"]).alias("c"))
    v = table(spark, sf_dir, "embeddings").join(centre, "label")
    cos = vectors.dot(F.col("embedding"), F.col("c")) / F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")) * vectors.dot(F.col("c"), F.col("c")))
    return v.select("label", cos.alias("cos")).groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.min("cos"), 5).alias("least"), F.round(F.avg("cos"), 5).alias("mean"), F.count(F.when(F.col("cos") < 0.1, 1)).alias("far"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score FROM q JOIN embeddings v USING (label)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS candidates FROM b) SELECT query_id, 'ok' AS status, candidates, rank, id, score FROM t WHERE rank <= 10""")
def vec_topk_by_label(spark, sf_dir):
    """The ten most similar vectors with the label of each hundredth vector."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return vectors.top_in_scope(e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"), "label", k=10)


@query(f"""WITH ch AS ({CHANNEL_SQL}), w AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM (SELECT query_id, {TOKENS_SQL.format('query')} AS t FROM ({_SEARCH})) WHERE len(t) >= 2),
p AS (SELECT id, ' ' || array_to_string(t, ' ') || ' ' AS padded FROM ch) SELECT query_id, phrase, id, ((length(padded) - length(replace(padded, ' ' || phrase || ' ', ''))) // (length(phrase) + 2))::INT AS tf FROM w JOIN p ON contains(padded, ' ' || phrase || ' ')""")
def ngram_tf(spark, sf_dir):
    """How often each two neighbouring words of a search stand together in a record, counted without overlap; records are found by an equi-join on pairs of words."""
    pairs = F.array_distinct(lexical.runs(T.tokens(F.col("query")), 2))
    wanted = _search_queries(spark, sf_dir).select("query_id", F.explode(pairs).alias("phrase"))
    return lexical.phrase_frequency(_texts(spark, sf_dir), wanted)


@query(r"""SELECT ord, regexp_extract(source_path, '([^/]+)\.[^./]*$', 1) AS stem, coalesce(regexp_matches(image_path, '^[^\s]+\.png$') AND NOT regexp_matches(image_path, '^https?://'), false) AS local_figure,
sha256(array_to_string(list_filter([CASE WHEN document_title <> '' THEN 'TITLE: ' || document_title END, CASE WHEN array_to_string(section_path, ' / ') <> '' THEN 'SECTION: ' || array_to_string(section_path, ' / ') END, CASE WHEN label <> '' THEN 'LABEL: ' || label END, 'SOURCE:', coalesce(text, '')], lambda x: x IS NOT NULL), chr(10))) AS block,
length(CASE WHEN strpos(retrieval_text, chr(10) || 'SOURCE:' || chr(10)) > 0 THEN substr(retrieval_text, strpos(retrieval_text, chr(10) || 'SOURCE:' || chr(10)) + 9) ELSE retrieval_text END) AS source_chars,
document_id || '::text::context-' || substr(sha256(text), 1, 20) AS content_id, printf('s%d_%d', e16_span.char_start, e16_span.char_end) AS span FROM records""")
def record_builders(spark, sf_dir):
    """What a record is encoded as, and the ids made of its path, content and span."""
    start, stop = F.col("e16_span.char_start"), F.col("e16_span.char_end")
    return _records(spark, sf_dir).select(
        "ord",
        T.stem(F.col("source_path")).alias("stem"),
        F.coalesce(T.is_local_figure(F.col("image_path")), F.lit(False)).alias("local_figure"),
        T.sha256(T.input_block(F.col("document_title"), F.array_join("section_path", " / "), F.col("label"), F.col("text"))).alias("block"),
        F.length(T.source_block(F.col("retrieval_text"))).alias("source_chars"),
        T.content_id(F.col("document_id"), F.col("text")).alias("content_id"),
        F.when(start.isNotNull(), T.span_id(start, stop)).alias("span"),
    )


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY chunk_id) AS deliveries FROM records), k AS (SELECT ord, chunk_id, deliveries, CASE WHEN image_path <> '' AND source_path <> '' THEN sha256(coalesce(text, '') || chr(31) || coalesce(retrieval_text, '') || chr(31) || source_path || chr(31) || image_path || chr(31) || coalesce(document_title, '') || chr(31) || coalesce(label, '') || chr(31) || coalesce(visual_type, '') || chr(31) || coalesce(array_to_string(section_path, '/'), '')) ELSE chunk_id END AS identity FROM f WHERE n = 1)
SELECT min(ord) AS kept, count(*) AS chunks, sum(deliveries)::BIGINT AS rows, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM k GROUP BY identity HAVING sum(deliveries) > 1""")
def dedup_evidence(spark, sf_dir):
    """Records that repeat others, in two steps: the same chunk id; then other ids with the same text, metadata and rendered asset. Without an asset to prove the place, both stay. The kept record has the ids of all."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "retrieval_text", "source_path", "image_path", "document_title", "label", "visual_type")]
    identity = F.sha2(F.concat_ws("\x1f", *parts, F.coalesce(F.array_join("section_path", "/"), F.lit(""))), 256)
    proven = F.expr("image_path <> '' AND source_path <> ''")
    rows = _records(spark, sf_dir).select("chunk_id", "ord", F.when(proven, identity).otherwise(F.col("chunk_id")).alias("identity"))
    return context.merged(rows, "chunk_id", "ord", "identity")


@query(f"""WITH b AS (SELECT query_id AS case_id, rank, id FROM ({_BM25_SQL}) WHERE rank <= 10 AND channel = 'body'), t AS (SELECT b.*, coalesce(text, '') AS text, list_distinct(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: trim(x)), lambda x: length(x) >= 20)) AS lines FROM b JOIN records ON ord = id)
SELECT case_id, x.id AS first, y.id AS second, x.text = y.text AS exact, x.text <> y.text AND (contains(x.text, y.text) OR contains(y.text, x.text)) AS contained, CASE WHEN x.text = y.text THEN 0 ELSE len(list_intersect(x.lines, y.lines)) END::INT AS shared_lines
FROM t x JOIN t y USING (case_id) WHERE x.rank < y.rank AND (x.text = y.text OR contains(x.text, y.text) OR contains(y.text, x.text) OR len(list_intersect(x.lines, y.lines)) > 0)""")
def case_overlaps(spark, sf_dir):
    """Pairs of a search's ten best texts that repeat each other: exactly, one inside the other, or in lines of twenty characters and more."""
    best = _best(spark, sf_dir, 10).filter("channel = 'body'").select(F.col("query_id").alias("case_id"), "rank", "id")
    texts = _records(spark, sf_dir).select(F.col("ord").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return context.pair_overlaps(kept(best.join(texts, "id")))


_COST_SQL = "octet_length(encode('[S' || rank || '] ' || coalesce(document_title, '') || chr(10) || coalesce(text, '') || chr(10) || chr(10)))"


@query(f"""WITH b AS (SELECT query_id, id, rank FROM ({_BM25_SQL}) WHERE rank <= 20 AND channel = 'body'), c AS (SELECT b.query_id AS case_id, {_COST_SQL} AS cost FROM b JOIN records ON ord = id), g AS (SELECT case_id, count(*) AS items, sum(cost) AS cost FROM c GROUP BY 1),
a AS (SELECT query_id AS case_id, 120 + octet_length(encode(query)) AS base FROM ({_SEARCH})) SELECT case_id, coalesce(items, 0) AS items, base + coalesce(cost, 0) AS cost, CASE WHEN base > 12000 THEN 'envelope over budget' WHEN base + coalesce(cost, 0) > 12000 THEN 'refused' ELSE 'fits' END AS status FROM a LEFT JOIN g USING (case_id)""")
def pack_all(spark, sf_dir):
    """All records of each search as context, in the form they are sent, with the question: what does not fit is refused, never cut; searches without records stay."""
    best = _small(_best(spark, sf_dir, 20).filter("channel = 'body'"))
    texts = _records(spark, sf_dir).select(F.col("ord").alias("id"), "document_title", "text")
    block = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.coalesce("document_title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    items = best.join(texts, "id").select(F.col("query_id").alias("case_id"), F.octet_length(block).cast("long").alias("cost"))
    cases = _search_queries(spark, sf_dir).select(F.col("query_id").alias("case_id"), (F.octet_length("query") + 120).cast("long").alias("base"))
    return context.packed_all(cases, items, 12_000)


_CHECK_SQL = "SELECT '{0}' AS rule, count(*) AS failures FROM {1}"
_VECTOR_OWNERS = "(SELECT chunk_id, 'text' AS kind FROM body_vectors UNION ALL SELECT chunk_id, 'visual_description' FROM description_vectors)"


@query(" UNION ALL ".join(_CHECK_SQL.format(n, q) for n, q in [
    ("vector shape", "(SELECT vector FROM body_vectors UNION ALL SELECT vector FROM description_vectors) WHERE vector IS NULL OR len(vector) <> 64"),
    ("vector values", "(SELECT vector FROM body_vectors UNION ALL SELECT vector FROM description_vectors) WHERE len(vector) = 64 AND (len(list_filter(vector, lambda x: isnan(x))) > 0 OR abs(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) - 1) > 1e-3)"),
    ("vector without record", f"(SELECT DISTINCT chunk_id, kind FROM {_VECTOR_OWNERS}) v ANTI JOIN records r ON r.chunk_id = v.chunk_id AND r.kind = v.kind"),
    ("caption without text", "(SELECT DISTINCT unnest(caption_chunk_ids) AS chunk_id FROM records) c ANTI JOIN (SELECT chunk_id FROM records WHERE kind = 'text') r USING (chunk_id)"),
    ("neighbour without text", "(SELECT DISTINCT prev_text_chunk_id AS chunk_id FROM records WHERE prev_text_chunk_id IS NOT NULL UNION SELECT next_text_chunk_id FROM records WHERE next_text_chunk_id IS NOT NULL) c ANTI JOIN (SELECT chunk_id FROM records WHERE kind = 'text') r USING (chunk_id)"),
    ("document not in catalog", "(SELECT DISTINCT document_id FROM records WHERE document_id IS NOT NULL) d ANTI JOIN doc_catalog c USING (document_id)"),
    ("chunk with two texts", "(SELECT chunk_id FROM records GROUP BY 1 HAVING count(DISTINCT sha256(coalesce(text, ''))) > 1)"),
]))
def load_check(spark, sf_dir):
    """What must hold before records and vectors are searched together, and how often it does not."""
    rows = _records(spark, sf_dir)
    named = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("failures"))
    owned = [table(spark, sf_dir, t).select("vector", "chunk_id", F.lit(k).alias("kind")) for t, k in (("body_vectors", "text"), ("description_vectors", "visual_description"))]
    both = owned[0].unionByName(owned[1])
    texts = rows.filter("kind = 'text'").select("chunk_id").distinct()
    v = F.col("vector")
    fits = F.size(v) == 64
    linked = rows.select(F.explode(F.array("prev_text_chunk_id", "next_text_chunk_id")).alias("chunk_id")).filter("chunk_id IS NOT NULL").distinct()
    checks = [
        named("vector shape", both.filter(v.isNull() | ~fits)),
        named("vector values", both.filter(fits & (F.exists(v, F.isnan) | (F.abs(F.sqrt(vectors.dot(v, v)) - 1) > 1e-3)))),
        named("vector without record", both.select("chunk_id", "kind").distinct().join(rows.select("chunk_id", "kind").distinct(), ["chunk_id", "kind"], "left_anti")),
        named("caption without text", rows.select(F.explode("caption_chunk_ids").alias("chunk_id")).distinct().join(texts, "chunk_id", "left_anti")),
        named("neighbour without text", linked.join(texts, "chunk_id", "left_anti")),
        named("document not in catalog", rows.select("document_id").filter("document_id IS NOT NULL").distinct().join(table(spark, sf_dir, "doc_catalog").select("document_id").distinct(), "document_id", "left_anti")),
        named("chunk with two texts", rows.groupBy("chunk_id").agg(F.countDistinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("n")).filter("n > 1")),
    ]
    return reduce(DataFrame.unionByName, checks)


@query("""SELECT document_id, kind, count(*) AS rows, sum(length(text))::BIGINT AS chars, count(*) FILTER (len(section_path) > 0) AS sections FROM records GROUP BY 1, 2""")
def json_round_trip(spark, sf_dir):
    """The records written as JSON lines in the form of chunks and read again by their schema."""
    meta = F.struct(*[c for c in ("document_id", "document_title", "source_path", "source_url", "section_path", "image_path", "visual_type", "label", "prev_text_chunk_id", "next_text_chunk_id", "caption_chunk_ids")])
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    write_json_lines(_records(spark, sf_dir).select("chunk_id", "kind", "seq", "text", "retrieval_text", meta.alias("metadata")), path)
    rows = json_lines(spark, path)
    return rows.groupBy("metadata.document_id", "kind").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"), F.count(F.when(F.size("metadata.section_path") > 0, 1)).alias("sections"))


@query("""SELECT count(*) AS rows, sum(length(text))::BIGINT AS chars, true AS manifest_agrees FROM records""")
def table_round_trip(spark, sf_dir):
    """The records written as a new table with its manifest last, read again, and compared with the manifest."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows = _records(spark, sf_dir).select("document_id", "ord", "text")
    write_new(rows, path, content_manifest(rows, "document_id", "text"))
    back = spark.read.parquet(path)
    columns = ["document_id", "rows", "bytes", "digest"]
    said = spark.read.schema("document_id string, rows long, bytes long, digest long").json(f"{path}.manifest").select(columns)
    differ = content_manifest(back, "document_id", "text").select(columns).exceptAll(said).agg(F.count("*").alias("n"))
    return back.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).crossJoin(differ).select("rows", "chars", (F.col("n") == 0).alias("manifest_agrees"))


@query("""WITH b AS (SELECT chunk_id, min(ord) AS ord, arg_min(document_title, ord) FILTER (document_title IS NOT NULL) AS t0, arg_min(lang, ord) FILTER (lang IS NOT NULL) AS l0, arg_min(document_id, ord) FILTER (document_id IS NOT NULL) AS document_id FROM records GROUP BY 1),
l AS (SELECT chunk_id, arg_max(document_title, (loaded_at, ord)) FILTER (document_title IS NOT NULL) AS t1, arg_max(lang, (loaded_at, ord)) FILTER (lang IS NOT NULL) AS l1 FROM records GROUP BY 1), c AS (SELECT document_id, min(document_title) AS t2 FROM doc_catalog GROUP BY 1)
SELECT chunk_id, ord, document_id, coalesce(t2, t1, t0) AS document_title, coalesce(l1, l0) AS lang FROM b JOIN l USING (chunk_id) LEFT JOIN c USING (document_id)""")
def overlay_layers(spark, sf_dir):
    """Each chunk as first delivered, under what its last deliveries say, under the catalog's titles."""
    rows = _records(spark, sf_dir).select("chunk_id", "ord", "document_id", "document_title", "lang", "loaded_at")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("loaded_at", "ord"))).alias(c)
    base = rows.groupBy("chunk_id").agg(F.min("ord").alias("ord"), first("document_id"), first("document_title"), first("lang"))
    later = rows.groupBy("chunk_id").agg(last("document_title"), last("lang"))
    titles = table(spark, sf_dir, "doc_catalog").groupBy("document_id").agg(F.min("document_title").alias("document_title"))
    return context.overlaid(context.overlaid(base, [later], "chunk_id"), [titles], "document_id")


_HELD_SQL = f"SELECT sha256({BODY_SQL}) AS h, u.ord, r.kind FROM ({USABLE_SQL.format('body_vectors')} UNION ALL {USABLE_SQL.format('description_vectors')}) u JOIN records r USING (ord)"


@query(f"""WITH v AS (SELECT h, kind, min(ord) AS at FROM ({_HELD_SQL}) GROUP BY 1, 2), r AS (SELECT ord, kind, sha256({BODY_SQL}) AS h FROM records)
SELECT r.ord, v.at AS vector_of FROM r JOIN v USING (h, kind) WHERE r.ord <> v.at""")
def vector_lookup(spark, sf_dir):
    """Records that can take the vector of another record of their kind with the same text, by the hash of the text."""
    body = T.sha256(T.retrievable(F.col("kind"), F.col("text"), F.col("retrieval_text")))
    rows = _records(spark, sf_dir).select("ord", "kind", body.alias("h"))
    both = vectors.usable(table(spark, sf_dir, "body_vectors")).select("ord").unionByName(vectors.usable(table(spark, sf_dir, "description_vectors")).select("ord"))
    held = both.join(rows, "ord").groupBy("h", "kind").agg(F.min("ord").alias("vector_of"))
    return rows.join(held, ["h", "kind"]).filter("ord <> vector_of").select("ord", "vector_of")


@query(f"""SELECT ord, round(sqrt(list_dot_product(v, v)), 4) AS norm, round(sqrt(list_dot_product(w, w)), 4) AS unit_norm, round(w[1], 4) AS first FROM (SELECT ord, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w FROM (SELECT ord, vector::DOUBLE[] AS v FROM ({USABLE_SQL.format('body_vectors')})))""")
def vec_unit(spark, sf_dir):
    """Body vectors scaled to unit length."""
    v = vectors.usable(table(spark, sf_dir, "body_vectors")).select("ord", F.col("vector").alias("v"), vectors.unit(F.col("vector")).alias("w"))
    norm = lambda c: F.round(F.sqrt(vectors.dot(F.col(c), F.col(c))), 4)
    return v.select("ord", norm("v").alias("norm"), norm("w").alias("unit_norm"), F.round(F.get("w", F.lit(0)), 4).alias("first"))


@query(r"""SELECT ord, printf('s%d_%d', e16_span.char_start, e16_span.char_end) AS span, e16_span.char_start AS start, e16_span.char_end AS stop, e16_span.char_end - e16_span.char_start AS chars FROM records WHERE e16_span.char_start IS NOT NULL AND e16_span.char_end IS NOT NULL""")
def span_ids(spark, sf_dir):
    """Ids of spans, and the spans read from the ids again."""
    named = _records(spark, sf_dir).filter("e16_span.char_start IS NOT NULL AND e16_span.char_end IS NOT NULL").select("ord", T.span_id(F.col("e16_span.char_start"), F.col("e16_span.char_end")).alias("span"))
    read = named.withColumn("s", T.span_of(F.col("span")))
    return read.select("ord", "span", "s.start", "s.stop", (F.col("s.stop") - F.col("s.start")).alias("chars"))

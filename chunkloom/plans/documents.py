"""Queries over whole texts and the catalog: paragraphs, duplicates, projections, identities."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import context, resolve, sequences
from ..sources.tables import table
from .queries import Registered

query = Registered()
QUERIES, SQL = query.queries, query.sql


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_PARAS = r"""SELECT doc_id, unnest(p) AS paragraph, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*(?:\n[ \t]*)+'), lambda x: trim(x, chr(32) || chr(9) || chr(10))),
lambda x: x <> '' AND NOT starts_with(x, '<!--') AND NOT regexp_full_match(x, '[0-9]{1,4}')) AS p FROM documents)"""


@query(f"SELECT doc_id, n, length(paragraph) AS chars, sha256(paragraph) AS digest FROM ({_PARAS})")
def para_split(spark, sf_dir):
    """Paragraphs of every text."""
    parts = sequences.exploded_paragraphs(_documents(spark, sf_dir))
    return parts.select("doc_id", "n", F.length("paragraph").alias("chars"), T.sha256(F.col("paragraph")).alias("digest"))


@query(f"""SELECT doc_id, grp, count(*) AS paragraphs, min(n) AS first, sum(length(paragraph)) AS chars FROM (SELECT *, sum(CASE WHEN starts_with(paragraph, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM ({_PARAS})) GROUP BY 1, 2""")
def heading_groups(spark, sf_dir):
    """Paragraphs grouped at headings."""
    return sequences.heading_groups(_documents(spark, sf_dir)).groupBy("doc_id", "grp").agg(F.count("*").alias("paragraphs"), F.min("n").alias("first"), F.sum("chars").alias("chars"))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, n, length(paragraph) AS len FROM ({_PARAS})),
f AS (SELECT doc_id, n, len AS open, NULL::BIGINT AS done FROM p WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, CASE WHEN f.open >= 220 THEN p.len ELSE f.open + 2 + p.len END, CASE WHEN f.open >= 220 THEN f.open END FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1),
e AS (SELECT doc_id, done AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM f WHERE done IS NOT NULL), l AS (SELECT doc_id, arg_max(open, n) AS open, count(done) AS m FROM f GROUP BY 1)
SELECT e.doc_id, k AS n, e.chars + CASE WHEN k = e.m AND l.open < 220 THEN 2 + l.open ELSE 0 END AS chars FROM e JOIN l USING (doc_id) UNION ALL SELECT doc_id, m + 1, open FROM l WHERE open >= 220 OR m = 0""")
def thin_merge(spark, sf_dir):
    """Chunk lengths after thin paragraphs are merged with their neighbours."""
    return sequences.merged_thin(_documents(spark, sf_dir))


@query("SELECT text_sha, min(doc_id) AS kept, count(*) AS copies FROM (SELECT sha256(text) AS text_sha, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def dedup_first_seen(spark, sf_dir):
    """Distinct texts, the first document of each, and its copies."""
    rows = _documents(spark, sf_dir).filter("text IS NOT NULL").select(T.sha256(F.col("text")).alias("text_sha"), "doc_id")
    return context.first_seen(rows, ["text_sha"], "doc_id")


@query(r"""WITH l AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: length(x) >= 20))) AS line FROM documents),
c AS (SELECT line FROM l GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, count(*) AS lines, count(c.line) AS shared FROM l LEFT JOIN c USING (line) GROUP BY 1""")
def shared_lines(spark, sf_dir):
    """How many lines of each text stand in other texts too."""
    return context.shared_lines(_documents(spark, sf_dir).select("doc_id", "text"))


@query("""SELECT a.text_sha, a.doc_id, b.kept FROM (SELECT sha256(text) AS text_sha, doc_id FROM documents WHERE text IS NOT NULL) a JOIN (SELECT sha256(text) AS text_sha, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL GROUP BY 1) b USING (text_sha) WHERE a.doc_id <> b.kept""")
def overlap_exact(spark, sf_dir):
    """Each repeated text with the document that has it first."""
    rows = _documents(spark, sf_dir).filter("text IS NOT NULL").select(T.sha256(F.col("text")).alias("text_sha"), "doc_id")
    first = context.first_seen(rows, ["text_sha"], "doc_id").filter("copies > 1").select("text_sha", "kept")
    return rows.join(first, "text_sha").filter("doc_id <> kept").select("text_sha", "doc_id", "kept")


@query("""SELECT domain, count(*) AS docs, sum(octet_length(encode(text))) AS bytes, max(octet_length(encode(text))) AS largest, round(median(octet_length(encode(text))), 1) AS median_bytes FROM documents GROUP BY 1""")
def byte_budget_stats(spark, sf_dir):
    """Sizes of the texts by domain; the median is exact, by the number of texts of each size."""
    sized = _documents(spark, sf_dir).select("domain", F.octet_length("text").cast("long").alias("size")).groupBy("domain", "size").agg(F.count("*").alias("n"))
    totals = sized.groupBy("domain").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.max("size").alias("largest"), F.sum(F.when(F.col("size").isNotNull(), F.col("n"))).alias("sized"))
    so_far = sequences.running(sized.filter("size IS NOT NULL"), "domain", F.floor(F.col("size") / 4096), ["size"], F.col("n"), "upto")
    placed = so_far.join(totals.select(F.col("domain").alias("of"), "sized"), F.col("domain").eqNullSafe(F.col("of")))
    holds = lambda p: F.max(F.when((F.col("upto") >= p) & (F.col("upto") - F.col("n") < p), F.col("size")))
    middle = placed.groupBy("of").agg(F.round((holds(F.floor((F.col("sized") + 1) / 2)) + holds(F.floor(F.col("sized") / 2) + 1)) / 2, 1).alias("median_bytes"))
    return totals.join(middle, F.col("domain").eqNullSafe(F.col("of")), "left").select("domain", "docs", "bytes", "largest", "median_bytes")


_SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


@query(rf"""SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g')), '([\\`*_\[\]<>#|!~])', '\\\1', 'g')) AS escaped,
length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^\n]*?\)', '', 'g'), '(?:\[S[0-9]+\]\s*)+(的(?:原图|图表|正文|内容|描述))', '对应证据\1', 'g'), '\[S[0-9]+\]', '', 'g'), '[ \t]+([，。；：,.!?])', '\1', 'g'), '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g')) AS shown FROM documents""")
def text_projections(spark, sf_dir):
    """Texts escaped for Markdown, and as an answer would be shown."""
    return _documents(spark, sf_dir).select("doc_id", T.sha256(T.escaped(F.col("text"))).alias("escaped"), F.length(T.shown(F.col("text"))).alias("shown"))


@query(r"""SELECT doc_id, len(list_distinct(i)) AS identifiers, array_to_string(list_sort(list_distinct(i)), ',') AS found FROM (SELECT doc_id, list_concat(list_concat(list_concat(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b'),
regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9]*\.[A-Za-z_][A-Za-z0-9_.]*')), regexp_extract_all(text, '\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]+\b')), regexp_extract_all(text, '[`''"]([A-Za-z_][A-Za-z0-9_.]*)[`''"]', 1)) AS i FROM documents WHERE text IS NOT NULL)""")
def code_identifiers(spark, sf_dir):
    """Identifiers of program code in every text."""
    ids = T.code_identifiers(F.col("text"))
    return _documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.size(ids).alias("identifiers"), F.array_join(F.array_sort(ids), ",").alias("found"))


@query(f"""SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(paragraph), '[a-z]{{4,}}'))) AS term FROM ({_PARAS}) WHERE starts_with(paragraph, '#')) GROUP BY 1""")
def heading_keywords(spark, sf_dir):
    """Words of headings, by how many headings have them."""
    heads = sequences.exploded_paragraphs(_documents(spark, sf_dir)).filter(T.is_heading(F.col("paragraph")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("paragraph"), F.lit("[a-z]{4,}"), F.lit(0)))
    return heads.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


@query("""SELECT vendor, count(*) AS documents, count(*) FILTER (include_in_index) AS indexed FROM (SELECT document_id, include_in_index, unnest(list_distinct(vendors)) AS vendor FROM doc_catalog) GROUP BY 1""")
def vendor_docs(spark, sf_dir):
    """Documents of each vendor."""
    each = table(spark, sf_dir, "doc_catalog").select("include_in_index", F.explode(F.array_distinct("vendors")).alias("vendor"))
    return each.groupBy("vendor").agg(F.count("*").alias("documents"), F.count(F.when(F.col("include_in_index"), 1)).alias("indexed"))


@query("""SELECT document_id, array_to_string(list_sort(list_distinct(list_filter([lower(document_title), lower(split_part(document_title, ':', 1))] || list_transform(coalesce(aliases, []), lambda x: lower(x)), lambda x: x IS NOT NULL)))[1:12], '|') AS names,
CASE WHEN regexp_matches(source_url, '^https?://[^\\s]+$') THEN source_url END AS url FROM doc_catalog WHERE document_title IS NOT NULL""")
def identity_names(spark, sf_dir):
    """The names each source goes by: distinct, sorted, the first twelve, and its safe address."""
    return identities(table(spark, sf_dir, "doc_catalog"), most=12)


def identities(catalog, *, most: int | None = None):
    """(document_id, names, url) of a catalog's titled documents; most: how many names are given, all if None."""
    own = F.array(F.lower("document_title"), F.lower(F.split_part("document_title", F.lit(":"), F.lit(1))))
    names = F.array_sort(F.array_distinct(F.filter(F.concat(own, F.transform(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), F.lower)), lambda x: x.isNotNull())))
    return catalog.filter("document_title IS NOT NULL").select("document_id", F.array_join(F.slice(names, 1, most) if most else names, "|").alias("names"), T.safe_url(F.col("source_url")).alias("url"))


_WORDS_SQL = r"list_distinct(regexp_extract_all(regexp_replace(lower({0}), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+'))"
_NAMED_SQL = f"""WITH n AS MATERIALIZED (SELECT DISTINCT owner, name, {_WORDS_SQL.format('name')} AS words FROM ({{0}}) WHERE name IS NOT NULL), q AS MATERIALIZED (SELECT question_id, unnest({_WORDS_SQL.format('original_query')}) AS word FROM questions),
w AS (SELECT owner, name, len(words) AS need, unnest(words) AS word FROM n) SELECT question_id, owner, name FROM q JOIN w USING (word) GROUP BY question_id, owner, name, need HAVING count(*) = need"""
_ALIASES_SQL = "SELECT document_id AS owner, unnest(aliases) AS name FROM doc_catalog"
_SOURCE_NAMES_SQL = f"SELECT document_id AS owner, document_title AS name FROM doc_catalog UNION ALL SELECT document_id, split_part(document_id, '-', 1) FROM doc_catalog UNION ALL {_ALIASES_SQL}"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "questions").select(F.col("question_id").alias("id"), F.col("original_query").alias("text"))


def _aliases(spark, sf_dir):
    return table(spark, sf_dir, "doc_catalog").select(F.col("document_id").alias("owner"), F.explode("aliases").alias("name"))


@query(f"SELECT question_id, count(DISTINCT owner) AS sources, min(owner) AS first FROM ({_NAMED_SQL.replace("{0}", _SOURCE_NAMES_SQL)}) GROUP BY 1")
def name_contains(spark, sf_dir):
    """Sources that a question names: by title, by the first part of the id, or by an alias, of which it must have every word."""
    catalog = table(spark, sf_dir, "doc_catalog")
    names = catalog.select(F.col("document_id").alias("owner"), F.explode(F.array("document_title", F.split_part("document_id", F.lit("-"), F.lit(1)))).alias("name"))
    named = resolve.named_whole(_asked(spark, sf_dir), names.unionByName(_aliases(spark, sf_dir)))
    return named.groupBy(F.col("id").alias("question_id")).agg(F.countDistinct("owner").alias("sources"), F.min("owner").alias("first"))


@query(f"SELECT question_id, owner AS document_id, name AS alias FROM ({_NAMED_SQL.replace("{0}", _ALIASES_SQL)})")
def token_division(spark, sf_dir):
    """Aliases of which a question has every word: relational division."""
    return resolve.named_whole(_asked(spark, sf_dir), _aliases(spark, sf_dir)).select(F.col("id").alias("question_id"), F.col("owner").alias("document_id"), F.col("name").alias("alias"))


@query(rf"""WITH n AS ({_NAMED_SQL.replace("{0}", _ALIASES_SQL)}), p AS (SELECT question_id, owner, name, original_query AS t, unnest(range(1, length(original_query) + 1)) AS place FROM n JOIN questions USING (question_id))
SELECT question_id, owner AS document_id, name AS alias, count(*) AS times, min(place) AS first, max(place) AS last FROM p WHERE substr(t, place, length(name)) = name AND (place = 1 OR NOT regexp_matches(substr(t, place - 1, 1), '[A-Za-z0-9_]')) AND NOT regexp_matches(substr(t, place + length(name), 1), '[A-Za-z0-9_]') GROUP BY 1, 2, 3""")
def name_occurrences(spark, sf_dir):
    """Where aliases stand in questions as written, at the bounds of words."""
    named = resolve.named_whole(_asked(spark, sf_dir), _aliases(spark, sf_dir)).join(_asked(spark, sf_dir), "id")
    places = named.select(F.col("id").alias("question_id"), F.col("owner").alias("document_id"), F.col("name").alias("alias"), T.occurrences(F.col("text"), F.col("name")).alias("p")).filter(F.size("p") > 0)
    return places.select("question_id", "document_id", "alias", F.size("p").alias("times"), F.get("p", F.lit(0)).alias("first"), F.element_at("p", -1).alias("last"))


@query("""SELECT coalesce(c.document_id, r.document_id) AS document_id, CASE WHEN r.document_id IS NULL THEN 'no records' WHEN c.document_id IS NULL THEN 'not in catalog' WHEN NOT coalesce(c.inc, false) THEN 'left out' ELSE 'indexed' END AS state, coalesce(n, 0) AS records
FROM (SELECT document_id, bool_or(include_in_index) AS inc FROM doc_catalog GROUP BY 1) c FULL JOIN (SELECT document_id, count(*) AS n FROM records WHERE document_id IS NOT NULL GROUP BY 1) r ON c.document_id = r.document_id""")
def catalog_coverage(spark, sf_dir):
    """The catalog against the records: every document of either has a row."""
    c = table(spark, sf_dir, "doc_catalog").groupBy("document_id").agg(F.bool_or("include_in_index").alias("inc")).withColumn("c", F.lit(1))
    r = table(spark, sf_dir, "records").filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "no records").when(F.col("c").isNull(), "not in catalog").when(~F.coalesce("inc", F.lit(False)), "left out").otherwise("indexed")
    return c.join(r, "document_id", "full_outer").select("document_id", state.alias("state"), F.coalesce("n", F.lit(0)).alias("records"))


@query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL QUALIFY rank <= 10""")
def topk_per_source(spark, sf_dir):
    """The ten longest texts of each source: a top-k report with stable ties."""
    w = Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id")
    return _documents(spark, sf_dir).filter("text IS NOT NULL").select("source", "doc_id", F.row_number().over(w).alias("rank")).filter("rank <= 10")


@query(r"""WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(0, len(s))) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS s FROM documents)),
f AS (SELECT *, regexp_matches(line, '^[ \t]*```') AS fence, sum(regexp_matches(line, '^[ \t]*```')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l),
k AS (SELECT doc_id, n, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^[ \t]*[|]') THEN 'table' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^!\[[^\]]*\]\([^)]*\)') THEN 'image' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM f),
i AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS segment FROM i)
SELECT doc_id, segment, kind, min(n) + 1 AS first, count(*) AS lines FROM g GROUP BY 1, 2, 3""")
def md_segments(spark, sf_dir):
    """Every text as runs of code, tables, headings, images, blanks and prose."""
    return sequences.line_segments(_documents(spark, sf_dir))


# What a paragraph is, the first that fits.
_KINDS = [
    ("code", "^```|\n```|^<Steps|^<Step |^</|^\\s*[0-9]+[.]\\s.*(\n\\s*[0-9]+[.]\\s.*)*$"),
    ("heading", "^#"),
    ("caption", "(?i)^((Fig[.]|Figure)\\s*[0-9]+\\s*[:.]|TABLE\\s+[IVXLCDM]+\\b|(Table|Tab[.])\\s*[0-9]+\\s*[:.])"),
    ("table", "^[|]"),
    ("fragment", "^[a-z]"),
]


@query("SELECT doc_id, kind, count(*) AS paragraphs, sum(length(paragraph)) AS chars FROM (SELECT doc_id, paragraph, CASE " + " ".join(f"WHEN regexp_matches(paragraph, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in _KINDS) + f" ELSE 'prose' END AS kind FROM ({_PARAS})) GROUP BY 1, 2")
def para_kinds(spark, sf_dir):
    """What the paragraphs of each text are: code, heading, caption, table, capitals, fragment or prose."""
    kind = F.lit("prose")
    for name, pattern in reversed(_KINDS):
        kind = F.when(F.col("paragraph").rlike(pattern), name).otherwise(kind)
    parts = sequences.exploded_paragraphs(_documents(spark, sf_dir))
    return parts.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


_CN_SQL = "strpos('一二三四五六七八九', {0})"
_ORDINALS_SQL = rf"""SELECT key, array_to_string(list_filter(list_concat(list_concat(list_transform(regexp_extract_all(t, '第\s*([0-9]+|[一二两三四五六七八九十]+)', 1), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::INT WHEN length(x) = 1 THEN CASE x WHEN '十' THEN 10 WHEN '两' THEN 2 ELSE {_CN_SQL.format('x')} END
WHEN length(x) = 2 AND x[1] = '十' THEN 10 + CASE x[2] WHEN '十' THEN 10 WHEN '两' THEN 2 ELSE {_CN_SQL.format('x[2]')} END WHEN length(x) = 2 AND x[2] = '十' THEN 10 * CASE x[1] WHEN '两' THEN 2 ELSE {_CN_SQL.format('x[1]')} END WHEN length(x) = 3 AND x[2] = '十' THEN 10 * CASE x[1] WHEN '十' THEN 10 WHEN '两' THEN 2 ELSE {_CN_SQL.format('x[1]')} END + CASE x[3] WHEN '十' THEN 10 WHEN '两' THEN 2 ELSE {_CN_SQL.format('x[3]')} END END),
list_transform(regexp_extract_all(t, '(?i)(first|second|third|top)\s+(?:place|position|rank|spot)', 1), lambda x: CASE lower(x) WHEN 'second' THEN 2 WHEN 'third' THEN 3 ELSE 1 END)), list_transform(regexp_extract_all(t, '排在最前|放在最前|最前面|排在首位|首位|榜首'), lambda x: 1)), lambda x: x IS NOT NULL), ',') AS ordinals FROM ({{0}})"""
_SAID = "SELECT question_id AS key, original_query AS t FROM questions UNION ALL SELECT -1 - doc_id, text FROM documents"


@query(f"SELECT * FROM ({_ORDINALS_SQL.replace('{0}', _SAID)}) WHERE ordinals <> ''")
def ordinals(spark, sf_dir):
    """Ordinal numbers and ranks named in questions (key: question_id) and in documents (key: -1 - doc_id)."""
    said = table(spark, sf_dir, "questions").select(F.col("question_id").alias("key"), F.col("original_query").alias("t"))
    said = said.unionByName(_documents(spark, sf_dir).select((-1 - F.col("doc_id")).alias("key"), F.col("text").alias("t")))
    return said.select("key", F.array_join(T.ordinals(F.col("t")), ",").alias("ordinals")).filter("ordinals <> ''")


@query("""WITH t AS (SELECT question_id, list_distinct(list_filter([CASE WHEN regexp_matches(lower(original_query), 'figure|图|abbildung|schéma|figura') THEN 'figure' END, CASE WHEN regexp_matches(lower(original_query), 'table|表|tabelle|tableau|tabla') THEN 'table' END], lambda x: x IS NOT NULL)) AS types FROM questions WHERE original_query IS NOT NULL)
SELECT question_id, CASE WHEN len(types) = 0 THEN 'text' WHEN len(types) = 1 THEN types[1] ELSE 'mixed' END AS intent FROM t""")
def intent_recompute(spark, sf_dir):
    """What kind of evidence a question asks for: its only type, or mixed."""
    q = F.lower("original_query")
    types = F.array_compact(F.array(F.when(q.rlike("figure|图|abbildung|schéma|figura"), "figure"), F.when(q.rlike("table|表|tabelle|tableau|tabla"), "table")))
    intent = F.when(F.size(types) == 0, "text").when(F.size(types) == 1, F.get(types, F.lit(0))).otherwise("mixed")
    return table(spark, sf_dir, "questions").filter("original_query IS NOT NULL").select("question_id", intent.alias("intent"))


@query("""WITH q AS (SELECT question_id, list_distinct(regexp_extract_all(original_query, '[0-9]+|[A-Z][a-z]+')) AS atoms FROM questions WHERE original_query IS NOT NULL), j AS (SELECT job_id, question_id, list_distinct(regexp_extract_all(query, '[0-9]+|[A-Z][a-z]+')) AS atoms FROM (SELECT DISTINCT job_id, question_id, query FROM jobs WHERE query IS NOT NULL))
SELECT j.job_id, len(q.atoms) AS atoms, len(list_filter(q.atoms, lambda x: NOT list_contains(j.atoms, x))) AS missing FROM j JOIN q USING (question_id)""")
def atoms_retained(spark, sf_dir):
    """Names and numbers of each question that its job's query lost."""
    atoms = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[0-9]+|[A-Z][a-z]+"), F.lit(0)))
    q = table(spark, sf_dir, "questions").filter("original_query IS NOT NULL").select("question_id", atoms("original_query").alias("a"))
    j = table(spark, sf_dir, "jobs").filter("query IS NOT NULL").select("job_id", "question_id", "query").distinct().select("job_id", "question_id", atoms("query").alias("b"))
    return j.join(q, "question_id").select("job_id", F.size("a").alias("atoms"), F.size(F.array_except("a", "b")).alias("missing"))


@query("""SELECT domain, source, count(*) AS rows, count(*) FILTER (collected_at - published_at > INTERVAL 7 DAY) AS late, max(epoch_us(collected_at) - epoch_us(published_at)) AS longest_us FROM documents WHERE published_at IS NOT NULL AND collected_at IS NOT NULL GROUP BY 1, 2""")
def late_rows(spark, sf_dir):
    """How late texts were collected, by domain and source."""
    lag = F.unix_micros("collected_at") - F.unix_micros("published_at")
    rows = _documents(spark, sf_dir).filter("published_at IS NOT NULL AND collected_at IS NOT NULL")
    return rows.groupBy("domain", "source").agg(F.count("*").alias("rows"), F.count(F.when(lag > 7 * 86_400_000_000, 1)).alias("late"), F.max(lag).alias("longest_us"))


@query(rf"""WITH t AS (SELECT text, min(ord) AS id FROM records WHERE len({_WORDS_SQL.format('text').replace('list_distinct', '')}) >= 7 GROUP BY 1) SELECT a.id AS "inner", b.id AS "outer" FROM t a JOIN t b ON length(a.text) < length(b.text) AND contains(b.text, a.text)""")
def overlap_containment(spark, sf_dir):
    """Texts of records that stand whole inside another text."""
    return context.contained(table(spark, sf_dir, "records").select(F.col("ord").alias("id"), "text"))


@query(r"""SELECT question_id, len(list_distinct(regexp_extract_all(lower(original_query), '[a-z]+'))) AS words, length(regexp_replace(regexp_replace(original_query, '''[^''\n]{1,120}''', ' ', 'g'), '《[^》]*》', ' ', 'g')) AS unquoted_chars,
array_to_string(list_filter([CASE WHEN regexp_matches(original_query, '(?i)\b(?:not|no|never|without|except|unless|neither|nor)\b') THEN 'negation' END, CASE WHEN regexp_matches(original_query, '(?i)(?:\bvs[.](?:[^A-Za-z0-9_]|$)|\b(?:vs|versus|compared|compares|compare|comparison|than|more|less|least|most|difference)\b)') THEN 'comparison' END,
CASE WHEN regexp_matches(original_query, '(?i)\b(?:first|second|third|then|after|before|next|previous|step|steps|order|sequence|final)\b') THEN 'order' END], lambda x: x IS NOT NULL), ',') AS hints FROM questions WHERE original_query IS NOT NULL""")
def question_hints(spark, sf_dir):
    """What a rewriting of each question must keep."""
    q = F.col("original_query")
    return table(spark, sf_dir, "questions").filter(q.isNotNull()).select("question_id", F.size(T.evidence_words(q)).alias("words"), F.length(T.unquoted(q)).alias("unquoted_chars"), T.completeness_hints(q).alias("hints"))


_THIN = "(length({0}) < 220 OR NOT regexp_matches({0}, '(^|\\n)[^#\\n]'))"


@query(rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, n, paragraph, starts_with(paragraph, '#') AS head FROM ({_PARAS})),
f AS (SELECT doc_id, 0::BIGINT AS n, NULL::VARCHAR AS open, false AS skip, NULL::VARCHAR AS done FROM (SELECT DISTINCT doc_id FROM p) UNION ALL
SELECT doc_id, n, CASE WHEN skip THEN open WHEN open IS NULL OR cut THEN paragraph ELSE open || chr(10) || chr(10) || paragraph END, skip, CASE WHEN NOT skip AND open IS NOT NULL AND cut THEN open END FROM
(SELECT p.doc_id, p.n, p.paragraph, f.open, CASE WHEN head AND regexp_matches(paragraph, '(?i)^#+\s*(references|bibliography|参考文献)\s*$') THEN true WHEN head AND regexp_matches(paragraph, '(?i)^#+\s*(appendix|appendices|附录)') THEN false ELSE f.skip END AS skip, head AND NOT {_THIN.format('f.open')} AS cut FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1)),
e AS (SELECT doc_id, done AS body, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM f WHERE done IS NOT NULL), l AS (SELECT doc_id, arg_max(open, n) AS open, count(done) AS m FROM f GROUP BY 1),
c AS (SELECT e.doc_id, k AS seq, CASE WHEN k = e.m AND l.open IS NOT NULL AND {_THIN.format('l.open')} THEN e.body || chr(10) || chr(10) || l.open ELSE e.body END AS body FROM e JOIN l USING (doc_id) UNION ALL SELECT doc_id, m + 1, open FROM l WHERE open IS NOT NULL AND (m = 0 OR NOT {_THIN.format('open')}))
SELECT doc_id, seq, printf('%d::text::%04d', doc_id, seq) AS chunk_id, length(body) AS chars, sha256(body) AS digest FROM c""")
def chunk_documents(spark, sf_dir):
    """Every text as ordered chunks: heading groups, thin ones merged, references left out."""
    return sequences.chunked(_documents(spark, sf_dir)).select("doc_id", "seq", "chunk_id", F.length("body").alias("chars"), T.sha256(F.col("body")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s<>()\[\]"]+') AS urls, regexp_extract_all(text, '!\[[^\]]*\]\(\s*<?([^)\s>]+)', 1) AS images FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(urls) AS links, len(list_distinct(urls)) AS targets, len(images) AS images FROM l WHERE len(urls) + len(images) > 0""")
def text_links(spark, sf_dir):
    """Addresses and pictures that each text links to."""
    urls = F.regexp_extract_all(F.col("text"), F.lit(r'https?://[^\s<>()\[\]"]+'), F.lit(0))
    images = F.regexp_extract_all(F.col("text"), F.lit(r"!\[[^\]]*\]\(\s*<?([^)\s>]+)"), F.lit(1))
    rows = _documents(spark, sf_dir).filter("text IS NOT NULL")
    return rows.select("doc_id", F.size(urls).alias("links"), F.size(F.array_distinct(urls)).alias("targets"), F.size(images).alias("images")).filter("links + images > 0")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(m) AS chars, sha256(m) AS digest FROM (SELECT doc_id, substr(regexp_replace(array_to_string(list_filter(s, lambda x: NOT regexp_matches(x, '^[ \t\r\f]*(Traceback|File "|at )')), chr(10)), '[A-Za-z0-9_-]{32,}', '***', 'g'), 1, 500) AS m FROM l)""")
def masked_texts(spark, sf_dir):
    """Texts as messages fit to be shown: without lines of a stack, long keys masked, the first 500 characters (the length of a message is the feature)."""
    m = T.masked(F.col("text"))
    return _documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.length(m).alias("chars"), T.sha256(m).alias("digest"))

"""Column builders over text: every one stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of tokens, labels and citation marks, and what an answer's text is changed by.
TOKEN = r"[0-9]+(?:\.[0-9]+)+|[a-z]+|[0-9]+"
LATIN_LABEL = r"(?iU)\b(fig(?:ure)?|tab(?:le)?)\.?\s*([0-9]+|[ivxlcdm]+)\b"
CJK_LABEL = r"(?U)([图表])\s*([0-9]+)"
CITATION = r"\[\s*S[0-9]+(?:\s*[,，、;；]\s*S[0-9]+)*\s*\]"
SNAKE = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+(?![A-Za-z0-9_])"
DOTTED = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9]*\.[A-Za-z_][A-Za-z0-9_.]*(?![A-Za-z0-9_])"
CAMEL = r"(?<![A-Za-z0-9_])[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]+(?![A-Za-z0-9_])"
QUOTED_NAME = r"[`'\"]([A-Za-z_][A-Za-z0-9_.]*)[`'\"]"
NEGATION = r"(?i)(?<![A-Za-z0-9_])(?:not|no|never|without|except|unless|neither|nor)(?![A-Za-z0-9_])"
COMPARISON = r"(?i)(?<![A-Za-z0-9_])(?:vs\.?|versus|compared|compares|compare|comparison|than|more|less|least|most|difference)(?![A-Za-z0-9_])"
ORDER = r"(?i)(?<![A-Za-z0-9_])(?:first|second|third|then|after|before|next|previous|step|steps|order|sequence|final)(?![A-Za-z0-9_])"
MARKDOWN_SPECIAL = r"([\\`*_\[\]<>#|!~])"
WORD_START = r"[A-Za-z0-9_]"


def retrievable(kind: Column, text: Column, retrieval_text: Column) -> Column:
    """What a record is found by: its text, or a visual's retrieval text; empty where that is null."""
    return F.coalesce(F.when(kind == "visual_description", retrieval_text).otherwise(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Lexical tokens in order: decimals, runs of Latin letters, runs of digits, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def squeezed(text: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def roman(text: Column) -> Column:
    """Value of a Roman numeral by the subtractive rule; order and repetition are not checked."""
    digits = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    value = lambda c: F.create_map(*[F.lit(x) for kv in digits.items() for x in kv])[c]
    step = lambda s, c: F.struct(
        (s["total"] + F.when(value(c) < s["last"], -value(c)).otherwise(value(c))).alias("total"), F.greatest(s["last"], value(c)).alias("last")
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(F.reverse(F.split(F.lower(text), "")), start, lambda s, c: F.when(c == "", s).otherwise(step(s, c)), lambda s: s["total"])


def number(text: Column) -> Column:
    """A label's number: decimal digits or a Roman numeral."""
    return F.when(text.rlike("^[0-9]+$"), text.cast("int")).otherwise(roman(text))


def visual_labels(text: Column) -> Column:
    """Labels named in a text, 'figure:3' or 'table:4': the Latin ones in order, then the CJK ones, each once; numbers from 1."""
    latin = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(LATIN_LABEL), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(LATIN_LABEL), F.lit(2)).alias("n")),
        lambda m: F.struct(F.when(F.lower(m["kind"]).startswith("f"), "figure").otherwise("table").alias("kind"), number(m["n"]).alias("n")),
    )
    cjk = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(CJK_LABEL), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(CJK_LABEL), F.lit(2)).alias("n")),
        lambda m: F.struct(F.when(m["kind"] == "图", "figure").otherwise("table").alias("kind"), number(m["n"]).alias("n")),
    )
    kept = F.filter(F.concat(latin, cjk), lambda m: m["n"] >= 1)
    return F.array_distinct(F.transform(kept, lambda m: F.concat(m["kind"], F.lit(":"), m["n"].cast("string"))))


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones, comments and bare page numbers."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: F.regexp_replace(p, r"^[ \t\n]+|[ \t\n]+$", ""))
    return F.filter(parts, lambda p: (p != "") & ~p.startswith("<!--") & ~p.rlike("^[0-9]{1,4}$"))


def is_heading(paragraph: Column) -> Column:
    return paragraph.startswith("#")


def citation_ids(text: Column) -> Column:
    """All S-ids of single and grouped citation marks, in order, with repeats."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("S[0-9]+"), F.lit(0))))


def code_identifiers(text: Column) -> Column:
    """snake_case, dotted.names, CamelCase words and single names between quotes, each once, by kind and then in order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (SNAKE, DOTTED, CAMEL)]
    return F.array_distinct(F.concat(*found, F.regexp_extract_all(text, F.lit(QUOTED_NAME), F.lit(1))))


def escaped(text: Column) -> Column:
    """A text on one line, Markdown's special characters behind a backslash."""
    return F.regexp_replace(squeezed(text), MARKDOWN_SPECIAL, r"\\$1")


def shown(answer: Column) -> Column:
    """An answer as shown: without images and single citation marks (before a word for a picture or text they become words), blanks before stops removed."""
    steps = [(r"!\[[^\]]*\]\([^\n]*?\)", ""), (r"(?:\[S[0-9]+\]\s*)+(的(?:原图|图表|正文|内容|描述))", "对应证据$1"), (r"\[S[0-9]+\]", ""), (r"[ \t]+([，。；：,.!?])", "$1")]
    return F.regexp_replace(reduce(lambda t, pr: F.regexp_replace(t, *pr), steps, answer), r"(?U)^\s+|\s+$", "")


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://[^\s]+$"), url)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stem(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def is_local_figure(path: Column) -> Column:
    return path.rlike(r"^(?!https?://)[^\s]+\.png$")


def image_target(anchor: Column) -> Column:
    """Target of a Markdown image, without its title."""
    return F.regexp_extract(anchor, r'!\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)', 1)


def input_block(title: Column, section: Column, label: Column, source: Column) -> Column:
    """The block a record is encoded as; parts that are null are left out."""
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("TITLE", title), part("SECTION", section), part("LABEL", label), F.lit("SOURCE:"), F.coalesce(source, F.lit("")))


def source_block(retrieval_text: Column) -> Column:
    """What follows the first SOURCE line; the whole text where there is none."""
    at = F.instr(retrieval_text, "\nSOURCE:\n")
    return F.when(at > 0, F.substring(retrieval_text, at + 9, F.length(retrieval_text))).otherwise(retrieval_text)


def content_id(document_id: Column, body: Column) -> Column:
    """An id made of the document and the first 20 hex digits of the body's hash."""
    return F.concat(document_id, F.lit("::text::context-"), F.substring(F.sha2(body, 256), 1, 20))


def span_id(start: Column, stop: Column) -> Column:
    return F.format_string("s%d_%d", start, stop)


def span_of(ident: Column) -> Column:
    """(start, stop) of a span id; nulls where it is none."""
    cut = lambda k: F.regexp_extract(ident, r"^s([0-9]+)_([0-9]+)$", k)
    return F.struct(F.nullif(cut(1), F.lit("")).cast("int").alias("start"), F.nullif(cut(2), F.lit("")).cast("int").alias("stop"))


def evidence_words(text: Column) -> Column:
    """Distinct Latin words of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def unquoted(text: Column) -> Column:
    """A text with a blank for each phrase between single quotes and each title."""
    return F.regexp_replace(F.regexp_replace(text, r"'[^'\n]{1,120}'", " "), "《[^》]*》", " ")


def completeness_hints(text: Column) -> Column:
    """Which of negation, comparison and order a text has, as a comma list."""
    flag = lambda name, p: F.when(text.rlike(p), name)
    return F.concat_ws(",", flag("negation", NEGATION), flag("comparison", COMPARISON), flag("order", ORDER))


# Chinese digits, and the wordings of a rank.
CN_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
ORDINAL = r"第\s*([0-9]+|[一二两三四五六七八九十]+)"
EN_RANK = r"(?i)(first|second|third|top)\s+(?:place|position|rank|spot)"
FIRST_RANK = "排在最前|放在最前|最前面|排在首位|首位|榜首"


def cn_number(text: Column) -> Column:
    """Value of decimal digits or of a Chinese numeral below 100; null for others."""
    digits = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    at = lambda k: F.coalesce(digits[F.substring(text, k, 1)], F.lit(0))
    n, ten = F.length(text), F.substring(text, 2, 1) == "十"
    return (
        F.when(text.rlike("^[0-9]+$"), text.cast("int"))
        .when(n == 1, digits[text])
        .when((n == 2) & text.startswith("十"), 10 + at(2))
        .when((n == 2) & ten, at(1) * 10)
        .when((n == 3) & ten, at(1) * 10 + at(3))
    )


def ordinals(text: Column) -> Column:
    """Ranks and ordinal numbers a text names: numbered ones in order, then English ones, then a 1 for each wording of the first place."""
    numbered = F.transform(F.regexp_extract_all(text, F.lit(ORDINAL), F.lit(1)), cn_number)
    english = F.transform(F.regexp_extract_all(text, F.lit(EN_RANK), F.lit(1)), lambda w: F.when(F.lower(w) == "second", 2).when(F.lower(w) == "third", 3).otherwise(1))
    first = F.transform(F.regexp_extract_all(text, F.lit(FIRST_RANK), F.lit(0)), lambda _: F.lit(1))
    return F.filter(F.concat(numbered, english, first), lambda x: x.isNotNull())


def occurrences(text: Column, span: Column) -> Column:
    """Where a span stands in a text, from 1, with no letter, digit or underscore of ASCII beside it; occurrences may overlap. Nulls give null, an empty span none."""
    there = lambda p: F.substr(text, p, F.length(span)) == span
    free = lambda p: ~F.substr(text, p, F.lit(1)).rlike(WORD_START)
    places = F.filter(F.sequence(F.lit(1), F.length(text)), lambda p: there(p) & ((p == 1) | free(p - 1)) & free(p + F.length(span)))
    return F.when((F.length(span) > 0) & (F.length(text) > 0), places).when(text.isNotNull() & span.isNotNull(), F.expr("cast(array() as array<int>)"))


def words(text: Column) -> Column:
    """Words in order: runs of letters and digits of the lower-cased text, each character U+4E00 to U+9FFF a word of its own."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"([\u4e00-\u9fff])", " $1 "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def masked(text: Column, limit: int = 500) -> Column:
    """A message fit to be shown: no traceback lines, long keys masked, cut to ``limit`` characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(Traceback|File \"|at )"))
    return F.substring(F.regexp_replace(F.array_join(lines, "\n"), r"[A-Za-z0-9_-]{32,}", "***"), 1, limit)


def bounded(text: Column, word: Column) -> Column:
    """Whether a word stands in a text with no letter, digit or underscore beside it."""
    return F.concat(F.lit(" "), F.regexp_replace(text, "[^A-Za-z0-9_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), word, F.lit(" ")))

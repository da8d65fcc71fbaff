"""One consistent form of texts that look the same (problem 5).

Compatibility normalisation in composed form, mapped white space and removal of
default-ignorable characters, applied once per distinct value; full case folding
is a second column, since another letter case looks different here.

The mapping is a table over code points made from the Unicode data of Python:
compatibility decompositions whose result looks like the character itself
(full-width, half-width, font variants, ligatures, radicals), never raised,
lowered, circled or fraction forms.  Letters of other alphabets with the shape
of a Latin letter map to that letter, so the form is a skeleton for comparing,
not for display.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, table, written

# Letters of other alphabets, and the Latin letters of the same shape.
SAME_SHAPE = {
    "cyrillic": ("аеорсухѕіјһԁԛԝѵАВЕЅІЈКМНОРСТХѴԌԚԜ", "aeopcyxsijhdqwvABESIJKMHOPCTXVGQW"),
    "cyrillic capital u": ("У", "Y"),
    "greek": ("οννιρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovvipABEZHIKMNOPTYX"),
    "armenian": ("օոսցՕՏԼ", "onugOSL"),
    "latin": ("ɡɑıȷ", "gaij"),
    "cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"),
    "lisu": ("ꓐꓚꓓꓔꓖꓗꓙꓜꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴꓝꓟꓠꓑ", "BCDTGKJZLSRVHWXYAEIOUFMNP"),
    "hyphens": ("‐‑", "--"),
    "stops": ("｡", "。"),
}
# Radicals of the supplement block without a decomposition, and the characters of the same shape.
RADICALS = (
    "⺁厂⺅亻⺆冂⺈刀⺉刂⺊卜⺋㔾⺎兀⺏尣⺐尢⺒巳⺓幺⺔彑⺖忄⺘扌⺙攵⺛旡⺝月⺞歺⺠民⺡氵⺢氺⺣灬⺤爫⺥爫⺦丬⺧牛⺨犭⺩王⺪疋⺫罒⺬示⺭礻⺮竹⺯糹⺰纟⺱罓⺲罒⺶羊"
    "⺸羋⺹耂⺺肀⺻聿⺼肉⺾艹⺿艹⻀艹⻁虎⻂衤⻃覀⻄西⻅见⻆角⻈讠⻉贝⻋车⻌辶⻍辶⻎辶⻐钅⻑長⻒镸⻓长⻔门⻖阝⻗雨⻘青⻙韦⻚页⻛风⻜飞⻝食⻟飠⻠饣⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄"
    "⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱龜⻲亀⻳龟"
)
#: Characters without category Cf that show nothing.
HIDDEN = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
#: A noncharacter: never assigned to text.
BETWEEN = "\uffff"
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def _plain(c: int) -> str:
    """The character decomposed as far as the result looks the same."""
    parts = unicodedata.decomposition(chr(c)).split()
    if not parts:
        return chr(c)
    if parts[0][0] == "<":
        if parts[0] not in SAME_LOOK_TAGS or parts[1] == "0020":
            return chr(c)
        parts = parts[1:]
    return "".join(_plain(int(p, 16)) for p in parts)


@lru_cache(1)
def _tables() -> tuple[dict[int, str | None], dict[int, str]]:
    first: dict[int, str | None] = {}
    hidden = {c for lo, hi in HIDDEN for c in range(lo, hi + 1)}
    for c in range(sys.maxunicode + 1):
        s, kind = chr(c), unicodedata.category(chr(c))
        if s.isspace():
            first[c] = " "
        elif kind == "Cf" or c in hidden or kind == "Cc":
            first[c] = None
        elif c < 0xAC00 or c > 0xD7A3:
            if (plain := _plain(c)) != s:
                first[c] = plain
    shapes = {ord(a): b for have, want in SAME_SHAPE.values() for a, b in zip(have, want, strict=True)}
    shapes |= {ord(a): b for a, b in zip(RADICALS[::2], RADICALS[1::2], strict=True)}
    return first, shapes


def visual_forms(texts: list[str | None], *, fold: bool = False) -> list[str | None]:
    """The form of each text; None for None and for a text that shows nothing.

    All texts pass the tables and normalisations together, as one string with a
    noncharacter between them; that character itself shows nothing.
    fold: full case folding as well.
    """
    first, shapes = _tables()
    joined = BETWEEN.join((t or "").replace(BETWEEN, "") for t in texts)
    out = unicodedata.normalize("NFD", joined.translate(first)).translate(shapes)
    if fold:
        out = unicodedata.normalize("NFD", out.casefold())
    return [" ".join(x.split()) or None for x in unicodedata.normalize("NFC", out).split(BETWEEN)]


def visual_form(text: str | None, *, fold: bool = False) -> str | None:
    return visual_forms([text], fold=fold)[0]


def _forms(fold: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            values = [v if isinstance(v, str) else None for v in f["value"]]
            yield pd.DataFrame({"value": values, "form": visual_forms(values)} | ({"folded": visual_forms(values, fold=True)} if fold else {}), dtype=object)

    return run


def distinct_forms(values: DataFrame, column: str, *, fold: bool = True) -> DataFrame:
    """(value, form, folded) of each distinct non-null value of a column; nulls of form show nothing.

    Each value is normalised once: the result is written and read again, however
    often it is used.  fold: with the column folded.
    """
    spark = values.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the work is in the values, so they are spread whatever their bytes
    distinct = values.select(F.col(column).alias("value")).filter("value is not null").distinct().repartition(tasks, F.xxhash64("value"))
    return written(distinct.mapInPandas(_forms(fold), "value string, form string" + ", folded string" * fold))


def with_visual_form(rows: DataFrame, column: str, *, form: str = "visual_form", folded: str = "visual_folded") -> DataFrame:
    """All rows with two more columns; null values keep null forms. Values are normalised once each.

    An existing column of the same name as form or folded is replaced.
    """
    forms = distinct_forms(rows, column).select(F.col("value").alias("__value"), F.col("form").alias("__form"), F.col("folded").alias("__folded"))
    joined = rows.join(forms, rows[column] == forms["__value"], "left")
    kept = [rows[c] for c in rows.columns if c not in (form, folded)]
    return joined.select(*kept, F.col("__form").alias(form), F.col("__folded").alias(folded))


def same_look_pairs(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of rows whose values look the same without being the same string.

    Spellings meet once per form; only then are they expanded to their rows, so
    a value repeated in many rows is compared once.  Null keys, null values and
    values that show nothing take no part; repeated rows count once.
    """
    forms = distinct_forms(rows, column, fold=False).filter("form is not null")
    some = forms.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    forms = forms.join(some, "form")
    spelled = forms.withColumnRenamed("value", "x").join(forms.withColumnRenamed("value", "y"), "form").filter("x < y").select("x", "y")
    held = rows.select(F.col(key).alias("key"), F.col(column).alias("value")).filter("key is not null and value is not null").distinct()
    pairs = spelled.join(held.select(F.col("key").alias("a"), F.col("value").alias("x")), "x").join(held.select(F.col("key").alias("b"), F.col("value").alias("y")), "y")
    return pairs.filter("a <> b").select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = same_look_pairs(table(spark, sf_dir, "questions"), "question_id", "original_query")
    return pairs.select(F.col("key_a").alias("question_id_a"), F.col("key_b").alias("question_id_b"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_visual_form(table(spark, sf_dir, "questions").select("question_id", "original_query"), "original_query")


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms}
SQL: dict[str, str] = {}

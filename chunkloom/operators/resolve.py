"""Which names a text speaks of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _words(column: str):
    return F.array_distinct(T.words(F.col(column)))


def named_whole(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, owner, name): names of which a text has every word: relational division.

    texts: id, text; names: owner, name.  A name is joined by its rarest word
    only, so words that most names share never meet all texts; the other words
    are then looked up in the text's own.  Names without words match nothing.
    """
    split = names.select("owner", "name").filter("name is not null").distinct().withColumn("words", _words("name")).filter(F.size("words") > 0)
    each = split.select("owner", "name", F.explode("words").alias("word"))
    spread = each.groupBy("word").agg(F.count("*").alias("n"))
    rarest = each.join(spread, "word").groupBy("owner", "name").agg(F.min(F.struct("n", "word")).alias("r")).select("owner", "name", F.col("r.word").alias("word"))
    keyed = rarest.join(split, ["owner", "name"])
    said = texts.select("id", _words("text").alias("own")).filter(F.size("own") > 0)
    met = said.withColumn("word", F.explode("own")).join(keyed, "word")
    return met.filter(F.size(F.array_except("words", "own")) == 0).select("id", "owner", "name")

"""All core queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical
from ..sources.tables import table
from . import documents, records, service

QUERIES = documents.QUERIES | records.QUERIES | service.QUERIES
SQL = documents.SQL | records.SQL | service.SQL


def flagship(spark, sf_dir):
    """The ten best records of every question, by channel."""
    asked = table(spark, sf_dir, "questions").filter("original_query IS NOT NULL").select(F.col("question_id").alias("query_id"), F.col("original_query").alias("query"))
    return lexical.bm25(asked, lexical.channels(table(spark, sf_dir, "records")), k=10)

"""Cosine ranking inside a scope, audits of vectors, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def audit(vectors: DataFrame, size: int = 64) -> DataFrame:
    """(problem, rows): how many rows are null, of another size, with a NaN, all zero, not of unit length, or fine."""
    v = F.col("vector")
    norm = F.sqrt(dot(v, v))
    problem = (
        F.when(v.isNull(), "null").when(F.size(v) != size, "size").when(F.exists(v, F.isnan), "nan").when(F.forall(v, lambda x: x == 0), "zero").when(F.abs(norm - 1) > 1e-3, "not unit").otherwise("fine")
    )
    return vectors.select(problem.alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"))


def usable(vectors: DataFrame, size: int = 64) -> DataFrame:
    """Each ord once, with a vector that can be compared."""
    v = F.col("vector")
    kept = vectors.filter(v.isNotNull() & (F.size(v) == size)).filter(~F.exists(v, F.isnan) & F.exists(v, lambda x: x != 0))
    return kept.groupBy("ord").agg(F.min("vector").alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, rounded to six decimals."""
    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


def unit(v: Column) -> Column:
    """A vector scaled to unit length, in double precision; null for null and all-zero vectors."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def top_in_scope(queries: DataFrame, candidates: DataFrame, scope: str, *, k: int, block: int = 4096) -> DataFrame:
    """(query_id, status, candidates, rank, id, score): the k most similar candidates of the query's scope.

    queries: query_id, scope column, vector; candidates: id, scope column,
    vector.  The scope is an equi-join key, so candidates outside never meet the
    query.  A scope with more than ``block`` candidates is cut into blocks that
    each query of it meets apart, so a hot scope is spread over tasks; the best of
    each block are merged.  A query without candidates keeps one row, with status
    no_candidates and nulls.  Ties go to the smaller id; candidates are counted
    before the limit.
    """
    sizes = candidates.filter(F.col(scope).isNotNull()).groupBy(scope).agg(F.count("*").alias("candidates"))
    blocks = F.ceil(F.coalesce("candidates", F.lit(1)) / block)
    large = sizes.filter(F.col("candidates") > block)
    placed = candidates.join(large, scope, "left").select(F.col(scope), "id", F.col("vector").alias("c"), F.pmod(F.xxhash64("id"), blocks).alias("__block"))
    asked = queries.join(sizes, scope, "left")
    spread = asked.filter("candidates IS NOT NULL").select("query_id", F.col(scope), F.col("vector").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("__block"))
    scored = spread.join(placed, [scope, "__block"]).select("query_id", "id", cosine(F.col("q"), F.col("c")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = asked.select("query_id", "candidates").join(top, "query_id", "left")
    return out.select("query_id", F.when(F.col("candidates").isNull(), "no_candidates").otherwise("ok").alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "rank", "id", "score")


def fused(first: DataFrame, second: DataFrame, keys: list[str], *, constant: int = 60) -> DataFrame:
    """Mean of 1 / (60 + rank) over the rankings that hold an item: being in one only is no penalty.

    first and second: keys and rank.  Returns keys, score (rounded to nine decimals), and both ranks.
    """
    both = first.withColumnRenamed("rank", "rank_1").join(second.withColumnRenamed("rank", "rank_2"), keys, "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(float(constant)) + F.col(r)), F.lit(0.0))
    present = F.col("rank_1").isNotNull().cast("int") + F.col("rank_2").isNotNull().cast("int")
    return both.select(*keys, "rank_1", "rank_2", F.round((part("rank_1") + part("rank_2")) / present, 9).alias("score"))


def supplemented(hits: DataFrame, lexical: DataFrame, *, cap: int, tie: str = "id") -> DataFrame:
    """Hits of a vector search, then the best lexical hits not among them, up to ``cap`` together; ranks go on and no hit is moved.

    hits: query_id, id, rank; lexical: query_id, id, score, and the tie column.
    Lexical order is score descending, tie ascending.  Returns query_id, id,
    rank, source ('vector' or 'lexical') and lexical_rank, which is null for
    vector hits that the lexical search has not.
    """
    ranked = lexical.withColumn("lexical_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))).select("query_id", "id", "lexical_rank")
    n = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    extra = ranked.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(n, "query_id", "left")
    order = Window.partitionBy("query_id").orderBy("lexical_rank")
    extra = extra.withColumn("rank", F.coalesce("n", F.lit(0)) + F.row_number().over(order)).filter(F.col("rank") <= cap)
    first = hits.select("query_id", "id", "rank").join(ranked, ["query_id", "id"], "left")
    return first.select("query_id", "id", "rank", F.lit("vector").alias("source"), "lexical_rank").unionByName(extra.select("query_id", "id", "rank", F.lit("lexical").alias("source"), "lexical_rank"))

"""Evidence: duplicates, shared lines, packing under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, kept, copies): the first row of each key by order, and how many rows it stands for; a map-side aggregate, so hot keys shrink before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(order).alias("kept"), F.count("*").alias("copies"))


def shared_lines(texts: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, lines, shared): distinct lines of at least ``least`` characters, and how many of them other texts have too."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least))
    each = texts.filter("text is not null").select("doc_id", F.explode(lines).alias("line")).select("doc_id", F.sha2("line", 256).alias("line"))
    common = each.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line", F.lit(1).alias("hit"))
    return each.join(common, "line", "left").groupBy("doc_id").agg(F.count("*").alias("lines"), F.coalesce(F.sum("hit"), F.lit(0)).alias("shared"))


def packed_greedy(ranked: DataFrame, budget: int) -> DataFrame:
    """(case_id, rank, id, cost): in order of rank, each item that still fits; one that does not is skipped, not the end.

    ranked: case_id, rank, id, cost, with a bounded number of ranks a case.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "cost")))
    start = F.expr("struct(cast(0 as bigint) as used, cast(array() as array<struct<rank:int,id:bigint,cost:bigint>>) as kept)")
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    cases = ranked.select("case_id", F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("id"), F.col("cost").cast("long").alias("cost")).groupBy("case_id").agg(items.alias("items"))
    return cases.select("case_id", F.explode(F.aggregate("items", start, step, lambda s: s["kept"])).alias("x")).select("case_id", "x.rank", "x.id", "x.cost")


def packed_top(ranked: DataFrame, n: int, budget: int) -> DataFrame:
    """(case_id, items, cost, fits): the first n items of each case, their cost, and whether it is within the budget."""
    return ranked.filter(F.col("rank") <= n).groupBy("case_id").agg(F.count("*").alias("items"), F.sum("cost").alias("cost")).withColumn("fits", F.col("cost") <= budget)


def citation_check(answers: DataFrame) -> DataFrame:
    """(id, used, unknown, unused) as comma lists: cited ids in order of first use; those that are not known; known ones not cited.

    answers: id, answer, known array<string>.
    """
    cited = F.array_distinct(T.citation_ids(F.col("answer")))
    row = answers.select("id", cited.alias("used"), "known")
    return row.select("id", F.array_join("used", ",").alias("used"), F.array_join(F.array_except("used", "known"), ",").alias("unknown"), F.array_join(F.array_sort(F.array_except("known", "used")), ",").alias("unused"))


def covered(spans: DataFrame, claims: DataFrame, width: int) -> DataFrame:
    """(id, start, stop, proven): spans that lie inside a claim of the same id.

    Interval containment as an equi-join: a claim is put into every cell of
    ``width`` it touches, a span into the cell of its start.
    """
    cell = lambda c: F.floor(c / width)
    placed = claims.select("id", F.col("start").alias("from"), F.col("stop").alias("to")).withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to") - 1))))
    hit = spans.withColumn("cell", cell(F.col("start"))).join(placed, ["id", "cell"]).filter("from <= start AND stop <= to").select("id", "start", "stop").distinct().withColumn("hit", F.lit(True))
    return spans.join(hit, ["id", "start", "stop"], "left").select("id", "start", "stop", F.coalesce("hit", F.lit(False)).alias("proven"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that comes last by order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def contained(texts: DataFrame, gram: int = 3) -> DataFrame:
    """(inner, outer): texts that stand whole inside another text, by the smallest id of each.

    texts: id, text.  Copies are one text.  A text of fewer than gram + 4 words
    is not looked for (a few words stand in many texts, an empty one in all); a
    text may begin and end inside a word of the outer one, so its first and last
    two words do not count.  Any run of ``gram`` of the words between is in the
    outer text too: the inner text meets others by the run that the fewest texts
    have, and ``contains`` decides.
    """
    first = texts.filter("text is not null").groupBy(F.sha2("text", 256).alias("same")).agg(F.min(F.struct("id", "text")).alias("r")).select("r.id", "r.text")
    words = first.select("id", T.words(F.col("text")).alias("w"))
    runs = lambda lo, hi: F.array_distinct(F.transform(F.sequence(lo, hi), lambda k: F.xxhash64(F.slice("w", k, F.lit(gram)))))
    n = F.size("w")
    all_runs = words.filter(n >= gram).select("id", F.explode(runs(F.lit(1), n - (gram - 1))).alias("run"))
    own_runs = words.filter(n >= gram + 4).select("id", F.explode(runs(F.lit(3), n - (gram + 1))).alias("run"))
    spread = all_runs.groupBy("run").agg(F.count("*").alias("texts")).filter("texts > 1")
    rarest = own_runs.join(spread, "run", "left").groupBy(F.col("id").alias("inner")).agg(F.min(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "run")).alias("r")).filter("r.texts > 1").select("inner", F.col("r.run").alias("run"))
    pairs = rarest.join(all_runs.select(F.col("id").alias("outer"), "run"), "run").filter("inner <> outer").select("inner", "outer")
    both = pairs.join(first.select(F.col("id").alias("inner"), F.col("text").alias("a")), "inner").join(first.select(F.col("id").alias("outer"), F.col("text").alias("b")), "outer")
    return both.filter((F.length("a") < F.length("b")) & F.contains(F.col("b"), F.col("a"))).select("inner", "outer")


def merged(rows: DataFrame, key: str, order: str, identity: str) -> DataFrame:
    """(kept, chunks, rows, chunk_ids) of the groups with more than one row: first by key, then by identity.

    Of a key delivered again the first row by order counts; of the keys with one
    identity the first is kept, with the names of all.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(order, identity)).alias("r"), F.count("*").alias("n"))
    groups = first.groupBy(F.col(f"r.{identity}").alias("identity")).agg(F.min(f"r.{order}").alias("kept"), F.count("*").alias("chunks"), F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_set(key)), ",").alias("chunk_ids"))
    return groups.filter("rows > 1").select("kept", "chunks", "rows", "chunk_ids")


def pair_overlaps(items: DataFrame, least: int = 20) -> DataFrame:
    """(case_id, first, second, exact, contained, shared_lines): pairs of a case that repeat each other.

    items: case_id, rank, id, text, with a bounded number of ranks a case.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least))
    lined = items.select("case_id", "rank", "id", "text", lines.alias("lines"))
    left = lined.select("case_id", F.col("rank").alias("r"), F.col("id").alias("first"), F.col("text").alias("a"), F.col("lines").alias("p"))
    right = lined.select("case_id", F.col("rank").alias("s"), F.col("id").alias("second"), F.col("text").alias("b"), F.col("lines").alias("q"))
    exact = F.col("a") == F.col("b")
    inside = F.contains(F.col("a"), F.col("b")) | F.contains(F.col("b"), F.col("a"))
    pairs = left.join(right, "case_id").filter("r < s").select("case_id", "first", "second", exact.alias("exact"), (~exact & inside).alias("contained"), F.when(exact, 0).otherwise(F.size(F.array_intersect("p", "q"))).alias("shared_lines"))
    return pairs.filter("exact OR contained OR shared_lines > 0")


def packed_all(cases: DataFrame, items: DataFrame, budget: int) -> DataFrame:
    """(case_id, items, cost, status): every item of each case, or none: 'fits', 'refused', or 'envelope over budget' where the case alone is too much.

    cases: case_id, base (the cost without items); items: case_id, cost.
    """
    sums = items.groupBy("case_id").agg(F.count("*").alias("items"), F.sum("cost").alias("cost"))
    total = F.col("base") + F.coalesce("cost", F.lit(0))
    status = F.when(F.col("base") > budget, "envelope over budget").when(total > budget, "refused").otherwise("fits")
    return cases.join(sums, "case_id", "left").select("case_id", F.coalesce("items", F.lit(0)).alias("items"), total.alias("cost"), status.alias("status"))


def overlaid(base: DataFrame, layers: list[DataFrame], key: str) -> DataFrame:
    """The base's rows with the columns of each layer laid over them in turn: a layer's value holds where it is not null.

    Layers: the key (once each) and columns of the base.  Rows of a layer that
    the base lacks are left out.
    """
    for layer in layers:
        columns = [c for c in layer.columns if c != key]
        over = layer.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
        base = base.join(over, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
    return base

"""Ordered operators inside a document: sections, neighbours, merges, overlapping splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def exploded_paragraphs(texts: DataFrame) -> DataFrame:
    """(doc_id, n, paragraph), n from 1."""
    return texts.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("n", "paragraph")).withColumn("n", F.col("n") + 1)


def heading_groups(texts: DataFrame) -> DataFrame:
    """(doc_id, n, chars, grp): the paragraphs of each text with the number of the heading group they stand in; 0 before the first heading.

    Only places, lengths and flags are shuffled, no text.
    """
    marks = F.transform(T.paragraphs(F.col("text")), lambda p: F.struct(F.length(p).alias("chars"), T.is_heading(p).cast("int").alias("head")))
    parts = texts.select("doc_id", F.posexplode(marks).alias("n", "p")).select("doc_id", (F.col("n") + 1).alias("n"), "p.chars", "p.head")
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("grp", F.sum("head").over(so_far)).drop("head")


BLOCK = 4096


def _blocked(rows: DataFrame, key: str, block: Column) -> DataFrame:
    return rows.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\x00"))).withColumn("__block", F.coalesce(block, F.lit(-1)).cast("long"))


def carried(rows: DataFrame, key: str, block: Column, order: list[str], value: Column, name: str, *, strict: bool = False, backward: bool = False) -> DataFrame:
    """Rows with the last non-null value of their key at or before them in order; strict: before; backward: at or after.

    A key may hold a third of all rows, so no task sees a whole key: rows are
    looked through inside blocks of the order (block must not fall as the order
    rises), and one value a block is carried to the blocks after it.
    """
    marked = _blocked(rows, key, block).withColumn("__value", value)
    inside = Window.partitionBy("__key", "__block").orderBy(*order)
    pick, best, step = (F.first, F.min_by, 1) if backward else (F.last, F.max_by, -1)
    frame = (step if strict else 0, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, step if strict else 0)
    own = pick("__value", True).over(inside.rowsBetween(*frame))
    there = F.when(F.col("__value").isNotNull(), F.struct(*order))
    ends = marked.groupBy("__key", "__block").agg(best("__value", there).alias("__end"))
    far = (1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, -1)
    brought = ends.select("__key", "__block", pick("__end", True).over(Window.partitionBy("__key").orderBy("__block").rowsBetween(*far)).alias("__far"))
    return marked.withColumn("__own", own).join(brought, ["__key", "__block"]).withColumn(name, F.coalesce("__own", "__far")).drop("__key", "__block", "__value", "__own", "__far")


def running(rows: DataFrame, key: str, block: Column, order: list[str], value: Column, name: str, *, total=F.sum, strict: bool = False) -> DataFrame:
    """Rows with the sum (or max, min) of a value over their key up to them, null where there is none; strict: before them. Blocks as in carried()."""
    marked = _blocked(rows, key, block).withColumn("__value", value)
    own = total("__value").over(Window.partitionBy("__key", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    ends = marked.groupBy("__key", "__block").agg(total("__value").alias("__end"))
    brought = ends.select("__key", "__block", total("__end").over(Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    both = F.when(F.col("__own").isNull(), F.col("__far")).when(F.col("__far").isNull(), F.col("__own"))
    both = both.otherwise(F.col("__own") + F.col("__far") if total is F.sum else (F.greatest if total is F.max else F.least)("__own", "__far"))
    return marked.withColumn("__own", own).join(brought, ["__key", "__block"]).withColumn(name, both).drop("__key", "__block", "__value", "__own", "__far")


def _place() -> Column:
    return F.floor(F.col("seq") / BLOCK)


def document_places(records: DataFrame) -> DataFrame:
    """(ord, document_id, place): each record's place in its document, from 1."""
    return running(records, "document_id", _place(), ["seq", "ord"], F.lit(1), "place").select("ord", "document_id", "place")


def text_neighbours(records: DataFrame) -> DataFrame:
    """(id, before, after): the nearest text records of the same document strictly before and after each visual one."""
    text = F.when(F.col("kind") == "text", F.col("ord"))
    linked = carried(records, "document_id", _place(), ["seq", "ord"], text, "before", strict=True)
    linked = carried(linked, "document_id", _place(), ["seq", "ord"], text, "after", strict=True, backward=True)
    return linked.filter("kind <> 'text'").select(F.col("ord").alias("id"), "before", "after")


def section_as_of(records: DataFrame) -> DataFrame:
    """(id, section): the last non-empty section at or before each record of its document."""
    own = F.when(F.size("section_path") > 0, F.array_join(F.col("section_path"), " / "))
    return carried(records, "document_id", _place(), ["seq", "ord"], own, "section").select(F.col("ord").alias("id"), "section")


def merged_thin(texts: DataFrame, least: int = 220) -> DataFrame:
    """(doc_id, n, chars) of the chunks after thin ones are merged forward, and a thin last one backward.

    A fold over the paragraphs of one text: merging goes on until the chunk has ``least`` characters.
    """
    sizes = F.transform(T.paragraphs(F.col("text")), F.length)
    empty = F.expr("struct(cast(array() as array<int>) as done, cast(null as int) as open)")
    step = lambda s, x: F.struct(
        F.when(s["open"].isNotNull() & (s["open"] >= least), F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"),
        F.when(s["open"].isNull() | (s["open"] >= least), x).otherwise(s["open"] + 2 + x).alias("open"),
    )
    last = F.when(F.col("f.open").isNull(), F.col("f.done")).when((F.col("f.open") >= least) | (F.size("f.done") == 0), F.array_append("f.done", F.col("f.open")))
    tail = F.element_at("f.done", -1) + 2 + F.col("f.open")
    back = F.array_append(F.slice("f.done", F.lit(1), F.size("f.done") - 1), tail)
    folded = texts.filter("text is not null").select("doc_id", F.aggregate(sizes, empty, step).alias("f"))
    return folded.select("doc_id", F.posexplode(F.when(F.col("f.open").isNotNull() & (F.col("f.open") < least) & (F.size("f.done") > 0), back).otherwise(last)).alias("n", "chars")).withColumn("n", F.col("n") + 1)


def halved(n: Column, limit: int, overlap: int) -> Column:
    """Spans (start, stop) of at most ``limit`` of n tokens, by halving; halves share at most ``overlap`` tokens.

    A span of m tokens is cut at its middle and widened by half the overlap on
    both sides, less where it would not shrink.  One fold in the row: each round
    cuts what is still too long, and there are as many rounds as n has binary
    digits, and a few.
    """

    def cut(x: Column) -> Column:
        m = x["stop"] - x["start"]
        share = F.least(F.lit(overlap), m - 2)
        middle = x["start"] + F.floor(m / 2).cast("int")
        left = F.struct(x["start"].alias("start"), (middle + F.floor((share + 1) / 2).cast("int")).alias("stop"))
        right = F.struct((middle - F.floor(share / 2).cast("int")).alias("start"), x["stop"].alias("stop"))
        return F.when(m > limit, F.array(left, right)).otherwise(F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.greatest(n, F.lit(1)))) + 3)
    whole = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("stop")))
    return F.when(n <= limit, whole).otherwise(F.aggregate(rounds, whole, lambda spans, _: F.flatten(F.transform(spans, cut))))


def overlapping_spans(texts: DataFrame, *, limit: int, overlap: int) -> DataFrame:
    """(id, start, stop): token spans of texts (id, n: the number of tokens), as halved() cuts them; a projection, without a shuffle."""
    if not 0 <= overlap < limit - 2:
        raise ValueError("overlap must be less than limit - 2")
    return texts.select("id", F.inline(halved(F.col("n"), limit, overlap)))


def maximal_spans(spans: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Spans that no other span of their id contains; of equal spans the first by tie stays.

    spans: id, start, stop, tie.  No self-join: by start, longest first, a span is
    contained if an earlier one ends no sooner.  width: how much of ``start`` one task sees at once.
    """
    ordered = spans.withColumn("__back", -F.col("stop"))
    seen = running(ordered, "id", F.floor(F.col("start") / width), ["start", "__back", "tie"], F.col("stop"), "reach", total=F.max, strict=True)
    return seen.filter(F.col("reach").isNull() | (F.col("stop") > F.col("reach"))).drop("reach", "__back")


def line_segments(texts: DataFrame) -> DataFrame:
    """(doc_id, segment, kind, first, lines): runs of lines of one kind: code, table, heading, image, blank or text.

    A fence line belongs to its code.  Gaps and islands: a new segment begins
    where the kind differs from that of the line before.  A line's own kind is
    found in its row, so that no text is shuffled.
    """
    own = lambda x: (
        F.when(x.rlike("^[ \t]*```"), "fence")
        .when(x.rlike("^[ \t]*[|]"), "table")
        .when(x.rlike("^#{1,6} "), "heading")
        .when(x.rlike(r"^!\[[^\]]*\]\([^)]*\)"), "image")
        .when(F.trim(x) == "", "blank")
        .otherwise("text")
    )
    lines = texts.select("doc_id", F.posexplode(F.transform(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n"), own)).alias("n", "own"))
    w = Window.partitionBy("doc_id").orderBy("n")
    fence = F.col("own") == "fence"
    fenced = lines.withColumn("fences", F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = fenced.withColumn("kind", F.when(fence | (F.col("fences") % 2 == 1), "code").otherwise(F.col("own")))
    marked = marked.withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1)))
    return marked.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "segment", "kind").agg((F.min("n") + 1).alias("first"), F.count("*").alias("lines"))


def clear_spans(spans: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Spans that overlap no other of their id: of two that clash both are left out. Half-open: touching is no clash.

    width: how much of ``start`` one task sees at once.
    """
    block, order = F.floor(F.col("start") / width), ["start", "stop", "tie"]
    seen = running(spans, "id", block, order, F.col("stop"), "reach", total=F.max, strict=True)
    seen = carried(seen, "id", block, order, F.col("start"), "next", strict=True, backward=True)
    return seen.filter((F.col("reach").isNull() | (F.col("reach") <= F.col("start"))) & (F.col("next").isNull() | (F.col("next") >= F.col("stop")))).drop("reach", "next")


def greedy_spans(spans: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Of each id, in order of tie, each span that overlaps no span taken before: earlier ones win.

    Of equal spans only the first by tie can win.  The spans of an id are cut
    into stretches that touch no other, and each stretch is a fold of its own, so
    an id of any size is spread.  width: how much of ``start`` one task sees at once.
    """
    empty = F.when(F.col("start") >= F.col("stop"), F.col("tie"))  # empty spans clash with no equal one
    distinct = spans.groupBy("id", "start", "stop", empty.alias("__empty")).agg(F.min("tie").alias("tie")).drop("__empty")
    block, order = F.floor(F.col("start") / width), ["start", "stop", "tie"]
    seen = running(distinct, "id", block, order, F.col("stop"), "reach", total=F.max, strict=True)
    begins = F.when(F.col("reach").isNull() | (F.col("reach") <= F.col("start")), F.col("start"))
    stretches = carried(seen, "id", block, order, begins, "stretch")
    items = F.array_sort(F.collect_list(F.struct("tie", "start", "stop")))
    none = F.expr("cast(array() as array<struct<tie:bigint,start:bigint,stop:bigint>>)")
    clash = lambda kept, x: F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"]))
    kept = F.aggregate("items", none, lambda kept, x: F.when(clash(kept, x), kept).otherwise(F.array_append(kept, x)))
    wide = stretches.select("id", "stretch", F.col("tie").cast("long").alias("tie"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    taken = wide.groupBy("id", "stretch").agg(items.alias("items")).select("id", F.explode(kept).alias("x")).select("id", "x.start", "x.stop", "x.tie")
    return taken.select("id", *[F.col(c).cast(spans.schema[c].dataType).alias(c) for c in ("start", "stop", "tie")])


REFERENCES, APPENDIX = r"(?i)^#+\s*(references|bibliography|参考文献)\s*$", r"(?i)^#+\s*(appendix|appendices|附录)"


def chunked(texts: DataFrame, least: int = 220) -> DataFrame:
    """(doc_id, seq, chunk_id, body): a text's paragraphs grouped at headings, in order, ids made of document and place.

    A chunk that is only headings, or thinner than ``least`` characters, goes on
    into the next group; a last one like that joins the chunk before.  What
    follows a heading of references is left out up to a heading of an appendix.
    One fold over the paragraphs of a row, so nothing is shuffled.
    """
    only_headings = lambda t: F.forall(F.split(t, "\n"), lambda x: (x == "") | x.startswith("#"))
    thin = lambda t: (F.length(t) < least) | only_headings(t)
    start = F.expr("struct(cast(array() as array<string>) as done, cast(null as string) as open, false as skip)")

    def step(s, p):
        heading = T.is_heading(p)
        skip = F.when(heading & p.rlike(REFERENCES), True).when(heading & p.rlike(APPENDIX), False).otherwise(s["skip"])
        cut = heading & ~thin(s["open"])
        done = F.when(~skip & s["open"].isNotNull() & cut, F.array_append(s["done"], s["open"])).otherwise(s["done"])
        opened = F.when(skip, s["open"]).when(s["open"].isNull() | cut, p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), opened.alias("open"), skip.alias("skip"))

    def finish(s):
        n = F.size(s["done"])
        back = F.array_append(F.slice(s["done"], F.lit(1), n - 1), F.concat(F.get(s["done"], n - 1), F.lit("\n\n"), s["open"]))
        return F.when(s["open"].isNull(), s["done"]).when((n > 0) & thin(s["open"]), back).otherwise(F.array_append(s["done"], s["open"]))

    folded = texts.filter("text is not null").select("doc_id", F.posexplode(F.aggregate(T.paragraphs(F.col("text")), start, step, finish)).alias("n", "body"))
    return folded.select("doc_id", (F.col("n") + 1).alias("seq"), F.format_string("%d::text::%04d", "doc_id", F.col("n") + 1).alias("chunk_id"), "body")

"""Evaluation texts inside training texts (problem 7).

Pigeonhole edit matching.  A passage is ``run`` words in a row of a test item.
With an error budget of e edits it is split into e + 1 pieces, of which at least
one must occur unchanged.  A piece is indexed at every word of the item, so those
of every passage are there, and their hashes are looked up at every word of every
document.  A hit can be any of the e + 1 pieces of a passage; for each of these
passages Myers' bit-parallel algorithm gives the edit distance, in words, to the
document around the hit.  Distance 0 is a passage copied word by word.

The items are few and fixed; they go to the tasks in blocks of bounded size, and
the corpus is read once for each block, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import language, ship, table
from .words import Words, pieces_of

RUN, RUN_CJK = 16, 32
BATCH_CHARS = 1_500_000
BLOCK_CHARS = 8_000_000
ONE = np.uint64(1)


def myers_distance(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern (a row of at most 64 words) to any stretch of its text (a row of words).

    All rows advance together, a text word at a time; a column of the edit
    matrix is two words of bits.
    """
    n, m = patterns.shape
    weights = ONE << np.arange(m, dtype=np.uint64)
    high = ONE << np.uint64(m - 1)
    plus = np.full(n, np.uint64((1 << m) - 1), np.uint64)
    minus = np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = ((patterns == texts[:, j : j + 1]) * weights).sum(axis=1, dtype=np.uint64)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        score += ((ph & high) > 0).astype(np.int64) - ((mh & high) > 0).astype(np.int64)
        ph, mh = ph << ONE, mh << ONE
        plus = mh | ~(xv | ph)
        minus = ph & xv
        best = np.minimum(best, score)
    return best


class Items:
    """The pieces of a block of items that have passages of one length."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], run: int, budget: int):
        self.run, self.piece, self.budget = run, run // (budget + 1), budget
        kept = [k for k, w in enumerate(words) if len(w) >= run]
        self.ids = ids[kept]
        self.words = np.concatenate([words[k] for k in kept]) if kept else np.zeros(0, np.uint64)
        sizes = np.array([len(words[k]) for k in kept], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(kept)), sizes - self.piece + 1)
        place = np.concatenate([np.arange(s - self.piece + 1) for s in sizes]) if kept else np.zeros(0, np.int64)
        hashes = np.zeros(len(owner), np.uint64)
        for k in range(self.piece):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + self.words[self.starts[owner] + place + k]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, docs: Words) -> pd.DataFrame:
        """(doc, item_id, distance, longest_run) of documents that hold passages within the budget, one row for each two."""
        flat, total = docs.hashes, len(docs.hashes)
        if total < self.piece or not len(self.hashes):
            return pd.DataFrame({"doc": [], "item_id": [], "distance": [], "longest_run": []})
        h = np.zeros(total - self.piece + 1, np.uint64)
        for k in range(self.piece):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : total - self.piece + 1 + k]
        at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        doc = np.searchsorted(docs.offsets, at, "right") - 1
        keep = (hi > lo) & (at + self.piece <= docs.offsets[doc + 1])
        at, doc, lo, n = at[keep], doc[keep], lo[keep], (hi - lo)[keep]
        hit = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = [self._verified(docs, at[hit[k : k + 50_000]], doc[hit[k : k + 50_000]], entry[k : k + 50_000]) for k in range(0, len(hit), 50_000)]
        if not out:
            return pd.DataFrame({"doc": [], "item_id": [], "distance": [], "longest_run": []})
        return pd.concat(out).groupby(["doc", "item_id"], as_index=False).agg({"distance": "min", "longest_run": "max"})

    def _verified(self, docs: Words, at: np.ndarray, doc: np.ndarray, entry: np.ndarray) -> pd.DataFrame:
        item, place = self.owner[entry], self.place[entry]
        first, last = self.starts[item], self.starts[item + 1]
        low, high = docs.offsets[doc], docs.offsets[doc + 1]
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for count, step in ((left, -1), (right, 1)):
            going = np.arange(len(at))
            k = 1 if step < 0 else self.piece
            while len(going):
                i, d = (first + place)[going] + k * step, at[going] + k * step
                ok = (i >= first[going]) & (i < last[going]) & (d >= low[going]) & (d < high[going])
                ok[ok] = self.words[i[ok]] == docs.hashes[d[ok]]
                going = going[ok]
                count[going] += 1
                k += 1
        best = np.full(len(at), self.run, np.int64)
        span = np.arange(self.run)
        stretch = np.arange(-self.budget, self.run + self.budget)
        for k in range(self.budget + 1):  # the passages of which the hit is a piece
            start = place - k * self.piece
            rows = np.flatnonzero((start >= 0) & (start + self.run <= last - first))
            pattern = self.words[(first + start)[rows, None] + span]
            where = (at - place + start)[rows, None] + stretch
            inside = (where >= low[rows, None]) & (where < high[rows, None])
            text = np.where(inside, docs.hashes[np.clip(where, 0, len(docs.hashes) - 1)], np.uint64(0))
            best[rows] = np.minimum(best[rows], myers_distance(pattern, text))
        keep = best <= self.budget
        return pd.DataFrame({"doc": doc[keep], "item_id": self.ids[item[keep]], "distance": best[keep], "longest_run": (left + self.piece + right)[keep]})


def _search(items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in pieces_of(batches, BATCH_CHARS, "text"):
            docs = Words(f.text)
            ids = f.doc_id.to_numpy()
            for some in items.value:
                found = some.find(docs)
                if len(found):
                    yield pd.DataFrame({"doc_id": ids[found.doc.to_numpy(np.int64)], "item_id": found.item_id.astype("int64"), "distance": found.distance.astype("int32"), "longest_run": found.longest_run.astype("int32")})

    return run


def leaked_items(documents: DataFrame, items: DataFrame, *, run: int = RUN, run_cjk: int = RUN_CJK, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, longest_run) of the documents that hold a passage of an item with at most ``budget`` edited words.

    documents: doc_id long, text string.  items: item_id long, text string, lang
    string; passages of items in zh are ``run_cjk`` words.  distance is that of
    the best passage; longest_run the longest stretch around a piece copied word
    by word.  Every passage within the budget is found, wherever it begins.  Null and empty texts, and items shorter than a
    passage, match nothing; repeated rows count once.
    """
    if run % (budget + 1) or run_cjk % (budget + 1) or budget < 1 or max(run, run_cjk) > 64:
        raise ValueError("the budget plus one must divide the passages' lengths, of at most 64 words, into at least two pieces")
    ship(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    wanted = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    given = items.filter("item_id is not null and text is not null").select("item_id", "text", (language(F.col("lang")) == "zh").alias("cjk"))
    blocks = max(1, ceil((given.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    found = []
    for block in range(blocks):
        own = given.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()  # one block of bounded size
        words = Words(own.text)
        each = [words.hashes[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        cjk = own.cjk.to_numpy(bool)
        sides = [Items(own.item_id.to_numpy()[side], [each[k] for k in np.flatnonzero(side)], size, budget) for side, size in ((~cjk, run), (cjk, run_cjk))]
        found.append(wanted.mapInPandas(_search(context.broadcast(sides)), "doc_id long, item_id long, distance int, longest_run int"))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("longest_run").alias("longest_run"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).filter("distance = 0").select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
SQL: dict[str, str] = {}

"""Splitting oversized items at natural boundaries (problem 2).

Lexical-cohesion segmentation.  The boundaries of a text are its headings,
paragraphs, lines and sentence ends.  At each of them the words of a block
before and a block after are compared (cosine of their counts); a valley of this
similarity marks a change of topic, and its depth is how far the similarity
rises again on both sides.  Of the boundaries that leave the piece between half
the limit and the limit, the deepest valley is taken; a heading, a paragraph and
a line make a valley a little deeper, so the kind decides only between valleys of
like depth.  The next piece begins at the first boundary within the
overlap before the cut.  Only a stretch without any boundary is cut elsewhere:
at its last blank, or else at the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import content, ship, table
from .words import Words

HEADING, PARAGRAPH, LINE, SENTENCE, BLANK, NOWHERE = "heading", "paragraph", "line", "sentence", "blank", "nowhere"
#: What a kind of boundary adds to the depth of its valley, which is 0 to 2.
BONUS = {HEADING: 0.15, PARAGRAPH: 0.1, LINE: 0.05, SENTENCE: 0.0}
_BREAK = re.compile(r"(?:\r\n|\r|\n|\u2028|\u2029)(?:[^\S\r\n\u2028\u2029]*(?:\r\n|\r|\n|\u2028|\u2029))*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*")
_ONE_BREAK = re.compile(r"\r\n|\r|\n|\u2028|\u2029")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)|(?:=+|-+)\s*$")


def boundaries(text: str) -> dict[int, str]:
    """Where a piece may end, and the strongest kind of boundary there; without the ends of the text."""
    found: dict[int, str] = {}
    for m in _SENTENCE.finditer(text):
        found[m.end()] = SENTENCE
    for m in _BREAK.finditer(text):
        kind = PARAGRAPH if len(_ONE_BREAK.findall(m.group())) > 1 else LINE
        found[m.end()] = HEADING if _HEADING.match(text, m.end()) and text[m.end()] in " #" else kind
    return {k: v for k, v in found.items() if 0 < k < len(text)}


def valley_depths(text: str, at: np.ndarray, block: int = 60) -> np.ndarray:
    """Depth of the similarity valley at each of some ascending places of a text."""
    lowered = Words([text])
    if not len(lowered.hashes) or not len(at):
        return np.zeros(len(at))
    _, words = np.unique(lowered.hashes, return_inverse=True)
    size = int(words.max()) + 1
    where = np.searchsorted(lowered.at, at)
    similar = np.zeros(len(at))
    for k, w in enumerate(where):
        left = np.bincount(words[max(0, w - block) : w], minlength=size).astype(float)
        right = np.bincount(words[w : w + block], minlength=size).astype(float)
        norm = np.sqrt((left @ left) * (right @ right))
        similar[k] = left @ right / norm if norm else 0.0
    depth = np.zeros(len(at))
    for k in range(len(at)):
        lo = hi = similar[k]
        for j in range(k - 1, -1, -1):
            if similar[j] < lo:
                break
            lo = similar[j]
        for j in range(k + 1, len(at)):
            if similar[j] < hi:
                break
            hi = similar[j]
        depth[k] = lo + hi - 2 * similar[k]
    return depth


def _whole(text: str, at: int, least: int) -> int:
    """A place at or before ``at`` that splits no character from its accents and no line break; after ``least``."""
    k = at
    while k > least + 1 and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1 : k + 1] == "\r\n"):
        k -= 1
    return k


def split_text(text: str, limit: int = 6000, overlap: int = 960) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of each piece, in order; a text within the limit is one piece.

    Pieces cover the text, are at most ``limit`` characters, and share at most
    ``overlap`` characters with the piece before.  Equally deep valleys: the
    later one.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    kinds = boundaries(text)
    at = np.array(sorted(kinds), np.int64)
    depths = valley_depths(text, at)
    depths = depths + np.array([BONUS[kinds[int(k)]] for k in at])
    pieces: list[tuple[int, int, str]] = []
    start = done = 0
    while len(text) - start > limit:
        fits = np.flatnonzero((at > max(done, start + limit // 2)) & (at <= start + limit))
        if not len(fits):
            fits = np.flatnonzero((at > done) & (at <= start + limit))
        if len(fits):
            best = max(fits, key=lambda k: (depths[k], k))
            end, kind = int(at[best]), kinds[int(at[best])]
        else:
            blank = max((m.end() for m in re.finditer(r"\s+", text[done + 1 : start + limit])), default=0)
            end, kind = (done + 1 + blank, BLANK) if blank else (_whole(text, start + limit, done), NOWHERE)
        pieces.append((start, end, kind))
        done = end
        again = at[(at >= end - overlap) & (at < end) & (at > start)]
        if len(again):
            start = int(again[0])
        else:
            blank = re.search(r"\s+(?=\S)", text[max(end - overlap, start + 1) : end]) if overlap else None
            start = max(end - overlap, start + 1) + blank.end() if blank else _whole(text, max(end - overlap, start + 1), start) if overlap else end
            if start < end - overlap:
                start = end - overlap
    pieces.append((start, len(text), "end"))
    return pieces


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for row in f.itertuples(index=False):
                cut = split_text(row.content, limit, overlap)
                yield pd.DataFrame({
                    "key": row.key, "id": row.id, "section_path": [row.section_path] * len(cut), "piece": range(1, len(cut) + 1), "pieces": len(cut),
                    "char_start": [a for a, _, _ in cut], "char_end": [b for _, b, _ in cut], "boundary": [k for _, _, k in cut], "content": [row.content[a:b] for a, b, _ in cut],
                })

    return run


def split_oversized(rows: DataFrame, key: Column, order: Column, text: Column, section_path: Column, *, limit: int = 6000, overlap: int = 960) -> DataFrame:
    """Pieces of the items longer than ``limit`` characters: (key, id, section_path, piece, pieces, char_start, char_end, boundary, content).

    char_start and char_end count from 0, the end excluded.  Of a key delivered
    again the one smallest in order counts.  Null keys and null texts take no
    part; items within the limit have no rows here; other columns are ignored.
    Only oversized texts leave the scan.
    """
    ship(rows.sparkSession)
    large = rows.select(key.alias("key"), order.alias("id"), text.alias("content"), section_path.alias("section_path")).filter((F.char_length("content") > limit) & F.col("key").isNotNull())
    first = large.groupBy("key").agg(F.min(F.struct(F.coalesce("id", F.lit(2**62)).alias("id"), "content", "section_path")).alias("r")).select("key", "r.*")
    schema = "key string, id long, section_path array<string>, piece int, pieces int, char_start int, char_end int, boundary string, content string"
    return first.mapInPandas(_split(limit, overlap), schema)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf_dir, "records"), F.col("chunk_id"), F.col("ord"), content(), F.col("section_path"))
    return pieces.withColumnRenamed("key", "chunk_id").withColumnRenamed("id", "ord")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).filter("piece = 1 and pieces > 1").select("chunk_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {"p2_found": "SELECT DISTINCT chunk_id FROM records WHERE length(coalesce(retrieval_text, text)) > 6000 AND chunk_id IS NOT NULL"}

"""Token budget per source, language and domain (problem 3).

The vocabulary becomes a double-array trie; a count-only Viterbi pass over each
normalised segment keeps, at every position, the best score and the number of
tokens on the best path, never the path itself.  A segment is a stretch that no
token of the vocabulary can cross the ends of; the text's count is the sum over
its segments, so a segment met before costs a dictionary look-up.

A unigram vocabulary has log-probabilities as scores.  A vocabulary of merges has
only ranks; its scores are then log-probabilities by Zipf's law, -log(rank + 100),
which makes the count an estimate of the number of tokens by merging.
"""

from __future__ import annotations

import collections
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import language, ship, table
from .words import pieces_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 2_000_000
KEPT_SEGMENTS = 300_000
MOST_PIECES = 2_000_000
ZIPF_SHIFT = 100.0
BYTE_SCORE = -16.0
SPACE = "▁"


def piece_scores(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a vocabulary file with their log-probabilities.

    Pieces whose scores are whole numbers counting down are ranked merges and get Zipf's scores.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MOST_PIECES:
        raise ValueError(f"the vocabulary has more than {MOST_PIECES} pieces")
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in kept]
    if all(s == int(s) for s in scores):
        scores = [-math.log(k + ZIPF_SHIFT) for k in range(len(kept))]
    return [(model.id_to_piece(i), s) for i, s in zip(kept, scores)]


class DoubleArray:
    """A trie as two arrays: the child of state s by character code c is base[s] + c where check there is s."""

    def __init__(self, pieces: list[tuple[str, float]]):
        letters = [c for c, _ in collections.Counter(c for p, _ in pieces for c in p).most_common()]
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        tree: dict = {}
        for p, score in pieces:
            node = tree
            for c in p:
                node = node.setdefault(self.code[c], {})
            node[0] = score
        size = 6 * sum(len(p) for p, _ in pieces) + 64 * len(letters) + 4096
        self.base, self.check, self.score = [0] * size, [-1] * size, [None] * size
        taken = np.zeros(size, bool)
        taken[0] = True
        self.check[0] = 0
        todo, free, top = [(0, 0, tree)], np.arange(1, size), 1
        placed = 0
        while todo:
            _, state, node = heapq.heappop(todo)
            self.score[state] = node.get(0)
            children = sorted(k for k in node if k)
            if not children:
                continue
            if (placed := placed + 1) % 64 == 0:
                free = free[~taken[free]]
            own = np.array(children)
            at = top  # a node without room among the first free places goes behind the last
            for lo, hi in ((0, 128), (128, 4096)):
                starts = free[lo:hi] - children[0]
                starts = starts[(starts > 0) & (starts + children[-1] < size)]
                fits = ~taken[starts[:, None] + own].any(axis=1)
                if fits.any():
                    at = int(starts[fits.argmax()])
                    break
            self.base[state] = at
            taken[at + own] = True
            top = max(top, at + children[-1] + 1)
            for c in children:
                self.check[at + c] = state
                heapq.heappush(todo, (-len(node[c]), at + c, node[c]))
        self.base, self.check, self.score = self.base[: top + 1], self.check[: top + 1], self.score[: top + 1]
        #: Neighbours inside some piece; a segment ends between any others.
        self.joined = {a + b for p, _ in pieces for a, b in zip(p, p[1:])}

    def count(self, segment: str) -> int:
        """Number of tokens on the best path; a character outside the vocabulary costs a token for each of its bytes."""
        base, check, score, code = self.base, self.check, self.score, self.code
        codes = [code.get(c, 0) for c in segment]
        n = len(codes)
        best, tokens = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        limit = len(check)
        for i in range(n):
            here, so_far = best[i], tokens[i]
            state, whole = 0, False
            for j in range(i, n):
                c = codes[j]
                if not c:
                    break
                nxt = base[state] + c
                if nxt >= limit or check[nxt] != state or not base[state]:
                    break
                state = nxt
                if (s := score[state]) is not None:
                    whole = whole or j == i
                    if here + s > best[j + 1]:
                        best[j + 1], tokens[j + 1] = here + s, so_far + 1
            if not whole:
                size = len(segment[i].encode("utf-8", "surrogatepass"))
                if here + BYTE_SCORE * size > best[i + 1]:
                    best[i + 1], tokens[i + 1] = here + BYTE_SCORE * size, so_far + size
        return tokens[n]


class Counter:
    """Counts tokens of texts, with the counts of segments met so far."""

    def __init__(self, trie: DoubleArray):
        self.trie = trie
        self.known: dict[str, int] = {}
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*").findall

    def stretch(self, text: str) -> int:
        """Tokens of a stretch between spaces: its segments are looked up or counted."""
        joined, known = self.trie.joined, self.known
        total, lo = 0, 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in joined:
                part = text[lo:k]
                n = known.get(part)
                if n is None:
                    n = known[part] = self.trie.count(part)
                total += n
                lo = k
        return total

    def text(self, text: str | None) -> int:
        """Tokens of a text; 0 for null and empty texts."""
        if not text:
            return 0
        if len(self.known) > KEPT_SEGMENTS:
            self.known.clear()
        total, known = 0, self.known
        for part in self.split(SPACE + text.replace(" ", SPACE)):
            n = known.get(part)
            if n is None:
                n = self.stretch(part)
                if len(part) < 24:
                    known[part] = n
            total += n
        return total


_kept: dict[str, Counter] = {}


def _counts(trie, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _kept.get(key)
        if counter is None:
            _kept.clear()
            counter = _kept[key] = Counter(trie.value)
        for f in pieces_of(batches, BATCH_CHARS, "text"):
            yield f.drop(columns="text").assign(tokens=[counter.text(t if isinstance(t, str) else None) for t in f.text])

    return run


def record_tokens(records: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(chunk_id, ord, document_id, lang, text) -> (chunk_id, document_id, language, tokens), each chunk_id once.

    Of a chunk_id delivered again the smallest ord counts.  Null chunk_ids take
    no part; null and empty texts have 0 tokens; null and unknown languages are
    'und'.
    """
    ship(records.sparkSession)
    trie = records.sparkSession.sparkContext.broadcast(DoubleArray(piece_scores(vocabulary)))
    rows = records.filter("chunk_id is not null").select("chunk_id", F.coalesce("ord", F.lit(2**62)).alias("ord"), "document_id", language(F.col("lang")).alias("language"), "text")
    counted = rows.mapInPandas(_counts(trie, vocabulary), "chunk_id string, ord long, document_id string, language string, tokens long")
    first = counted.groupBy("chunk_id").agg(F.min(F.struct("ord", "document_id", "language", "tokens")).alias("r"))
    return first.select("chunk_id", "r.document_id", "r.language", "r.tokens")


def slice_tokens(counted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Totals by document, language, domain and all three: (slice, document_id, language, domain, records, tokens).

    The domain is that of the record's document; a document that the catalog
    lacks, or without a domain, has the domain 'unknown'.  Rows are summed by
    document and language before the catalog is joined.
    """
    sums = counted.groupBy("document_id", "language").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    domains = catalog.filter("document_id is not null").groupBy("document_id").agg(F.min("domain").alias("domain"))
    cells = sums.join(domains, "document_id", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    cells = cells.withColumn("document_id", F.coalesce("document_id", F.lit("")))
    wide = cells.groupingSets([["document_id"], ["language"], ["domain"], ["document_id", "language", "domain"]], "document_id", "language", "domain")
    totals = wide.agg(F.grouping_id("document_id", "language", "domain").alias("g"), F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    name = F.when(F.col("g") == 3, "document").when(F.col("g") == 5, "language").when(F.col("g") == 6, "domain").otherwise("document and language")
    return totals.select(name.alias("slice"), "document_id", "language", "domain", "records", "tokens")


def p3_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records").select("chunk_id", "ord", "document_id", "lang", "text")
    return slice_tokens(record_tokens(records), table(spark, sf_dir, "doc_catalog").select("document_id", "domain"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_tokens(table(spark, sf_dir, "records").select("chunk_id", "ord", "document_id", "lang", "text"))


QUERIES = {"p3_slices": p3_slices, "p3_records": p3_records}
SQL: dict[str, str] = {}

"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Pair occurrence index: the pieces of a partition that were not met before are
laid out as one linked list of symbols; every pair of neighbours that the
vocabulary can merge is mapped to all its positions; the active ranks are
applied in ascending order, and each merge updates the lists of the two new
neighbours.  A heap holds the active ranks, so a merge that makes a lower rank
possible is applied next.  Pieces repeat heavily, so their ids are kept and each
distinct piece of a task is encoded once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import ship, table
from .words import pieces_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 1_500_000
KEPT_PIECES = 300_000
MOST_BYTES = 64_000_000


class PairIndex:
    """Ranks of a vocabulary, and the ids of pieces met so far."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.merges[a << 32 | b] = rank
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces together, by one index of pair occurrences."""
        merges, single = self.merges, self.single
        symbols: list[int] = []
        starts = [0]
        for p in pieces:
            symbols.extend([single[b] for b in p.encode("utf-8", "surrogatepass")])
            symbols.append(-1)
            starts.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (r := merges.get(a << 32 | b)) is not None:
                places.setdefault(r, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for i in sorted(places.pop(rank, ())):
                a = symbols[i]
                if a < 0 or (j := after[i]) >= n or symbols[j] < 0 or merges.get(a << 32 | symbols[j]) != rank:
                    continue
                symbols[i] = rank
                symbols[j] = -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbols[k] >= 0 and (r := merges.get(rank << 32 | symbols[k])) is not None:
                        if r not in places:
                            places[r] = []
                            heapq.heappush(active, r)
                        places[r].append(i)
                h = before[i]
                if h >= 0 and symbols[h] >= 0 and (r := merges.get(symbols[h] << 32 | rank)) is not None:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(active, r)
                    places[r].append(h)
        for p, lo, hi in zip(pieces, starts, starts[1:]):
            self.known[p] = tuple(s for s in symbols[lo:hi] if s >= 0)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and for empty texts."""
        split = [self.split(t) if t else () for t in texts]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        if new := list({p for pieces in split for p in pieces if p not in self.known}):
            self.learn(new)
        known = self.known
        return [np.fromiter([i for p in pieces for i in known[p]], np.int32) for pieces in split]


_kept: dict[int, PairIndex] = {}


def _encode(vocabulary, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = vocabulary.value
        index = _kept.get(key := hash((data, pattern)))
        if index is None:
            _kept.clear()
            index = _kept[key] = PairIndex(data, pattern)
        for f in pieces_of(batches, BATCH_CHARS, "text"):
            yield pd.DataFrame({"doc_id": f.doc_id, "ids": index.encode([t if isinstance(t, str) else None for t in f.text])})

    return run


def byte_pair_ids(texts: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id long, text string) -> (doc_id, ids array<int>), one row per row, without special tokens.

    Null and empty texts have an empty list.  Strings that spell special tokens
    are ordinary text.  vocabulary: path of a rank file on the driver; its bytes
    are broadcast, at most 64 MB.
    """
    ship(texts.sparkSession)
    with open(vocabulary, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"the vocabulary is larger than {MOST_BYTES} bytes")
    return texts.select("doc_id", "text").mapInPandas(_encode(texts.sparkSession.sparkContext.broadcast(data), pattern), "doc_id long, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pair_ids(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}

"""Reading level of each document (problem 8).

Every sentence is classified by regularised models of its words, pairs of words
and character trigrams (a softmax regression over hashed features, with the
document's grade as the sentence's); the distributions of its sentences, their
spread and their lengths then give the document's distribution over the grades,
by a second softmax regression fitted on sentences the first had not seen, so
that its probabilities are calibrated.

Code, tables, headings, links and passages in another language than most of the
document are taken out before.

The models are fitted on a bounded sample of the graded documents
(``most_graded``), chosen by a hash of doc_id; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import language, ship, table
from .words import Words, mix, pieces_of

GRADES = 5
BITS = 15
BATCH_CHARS = 1_000_000
MOST_GRADED = 2_500
LEAST_WORDS = 60

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_DROPPED_LINE = re.compile(r"^(?:[ ]{0,3}#{1,6}(?:[ \t].*)?|[ \t]*\|.*|[ \t]*(?:=+|-{3,}|\*{3,})[ \t]*|(?:[ ]{4,}|\t)[^\s\-*+\d].*)$", re.M)
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|<[^>\n]{1,200}>|\b(?:https?://|www\.)\S+|`[^`\n]*`")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+|^[ \t]*>[ \t]?", re.M)
_WRAP = re.compile(r"(?<=\S)[ \t]*\n[ \t]*(?=[^\W\d_A-ZÀ-Þ一-鿿])")
_END = re.compile(r"(?<=[。！？])|(?<=[.!?…])[\"'”»)\]]*\s+(?=[^\sa-z\d])|[\r\n\u2028\u2029]+")

# Frequent short words by which passages in another language are told.
COMMON_WORDS = {
    "en": "the of and to in is that for with on at from by are this which as between after before",
    "de": "der die das und ist nicht ein eine mit den von zu auf für im dem des sich als bei nach vor",
    "fr": "le la les des et est une un dans pour que qui sur avec du au par pas avant après",
    "es": "el los las y es una un en para que por con del se al como sin antes tras entre",
}


def prose(text: str | None) -> list[str]:
    """Sentences of a text without code, tables, headings and links."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    text = _LINK.sub(r"\1", _DROPPED_LINE.sub("\n", text))
    text = _WRAP.sub(" ", _ITEM.sub("\n\n", text).replace("\n\n", "\v")).replace("\v", "\n\n")
    return [s for s in map(str.strip, _END.split(text)) if s]


class Sentences:
    """The sentences of a batch of texts as hashed features."""

    def __init__(self, texts: list[str | None]):
        parts = [prose(t) for t in texts]
        self.docs = len(parts)
        flat = [s for p in parts for s in p]
        doc = np.repeat(np.arange(self.docs), [len(p) for p in parts])
        words = Words(flat)
        n = words.counts()
        keep = (n >= 3) & _own_language(words, doc, self.docs)
        self.kept = np.flatnonzero(keep)
        self.doc = doc[self.kept]
        number = np.cumsum(keep) - 1
        owner = np.repeat(np.arange(len(flat)), n)
        use = keep[owner]
        hashes, own = words.hashes[use], number[owner[use]]
        self.size = np.bincount(own, minlength=len(self.kept)).astype(np.float32)
        pair = own[1:] == own[:-1]
        pairs = mix(hashes[1:] * np.uint64(3) + hashes[:-1])[pair]
        begin, end = words.at[use], words.end[use]
        lengths = end - begin
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(begin) else np.zeros(0, np.int64)
        p = words.points.astype(np.uint64)
        before = np.where(where == np.repeat(begin, lengths), 0, p[where - 1])
        after = np.where(where == np.repeat(end, lengths) - 1, 0, p[np.minimum(where + 1, len(p) - 1)])
        grams = mix((before << np.uint64(42)) ^ (p[where] << np.uint64(21)) ^ after)
        gram_own = np.repeat(own, lengths)
        self.chars = np.bincount(gram_own, minlength=len(self.kept)).astype(np.float32)
        mask = np.uint64((1 << BITS) - 1)
        blocks = [(hashes, own), (pairs, own[1:][pair]), (grams, gram_own)]
        feature = [(h & mask).astype(np.int64) + (k << BITS) for k, (h, _) in enumerate(blocks)]
        weight = [1 / np.maximum(np.bincount(o, minlength=len(self.kept)), 1)[o] for _, o in blocks]
        self.feature = np.concatenate(feature).astype(np.int32)
        self.owner = np.concatenate([o for _, o in blocks]).astype(np.int32)
        self.weight = np.concatenate(weight).astype(np.float32)
        commas = np.concatenate([[0], np.cumsum(np.isin(words.points, np.array([ord(c) for c in ",，;；、:："], np.uint32)))])
        marks = (commas[words.starts[1:]] - commas[words.starts[:-1]])[self.kept]
        dense = np.stack([np.ones(len(self.kept)), np.log1p(self.size), np.log1p(self.chars), self.chars / np.maximum(self.size, 1) / 8, np.log1p(marks)], axis=1)
        self.dense = dense.astype(np.float32)

    def logits(self, sparse: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = self.dense @ dense
        for k in range(GRADES):
            out[:, k] += np.bincount(self.owner, sparse[self.feature, k] * self.weight, minlength=len(self.kept))
        return out


def _own_language(words: Words, doc: np.ndarray, docs: int) -> np.ndarray:
    """Which sentences are in the language that most of their document is in; sentences that show none count as own."""
    n = len(words)
    owner = np.repeat(np.arange(n), words.counts())
    seen = np.zeros((n, len(COMMON_WORDS) + 1), np.float32)
    for k, listed in enumerate(COMMON_WORDS.values()):
        seen[:, k] = np.bincount(owner, np.isin(words.hashes, Words([listed]).hashes), minlength=n)
    first = words.points[words.at]
    seen[:, -1] = np.bincount(owner, (first >= 0x4E00) & (first < 0xA000), minlength=n) / 3
    total = np.zeros((docs, seen.shape[1]), np.float32)
    np.add.at(total, doc, seen)
    main = total.argmax(axis=1)[doc] if n else np.zeros(0, np.int64)
    return seen[np.arange(n), main] >= seen.max(axis=1, initial=0) - 1e-6


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_sentences(s: Sentences, grades: np.ndarray, rows: np.ndarray, *, rounds: int = 40, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression of the documents' grades (0-based) on the chosen sentences; Adam on all of them, ridge penalty."""
    use = rows[s.owner]
    feature, owner, weight = s.feature[use], s.owner[use], s.weight[use]
    used, place = np.unique(feature, return_inverse=True)
    sparse = np.zeros((len(used), GRADES), np.float32)
    dense = np.zeros((s.dense.shape[1], GRADES), np.float32)
    target = np.zeros((len(s.kept), GRADES), np.float32)
    target[np.arange(len(s.kept)), grades[s.doc]] = 1
    share = (rows / max(rows.sum(), 1)).astype(np.float32)[:, None]
    state = [np.zeros_like(sparse), np.zeros_like(sparse), np.zeros_like(dense), np.zeros_like(dense)]
    for t in range(1, rounds + 1):
        logit = s.dense @ dense
        for k in range(GRADES):
            logit[:, k] += np.bincount(owner, sparse[place, k] * weight, minlength=len(s.kept))
        error = ((_softmax(logit) - target) * share).astype(np.float32)
        grad = np.stack([np.bincount(place, error[owner, k] * weight, minlength=len(used)) for k in range(GRADES)], axis=1) + ridge * sparse
        for value, g, m, v in ((sparse, grad, state[0], state[1]), (dense, s.dense.T @ error, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    whole = np.zeros((3 << BITS, GRADES), np.float32)
    whole[used] = sparse
    return whole, dense


def document_features(s: Sentences, probabilities: np.ndarray) -> np.ndarray:
    """What the sentences of each document say together, weighted by their words; zeros for documents without sentences."""
    def mean(values: np.ndarray) -> np.ndarray:
        weight = np.bincount(s.doc, s.size, minlength=s.docs)
        return np.bincount(s.doc, values * s.size, minlength=s.docs) / np.maximum(weight, 1)

    level = probabilities @ np.arange(GRADES)
    average = mean(level)
    spread = np.sqrt(mean((level - average[s.doc]) ** 2))
    columns = [np.ones(s.docs), *(mean(probabilities[:, k]) for k in range(GRADES)), average, average**2 / 4, spread]
    columns += [mean(probabilities.argmax(axis=1) == k) for k in range(GRADES)]
    columns += [np.log1p(mean(s.size)), mean(s.chars / np.maximum(s.size, 1)) / 8]
    return np.stack(columns, axis=1)


def fit_documents(x: np.ndarray, grades: np.ndarray, *, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression of grades on document features."""
    w, m, v = (np.zeros((x.shape[1], GRADES)) for _ in range(3))
    target = np.eye(GRADES)[grades]
    for t in range(1, rounds + 1):
        g = x.T @ (_softmax(x @ w) - target) / max(len(x), 1) + ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class LevelModel:
    """Sentence model and document model; score() gives a distribution over the grades for each text."""

    def __init__(self, texts: list[str | None], levels: np.ndarray):
        s = Sentences(texts)
        grades = np.clip(np.asarray(levels, int) - 1, 0, GRADES - 1)
        half = (np.arange(s.docs) % 2).astype(bool)
        p = np.zeros((len(s.kept), GRADES))
        for side in (half, ~half):  # each half is judged by the model of the other
            p_side = _softmax(s.logits(*fit_sentences(s, grades, (~side)[s.doc])))
            p[side[s.doc]] = p_side[side[s.doc]]
        some = np.bincount(s.doc, minlength=s.docs) > 0
        self.document = fit_documents(document_features(s, p)[some], grades[some])
        self.sparse, self.dense = fit_sentences(s, grades, np.ones(len(s.kept), bool))
        self.prior = np.bincount(grades, minlength=GRADES) / max(len(grades), 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = Sentences(texts)
        out = _softmax(document_features(s, _softmax(s.logits(self.sparse, self.dense))) @ self.document)
        out[np.bincount(s.doc, minlength=s.docs) == 0] = np.nan
        return out


def fit_level_model(documents: DataFrame, labels: DataFrame, *, most_graded: int = MOST_GRADED) -> LevelModel | None:
    """The model of a bounded sample of graded documents; None where none is graded.

    A document's grade is the rounded mean of its readers' grades; null grades
    and repeated rows do not count.
    """
    graded = labels.filter("doc_id is not null and reading_level is not null").dropDuplicates(["doc_id", "rater", "rated_at", "reading_level"])
    graded = graded.groupBy("doc_id").agg(F.round(F.avg("reading_level")).cast("int").alias("level"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_graded)
    texts = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    return LevelModel(list(texts.text), texts.level.to_numpy()) if len(texts) else None


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in pieces_of(batches, BATCH_CHARS, "text"):
            p = model.value.score([t if isinstance(t, str) else None for t in f.text])
            none = np.isnan(p[:, 0])
            level = np.where(none, 0, np.nan_to_num(p).argmax(axis=1) + 1)
            demanding = np.where(none, 0.0, np.nan_to_num(p)[:, 3:].sum(axis=1))
            yield pd.DataFrame({
                "doc_id": f.doc_id, "words": Words(f.text).counts().astype(np.int32), "level": level.astype(np.int32),
                "expected_level": np.where(none, 0.0, np.nan_to_num(p) @ np.arange(1, GRADES + 1)), "demanding": demanding,
            })

    return run


def reading_levels(documents: DataFrame, labels: DataFrame, *, most_graded: int = MOST_GRADED) -> DataFrame:
    """(doc_id, words, level, expected_level, demanding) of every document.

    level: the likeliest grade, 1 to 5; expected_level: the mean of the
    distribution; demanding: the probability of grades 4 and 5.  A document
    without prose (null, empty, only code) has level 0.  Without any grades the
    result is empty.
    """
    schema = "doc_id long, words int, level int, expected_level double, demanding double"
    model = fit_level_model(documents, labels, most_graded=most_graded)
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.filter("doc_id is not null").select("doc_id", "text").mapInPandas(_score(shared), schema)


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).filter(f"words >= {LEAST_WORDS} and demanding >= 0.5").select("doc_id").distinct()


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(domain, language, level, documents, words): how demanding each slice is; documents without prose have level 0, null domains are 'unknown'."""
    slices = documents.filter("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min(language(F.col("lang"))).alias("language"))
    rows = levels.select("doc_id", "level", "words").join(slices, "doc_id")
    return rows.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain"), "language", "level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return level_profile(reading_levels(documents, table(spark, sf_dir, "reading_labels")), documents.select("doc_id", "domain", "lang"))


QUERIES = {"p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile}
SQL: dict[str, str] = {}

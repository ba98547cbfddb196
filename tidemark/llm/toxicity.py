"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

The probability of a grade above k is the logistic function of w.x - t(k): the weights w are shared by
all thresholds, and the thresholds t are ordered. x marks which of the chosen features a text has: whole words,
and beginnings and ends of words, as insults have many forms in some languages. A document's severity is the
expected grade, the sum over k of these probabilities.

Learning takes a sample of labelled rows (``MAX_ROWS``, a documented bound), and counts in how many toxic
and other documents of it each feature stands. They are ranked by the z-score of the difference of these
shares; the ``FEATURES`` farthest from zero are used. If the labels have no column of grades, they are made: 0 if not
toxic, else 1, 2 or 3 for at most 1, up to 3, or more *marked* words in the text. Marks are crossed: the sample is
dealt into two halves, and a text's words are marked by the labels of the other half alone (words with a feature of half
of the highest z-score there or more), so no document's grade rests on features that its own label chose. The
likelihood, with a ridge, is climbed with all rows at a time.

Texts are read whole, map-side; the model is a table of ``FEATURES`` entries at most. Words are lower-cased
and lose ASCII punctuation. A null or empty text has no features. Repeated rows are graded each. With no
labels, or labels of one kind only, every document gets severity 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_texts, map_batches, parts, sampled_labels, stored
from .decontam import plain_words

MAX_ROWS = 20_000
FEATURES = 2048
LEAST_Z = 4.0
#: Marked words up to which a toxic document has grade 1, 2; grade 3 beyond.
GRADE_STEPS = (1, 3)
TALLY = 400_000
PART_CHARS = 4_000_000


def features_of(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 characters and its ends of 3 and 4."""
    n = len(word)
    return [word, *("^" + word[:k] for k in (3, 4, 5, 6) if k < n), *(word[-k:] + "$" for k in (3, 4) if k < n)]


class Features(dict):
    """The known features of each word, worked out when first asked for."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        get = self.index.get
        found = self[word] = tuple(k for f in features_of(word.decode()) if (k := get(f)) is not None)
        return found

    def rows(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """For each text the features of its distinct words that have any."""
        return [[f for w in set(plain_words(text)) if (f := self[w])] for text in texts]


class Ordinal(NamedTuple):
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        x = []
        for a, b in parts(texts, PART_CHARS):
            for row in Features(self.words).rows(texts[a:b]):
                x.append(self.weights[sorted({k for own in row for k in own})].sum())
        x = np.array(x, float)
        return 1 / (1 + np.exp(np.clip(self.thresholds - x[:, None], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, rounds: int = 400, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds for rows of feature numbers, by Adam on the whole likelihood.

    Thresholds are the first one plus the exponentials of steps, so their order can't be lost.
    """
    levels = int(grades.max())
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([(grades > k).mean() for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(len(grades))

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    for r in range(1, rounds + 1):
        w, t = p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1 :]))])
        x = np.bincount(owner, w[flat], len(rows))
        s = np.concatenate([np.ones((len(x), 1)), sigmoid(x[:, None] - t), np.zeros((len(x), 1))], axis=1)  # P(grade >= k)
        high, low = s[at, grades], s[at, grades + 1]
        likelihood = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / likelihood, low * (1 - low) / likelihood
        gx = d_high - d_low
        gt = np.zeros(levels)
        np.add.at(gt, grades[grades > 0] - 1, -d_high[grades > 0])
        np.add.at(gt, grades[grades < levels], d_low[grades < levels])
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(flat, gx[owner], features), tail[:1], tail[1:] * np.exp(p[features + 1 :])]) / len(x)
        g[:features] -= ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1 :]))])


def feature_shares(sample: DataFrame) -> dict[str, tuple[float, int]]:
    """z-score and number of texts of the features whose z-score is farthest from zero, ``FEATURES`` at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)], ["word", "other", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic > 0].update({f for w in set(plain_words(text)) for f in features_of(w.decode())})
            if len(seen[0]) + len(seen[1]) > TALLY:
                yield out()
                seen[0].clear()
                seen[1].clear()
        yield out()

    sizes = sample.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("a"), F.count("*").alias("n")).first()
    a, b = sizes["a"] or 0, sizes["n"] - (sizes["a"] or 0)
    if not a or not b:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(tally, "word string, other long, toxic long").groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    n = F.col("toxic") + F.col("other")
    p = n / F.lit(float(a + b))
    z = (F.col("toxic") / F.lit(float(a)) - F.col("other") / F.lit(float(b))) / F.sqrt(p * (1 - p) * F.lit(1 / a + 1 / b))
    ranked = counts.where((n >= 4) & (p < 1)).select("word", z.alias("z"), n.alias("n")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(FEATURES)
    return {r["word"]: (r["z"], r["n"]) for r in ranked.collect()}


def marked_features(shares: dict[str, tuple[float, int]]) -> dict[str, int]:
    """The features of half of the highest z-score or more, numbered."""
    top = max((z for z, _ in shares.values()), default=0.0)
    return {w: k for k, w in enumerate(w for w, (z, _) in shares.items() if z >= top / 2 > 0)}


def fit_severity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ordinal | None:
    """The model from the labels' ``toxic`` (and ``grade``, if they have it); None if nothing can be learned."""
    graded = "grade" in labels.columns
    chosen = sampled_labels(labels, "toxic", max_rows)
    if graded:
        chosen = chosen.join(labels.groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")), "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = stored(labelled_texts(docs, chosen).withColumn("half", half))
    shares = feature_shares(sample)
    if not shares:
        return None
    index = {w: k for k, w in enumerate(shares)}
    marks = [{}, {}] if graded else [marked_features(feature_shares(sample.where(F.col("half") != k))) for k in (0, 1)]

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, other, hits, features = Features(index), [Features(m) for m in marks], [], []
        for text, k in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True):
            hits.append(len(other[k].rows([text])[0]))
            features.append(sorted({f for row in own.rows([text])[0] for f in row}))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hits, pa.int32()), pa.array(features, pa.list_(pa.int32()))], ["doc_id", "label", "hits", "features"])

    label = F.col("grade" if graded else "toxic").cast("int").alias("label")
    rows = map_batches(sample.select("doc_id", label, "half", "text"), mark, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, hits int, features array<int>").orderBy("doc_id", "label", "features").collect()
    features = [np.array(r["features"], np.int64) for r in rows]
    hits = np.array([r["hits"] for r in rows])
    given = np.array([r["label"] or 0 for r in rows])
    grades = given if graded else np.where(given > 0, 1 + sum((hits > s).astype(int) for s in GRADE_STEPS), 0)
    if grades.max() < 1:
        return None
    return Ordinal(index, *fit_ordinal(features, grades, len(index)))


def grade_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.35, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, severity (the expected grade), grade (the most likely), p_toxic, toxic for each document."""
    model = fit_severity(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        above = shared.value.above(texts) if shared.value else np.zeros((len(texts), 1))
        edges = np.concatenate([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))], axis=1)
        grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
        arrays = [pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cutoff)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, grade int, p_toxic double, toxic boolean")

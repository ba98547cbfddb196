"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

Each document's statistics come from its whole text, map-side. A document fails the fixed limits if it
has fewer than ``MIN_WORDS`` words, or more than half of its words stand in 3-word windows that occur
twice or more. The trees judge the rest.

The trees are fitted on the statistics of a sample of labelled rows (``max_rows``, a documented bound)
with logistic loss on histogram bins. Chosen features are monotonic: more symbols, repeats, repeated
lines or capitals can't raise the score. Such a split is taken only if its sides are in order, and both
sides are then bounded by the value between them. The fitted trees are flattened into numpy arrays
with a row for each tree and a column for each node of a complete binary tree, so a batch is scored by
stepping all rows down a level at a time.

A null or empty text has no words: its statistics are zero and it isn't kept. Repeated rows are judged
each. Without usable labels of both kinds the fixed limits alone decide. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, labelled_texts, map_batches, sampled_labels

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50
WINDOW = 3
#: Most labelled rows that the trees are fitted on.
MAX_ROWS = 20_000

_words = re.compile(WORD).findall
_SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and the sign of their monotonic constraint (0: none).
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punctuation_share": 0, "exclamation_share": -1, "distinct_word_share": 0,
    "long_word_share": 0, "lines_per_word": 0, "sentence_end_share": 0,
}


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words occurring twice or more in the list."""
    if len(words) <= window:
        return 0
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, total = 0, 0
    for at, w in enumerate(windows):
        if seen[w] > 1:
            total += at + window - max(covered, at)
            covered = at + window
    return total


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the values of ``FEATURES`` of one text."""
    text = text or ""
    words = _words(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if _has_word(line)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    per_char, per_word = 1 / max(1, chars), 1 / max(1, n)
    features = [
        float(np.log1p(n)), chars * per_word, symbols * per_char, dup_lines / max(1, len(lines)), repeats * per_word,
        len(_capitals(text)) * per_char, len(_digits(text)) * per_char, len(_punctuation(text)) * per_char, text.count("!") * per_word, len(set(words)) * per_word,
        sum(len(w) > 12 for w in words) * per_word, len(lines) * per_word, (text.count(". ") + text.count(".\n")) * per_word,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


_has_word = re.compile(WORD).search
_capitals = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_digits = re.compile(r"[0-9]").findall
_punctuation = re.compile(r"[!-/:-@\[-`{-~]").findall


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and ``features`` (an array of doubles) of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(text) for text in batch.column("text").to_pylist()]
        counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "features"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


class Trees(NamedTuple):
    """Flat trees. Node k's children are 2k + 1 (value at most the threshold) and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of ``x``."""
        total = np.full(len(x), self.bias)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted complete trees of one depth by Newton steps on binned features.

    A node that can't be split well gets a split that sends every row left.
    """
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), bias)
    total = np.full(len(y), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node, bound = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
        for k in range(inner):
            low, high = bound[k]
            rows = np.flatnonzero(node == k)
            best, split, middle = 1e-6, None, None
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, sign in enumerate(signs):
                if len(rows) == 0 or len(cuts[f]) == 0:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                left, right = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = gl * left - 0.5 * (hl + ridge) * left**2 + gr * right - 0.5 * (hr + ridge) * right**2
                v = np.clip(gs / (hs + ridge), low, high)
                gain -= gs * v - 0.5 * (hs + ridge) * v**2
                gain[(hl * 4 < least) | (hr * 4 < least) | (sign * (right - left) < 0)] = -np.inf
                if len(gain) and gain.max() > best:
                    c = int(gain.argmax())
                    best, split, middle = gain[c], (f, c), sign * (left[c] + right[c]) / 2 if sign else None
            bound[2 * k + 1] = bound[2 * k + 2] = (low, high)
            if split is None:
                node[rows] = 2 * k + 1
                continue
            f, c = split
            out.feature[t, k], out.threshold[t, k] = f, cuts[f][c]
            node[rows] = 2 * k + 1 + (binned[rows, f] > c)
            if signs[f]:
                m = middle * signs[f]
                bound[2 * k + 1], bound[2 * k + 2] = ((low, m), (m, high)) if signs[f] > 0 else ((m, high), (low, m))
        for leaf in range(leaves):
            rows = np.flatnonzero(node == inner + leaf)
            low, high = bound[inner + leaf]
            out.value[t, leaf] = rate * np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high)
        total += out.value[t, node - inner]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees | None:
    """Trees from the statistics of a sample of labelled documents; None without both kinds."""
    sample = sampled_labels(labels, "quality", max_rows)
    rows = document_statistics(labelled_texts(docs, sample)).join(F.broadcast(sample), "doc_id")
    got = rows.select("doc_id", "features", "quality").orderBy("doc_id").toPandas()
    y = (got["quality"].to_numpy(float) > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return fit_trees(np.stack(got["features"].to_numpy()).astype(float), y, list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cutoff: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score for each document."""
    model = fit_quality(docs, labels, max_rows)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
        scores = model.score(x) if model else np.ones(len(x))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

    stats = document_statistics(docs)
    fields = ", ".join(f"{c} {t}" for c, t in stats.dtypes if c != "features")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    scored = map_batches(stats, score, f"{fields}, score double").withColumn("base_failed", failed)
    return scored.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("score") >= cutoff)).alias("kept"), "score")

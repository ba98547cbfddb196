"""The latent space of decontamination is learned from every window of every document."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import decontam


def dense_rows(texts, terms):
    """Counts of terms in every window of the texts, and how many half-windows have each term."""
    rows, df = [], np.zeros(len(terms))
    for text in texts:
        words = decontam.plain_words(text)
        for start in range(0, len(words), decontam.STRIDE):
            row = np.zeros(len(terms))
            for w in words[start : start + decontam.WINDOW]:
                if w in terms:
                    row[terms[w]] += 1
            rows.append(row)
            df[[terms[w] for w in set(words[start : start + decontam.STRIDE]) if w in terms]] += 1
    return np.array(rows), df


@pytest.mark.parametrize("most", [4096, 20])
def test_all_windows_make_the_space(spark, monkeypatch, most):
    """Long texts that change their topic: the space holds what all windows hold, as found with dense matrices."""
    monkeypatch.setattr(decontam, "CORPUS_ROWS", most, raising=False)
    rng = random.Random(31)
    topics = [[f"t{k}x{j}" for j in range(8)] for k in range(40)]
    texts = [" ".join(w for k in rng.sample(range(40), 30) for w in [*rng.choices(topics[k], k=40), "other", "words"]) for _ in range(3)] + [None, "", "none known"]
    items = [" ".join(rng.choice(t) for t in topics) for _ in range(3)] + [" ".join(w for t in topics for w in t)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index = decontam.build_index(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    terms = index.items.terms
    rows, df = dense_rows([t or "" for t in texts], terms)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    passages = np.array([np.bincount(own, minlength=len(terms)) for _, own in index.items.passages])
    gram = (passages * idf).T @ (passages * idf) + min(1, most / len(rows)) * (rows * idf).T @ (rows * idf)
    basis = index.folding[: len(terms)] / idf[:, None]
    assert np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-4
    best = np.sort(np.linalg.eigvalsh(gram))[::-1][: basis.shape[1]].sum()
    got = np.trace(basis.T @ gram @ basis)
    print("held by the space, of the most that can be", got / best)
    assert got >= 0.98 * best


def test_products_of_coded_windows(spark):
    """Products with all windows equal dense ones: texts of any length, terms in any order, a half without terms."""
    rng = random.Random(32)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words + ["x"] * 40, k=n)) for n in (0, 1, 23, 24, 25, 48, 49, 500)] + [" ".join(["x"] * 60 + words[:5]), None]
    items = decontam.Items([], {w.encode(): k for k, w in enumerate(words)}, [], [], [])
    rows, df = dense_rows([t or "" for t in texts], items.terms)
    windows = decontam.coded_windows(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), items)
    got, n = decontam.frequencies(windows, items)
    assert n == len(rows) and (got == df).all()
    idf, basis = np.arange(1.0, 61), np.random.default_rng(2).standard_normal((60, 7))
    total = np.zeros((60, 7))
    for r in decontam.window_products(windows, items, idf, 0.5, basis).collect():
        total[r["term"]] += r["product"]
    assert np.allclose(total, 0.5 * (rows * idf).T @ ((rows * idf) @ basis), rtol=1e-4, atol=1e-2 * np.abs(total).max() * 1e-2)


def test_pipeline_learns_from_windows_anywhere_in_long_texts(spark, tmp_path):
    """Paraphrases are near only if the space knows which words go together, and each topic's stand together in a few of many windows."""
    rng = random.Random(33)
    topics = [([f"a{k}x{j}" for j in range(16)], [f"b{k}x{j}" for j in range(32)]) for k in range(decontam.RANK)]

    def together(k):  # both items' words from last to first, so no long subsequence of either
        own, others = topics[k]
        return [w for j in range(15, -1, -1) for w in (others[2 * j + 1], others[2 * j], own[j])]

    def paraphrase(k):  # ten of an item's words in order, five others of its topic after each
        own, others = topics[k][0], topics[k][1][::-1] * 2
        return [w for j in range(10) for w in (own[j], *others[5 * j : 5 * j + 5])] + others[-14:-2]

    def text(leaked=None):
        order = rng.sample(range(len(topics)), len(topics))
        return " ".join(w for k in order for w in (paraphrase if k == leaked else together)(k))

    clean = [text(), text(), text(), text(), None, ""]
    docs = spark.createDataFrame(list(enumerate([*clean, *(text(k) for k in range(0, 64, 8))])), "doc_id long, text string").repartition(3)
    items = [" ".join(words) for topic in topics for words in topic]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()) == list(range(len(clean)))

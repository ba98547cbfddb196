"""Language identification with a linear-chain conditional random field over words.

The words of a text (what white space leaves, lower-cased; of each only its letters, and those without a
letter left out) are a chain of states, one state for each language that was learned. A word's score for
a language is the sum of the weights of its features: prefixes and suffixes of 1 to 3 characters,
character trigrams with the word's ends marked, and the word itself if it's in the lexicon of frequent
words. Transitions between languages are learned
too, so short foreign stretches in code-switched text are labelled by their context. Forward-backward
gives each word's probability of each language; a document's is the mean over its words.

Learning takes a sample of training documents, ``PER_LANG`` for each language at most and of each a
stretch of ``STRETCH`` consecutive words at a hashed place (both documented bounds). Stretches are
chained in hash order, so that chains switch languages as mixed text does. The likelihood is climbed
with all tokens at a time. The model is a table of weights for features seen ``MIN_COUNT`` times in
this sample, so its size is bounded by the sample's and it can be broadcast.

Prediction reads whole texts; a batch is worked off in parts of about ``PART_CHARS`` characters. Very long
chains are stepped in stretches of ``SPAN`` words side by side, each with a margin of its surroundings on both
sides that counts for nothing else. The margin follows from the learned transitions: a step brings any two states of
knowledge closer by a factor that the transitions alone bound (Birkhoff), whatever the words are, so what lies
beyond the margin changes no result by more than ``ROUNDING``. A null text, or one without a letter, is
``und`` with score 0; so is every text if nothing could be learned.
Repeated rows are labelled each. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, hash_below, map_batches, parts, sliced

PER_LANG = 400
STRETCH = 120
MIN_COUNT = 4
LEXICON_COUNT = 12
#: Stretches in one training chain.
CHAIN = 12
PART_CHARS = 2_500_000
SPAN = 2048
#: How far a result may be off because a chain is stepped in stretches.
ROUNDING = 1e-7
#: Most words whose scores a task remembers.
KNOWN_WORDS = 300_000
#: Words that are scored at a time.
CHUNK = 16_384
UNKNOWN = "und"

_others = re.compile(r"[\W\d_]+")


def letters_of(word: str) -> str:
    return word if word.isalpha() else _others.sub("", word)


def words_of(text: str | None) -> list[str]:
    return [w for own in (text or "").lower().split() if (w := letters_of(own))]


def features(word: str) -> list[str]:
    marked = f"^{word}$"
    ends = ["=" + word, "<" + word[:1], "<" + word[:2], "<" + word[:3], ">" + word[-1:], ">" + word[-2:], ">" + word[-3:]]
    return ends + [marked[k : k + 3] for k in range(len(word))]


class Crf(NamedTuple):
    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # from x to

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of language scores for each word."""
        table, out = np.concatenate([self.weights, np.zeros((1, len(self.langs)))]), []
        for at in range(0, len(words), CHUNK):
            flat, sizes = [], []
            for word in words[at : at + CHUNK]:  # an unknown feature counts as one more row, of zeros
                own = features(word)
                flat.extend(map(self.index.get, own, repeat(len(self.index))))
                sizes.append(len(own))
            out.append(spread(table, np.array(flat, np.int64), np.cumsum(sizes)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def spread(weights: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``weights`` that ``flat`` names, between the ``ends``."""
    total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[flat], axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, forward: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over chains that lie one after the other in ``scores``; none is empty.

    Chains are stepped together, longest first, so that at each step the ones still running are the
    first few rows. Every step is normalised, which leaves the marginals as they are. ``forward``, if
    given, is filled with the normalised forward values.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    running = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(p.dtype)
    out = np.empty_like(p)
    a = np.ones((len(lengths), p.shape[1]), p.dtype)
    for t, n in enumerate(running.tolist()):
        rows = starts[:n] + t
        a = (a[:n] @ step if t else a) * p[rows]
        a /= a.sum(axis=1, keepdims=True)
        out[rows] = a
    if forward is not None:
        forward[:] = out
    b = np.ones((len(lengths), p.shape[1]), p.dtype)
    for t in range(len(running) - 1, -1, -1):
        if t + 1 < len(running):
            n = running[t + 1]
            after = (p[starts[:n] + t + 1] * b[:n]) @ step.T
            b[:n] = after / after.sum(axis=1, keepdims=True)
        rows = starts[: running[t]] + t
        g = out[rows] * b[: running[t]]
        out[rows] = g / g.sum(axis=1, keepdims=True)
    return out


def fit_crf(stretches: list[tuple[str, list[str]]], rounds: int = 25, ridge: float = 1e-4) -> Crf | None:
    """A field from (language, words), chained in the order given; None if there are no words."""
    stretches = [(lang, words) for lang, words in stretches if words]
    if not stretches:
        return None
    langs = sorted({lang for lang, _ in stretches})
    types: dict[str, int] = {}
    tokens = np.array([types.setdefault(w, len(types)) for _, words in stretches for w in words], np.int64)
    labels = np.repeat([langs.index(lang) for lang, _ in stretches], [len(words) for _, words in stretches])
    lengths = np.array([sum(len(w) for _, w in stretches[k : k + CHAIN]) for k in range(0, len(stretches), CHAIN)])
    often = np.bincount(tokens)
    counts: Counter[str] = Counter()
    for word, k in types.items():
        counts.update(dict.fromkeys(features(word), int(often[k])))
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= (LEXICON_COUNT if f[0] == "=" else MIN_COUNT)))}
    flat, ends = [], []
    for word in types:
        flat += [index[f] for f in features(word) if f in index]
        ends.append(len(flat))
    flat, ends = np.array(flat, np.int64), np.array(ends, np.int64)
    owner = np.repeat(np.arange(len(types)), np.diff(ends, prepend=0))
    n = len(langs)
    weights, transitions = np.zeros((len(index), n)), np.zeros((n, n))
    speed_w, speed_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    inner = np.ones(len(tokens), bool)  # tokens with one before them in their chain
    inner[np.cumsum(lengths) - lengths] = False
    observed = np.zeros((n, n))
    np.add.at(observed, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    forward = np.empty((len(tokens), n))
    for _ in range(rounds):
        gamma = marginals(spread(weights, flat, ends)[tokens], lengths, transitions, forward)
        error = -gamma
        error[np.arange(len(labels)), labels] += 1
        by_type = np.stack([np.bincount(tokens, error[:, k], len(types)) for k in range(n)], axis=1)
        grad = np.stack([np.bincount(flat, by_type[owner, k], len(index)) for k in range(n)], axis=1) / len(tokens) - ridge * weights
        # A pair's probability: the next word's marginal, shared out over where the chain can have come from.
        step = np.exp(transitions)
        before, after = forward[:-1][inner[1:]], gamma[1:][inner[1:]]
        expected = step * (before.T @ (after / (before @ step)))
        grad_t = (observed - expected) / len(tokens) - ridge * transitions
        speed_w, speed_t = speed_w + grad**2, speed_t + grad_t**2
        weights += 0.5 * grad / np.sqrt(speed_w)
        transitions += 0.5 * grad_t / np.sqrt(speed_t)
    return Crf(langs, index, weights, transitions)


def training_stretches(docs: DataFrame, per_lang: int = PER_LANG, stretch: int = STRETCH) -> list[tuple[str, list[str]]]:
    """Stretches of the training fold, at most about ``per_lang`` for each language, in hash order."""
    usable = docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: max(1, r["ids"]) for r in usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).collect()}
    if not counts:
        return []
    # A share of the hash range somewhat larger than needed, so that few rows meet where the smallest are chosen.
    within = F.lit(False)
    for lang, n in counts.items():
        within = F.when(F.col("lang") == lang, hash_below(1.5 * per_lang / n, "doc_id")).otherwise(within)
    chosen = usable.where(within).groupBy("lang", "doc_id").agg(F.max("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            at = zlib.crc32(str(doc).encode()) % max(1, len(words) - stretch + 1)
            out.append(words[at : at + stretch])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "lang", "words"])

    cut_rows = map_batches(chosen.select("doc_id", "lang", "text"), cut, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, words array<string>")
    rows = cut_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang).collect()
    return [(r["lang"], r["words"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["words"]))]


class Scorer(dict):
    """Row in ``table`` of each word as it stands in a text; -1 if it has no letter. Scored a part at a time."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.new = model, []
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        if not (letters := letters_of(word)):
            self[word] = -1
        elif letters is word or letters not in self:
            self[word] = self[letters] = len(self.table) + len(self.new)
            self.new.append(letters)
        else:
            self[word] = self[letters]
        return self[word]

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the rows of its words; ``table`` has them afterwards."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.table = self.table[:0]
        found = [np.fromiter(map(self.__getitem__, own := (text or "").lower().split()), np.int32, len(own)) for text in texts]
        if self.new:
            self.table = np.concatenate([self.table, self.model.scores(self.new).astype(np.float32)])
            self.new = []
        return [own[own >= 0] for own in found]


def margin_of(transitions: np.ndarray, rounding: float = ROUNDING) -> int:
    """After how many words nothing before them changes a marginal by more than ``rounding``.

    In Hilbert's projective metric a step with the positive matrix exp(transitions) contracts by tanh(d / 4),
    d being the matrix's projective diameter; words only rescale states, which keeps the metric.
    """
    t = transitions
    diameter = float((t[:, None, :, None] + t[None, :, None, :] - t[:, None, None, :] - t[None, :, :, None]).max())
    shrink = np.tanh(diameter / 4)
    if shrink <= 0:
        return 1
    return 1 + int(np.ceil((np.log(rounding) - np.log(max(1.0, diameter))) / np.log(min(shrink, 1 - 1e-9))))


def chain_spans(words: int, margin: int) -> list[tuple[int, int, int, int]]:
    """(from, to) of the stretches that a chain is stepped in, and the part (from, to) of it that counts."""
    span = max(SPAN, 2 * margin)
    if words <= span + 2 * margin:
        return [(0, words, 0, words)]
    return [(max(0, s - margin), min(words, s + span + margin), s, min(words, s + span)) for s in range(0, words, span)]


def label_texts(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The most likely language of each text and its mean probability over the words."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    margin = margin_of(scorer.model.transitions)
    for first, last in parts(texts, PART_CHARS):
        chains, counts, words, own = [], [], [], []
        for k, rows in enumerate(scorer.rows(texts[first:last]), first):
            if len(rows):
                own.append(k)
                words.append(len(rows))
                for a, b, c, d in chain_spans(len(rows), margin):
                    chains.append(rows[a:b])
                    count = np.zeros(b - a, bool)
                    count[c - a : d - a] = True
                    counts.append(count)
        if own:
            gamma = marginals(scorer.table[np.concatenate(chains)], np.array([len(c) for c in chains]), scorer.model.transitions)[np.concatenate(counts)]
            n = np.array(words)
            mean = np.add.reduceat(gamma, np.cumsum(n) - n, axis=0, dtype=np.float64) / n[:, None]
            for k, best, value in zip(own, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                lang[k], score[k] = scorer.model.langs[best], min(1.0, value)
    return lang, score


def labelled(df: DataFrame, model: Crf | None, out: Callable[[pa.RecordBatch, list[str], list[float]], pa.RecordBatch], schema) -> DataFrame:
    """``out`` of each batch with the languages and scores of its ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in sliced(batches, PART_CHARS):
            texts = batch.column("text").to_pylist()
            yield out(batch, *(label_texts(scorer, texts) if scorer is not None else ([UNKNOWN] * len(texts), [0.0] * len(texts))))

    return df.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; one without an id isn't held out."""

    def out(batch: pa.RecordBatch, lang: list[str], score: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return labelled(rows, model or fit_crf(training_stretches(docs)), out, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, model: Crf | None = None) -> DataFrame:
    """The rows of ``docs`` with a language of at least that score, with all their columns as they are.

    At one half a language must be more likely than all others together: mixtures without a main language go, and so do
    null texts and those without a letter. Repeated rows are judged alike. If no language could be learned, all go. An
    empty table gives no rows.
    """

    def keep(batch: pa.RecordBatch, lang: list[str], score: list[float]) -> pa.RecordBatch:
        return batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return labelled(docs, model or fit_crf(training_stretches(docs)), keep, docs.schema)

"""Class-based bigram language model (Brown et al.) with classes from exchange clustering.

A text's probability is the product over its tokens of P(class | class before) P(token | class). Tokens
are its lower-cased (A-Z) words and one end. Everything is counted over all training documents:

* Word counts: each task adds up its words, Spark adds up the tasks. The table grows with the corpus
  and stays distributed. Words with at least one in ``HEAVY`` tokens (so ``HEAVY`` words at most) are
  broadcast if they occur ``LEAST_COUNT`` times; all others are looked up by a join that carries one row for each
  document and word; of those, words in many documents go by broadcast too.
* Classes: every broadcast word has a class of its own choice. All rarer words, seen or not, are one class more, as
  without a table nothing is known of them but that they are rare; and so is the end.
* Neighbours: how often which word stands before and after each clustered word is counted in all training
  documents and written to the shared folder. A frequent word's neighbours are dealt to several rows, the more the
  higher its rank, so no task has to take in all of them.
* Exchange: the most frequent words begin as a class each, all others without one. In each sweep every word of
  a share of the vocabulary finds the class that raises the likelihood of the class bigrams most, given all
  others where they are; these moves are made together. Where moves made together lower the likelihood they are taken
  back and the shares become smaller. It ends when a sweep gains less than ``LEAST_GAIN`` of the likelihood, or
  after ``SWEEPS``. Tasks do the work; what the driver holds is a class for each word and the class bigrams.
* P(class | before) is discounted towards the class frequencies; P(w | class) is (c(w) + 1) / (tokens of the class +
  its words), where the class of rare words has one word more: a share is left for the unseen.

Beside it stands the unigram score with add-one smoothing. Both take the same logarithms of
counts. Documents whose crc32(id) mod 7 is 2 are held out of all counts (a null id isn't held out).

A null text is empty and scores its end token. Repeated rows are counted and scored each. An empty table
gives no rows; with no training documents every token scores log10(1) in the unigram score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, parts, stored

FOLDS, HELD_OUT = 7, 2
#: Words with at least one in HEAVY of all training tokens are broadcast and clustered, if they occur so often.
HEAVY, LEAST_COUNT = 1 << 19, 3
#: Words in at least one of HEAVY_MISSES rows of those to be looked up by a join go by broadcast.
HEAVY_MISSES = 1 << 14
#: Classes, the one of rare words and the one of the end among them.
CLASSES = 64
SWEEPS, LEAST_GAIN = 12, 1e-3
DISCOUNT = 20.0
#: Rows of neighbours that the most frequent word is dealt to; the k-th has 1 / k of them.
BLOCKS = 4096
#: Most words, or pairs of words, that a task counts before it passes its counts on.
TALLY, PAIRS = 400_000, 2_000_000
PART_BYTES = 4_000_000
#: Words whose moves are worked out at a time.
AT_ONCE = 64


class Vocabulary(NamedTuple):
    words: list[bytes]  # heavy words, the most frequent first
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @property
    def rare(self) -> int:
        """The number that stands for all rarer words; the end has the next one."""
        return len(self.words)


class Model(NamedTuple):
    vocabulary: Vocabulary
    classes: np.ndarray  # of each word, the rare ones and the end
    log_moves: np.ndarray  # log10 P(class | class before)
    log_totals: np.ndarray  # log10 of each class's emission total; 0 for the end


_made: dict[str, dict[bytes, int]] = {}


def worker_lookup(shared) -> dict[bytes, int]:
    """The number of each word of a broadcast vocabulary, made once in a worker."""
    if shared.id not in _made:
        _made.clear()
        v = shared.value.vocabulary if isinstance(shared.value, Model) else shared.value
        _made[shared.id] = {w: k for k, w in enumerate(v.words)}
    return _made[shared.id]


class Shared:
    """A broadcast value with a number that workers know it by."""

    def __init__(self, df: DataFrame, value):
        self.broadcast = df.sparkSession.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def rows_of(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n of all training texts, written to the shared folder."""

    def out(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update((text or b"").lower().split())
                if len(seen) > TALLY:
                    yield out(seen)
                    seen.clear()
        if seen:
            yield out(seen)

    return stored(rows.where("not held_out").select("text").mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def heavy_words(counts: DataFrame, texts: int, heavy: int = HEAVY) -> Vocabulary:
    n, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    tokens = (n or 0) + texts
    found = counts.where((F.col("n") * heavy >= tokens) & (F.col("n") >= LEAST_COUNT)).toArrow()
    words, n = found.column("word").to_pylist(), found.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    return Vocabulary([words[k] for k in order], np.array([n[k] for k in order], np.int64), tokens, distinct + (texts > 0), texts)


def numbered(texts: list[bytes | None], lookup: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of the texts, the numbers of all tokens with each text's end, and the ends' places."""
    split = [(text or b"").lower().split() for text in texts]
    words = [w for own in split for w in own]
    sizes = np.array([len(own) for own in split], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    flat = np.full(len(words) + len(split), len(lookup) + 1, np.int64)
    inside = np.ones(len(flat), bool)
    inside[ends] = False
    flat[inside] = np.fromiter(map(lookup.get, words, repeat(len(lookup))), np.int64, len(words))
    return words, flat, ends


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def listed(groups: np.ndarray, others: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row (place, others, counts) for each of the ordered ``groups``."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(groups)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (others.astype(np.int32), counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(groups[first]), *lists], ["place", "others", "counts"])


def neighbours(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Right and left neighbours of each word in all training texts: place, others, counts.

    A place is (word * 2 + side) * BLOCKS + block, side 0 being right. Rare words and ends are neighbours of
    words; of their own they have only rare words and ends to the right.
    """
    shared, width = Shared(rows, vocabulary), vocabulary.rare + 2

    def pair_rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = keys // width, keys % width
        for side, (word, other) in enumerate(((a, b), (b, a))):
            own = (word < width - 2) | ((other >= width - 2) & (side == 0))
            word, other, n = word[own], other[own], counts[own]
            place = (word * 2 + side) * BLOCKS + other % np.maximum(1, BLOCKS // (word + 1))
            order = np.argsort(place * width + other)
            yield listed(place[order], other[order], n[order])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, keys, counts = worker_lookup(shared), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in parts(texts, PART_BYTES):
                flat = numbered(texts[first:last], lookup)[1]
                own = np.concatenate([[width - 1], flat[:-1]]) * width + flat  # each text begins after an end
                keys, counts = summed(np.concatenate([keys, own]), np.concatenate([counts, np.ones(len(own), np.int64)]))
                if len(keys) > PAIRS:
                    yield from pair_rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from pair_rows(keys, counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            places, others = batch.column("place").to_numpy(), batch.column("others")
            own = np.repeat(places, others.value_lengths().to_numpy()) * width + others.flatten().to_numpy()
            keys, counts = summed(np.concatenate([keys, own]), np.concatenate([counts, batch.column("counts").flatten().to_numpy()]))
            done = int(np.searchsorted(keys, places[-1] * width))  # the last place may go on in the next batch
            yield listed(keys[:done] // width, keys[:done] % width, counts[:done])
            keys, counts = keys[done:], counts[done:]
        yield listed(keys // width, keys % width, counts)

    schema = "place long, others array<int>, counts array<long>"
    tallied = rows.where("not held_out").select("text").mapInArrow(tally, schema)
    return stored(tallied.repartition("place").sortWithinPartitions("place").mapInArrow(merge, schema))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    return float(xlogx(n).sum() - 2 * xlogx(n.sum(axis=0)).sum())


def best_classes(n: np.ndarray, of: np.ndarray, right: np.ndarray, left: np.ndarray, self_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the class that raises the likelihood of the class bigrams ``n`` most, and by how much over its own.

    ``of`` has the words' classes, ``right`` and ``left`` their neighbours by class and ``self_`` how often they follow
    themselves. The last two classes, of rare words and of the end, take no word in.
    """
    at, size = np.arange(len(of)), n.sum(axis=0)
    own = right.sum(axis=1)
    right, left = right.copy(), left.copy()
    right[at, of] -= self_
    left[at, of] -= self_
    rest = np.repeat(n[None], len(of), axis=0)  # the bigrams without each word
    rest[at, of] -= right
    rest[at, :, of] -= left
    rest[at, of, of] -= self_
    sizes = np.repeat(size[None], len(of), axis=0)
    sizes[at, of] -= own
    base = xlogx(rest)
    rows, columns = xlogx(rest + right[:, None, :]) - base, xlogx(rest + left[:, :, None]) - base
    diagonal = np.einsum("kii->ki", rest)
    gain = rows.sum(axis=2) - np.einsum("kii->ki", rows) + columns.sum(axis=1) - np.einsum("kii->ki", columns)
    gain += xlogx(diagonal + right + left + self_[:, None]) - xlogx(diagonal) - 2 * (xlogx(sizes + own[:, None]) - xlogx(sizes))
    best = gain[:, :-2].argmax(axis=1)
    return best, gain[at, best] - gain[at, of]


def class_profiles(lists: DataFrame, of: np.ndarray) -> DataFrame:
    """word, right and left (neighbours by class) and self of each word, written to the shared folder."""
    shared, classes = lists.sparkSession.sparkContext.broadcast(of), int(of[-1]) + 1

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, others, n = batch.column("place").to_numpy(), batch.column("others"), batch.column("counts").flatten().to_numpy()
        word, row = np.unique(place // (2 * BLOCKS), return_inverse=True)  # a frequent word has many rows in a batch
        long = others.value_lengths().to_numpy()
        row, side, other, width = np.repeat(row, long), np.repeat(place // BLOCKS % 2, long), others.flatten().to_numpy(), 2 * classes + 1
        cells = np.bincount(row * width + side * classes + shared.value[other], n, len(word) * width).reshape(-1, width)
        own = (other == word[row]) & (side == 0)
        cells[:, -1] = np.bincount(row[own], n[own], len(word))
        return profile_rows(word, cells)

    def profile_rows(word: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(word) + 1, dtype=np.int32) * cells.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(word), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], ["word", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros((0, 2 * classes + 1)))
        for batch in batches:
            if batch.num_rows:
                word, cells = np.concatenate([held[0], batch.column("word").to_numpy()]), np.concatenate([held[1], cells_of(batch)])
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                word, cells = word[first], np.add.reduceat(cells, first)
                held = (word[-1:], cells[-1:])
                yield profile_rows(word[:-1], cells[:-1])
        yield profile_rows(*held)

    schema = "word long, cells array<double>"
    return stored(map_batches(lists, count, schema).repartition("word").sortWithinPartitions("word").mapInArrow(merge, schema))


def cells_of(batch: pa.RecordBatch) -> np.ndarray:
    """The right neighbours, left neighbours and self of each word, side by side."""
    return batch.column("cells").flatten().to_numpy().reshape(batch.num_rows, -1)


def class_bigrams(profiles: DataFrame, of: np.ndarray) -> np.ndarray:
    """Counts of (class, next class)."""
    shared, c = profiles.sparkSession.sparkContext.broadcast(of), int(of[-1]) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((c, c))
        for batch in batches:
            if batch.num_rows:
                own, cells = shared.value[batch.column("word").to_numpy()], cells_of(batch)
                np.add.at(n, own, cells[:, :c])
                np.add.at(n.T, own, np.where(np.arange(c) >= c - 2, cells[:, c : 2 * c], 0))  # rare words and ends before words
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n.ravel()[some])], ["cell", "n"])

    found = profiles.mapInArrow(add, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(c * c)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(c, c)


def class_moves(profiles: DataFrame, of: np.ndarray, n: np.ndarray, step: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of this step's share that gain by a move, and their new classes. Words without a class are in every share."""
    shared, c = profiles.sparkSession.sparkContext.broadcast((of, n)), len(n)

    def moves(batch: pa.RecordBatch) -> pa.RecordBatch:
        of_, n_ = shared.value
        word, cells = batch.column("word").to_numpy(), cells_of(batch)
        own = (word < len(of_) - 2) & (((word + step) % share == 0) | (of_[word] == c - 2))
        word, cells, best = word[own], cells[own], np.zeros(int(own.sum()), np.int64)
        for at in range(0, len(word), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            to, gain = best_classes(n_, of_[word[part]], cells[part, :c], cells[part, c : 2 * c], cells[part, 2 * c])
            best[part] = np.where((gain > 1e-9) | (of_[word[part]] == c - 2), to, of_[word[part]])
        moved = best != of_[word]
        return pa.RecordBatch.from_arrays([pa.array(word[moved]), pa.array(best[moved])], ["word", "to"])

    found = map_batches(profiles, moves, "word long, to long").toArrow()
    return found.column("word").to_numpy(), found.column("to").to_numpy()


def exchange(lists: DataFrame, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each of the ``words``, the rare ones and the end, and the class bigrams."""
    of = np.full(words + 2, classes - 2, np.int64)
    of[: classes - 2] = np.arange(len(of[: classes - 2])) % (classes - 2)
    of[words:] = classes - 2, classes - 1
    profiles = class_profiles(lists, of)
    n, share = class_bigrams(profiles, of), 2
    for step in range(sweeps):
        word, to = class_moves(profiles, of, n, step, share)
        if not len(word):
            break
        new = of.copy()
        new[word] = to
        new_profiles = class_profiles(lists, new)
        new_n = class_bigrams(new_profiles, new)
        gained = likelihood(new_n) - likelihood(n)
        if step and gained < 0:
            share *= 2
            continue
        of, n, profiles = new, new_n, new_profiles
        if step and gained < LEAST_GAIN * abs(likelihood(n)):
            break
    return of, n


def fit(rows: DataFrame, counts: DataFrame) -> Model:
    vocabulary = heavy_words(counts, rows.where("not held_out").count())
    of, n = exchange(neighbours(rows, vocabulary), vocabulary.rare)
    share = (n.sum(axis=0) + 1) / (n.sum() + CLASSES)
    moves = (n + DISCOUNT * share) / (n.sum(axis=1, keepdims=True) + DISCOUNT)
    words = np.bincount(of[:-2], minlength=CLASSES)
    words[CLASSES - 2] = max(0, vocabulary.distinct - (vocabulary.texts > 0) - vocabulary.rare) + 1  # the unseen beside the rare
    totals = n.sum(axis=0) + words
    totals[CLASSES - 1] = 1
    return Model(vocabulary, of, np.log10(moves), np.log10(np.maximum(totals, 1)))


def counted_misses(tail: DataFrame, counts: DataFrame, heavy: int = HEAVY_MISSES) -> DataFrame:
    """``tail`` (row, word, k: a row for each document and word) with the word's training count ``n``, null if it has none.

    A word may be rare in training and yet stand in a third of the other documents. Words with at least one in ``heavy`` of the
    tail's rows (so ``heavy`` words at most) are looked up by broadcast; no other word has enough rows to fill a task.
    """
    spread = tail.groupBy("word").agg(F.count("*").alias("rows"))
    total = tail.count()
    frequent = stored(spread.where(F.col("rows") * heavy >= F.lit(total)).where("rows > 1").join(counts, "word", "left").select("word", "n"))
    by_broadcast = tail.join(F.broadcast(frequent), "word")
    others = tail.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(counts, "word", "left")
    return by_broadcast.select("row", "k", "n").unionByName(others.select("row", "k", "n"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of a token) for each document."""
    rows = rows_of(docs)
    counts = word_counts(rows)
    model = fit(rows, counts)
    shared, v = Shared(rows, model), model.vocabulary

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup, m = worker_lookup(shared), shared.value
        rare_, end_ = m.vocabulary.rare, m.vocabulary.rare + 1
        logs = np.concatenate([np.log10(m.vocabulary.counts + 1.0), [0.0, 0.0]])
        texts = batch.column("text").to_pylist()
        columns: list[list] = [[] for _ in range(4)]
        rare: Counter[tuple[int, bytes]] = Counter()  # by text and word
        for a, b in parts(texts, PART_BYTES):
            words, flat, ends = numbered(texts[a:b], lookup)
            starts = np.concatenate([[0], ends[:-1] + 1])
            c = m.classes[flat]
            before = np.concatenate([m.classes[[end_]], c[:-1]])
            for column, x in zip(columns, (np.ones(len(flat), np.int64), flat < rare_, logs[flat], m.log_moves[before, c] - m.log_totals[c]), strict=True):
                column.append(np.add.reduceat(x, starts, dtype=np.float64))
            place = np.flatnonzero(flat == rare_)
            text = np.searchsorted(ends, place)
            rare.update(zip((a + text).tolist(), [words[k] for k in (place - text).tolist()], strict=True))
        n, known, value, moves = (np.concatenate(x) if x else np.zeros(0) for x in columns)
        tail = np.bincount(np.fromiter((t for t, _ in rare), np.int64, len(rare)), minlength=len(texts))  # texts come in order
        offsets = np.concatenate([[0], np.cumsum(tail)]).astype(np.int32)
        misses = pa.StructArray.from_arrays([pa.array([w for _, w in rare], pa.binary()), pa.array(list(rare.values()), pa.int64())], ["word", "k"])
        arrays = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(value), pa.array(moves), pa.ListArray.from_arrays(pa.array(offsets), misses)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", "held_out")), *arrays], ["row", "doc_id", "held_out", "n_tokens", "known", "value", "moves", "rare"])

    kind = dict(docs.dtypes)["doc_id"]
    by_row = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    first = stored(map_batches(by_row, run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, value double, moves double, rare array<struct<word binary, k long>>"))
    found = counted_misses(first.select("row", F.explode("rare").alias("m")).select("row", "m.word", "m.k"), counts)
    looked_up = found.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("rare_known"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_value"))
    value = F.col("value") + F.coalesce("rare_value", F.lit(0.0))
    end = float(np.log10(v.texts + 1.0))
    return first.join(looked_up, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(v.texts > 0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (value + end - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1.0))).alias("base_score"),
        (value + F.col("moves")).alias("score"),
        F.pow(F.lit(10.0), -(value + F.col("moves")) / F.col("n_tokens")).alias("perplexity"),
    )

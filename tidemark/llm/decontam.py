"""Benchmark decontamination by latent semantic retrieval, then exact checks.

1. Passages. Benchmark items are cut into passages of ``WINDOW`` words at most, document texts into
   half-windows of ``STRIDE`` words; two neighbouring halves are a window. Words are lower-cased
   and lose ASCII punctuation.
2. TF-IDF. The terms are the words of the benchmark. The texts are read once for the index: the terms of each half-window
   are written as numbers, and what follows reads these. How many half-windows of all documents have a term
   is counted map-side and summed. The inverse frequency is smooth and never below 1, so no term loses its weight.
3. A randomised SVD (range finder with power rounds; each product with the matrix is a job over its rows whose
   sparse partial sums Spark adds up by term) gives the latent space, of ``RANK`` dimensions. The matrix's rows are
   the TF-IDF passages and, so that terms come together that go together in the corpus, every window of every document.
   The windows together weigh as much as ``CORPUS_ROWS`` passages, if they are more, so the passages keep their part in the space
   however many documents there are. Document windows fold in linearly, so a window is the sum of its words.
4. Candidate search. Passages are dealt to cells around centres in the latent space (about the root of their number), and a
   window is compared with the passages of the ``PROBED`` share of cells whose centres are nearest to it: latent cosine, ``COSINE`` at
   least. Of these pairs those go on in which enough of the passage's words stand around the window for the check to accept it
   (bit sets of words, all pairs at once). So no product of all windows with all passages is formed; recall is measured against brute force.
5. Verbatim text needs no latent search and doesn't depend on its recall: a common subsequence of ``VERBATIM`` of a passage
   needs so many of its rarest words (its *core*, ``CORE`` of its words) around the window even if all others are there, and an
   inverted table of cores gives all such pairs. A word counts once around a window. Items of fewer than ``MIN_WORDS``
   words are looked up as word n-grams of their length.
6. Checks. Of each candidate the longest common subsequence of the passage and the window with its
   surroundings is taken, and that of the item's answer (its last sentence; of a long one the end). A document leaks an
   item if the subsequence covers ``VERBATIM`` of the passage, or, near it in the latent space, ``PARAPHRASE`` of it and ``ANSWER`` of the
   answer. Items of fewer than ``MIN_WORDS`` words are too short for subsequences: they leak where all their words stand in a row.

The benchmark is worked off in blocks of about ``BLOCK_WORDS`` words of whole items, so the broadcast tables (terms and
passage vectors) are bounded for any benchmark of items that fit a block; each block is one more pass over the documents.

Null texts or items leak nothing, nor do items without a word. Repeated rows are reported each, with one row for each
item id; rows of one item id are texts of one item. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import discard

from .common import map_batches, parts, sliced, stored

WINDOW, STRIDE = 48, 24
MIN_WORDS = 8
RANK, OVERSAMPLE, POWER_ROUNDS = 64, 16, 2
#: Share of a passage's words that verbatim candidates are found by, more than 1 - VERBATIM; it changes the time taken, not what is found.
CORE = 0.3
#: Least latent cosine of a candidate, and the share of cells that are compared with a window.
COSINE, PROBED = 0.45, 0.5
#: Words are told apart by so many bits where overlaps are counted; equal bits only let more pairs on to the checks.
BITS = 2048
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.5
BLOCK_WORDS = 400_000
#: All windows of the documents weigh as much as so many passages at most where the space is learned.
CORPUS_ROWS = 4096
#: Windows whose candidates are found at once, and half-windows that are added up at once.
AT_ONCE, SUMMED = 4096, 2048
#: Bytes of coded windows whose products are held at once.
SLICE = 1 << 18
PART_CHARS = 1_500_000

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(None, _PUNCTUATION).split()


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """The words in stretches of ``WINDOW`` at most, by ``STRIDE``; the last ends with the words."""
    if len(words) <= WINDOW:
        return [words]
    starts = [*range(0, len(words) - WINDOW, STRIDE), len(words) - WINDOW]
    return [words[s : s + WINDOW] for s in starts]


def answer_of(text: str) -> list[bytes]:
    """The last sentence of an item, of four words at least if it has them."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text) if (w := plain_words(s))]
    answer: list[bytes] = []
    while sentences and len(answer) < 4:
        answer = sentences.pop() + answer
    return answer[-WINDOW:]


class Items(NamedTuple):
    """One block of the benchmark: ``passages`` as (item's place, term ids), and each item's answer."""

    ids: list
    terms: dict[bytes, int]
    passages: list[tuple[int, list[int]]]
    answers: list[list[int]]
    same: list[int]  # the first place with the same id


class Index(NamedTuple):
    items: Items
    folding: np.ndarray  # terms x rank, with idf
    vectors: np.ndarray  # passages x rank, of length one
    centres: np.ndarray  # cells x rank
    members: list[np.ndarray]  # the passages of each cell
    bits: np.ndarray  # passages x WINDOW: the bit of each word, BITS where there is none
    sets: np.ndarray  # passages x BITS / 64: the same bits, each once
    first: np.ndarray  # of each term, its first place in the next two; one more at the end
    passage: np.ndarray  # the passages that have the term in their core
    times: np.ndarray  # and how often
    needed: np.ndarray  # of each passage, how many words of its core a verbatim match has at least
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # by length, the hashes of short items in order, and their passages


def collect_items(block: DataFrame) -> Items:
    rows = block.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct().collect()
    terms: dict[bytes, int] = {}
    out, places_ = Items([], terms, [], [], []), {}
    for row in sorted(rows, key=lambda r: (str(r["item_id"]), r["text"])):
        text = row["text"]
        words = plain_words(text)
        if words:
            for own in passages_of(words):
                out.passages.append((len(out.ids), [terms.setdefault(w, len(terms)) for w in own]))
            out.answers.append([terms[w] for w in answer_of(text)])
            out.same.append(places_.setdefault(row["item_id"], len(out.ids)))
            out.ids.append(row["item_id"])
    return out


def term_places(texts: list[str | None], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term id of each word (-1: none) of the texts, one after the other, and each text's number of words."""
    ids, sizes = [], []
    for text in texts:
        own = plain_words(text)
        ids.append(np.fromiter(map(terms.get, own, repeat(-1)), np.int32, len(own)))
        sizes.append(len(own))
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(sizes, np.int64)


def halves(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half-window that each word is in, counted through, and each text's first half-window."""
    counts = -(-sizes // STRIDE)
    first = np.cumsum(counts) - counts
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) + inside // STRIDE, first


def blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``values`` as one binary value each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def coded_windows(texts: DataFrame, items: Items) -> DataFrame:
    """For each text the ids of its words that are terms, and how many of them each half-window has, as bytes of numbers."""
    shared = texts.sparkSession.sparkContext.broadcast(items.terms)
    code = term_code(items)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = term_places(batch.column("text").to_pylist(), shared.value)
        half, _ = halves(sizes)
        known, n_halves = ids >= 0, -(-sizes // STRIDE)
        counts = np.bincount(half[known], minlength=int(n_halves.sum())).astype(np.uint8)
        own = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
        return pa.RecordBatch.from_arrays([blobs(ids[known].astype(code), own), blobs(counts, n_halves)], ["terms", "counts"])

    return map_batches(texts.where("text is not null"), cut, "terms binary, counts binary")


def term_code(items: Items) -> np.dtype:
    return np.dtype(np.uint16 if len(items.terms) <= 1 << 16 else np.uint32)


def read_windows(batch: pa.RecordBatch, code: np.dtype) -> tuple[Windows, np.ndarray]:
    """The half-windows of texts with the words that are terms only, and how many each has."""
    terms, counts = batch.column("terms").to_pylist(), batch.column("counts").to_pylist()
    many = np.array([len(c) for c in counts], np.int64)
    of_half = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) // code.itemsize for t in terms], np.int64)
    half = np.repeat(np.arange(len(of_half)), of_half)
    return Windows(np.frombuffer(b"".join(terms), code), sizes, half, np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)), of_half


def frequencies(windows: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How many half-windows of all texts have each term, and how many there are; ``windows`` are those of ``coded_windows``."""
    n, code = len(items.terms), term_code(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n + 1, np.int64)  # the last is the number of half-windows
        for batch in sliced(batches):
            own, of_half = read_windows(batch, code)
            order = np.argsort(own.ids, kind="stable")  # by term, then by half-window
            term, half = own.ids[order], own.half[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (half[1:] != half[:-1])
            seen[:n] += np.bincount(term[new], minlength=n)
            seen[n] += len(of_half)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["term", "n"])

    total = np.zeros(n + 1, np.int64)
    for row in windows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row["term"]] = row["n"]
    return total[:n], int(total[n])


def stretch_sums(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the ``rows`` of ``table`` in consecutive stretches of these sizes; one place of all long enough stretches at a time."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max(initial=0))
    longer = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # how many have more than so many
    total, out = np.zeros((2, len(sizes), table.shape[1]), table.dtype)
    for k, m in enumerate(longer.tolist()):
        total[:m] += table.take(rows[first[:m] + k], axis=0)
    out[order] = total
    return out


def half_sums(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``table`` with these ids in half-windows of these sizes, some half-windows at a time."""
    end = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    for a in range(0, len(sizes), SUMMED):
        b = min(a + SUMMED, len(sizes))
        out[a:b] = stretch_sums(table, ids[end[a] : end[b]], sizes[a:b])
    return out


def add_windows(own: Windows, of_half: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """Adds the windows' products with ``basis`` to each of their terms in ``total``."""
    end = np.concatenate([[0], np.cumsum(of_half)])
    vectors = half_sums(basis, own.ids, of_half)
    vectors += own.moved(vectors, 1)  # of the window that begins in a half
    vectors += own.moved(vectors, -1)  # of both windows that a half is in
    order = np.argsort(own.ids, kind="stable")
    term, half = own.ids[order], own.half[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
    many = np.diff(np.append(first, len(term)))
    # A term's places are cut into short stretches, and the sums of these are added up.
    pieces = -(-many // STRIDE)
    sizes = np.full(int(pieces.sum()), STRIDE)
    sizes[np.cumsum(pieces) - 1] = many - (pieces - 1) * STRIDE
    sums = half_sums(vectors, half, sizes)
    total[term[first]] += stretch_sums(sums, np.arange(len(sums)), pieces)


def window_products(windows: DataFrame, items: Items, idf: np.ndarray, weight: float, basis: np.ndarray) -> DataFrame:
    """(term, product) of the TF-IDF rows of all windows: their matrix's transpose by the matrix by ``basis``, each row with this weight."""
    shared = windows.sparkSession.sparkContext.broadcast((idf, (basis * idf[:, None]).astype(np.float32)))
    code = term_code(items)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf_, scaled = shared.value
        total = np.zeros(scaled.shape)
        for batch in sliced(batches, SLICE):
            add_windows(*read_windows(batch, code), scaled, total)
        total *= weight * idf_[:, None]
        some = np.flatnonzero(total.any(axis=1))
        products = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), products], ["term", "product"])

    return windows.mapInArrow(add, "term long, product array<double>")


def weights(df: np.ndarray, halves_: int) -> np.ndarray:
    return np.log((1 + halves_) / (1 + df)) + 1


def randomised_svd(rows: DataFrame, terms: int, rank: int = RANK, seed: int = 7, more: Callable[[np.ndarray], DataFrame] | None = None) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the sparse ``rows`` (terms array<int>, values array<double>).

    Each round multiplies by the matrix and its transpose in one job: a row's product with the current
    basis is formed where the row lies and added to its terms. ``more`` gives the products (term, product) of further rows.
    """
    rank = max(1, min(rank, terms))
    width = min(terms, rank + OVERSAMPLE)

    def gram(basis: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for own, values in zip(batch.column("terms").to_pylist(), batch.column("values").to_pylist(), strict=True):
                    v = np.array(values)
                    product = v @ shared.value[own]
                    for term, value in zip(own, values, strict=True):
                        total[term] = total.get(term, 0) + value * product
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["term", "product"])

        products = rows.mapInArrow(add, "term long, product array<double>")
        partial = (products.union(more(basis)) if more else products).select("term", F.posexplode("product").alias("k", "x"))
        out = np.zeros_like(basis)
        found = partial.groupBy("term", "k").agg(F.sum("x").alias("x")).toArrow()
        out[found.column("term").to_numpy(), found.column("k").to_numpy()] = found.column("x").to_numpy()
        return out

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(gram(basis))[0]
    # The small matrix of A'A in the basis has the same leading eigenvectors as the SVD of A has right ones.
    values, inner = np.linalg.eigh(basis.T @ gram(basis))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(1e-30, values.max())]
    return basis @ inner[:, keep]


def least_words(size: int) -> int:
    """The shortest common subsequence that is ``PARAPHRASE`` of a passage of ``size`` words."""
    return math.ceil(PARAPHRASE * size - 1e-9)


def cores(items: Items, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first``, ``passage``, ``times`` and ``needed`` of an index: the rarest terms of each passage that isn't short."""
    terms, passages, times, needed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for p, (_, own) in enumerate(items.passages):
        if len(own) < MIN_WORDS:
            needed.append(0)
            continue
        term, n = np.unique(own, return_counts=True)
        order = np.lexsort((term, df[term]))
        upto = np.cumsum(n[order])
        k = int(np.searchsorted(upto, CORE * len(own))) + 1
        terms.append(term[order[:k]])
        times.append(n[order[:k]])
        passages.append(np.full(len(terms[-1]), p))
        needed.append(math.ceil(VERBATIM * len(own) - 1e-9) - (len(own) - int(upto[len(terms[-1]) - 1])))
    term = np.concatenate(terms)
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(items.terms) + 1))
    return first, np.concatenate(passages)[order], np.concatenate(times)[order], np.array(needed)


def bit_sets(bits: np.ndarray) -> np.ndarray:
    there = np.zeros((len(bits), BITS + 1), bool)
    there[np.arange(len(bits))[:, None], bits] = True
    return np.packbits(there[:, :BITS], axis=1, bitorder="little").view(np.uint64)


def latent_cells(vectors: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres by k-means on the sphere, about the root of the passages' number, and the passages of each."""
    n = max(1, round(len(vectors) ** 0.5))
    centres = vectors[np.random.default_rng(5).permutation(len(vectors))[:n]].copy()
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(1)
        for c in range(n):
            own = vectors[nearest == c].sum(0)
            if (length := np.linalg.norm(own)) > 1e-9:
                centres[c] = own / length
    nearest = (vectors @ centres.T).argmax(1)
    return centres, [np.flatnonzero(nearest == c) for c in range(n)]


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[k : len(ids) - size + 1 + k] + 2).astype(np.uint64)
    return out


def short_grams(items: Items) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, list[tuple[int, int]]] = {}
    for p, (_, own) in enumerate(items.passages):
        if len(own) < MIN_WORDS:
            found.setdefault(len(own), []).append((int(gram_hashes(np.array(own), len(own))[0]), p))
    return {m: (np.array([h for h, _ in sorted(own)], np.uint64), np.array([p for _, p in sorted(own)])) for m, own in found.items()}


def build_index(texts: DataFrame, block: DataFrame) -> Index | None:
    items = collect_items(block)
    if not items.passages:
        return None
    windows = stored(coded_windows(texts, items))
    df, n_halves = frequencies(windows, items)
    idf = weights(df, n_halves)
    sparse = []
    for _, own in items.passages:
        term, n = np.unique(own, return_counts=True)
        sparse.append((term.tolist(), (n * idf[term]).tolist()))
    rows = texts.sparkSession.createDataFrame(sparse, "terms array<int>, values array<double>")
    weight = min(1.0, CORPUS_ROWS / max(1, n_halves))
    basis = randomised_svd(rows, len(items.terms), more=lambda basis: window_products(windows, items, idf, weight, basis))
    discard(windows)
    folding = (basis * idf[:, None]).astype(np.float32)
    vectors = np.stack([folding[own].sum(axis=0) for _, own in items.passages])
    lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    vectors = (vectors / lengths[:, None]).astype(np.float32)
    bits = np.full((len(vectors), WINDOW), BITS)
    for p, (_, own) in enumerate(items.passages):
        bits[p, : len(own)] = np.array(own) % BITS
    return Index(items, folding, vectors, *latent_cells(vectors), bits, bit_sets(bits), *cores(items, df), short_grams(items))


def places(words: list[int]) -> dict[int, int]:
    """For each word a number with a bit for each of its places."""
    masks: dict[int, int] = {}
    for k, x in enumerate(words):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


def common_subsequence(masks: dict[int, int], size: int, words: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence of ``words`` and the ``size`` words that ``masks`` has the places of.

    A row of the table is the bits of one number. If too few words are shared for a length of ``least``, 0.
    """
    shared = [m for x in words if (m := masks.get(x)) is not None]
    if len(shared) < least:
        return 0
    row = full = (1 << size) - 1
    for m in shared:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def in_a_row(words: list[int], own: list[int]) -> bool:
    """Whether ``own`` stands in ``words`` without a gap."""
    return any(words[k : k + len(own)] == own for k, x in enumerate(words) if x == own[0])


class Windows(NamedTuple):
    """The half-windows of several texts, each with the window that begins there."""

    ids: np.ndarray
    sizes: np.ndarray
    half: np.ndarray  # of each word
    first: np.ndarray  # of each text
    text: np.ndarray  # of each half-window

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray) -> Windows:
        half, first = halves(sizes)
        return cls(ids, sizes, half, first, np.repeat(np.arange(len(sizes)), -(-sizes // STRIDE)))

    def moved(self, values: np.ndarray, by: int) -> np.ndarray:
        """For each half the values of the half ``by`` later (or earlier), zeros where that isn't of the same text."""
        out, n = np.zeros_like(values), len(self.text)
        if abs(by) < n:
            here, there = (slice(0, n - by), slice(by, n)) if by >= 0 else (slice(-by, n), slice(0, n + by))
            same = self.text[here] == self.text[there]
            out[here] = values[there]
            out[here][~same] = 0
        return out


#: Half-windows before and after a window's first that it, and a passage's length around it, can lie in.
REACH = range(-(-(-WINDOW // STRIDE)), 2 * -(-WINDOW // STRIDE))


def latent_vectors(own: Windows, index: Index) -> np.ndarray:
    """The windows' vectors, of length one (zero where no word is known)."""
    known = own.ids >= 0
    vectors = half_sums(index.folding, own.ids[known], np.bincount(own.half[known], minlength=len(own.text)))
    windows = vectors + own.moved(vectors, 1)
    return windows / np.maximum(np.linalg.norm(windows, axis=1), 1e-9)[:, None]


def words_around(own: Windows) -> np.ndarray:
    """For each window a set of bits, packed, of the known words in its reach; the last bit is never set."""
    n = len(own.text)
    there = np.zeros((n, BITS + 8), bool)
    known = own.ids >= 0
    there[own.half[known], own.ids[known] % BITS] = True
    packed = np.packbits(there, axis=1, bitorder="little")
    around = packed.copy()
    for by in REACH:
        around |= own.moved(packed, by)
    return around


def latent_pairs(vectors: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) of all pairs with a latent cosine of ``COSINE`` in the cells probed."""
    cells = len(index.centres)
    probed = max(1, math.ceil(PROBED * cells)) if cells > 4 else cells
    near = vectors @ index.centres.T
    chosen = np.zeros(near.shape, bool)
    np.put_along_axis(chosen, np.argpartition(-near, probed - 1, axis=1)[:, :probed], True, axis=1)
    windows, passages = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c, members in enumerate(index.members):
        rows = np.flatnonzero(chosen[:, c])
        if len(rows) and len(members):
            i, k = np.nonzero(vectors[rows] @ index.vectors[members].T >= COSINE)
            windows.append(rows[i])
            passages.append(members[k])
    return np.concatenate(windows), np.concatenate(passages)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits each row of ``a`` and that of ``b``, of ``WINDOW`` bits at most, have in common."""
    counts = np.bitwise_count(a & b).view(np.uint64).sum(1)  # eight sums of a byte each; all together they fit a byte
    return (counts * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


def overlapping(around: np.ndarray, windows: np.ndarray, passages: np.ndarray, index: Index) -> np.ndarray:
    """Which pairs have so many of the passage's words around the window that ``PARAPHRASE`` of it may stand there."""
    keep = np.zeros(len(windows), bool)
    size = (index.bits < BITS).sum(1)
    least = np.ceil(PARAPHRASE * size - 1e-9)
    # Of the different bits at least so many are met; repeated ones are counted for those pairs only.
    enough = least - (size - np.bitwise_count(index.sets).sum(1, dtype=np.int64))
    sets = np.ascontiguousarray(around[:, : BITS // 8]).view(np.uint64)
    for at in range(0, len(windows), 1 << 11):
        w, p = windows[at : at + (1 << 11)], passages[at : at + (1 << 11)]
        met = common_bits(sets[w], index.sets[p])
        some = np.flatnonzero((met >= enough[p]) & (size[p] >= MIN_WORDS))
        w, p = w[some], p[some]
        bits = index.bits[p]
        met = (around[w[:, None], bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        keep[at + some] = met.sum(1) >= least[p]
    return keep


def verbatim_pairs(own: Windows, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) of all pairs with enough of the passage's core around the window, each word counted once."""
    n, n_terms, n_passages = len(own.text), len(index.first) - 1, len(index.needed)
    known = np.flatnonzero(own.ids >= 0)
    known = known[index.first[own.ids[known]] < index.first[own.ids[known] + 1]]
    pairs = np.unique(own.half[known] * n_terms + own.ids[known])
    where, term = pairs // n_terms, pairs % n_terms
    windows, passages = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, n, AT_ONCE):
        low, high = np.searchsorted(where, [at + REACH[0], min(n, at + AT_ONCE) + REACH[-1]])
        half, t = where[low:high], term[low:high]
        window = half[:, None] - np.array(REACH)
        fits = (window >= at) & (window < min(n, at + AT_ONCE))
        fits[fits] = own.text[window[fits]] == np.broadcast_to(own.text[half][:, None], fits.shape)[fits]
        around = np.unique((window * n_terms + t[:, None])[fits])
        w, t = around // n_terms, around % n_terms
        begin = index.first[t]
        many = index.first[t + 1] - begin
        place = np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)
        cell, inverse = np.unique(np.repeat(w, many) * n_passages + index.passage[place], return_inverse=True)
        total = np.bincount(inverse, index.times[place], len(cell))
        cell = cell[total >= index.needed[cell % n_passages]]
        windows.append(cell // n_passages)
        passages.append(cell % n_passages)
    return np.concatenate(windows), np.concatenate(passages)


def short_pairs(own: Windows, index: Index) -> Iterator[tuple[int, int]]:
    """(window in which it begins, passage) of short items that stand word for word."""
    offset = np.cumsum(own.sizes) - own.sizes
    text = np.repeat(np.arange(len(own.sizes)), own.sizes)
    for m, (hashes, passages) in index.grams.items():
        found = gram_hashes(own.ids, m)
        low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
        for at in np.flatnonzero(high > low).tolist():
            if text[at] == text[at + m - 1]:
                words = own.ids[at : at + m].tolist()
                for p in passages[low[at] : high[at]].tolist():
                    if words == index.items.passages[p][1]:
                        yield int(own.first[text[at]] + (at - offset[text[at]]) // STRIDE), p


def comparable(own: Windows, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, passage, cosine) of the pairs to check: near in the latent space, or with a passage's core; each once."""
    n_passages = max(1, len(index.vectors))
    vectors = latent_vectors(own, index)
    windows, passages = latent_pairs(vectors, index)
    keep = overlapping(words_around(own), windows, passages, index)
    w, p = verbatim_pairs(own, index)
    keys = np.unique(np.concatenate([windows[keep] * n_passages + passages[keep], w * n_passages + p]))
    windows, passages = keys // n_passages, keys % n_passages
    return windows, passages, np.einsum("ij,ij->i", vectors[windows], index.vectors[passages])


def candidates(ids: np.ndarray, sizes: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word of the window in it, passage, cosine) of the pairs to check."""
    own = Windows.of(ids, sizes)
    if not len(own.text):
        return
    found = zip(*(c.tolist() for c in comparable(own, index)), strict=True)
    for w, p, cosine in itertools.chain(found, ((w, p, 1.0) for w, p in short_pairs(own, index))):
        t = int(own.text[w])
        yield t, int(w - own.first[t]) * STRIDE, p, cosine


def leaks_of(texts: list[str | None], index: Index) -> Iterator[tuple[int, dict[int, tuple]]]:
    """For each text with leaks its place and, by item, (cosine, passage share, answer share, from, to)."""
    passage_masks = [places(passage) for _, passage in index.items.passages]
    answer_masks = [places(answer) for answer in index.items.answers]
    for a, b in parts(texts, PART_CHARS):
        ids, sizes = term_places(texts[a:b], index.items.terms)
        offset = np.cumsum(sizes) - sizes
        found: dict[int, dict[int, tuple]] = {}
        for t, start, p, cosine in candidates(ids, sizes, index):
            item, passage = index.items.passages[p]
            low, high = max(0, start - len(passage)), min(int(sizes[t]), start + WINDOW + len(passage))
            around = ids[offset[t] + low : offset[t] + high].tolist()
            if len(passage) < MIN_WORDS:
                share = of_answer = float(in_a_row(around, passage))
            else:
                share = common_subsequence(passage_masks[p], len(passage), around, least_words(len(passage))) / len(passage)
                answer = len(index.items.answers[item])
                of_answer = common_subsequence(answer_masks[item], answer, around) / answer if share >= PARAPHRASE else 0.0
            if share >= VERBATIM or (cosine >= COSINE and share >= PARAPHRASE and of_answer >= ANSWER):
                item = index.items.same[item]
                best = found.setdefault(t, {}).get(item)
                if best is None or (share, cosine) > (best[1], best[0]):
                    found[t][item] = (cosine, share, of_answer, low, high)
        for t in sorted(found):
            yield a + t, found[t]


def blocks_of(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of the benchmark."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    words = benchmark.agg(F.sum(F.size(F.split(F.trim(F.col("text").cast("string")), r"\s+")))).first()[0] or 0
    n = -(-words // BLOCK_WORDS)
    for k in range(n):
        own = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else benchmark
        if (index := build_index(texts, own)) is not None:
            yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, passage_share, answer_share, from_word, to_word: a row for each document and leaked item."""
    doc, item = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc}, item_id {item}, cosine double, passage_share double, answer_share double, from_word long, to_word long"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks_of(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            ids, at, values = shared.value.items.ids, [], []
            for t, found in leaks_of(batch.column("text").to_pylist(), shared.value):
                for item in sorted(found):
                    at.append(t)
                    values.append((ids[item], *found[item]))
            columns = list(zip(*values, strict=True)) or [()] * 6
            numbers = [pa.array(c, pa.float64()) for c in columns[1:4]] + [pa.array(c, pa.int64()) for c in columns[4:]]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], None if values else pa.int64()), *numbers], ["doc_id", "item_id", "cosine", "passage_share", "answer_share", "from_word", "to_word"])

        out = out.union(map_batches(rows, run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with all their columns. Null texts stay; repeated rows are judged alike; an empty table gives no rows."""
    for index in blocks_of(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            clean = np.ones(len(texts), bool)
            clean[[t for t, _ in leaks_of(texts, shared.value)]] = False
            return batch.filter(pa.array(clean))

        docs = map_batches(docs, keep, docs.schema)
    return docs

"""Periodic runs of words: stretches that repeat a shorter stretch several times.

A run is a stretch of words with a smallest period q that is at least ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words long, and
that neither neighbouring word extends. A run's words after its first q are repeats, and collapsing drops them.

A text's suffix automaton groups its stretches by where they end; its links are a tree in which the path from a prefix to the root
holds the prefix's endings, longest first. Words are appended one by one: the path of the new prefix is accessed as in a link-cut tree,
which recolours it with the new end. The preferred paths that an access cuts are the segments of one previous end each. If that
end is d words back and the segment's longest ending has d words or more, two copies of a square of period d stand
together, and the longest ending and d together are how far the period reaches back: to the run's start. The last
end at which a start and period are reported is the run's end, and d is its smallest period, as a smaller one would
have recoloured the ending later. All runs are found, in amortised O(log n) segments for each word.

Most of a text lies in no run, and appending there would be wasted: in a run with a period of K to 2K - 1 words every
ending of K words after the first period recurs at less than 2K words' distance, for at least 2K + 1 words on end. Stretches without that at any K
(a power of two) are passed over; this is exact, as a stretch is kept with the words before it that such a run can reach
to, and stretches that touch are taken together. A batch's texts are looked through at once, in time O(n log n) at worst.

A null text counts as empty: no words, no runs, an empty collapsed text. Texts of any length are taken whole; repeated rows are each treated alike. Ties
between runs go to the smaller start, then the smaller period. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches

#: A run has at least so many periods, and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
_word = re.compile(WORD)


# Suffix automaton and link-cut access


class Automaton:
    """The suffix automaton of a list of words. State 0 is the root; ``prefix`` holds the state of each prefix.

    A state's first transition lies in arrays; only states with several have a dictionary for the others.
    """

    def __init__(self, words: list[int]):
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.others: dict[int, dict[int, int]] = {}
        self.prefix = array("i")
        last = 0
        for word in words:
            last = self._append(last, word)
            self.prefix.append(last)

    def _after(self, state: int, word: int) -> int:
        """Where ``word`` leads from ``state``; -1 if nowhere."""
        if self.word[state] == word:
            return self.to[state]
        others = self.others.get(state)
        return others.get(word, -1) if others else -1

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.others.setdefault(state, {})[word] = to

    def _state(self, length: int, link: int) -> int:
        for column, value in ((self.link, link), (self.length, length), (self.word, -1), (self.to, 0)):
            column.append(value)
        return len(self.link) - 1

    def _append(self, last: int, word: int) -> int:
        own = self._state(self.length[last] + 1, 0)
        at = last
        while at >= 0 and (to := self._after(at, word)) < 0:
            self._lead(at, word, own)
            at = self.link[at]
        if at >= 0:
            if self.length[at] + 1 == self.length[to]:
                self.link[own] = to
            else:
                clone = self._state(self.length[at] + 1, self.link[to])
                self.word[clone], self.to[clone] = self.word[to], self.to[to]
                if to in self.others:
                    self.others[clone] = dict(self.others[to])
                self.link[to] = self.link[own] = clone
                while at >= 0 and self._after(at, word) == to:
                    self._lead(at, word, clone)
                    at = self.link[at]
        return own


class LastEnds:
    """A tree of links as a link-cut tree whose preferred paths are segments of states with the same last end.

    The end is kept at the root of a path's splay tree. Nodes are states plus one; 0 is none.
    """

    def __init__(self, link: array):
        self.up = array("i", [0, *(x + 1 for x in link)])
        self.near, self.far = array("i", bytes(4 * len(self.up))), array("i", bytes(4 * len(self.up)))
        self.end = array("i", [-1]) * len(self.up)

    def _rotate(self, x: int) -> None:
        up, near, far = self.up, self.near, self.far
        parent = up[x]
        grand = up[parent]
        if near[parent] == x:
            inner = near[parent] = far[x]
            far[x] = parent
        else:
            inner = far[parent] = near[x]
            near[x] = parent
        if inner:
            up[inner] = parent
        up[parent], up[x] = x, grand
        if near[grand] == parent:
            near[grand] = x
        elif far[grand] == parent:
            far[grand] = x

    def _splay(self, x: int) -> int:
        """Makes ``x`` the root of its path's splay tree; the path's last end."""
        up, near, far = self.up, self.near, self.far
        root = x
        while (above := up[root]) and (near[above] == root or far[above] == root):
            root = above
        while root != x:
            parent = up[x]
            if parent == root:
                self._rotate(x)
                break
            grand = up[parent]
            self._rotate(parent if (near[parent] == x) == (near[grand] == parent) else x)
            self._rotate(x)
            if grand == root:
                break
        self.end[x] = self.end[root]
        return self.end[x]

    def access(self, state: int, new_end: int) -> list[tuple[int, int]]:
        """Recolours the path from ``state`` to the root with ``new_end``; (deepest state, last end) of each coloured segment that lay on it."""
        found, below, x = [], 0, state + 1
        while x:
            end = self._splay(x)
            if end >= 0:
                found.append((x - 1, end))
            if cut := self.far[x]:
                self.end[cut] = end
            self.far[x] = below
            below, x = x, self.up[x]
        self._splay(state + 1)
        self.end[state + 1] = new_end
        return found


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, smallest period) of each run of two periods or more, and its last word."""
    automaton = Automaton(words)
    ends, length, found = LastEnds(automaton.link), automaton.length, {}
    for at, state in enumerate(automaton.prefix):
        for deepest, end in ends.access(state, at):
            if length[deepest] >= at - end:
                found[at - length[deepest] - (at - end) + 1, at - end] = at
    return found


# Stretches that may hold a run


def candidate_stretches(words: np.ndarray, begins: np.ndarray, least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(from, to) of the stretches that hold all runs with their neighbours. ``words`` are numbers, of several texts that begin at ``begins`` and share none."""
    n = len(words)
    first = np.repeat(begins, np.diff(np.append(begins, n)))  # where each word's text begins
    last = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    at, key, span = np.arange(n), words, 1
    found = []
    rank = np.full(n, -1, np.int64)
    while len(at):
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        near = np.sort(at[1:][same & (at[1:] - at[:-1] < 2 * span)])
        breaks = np.flatnonzero(np.diff(near) != 1) + 1
        starts, stops = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(near)]])
        enough = stops - starts >= max((least_periods - 2) * span + 1, least_words - 3 * span + 2)
        for i, j in zip(near[starts[enough]] if len(near) else (), near[stops[enough] - 1] if len(near) else (), strict=True):
            found.append((max(first[i], i - 3 * span + 1), min(last[i], j + 2)))
        # Endings of twice the length: both halves must recur.
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        rank[:] = -1
        rank[at[again]] = np.cumsum(np.concatenate([[True], ~same]))[again]
        at = np.sort(at[again])
        at = at[at - 2 * span + 1 >= first[at]]
        at = at[rank[at - span] >= 0]
        key = rank[at - span] * np.int64(n + 1) + rank[at]
        span *= 2
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low < merged[-1][1] and first[low] == first[merged[-1][0]]:
            merged[-1] = merged[-1][0], max(merged[-1][1], high)
        else:
            merged.append((low, high))
    return merged


def runs_of(texts: list[list[str]], least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run of each text (a list of its words), by start, then period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    codes, unique = pd.factorize(np.array(list(itertools.chain.from_iterable(texts)), object))
    begins = np.cumsum(sizes) - sizes
    own = codes + np.repeat(np.arange(len(texts)), sizes) * np.int64(len(unique))
    for low, high in candidate_stretches(own, begins[sizes > 0], least_periods, least_words):
        k = int(np.searchsorted(begins, low, "right")) - 1
        for (start, period), end in squares(codes[low:high].tolist()).items():
            length = end - start + 1
            if length >= max(least_words, least_periods * period):
                found[k].append((int(low - begins[k]) + start, length, period))
    return [sorted(set(runs), key=lambda run: (run[0], run[2])) for runs in found]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by single spaces."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(itertools.compress(words, keep.tolist()))


# Tables


def periodic_runs(docs: DataFrame, least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, in order) and collapsed (the text without what they repeat)."""
    kind = dict(docs.dtypes)["doc_id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_word.findall(text or "") for text in batch.column("text").to_pylist()]
        runs = runs_of(texts, least_periods, least_words)
        shown = [[dict(zip(("start", "length", "period"), run, strict=True)) for run in own] for own in runs]
        arrays = [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(shown, run_type), pa.array(list(map(collapsed, texts, runs)), pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, find, f"doc_id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs``, a tenth of them, by the hash of their ids, with words that repeat a stretch from a place on to the end."""
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    begin = (g % n).cast("int")
    period = (1 + F.floor((n - begin) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), F.ceil((n - begin) / period).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), begin), F.slice(cycle, F.lit(1), n - begin)), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text").cast("string")))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods, and digests of all runs and of the collapsed text, from ``periodic_runs``.

    Periods are compared as doubles, which tells them apart in texts of up to 10^8 words.
    """

    def key(run: Column) -> Column:
        return F.struct((run["length"] / run["period"]).alias("e"), (-run["start"]).alias("s"), (-run["period"]).alias("p"), run["length"].alias("length"))

    lines = F.array_join(F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(F.transform("runs", key)).alias("best"), lines.alias("lines"), "collapsed")
    period, length = -F.col("best.p"), F.col("best.length")
    return best.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

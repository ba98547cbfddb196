"""Gradient-boosted trees on binned features with a learned side for nulls; exact Shapley values of their scores.

Rows are binned once into small integers; a feature's null is a bin of its own. Rows of equal bins and label have equal gradients in every
round, so they become one row with a weight (Spark groups and counts them), and blocks of those are written. For each level of a tree, tasks add
up the gradients and curvatures of their rows by (node, feature, bin). Where all tasks' sums together are small (``DIRECT`` bytes, known
before the job) the driver adds them; otherwise they are shuffled by (node, feature), and only the best split of each comes back. Each
split tries the nulls on both sides and keeps the better one. Rows are never moved or sampled; their margins are written every ``FOLD`` rounds
and in between come from the rounds' trees, so a lost task costs no more than its rows. (These passes, hundreds of short ones over the
same blocks, are the one place that takes the blocks as an RDD: its plan is made once, and a pass costs half the time.)

The objective is the logistic loss with a ridge on leaf values. Shapley values are interventional, against a background sample: for
one leaf, a row's share depends only on which of the path's features the row meets and on how many background rows meet which, so
each leaf is a table over at most ``2^depth`` patterns, exact for a background of any size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, stored

from .grid import HOURS

#: Bins of a feature's values, at most; nulls have one more.
BINS = 64
#: Rows of a block.
BLOCK = 8192
#: Rounds after which margins are written.
FOLD = 10
#: Codes whose contributions a task keeps, at most.
KNOWN = 100_000
#: Rows whose values are sorted at once for quantiles, about.
CHUNK = 1 << 16
#: Bytes of all tasks' sums up to which the driver adds them.
DIRECT = 1 << 26


class Tree(NamedTuple):
    """Nodes as in a heap: those below node k are 2k + 1 and 2k + 2. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray  # bins up to this go left
    threshold: np.ndarray  # values below this go left
    null_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # curvature of the training rows

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def left(self, x: np.ndarray, node: np.ndarray | int) -> np.ndarray:
        """Which rows of values go left at their node."""
        own = x[np.arange(len(x)), np.maximum(self.feature[node], 0)]
        return np.where(np.isnan(own), self.null_left[node], own < self.threshold[node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf, by its values."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + 2 - self.left(x, at), at)
        return at

    def nodes(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Each row's leaf, or its node after ``levels`` levels, by its bins; quickest if these lie feature by feature."""
        node, bin_ = np.arange(len(self.feature))[:, None], np.arange(BINS + 1)
        left = np.where(bin_ == BINS, self.null_left[:, None], bin_ <= self.cut[:, None])
        step = np.where(self.feature[:, None] >= 0, 2 * node + 2 - left, node).ravel()
        flat, column, rows = x.ravel(order="F"), np.maximum(self.feature, 0) * len(x), np.arange(len(x))
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth if levels is None else levels):
            at = step[at * (BINS + 1) + flat[column[at] + rows]]
        return at


class Forest(NamedTuple):
    columns: list[str]
    base: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += tree.value[tree.leaves(x)]
        return total

    def thresholds(self) -> list[np.ndarray]:
        """Each feature's thresholds in all trees, sorted."""
        feature, threshold = (np.concatenate([own, *(getattr(t, name) for t in self.trees)]) for name, own in (("feature", np.zeros(0, int)), ("threshold", np.zeros(0))))
        return [np.unique(threshold[feature == f]) for f in range(len(self.columns))]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """For each row the places of its values among its features' thresholds, as bytes: rows of equal codes reach the same leaves."""
        out = np.zeros(x.shape, np.uint16)
        for f, own in enumerate(self.thresholds()):
            out[:, f] = np.where(np.isnan(x[:, f]), 1 << 15, np.searchsorted(own, x[:, f], "right"))
        return out.view(f"V{2 * x.shape[1]}").ravel()

    def distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of which each stands for those of equal codes, and the one of them for each row."""
        _, first, own = np.unique(self.codes(x), return_index=True, return_inverse=True)
        return x[first], own

    def margins_once(self, x: np.ndarray, known: dict[bytes, float]) -> np.ndarray:
        """``margins`` with each code worked out once, if ``known`` has room for it: it's kept from batch to batch, up to ``KNOWN`` codes."""
        code, first, own = np.unique(self.codes(x), return_index=True, return_inverse=True)
        keys = [c.tobytes() for c in code]
        found = np.array([known.get(key, np.nan) for key in keys], float)
        new = np.flatnonzero(np.isnan(found))
        if len(new):
            found[new] = self.margins(x[first[new]])
        known.update((keys[k], found[k]) for k in new[: max(0, KNOWN - len(known))])
        return found[own]

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as a table (thresholds and leaf values as they are), beside the columns and the base score."""
        rows = [
            (t, k, int(tree.feature[k]), int(tree.cut[k]), float(tree.threshold[k]), bool(tree.null_left[k]), float(tree.value[k]), float(tree.cover[k]))
            for t, tree in enumerate(self.trees)
            for k in range(len(tree.feature))
        ]
        schema = "tree int, node int, feature int, cut int, threshold double, null_left boolean, value double, cover double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({"columns": self.columns, "base": self.base, "trees": len(self.trees)})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        trees = [Tree(*(own[c].to_numpy() for c in Tree._fields)) for _, own in nodes.groupby("tree")]
        return cls(about["columns"], about["base"], trees)


# Training


def features_of(columns: list[str]) -> Column:
    """The features of a row as an array of doubles, NaN for null."""
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def weight_of(rows: DataFrame) -> Column:
    """How many rows a row stands for: hours, where it has ``HOURS``."""
    return F.col(HOURS).cast("long") if HOURS in rows.columns else F.lit(1).cast("long")


def points(v: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their weights. Of more than ``most``, the least and the last of each ``most``-th of the weight stay, each with the weight since the one before."""
    order = np.argsort(v, kind="stable")
    v, weight = v[order], weight[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
    value, above = v[first], np.cumsum(np.add.reduceat(weight, first)) if len(v) else np.zeros(0, np.int64)
    if len(value) > most:
        step = above * most // above[-1]
        last = np.append(step[1:] != step[:-1], True)
        last[0] = True
        value, above = value[last], above[last]
    return value, np.diff(above, prepend=0)


def value_points(rows: DataFrame, columns: list[str]) -> DataFrame:
    """k (a feature's place), v and w: ``points`` of each ``CHUNK`` rows, to a ``20 * BINS``-th of their weight, as percentiles of that accuracy are."""
    width = len(columns)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, weight = (np.concatenate(a) for a in zip(*held, strict=True))
        there = [~np.isnan(x[:, f]) for f in range(width)]
        found = [points(x[own, f], weight[own], 20 * BINS) for f, own in enumerate(there)]
        k = np.repeat(np.arange(width), [len(v) for v, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(np.concatenate(a)) for a in zip(*found, strict=True))], ["k", "v", "w"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append((matrix(batch, "x", width), batch.column("w").to_numpy()))
            if sum(len(w) for _, w in held) >= CHUNK:
                yield summed(held)
                held = []
        if held:
            yield summed(held)

    each = rows.select(features_of(columns).alias("x"), weight_of(rows).alias("w")).mapInArrow(own, "k long, v double, w long")
    return each.groupBy("k", "v").agg(F.sum("w").alias("w"))


def cuts_of(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Each feature's cuts, without its smallest value: all of its values if they are fewer than ``BINS``, quantiles otherwise."""
    own, upto = Window.partitionBy("k"), Window.partitionBy("k").orderBy("v")
    each = value_points(rows, columns).select("k", "v", "w", F.count("*").over(own).alias("n"), F.sum("w").over(own).alias("whole"), F.sum("w").over(upto).alias("upto"), F.row_number().over(upto).alias("at"))
    # A quantile lies in the weight of this value.
    ends = F.expr(f"least(upto * {BINS} div whole, {BINS - 1}) > (upto - w) * {BINS} div whole")
    found = each.where(F.col("at") > 1).where((F.col("n") < BINS) | ends).select("k", "v").collect()
    return [np.array(sorted(r["v"] for r in found if r["k"] == k), float) for k in range(len(columns))]


def binned_rows(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, own in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), BINS, np.searchsorted(own, x[:, f], "right"))
    return out


BLOCKS = "bins binary, label binary, weight binary, margin binary"


def distinct_rows(rows: DataFrame, columns: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """bins (a byte for each feature), label and weight: each combination that occurs, and how many rows have it."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = binned_rows(matrix(batch, "x", len(columns)), cuts), batch.num_rows
            ends = pa.py_buffer((np.arange(n + 1) * len(columns)).astype(np.int32))
            bins = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([bins, batch.column("label"), batch.column("weight")], ["bins", "label", "weight"])

    each = rows.select(features_of(columns).alias("x"), F.col("label").cast("int").alias("label"), weight_of(rows).alias("weight"))
    return each.mapInArrow(binned, "bins binary, label int, weight long").groupBy("bins", "label").agg(F.sum("weight").alias("weight"))


def mean_label(rows: DataFrame) -> float:
    """The label's mean over all that the rows stand for, away from 0 and 1."""
    weight = F.when(F.col("label").isNotNull(), weight_of(rows))
    share = rows.agg(F.sum(F.col("label") * weight) / F.nullif(F.sum(weight), F.lit(0))).first()[0]
    return min(max(float(share or 0.5), 1e-6), 1 - 1e-6)


def blocks(rows: DataFrame, columns: list[str], cuts: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of distinct rows: bins, labels, weights and margins; written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, weight = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8), batch.column("weight").to_numpy(zero_copy_only=False).astype(float)
            x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(y), len(columns))
            for at in range(0, len(y), BLOCK):
                to = at + BLOCK
                yield block(x[at:to], y[at:to], weight[at:to], np.full(len(y[at:to]), base))

    # Every round reads the blocks several times, so they are spread over all cores once; more tasks would only cost more in each pass.
    packed = distinct_rows(rows, columns, cuts).mapInArrow(pack, BLOCKS)
    return stored(packed.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def block(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (bins.T, label, weight, margin)], ["bins", "label", "weight", "margin"])


def unpacked(rows: Iterator[tuple], width: int, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bins (features one after the other), labels, weights and the margins after ``trees`` of each block."""
    for bins, label, weight, margin in rows:
        x, total = np.frombuffer(bins, np.uint8).reshape(width, -1).T, np.frombuffer(margin, float).copy()
        for tree in trees:
            total += tree.value[tree.nodes(x)]
        yield x, np.frombuffer(label, np.uint8), np.frombuffer(weight, float), total


def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, tree: Tree, level: int) -> np.ndarray:
    """Gradients and curvatures by (node of the level, feature, bin): two arrays."""
    p = 1 / (1 + np.exp(-margin))
    node = tree.nodes(x, level) - (2**level - 1)
    g, h = weight * (p - y), weight * p * (1 - p)
    if (node < 0).any():  # rows in leaves above stay out
        live = np.flatnonzero(node >= 0)
        x, node, g, h = np.asfortranarray(x[live]), node[live], g[live], h[live]
    out = np.empty((2, 2**level, x.shape[1], BINS + 1))
    first = node * (BINS + 1)
    for f in range(x.shape[1]):
        place = first + x[:, f]
        for own, weight in zip(out, (g, h), strict=True):
            own[:, f] = np.bincount(place, weight, 2**level * (BINS + 1)).reshape(2**level, -1)
    return out


class Choice(NamedTuple):
    """The best split of one node and feature: its gain, cut, side of nulls, and gradient and curvature of its left side and of the node."""

    gain: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    g_left: np.ndarray
    h_left: np.ndarray
    g: np.ndarray
    h: np.ndarray


def best_cuts(sums_: np.ndarray, ridge: float, least: float) -> Choice:
    """For sums of shape (2, m, bins + 1): the best of all cuts with nulls on either side. Of equal gains the smaller cut, nulls right first."""
    g, h = sums_[0].sum(1), sums_[1].sum(1)
    left = np.cumsum(sums_[:, :, :BINS], 2)
    both = np.stack([left, left + sums_[:, :, BINS:]], 3)  # (2, m, cut, side of nulls)
    gl, hl = both
    gr, hr = g[:, None, None] - gl, h[:, None, None] - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None, None]
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf).reshape(len(g), -1)
    at = gain.argmax(1)
    rows, (cut, side) = np.arange(len(g)), np.divmod(at, 2)
    return Choice(gain[rows, at], cut, side == 1, gl[rows, cut, side], hl[rows, cut, side], g, h)


def in_tasks(data: DataFrame, n: int) -> RDD:
    """Blocks of ``n`` rows as an RDD that is kept until the next fold, in a task for each full block at most: each task's sums go to the driver or are shuffled."""
    blocks_ = data.rdd
    return blocks_.coalesce(max(1, min(blocks_.getNumPartitions(), n // BLOCK))).persist(StorageLevel.MEMORY_AND_DISK)


def level_choices(data: RDD, width: int, recent: list[Tree], tree: Tree, level: int, ridge: float, least: float) -> list[tuple[int, int, Choice]]:
    """(node, feature, choice) for each node of a level and feature that have rows; choices hold one entry."""
    direct = data.getNumPartitions() * 2 * 2**level * width * (BINS + 1) * 8 <= DIRECT

    def partial(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros((2, 2**level, width, BINS + 1))
        for x, y, weight, margin in unpacked(rows, width, recent):
            total += sums(x, y, weight, margin, tree, level)
        yield total

    tasks = data.mapPartitions(partial)
    if direct:
        total = sum(tasks.collect())
        choice = best_cuts(total.reshape(2, 2**level * width, BINS + 1), ridge, least)
        return [(*divmod(k, width), Choice(*own)) for k, own in enumerate(zip(*choice, strict=True))]
    by_key = tasks.flatMap(lambda total: (((node, f), total[:, node, f]) for node in range(2**level) for f in range(width)))
    best = by_key.reduceByKey(np.add).mapValues(lambda own: Choice(*(v[0] for v in best_cuts(own[:, None], ridge, least))))
    return [(*key, choice) for key, choice in best.collect()]


def train_forest(rows: DataFrame, columns: list[str], rounds: int = 100, depth: int = 6, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """From ``columns`` and ``label`` (0 or 1) of all rows; one with ``HOURS`` counts as often."""
    cuts, share = cuts_of(rows, columns), mean_label(rows)
    base, width = float(np.log(share / (1 - share))), len(columns)
    data, trees, recent = blocks(rows, columns, cuts, base), [], []
    n = data.agg(F.sum(F.length("label"))).first()[0] or 0
    own = in_tasks(data, n)
    for _ in range(rounds):
        tree = Tree.empty(depth)
        for level in range(depth):
            if level and not (tree.feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0).any():
                break
            best: dict[int, tuple[int, Choice]] = {}  # by node, the smaller feature of equal gains
            for node, feature, choice in sorted(level_choices(own, width, recent, tree, level, ridge, least), key=lambda found: found[:2]):
                if node not in best or choice.gain > best[node][1].gain:
                    best[node] = feature, choice
            for node, (feature, c) in best.items():
                k = 2**level - 1 + node
                if level == 0:
                    tree.value[k], tree.cover[k] = -rate * c.g / (c.h + ridge), c.h
                if c.gain <= 1e-9 or (k and tree.feature[(k - 1) // 2] < 0):
                    continue
                tree.feature[k], tree.cut[k], tree.null_left[k] = feature, c.cut, c.null_left
                tree.threshold[k] = cuts[feature][c.cut] if c.cut < len(cuts[feature]) else np.inf
                for below, g, h in ((2 * k + 1, c.g_left, c.h_left), (2 * k + 2, c.g - c.g_left, c.h - c.h_left)):
                    tree.value[below], tree.cover[below] = -rate * g / (h + ridge), h
        trees, recent = [*trees, tree], [*recent, tree]
        if len(recent) == FOLD and len(trees) < rounds:
            last, data, recent = data, folded(data, width, recent), []
            own.unpersist()
            discard(last)
            own = in_tasks(data, n)
    own.unpersist()
    discard(data)
    return Forest(columns, base, trees)


def first_splits(rows: DataFrame, columns: list[str], ridge: float = 1.0, least: float = 1.0) -> DataFrame:
    """feature, threshold (null: none of the values), null_left and gain of each feature's best split of all rows; features that can't split are left out.

    What the first node of a forest chooses from, and a screening of features by themselves.
    """
    cuts, share = cuts_of(rows, columns), mean_label(rows)
    data = blocks(rows, columns, cuts, float(np.log(share / (1 - share))))
    found = level_choices(data.rdd, len(columns), [], Tree.empty(1), 0, ridge, least)
    discard(data)
    best = [(columns[f], float(cuts[f][c.cut]) if c.cut < len(cuts[f]) else None, bool(c.null_left), float(c.gain)) for _, f, c in found if c.gain > 1e-9]
    return rows.sparkSession.createDataFrame(sorted(best), "feature string, threshold double, null_left boolean, gain double")


def folded(data: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' values in their margins; written."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, weight, margin in unpacked(zip(*(c.to_pylist() for c in batch.columns), strict=True), width, trees):
                yield block(x, y, weight, margin)

    return stored(data.mapInArrow(fold, BLOCKS))


# Shapley values


def pattern_weights(k: int) -> np.ndarray:
    """(row's pattern, background's pattern, feature): a feature's Shapley value in the game "is the leaf reached".

    A pattern has a bit for each of the path's features that meets the path's conditions. Features that both meet don't matter; if neither
    meets one, the leaf is out of reach. Of the others the row must give p and the background n.
    """
    own, other = np.meshgrid(np.arange(2**k), np.arange(2**k), indexing="ij")
    x, z = ((a[..., None] >> np.arange(k)) & 1 == 1 for a in (own, other))
    p, n = (x & ~z).sum(2), (z & ~x).sum(2)
    reached = (x | z).all(2)
    fact = np.array([factorial(i) for i in range(k + 2)], float)
    gain = np.where(p > 0, fact[np.maximum(p - 1, 0)] * fact[n] / fact[p + n], 0)
    loss = np.where(n > 0, fact[p] * fact[np.maximum(n - 1, 0)] / fact[p + n], 0)
    return np.where(reached[..., None], (x & ~z) * gain[..., None] - (z & ~x) * loss[..., None], 0)


class Leaf(NamedTuple):
    """A leaf's path as (node, whether it goes left) for each of its features, and the contributions of each pattern."""

    features: np.ndarray
    steps: list[list[tuple[int, bool]]]
    table: np.ndarray

    def patterns(self, lefts: dict[int, np.ndarray], n: int) -> np.ndarray:
        found = np.zeros(n, np.int64)
        for bit, steps in enumerate(self.steps):
            met = np.ones(n, bool)
            for node, left in steps:
                met &= lefts[node] if left else ~lefts[node]
            found |= met.astype(np.int64) << bit
        return found


def leaf_tables(tree: Tree, background: np.ndarray) -> list[Leaf]:
    lefts = {int(k): tree.left(background, int(k)) for k in np.flatnonzero(tree.feature >= 0)}
    found = []

    def down(node: int, path: list[tuple[int, bool]]) -> None:
        if tree.feature[node] >= 0:
            down(2 * node + 1, [*path, (node, True)])
            down(2 * node + 2, [*path, (node, False)])
            return
        by_feature: dict[int, list[tuple[int, bool]]] = {}
        for step in path:
            by_feature.setdefault(int(tree.feature[step[0]]), []).append(step)
        if by_feature:
            leaf = Leaf(np.array(list(by_feature)), list(by_feature.values()), None)
            share = np.bincount(leaf.patterns(lefts, len(background)), minlength=2 ** len(by_feature)) / len(background)
            found.append(leaf._replace(table=tree.value[node] * np.einsum("xzk,z->xk", pattern_weights(len(by_feature)), share)))

    down(0, [])
    return found


class TreeTables(NamedTuple):
    """A tree's contributions by places: a place of a feature is the stretch between two of the tree's thresholds on it that a value lies in, or null.

    Values of equal places go the same way at every node, so contributions are worked out once for each combination of places that occurs.
    """

    features: list[int]
    #: The tree's place of each place among the forest's thresholds, by feature.
    places: list[np.ndarray]
    #: By leaf: its features (as numbers of ``features``), by those the pattern's bit for each place, and by those the contribution of each pattern.
    leaves: list[tuple[list[int], list[np.ndarray], list[np.ndarray]]]

    @classmethod
    def of(cls, tree: Tree, leaves: list[Leaf], thresholds: list[np.ndarray]) -> TreeTables:
        features = sorted({int(f) for f in tree.feature if f >= 0})
        places, lefts = [], {}
        for f in features:
            nodes = np.flatnonzero(tree.feature == f)
            own, all_ = np.unique(tree.threshold[nodes]), thresholds[f]
            # Of a place among the forest's thresholds, any value in it: the threshold it begins with.
            begins = np.append(-np.inf, all_)
            places.append(np.append(np.searchsorted(own, begins, "right"), len(own) + 1))
            places[-1][0] = 0
            for k in nodes:
                lefts[int(k)] = np.append(np.arange(len(own) + 1) <= np.searchsorted(own, tree.threshold[k]), tree.null_left[k])
        found = []
        for leaf in leaves:
            bits = []
            for bit, steps in enumerate(leaf.steps):
                met = np.all([lefts[node] if left else ~lefts[node] for node, left in steps], 0)
                bits.append(met.astype(np.int64) << bit)
            found.append(([features.index(f) for f in leaf.features], bits, list(np.ascontiguousarray(leaf.table.T))))
        return cls(features, places, found)

    def add(self, out: np.ndarray, at: list[np.ndarray]) -> None:
        """Adds the contributions of rows, given by feature's place among the forest's thresholds, to ``out`` (feature, row)."""
        if not self.features:
            return
        own = [table[at[f]] for f, table in zip(self.features, self.places, strict=True)]
        key, bound = np.zeros(out.shape[1], np.int64), 1
        for place, table in zip(own, self.places, strict=True):
            size = int(table.max()) + 1
            if bound * size >= 1 << 62:
                key, few = pd.factorize(key)
                bound = len(few)
            key, bound = key * size + place, bound * size
        group, few = pd.factorize(key)
        first = np.empty(len(few), np.int64)
        first[group[::-1]] = np.arange(len(group))[::-1]
        own = [place[first] for place in own]
        each = np.zeros((len(self.features), len(few)))
        for features, bits, tables in self.leaves:
            pattern = bits[0][own[features[0]]]
            for f, bit in zip(features[1:], bits[1:], strict=True):
                pattern = pattern | bit[own[f]]
            for f, table in zip(features, tables, strict=True):
                each[f] += table[pattern]
        for f, values in zip(self.features, each, strict=True):
            out[f] += values[group]


class Explainer:
    """Shapley values of a forest's margins against background rows (a matrix with NaN for null)."""

    def __init__(self, forest: Forest, background: np.ndarray):
        self.forest, self.base = forest, float(forest.margins(background).mean())
        self.thresholds = forest.thresholds()
        self.tables = [TreeTables.of(tree, leaf_tables(tree, background), self.thresholds) for tree in forest.trees]

    def values_once(self, x: np.ndarray, known: dict[bytes, np.ndarray]) -> np.ndarray:
        """``values`` with each code worked out once, if ``known`` has room for it: it's kept from batch to batch, up to ``KNOWN`` codes."""
        code, first, own = np.unique(self.forest.codes(x), return_index=True, return_inverse=True)
        keys = [c.tobytes() for c in code]
        new = [k for k, key in enumerate(keys) if key not in known]
        found = np.empty((len(keys), x.shape[1]))
        if new:
            found[new] = self.values(x[first[new]])
        old = np.ones(len(keys), bool)
        old[new] = False
        for k in np.flatnonzero(old):
            found[k] = known[keys[k]]
        known.update((keys[k], found[k].copy()) for k in new[: max(0, KNOWN - len(known))])
        return found[own]

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.forest.columns), len(x)))
        at = [np.where(np.isnan(x[:, f]), len(own) + 1, np.searchsorted(own, x[:, f], "right")) for f, own in enumerate(self.thresholds)]
        for tree in self.tables:
            tree.add(out, at)
        return out.T


def distinct_codes(forest: Forest, rows: DataFrame, label: bool = False) -> DataFrame:
    """x and n, with ``label`` also its value: one row of those of equal codes (and label), and how many they are (hours, where rows have ``HOURS``).

    Rows of equal codes have the same scores and contributions. Tasks add up their batches before they pass on.
    """
    forest_, width = forest, len(forest.columns)
    schema = "code binary, label int, x array<double>, n long"

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, weight = matrix(batch, "x", width), batch.column("label"), batch.column("n").to_numpy()
            code = forest_.codes(x)
            keyed = np.empty(len(x), [("label", np.int32), ("code", code.dtype)])
            keyed["label"], keyed["code"] = y.fill_null(-1).to_numpy(), code
            _, first, own = np.unique(keyed.view(f"V{keyed.dtype.itemsize}"), return_index=True, return_inverse=True)
            n = np.zeros(len(first), np.int64)
            np.add.at(n, own, weight)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * width, pa.int32()), pa.array(x[first].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in code[first]], pa.binary()), y.take(pa.array(first)), each, pa.array(n)], ["code", "label", "x", "n"])

    value = F.col("label").cast("int") if label else F.lit(0)
    each = rows.select(features_of(forest.columns).alias("x"), value.alias("label"), weight_of(rows).alias("n")).mapInArrow(few, schema)
    return each.groupBy("code", "label").agg(F.min("x").alias("x"), F.sum("n").alias("n")).select("x", *(["label"] if label else []), "n")


# Evaluation by round


def staged_scores(forest: Forest, x: np.ndarray) -> Iterator[np.ndarray]:
    """The scores after each round."""
    total = np.full(len(x), forest.base)
    for tree in forest.trees:
        total = total + tree.value[tree.leaves(x)]
        yield 1 / (1 + np.exp(-total))


#: Steps of a score in evaluations by round.
STEPS = 10_000


def round_counts(forest: Forest, rows: DataFrame) -> DataFrame:
    """round (from 1), step (score times ``STEPS``, rounded), pos and neg of ``rows`` (with ``label``), for all rounds in one pass.

    Tasks count before they pass on, so what is shuffled has a fixed bound for each task.
    """
    forest_, width = forest, len(forest.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(forest_.trees), 2, STEPS + 1), np.int64)
        for batch in batches:
            x, y, n = matrix(batch, "x", width), batch.column("label").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            for r, score in enumerate(staged_scores(forest_, x)):
                step = np.rint(score * STEPS).astype(np.int64)
                for side in (0, 1):
                    np.add.at(total[r, side], step[y == side], n[y == side])
        r, step = np.nonzero(total.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (r + 1, step, total[r, 1, step], total[r, 0, step])], ["round", "step", "pos", "neg"])

    each = distinct_codes(forest, rows, label=True).mapInArrow(count, "round long, step long, pos long, neg long")
    return each.groupBy("round", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

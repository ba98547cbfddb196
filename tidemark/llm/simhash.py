"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits; texts link where their fingerprints differ in ``RADIUS`` = 3 bits
or fewer, and classes are the connected components of these links.

Search. The 64 bits are four blocks of 16. Of two fingerprints that differ in up to three bits, one
block can be left out such that the other 48 bits differ in two at most (leave out a block with a
difference). So for each of the four choices every distinct fingerprint emits all variants of its
other 48 bits within half of that remaining radius, one bit: 4 x 49 rows. Two fingerprints within the
radius meet in a variant, the one half way. The variants are shuffled; where they collide, the pair
is verified on all 64 bits. Chance collisions stay rare because a key has 50 bits.

Skew. Copies count once: only distinct fingerprints are emitted. A variant's group holds distinct
fingerprints only, so it's bounded by the key space (49 x 65,536), whatever the number of copies. The variants
come sorted by key and are worked off group by group, so memory is that of the largest group and not of a task's
share of the shuffle. In a group no list of all pairs is made. Small groups compare in one numpy block; larger ones look up
the balls of whole fingerprints, where every middle point that has a fingerprint within one bit links all
others within two bits to it; very large ones, which fill a good part of their key space, take the space
as a grid and let the smallest label spread by bit flips. All keep only links that join what isn't joined yet, fewer than the
group has members for a large one, and these span the same components as all links.

Components come from rounds of joins on the linked fingerprints alone (few against all), each round
written to the shared folder; nothing of them passes through the driver but a count. Keys with more than
one in ``HOT`` of all rows (``HOT`` keys at most) are looked up in a broadcast table, in these rounds and when the
classes go back to the documents, so neither the copies of one text nor the neighbours of one fingerprint meet in one task.

A null or wordless text has fingerprint zero, and links like any other. Null ids are allowed; a
component's id is the smallest non-null one in it. Repeated rows give repeated results. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, unused

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Groups of up to this many fingerprints are compared member by member.
SMALL_GROUP = 512
#: Groups of more than this many are taken as a grid of their key space.
LARGE_GROUP = 32_768
#: Keys with more than one in HOT rows are looked up in a broadcast table.
HOT = 10_000
#: Variants in each part of the shuffle, about.
PART_ROWS = 4_000_000

_ONE = np.uint64(1)
_BIT = np.concatenate([[np.uint64(0)], _ONE << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of UTF-8 text, unsigned."""
    words = (text or b"").lower().split()  # both on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return map_batches(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and codes: for each left-out block, the other 48 bits with one bit changed at most.

    A key has the block's number and the changed bits. A code has what the key lacks of the fingerprint, the
    block's own bits and the number of the changed bit, so that a row is small.
    """
    keys, codes = [], []
    for block in range(4):
        low = np.uint64(16 * block)
        below = (_ONE << low) - _ONE
        rest = (fps & below) | ((fps >> np.uint64(16)) & ~below & np.uint64(0xFFFFFFFFFFFF))
        own = ((fps >> low) & np.uint64(0xFFFF)).astype(np.int32)
        keys.append(((rest[:, None] ^ _BIT[None, :49]) | np.uint64(block << 48)).ravel())
        codes.append((own[:, None] | (np.arange(49, dtype=np.int32) << 16)[None, :]).ravel())
    return np.concatenate(keys), np.concatenate(codes)


def owners(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The fingerprints that emitted these keys and codes."""
    low = np.uint64(16) * (keys >> np.uint64(48))
    rest = (keys & np.uint64(0xFFFFFFFFFFFF)) ^ _BIT[codes >> 16]
    below = (_ONE << low) - _ONE
    return (rest & below) | ((codes & 0xFFFF).astype(np.uint64) << low) | ((rest & ~below) << np.uint64(16))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def small_links(group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of all links: each member takes over its neighbours' smallest label until none changes.

    Where a label is taken over, the pair is a link.
    """
    near = distance(group[:, None], group[None, :]) <= radius
    label = np.arange(len(group))
    while True:
        seen = np.where(near, label[None, :], len(group))
        least, giver = seen.min(axis=1), seen.argmin(axis=1)
        lower = least < label
        if not lower.any():
            return
        yield group[lower], group[giver[lower]]
        label = np.minimum(label, least)


def large_links(group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the same components as all links within ``radius`` = 3, from middle points.

    Points within one bit of a member are kept in a sorted array, each with one member as its hub (65
    entries for each member); each member then looks up its own points of up to two changed bits, one
    change at a time. What is found is a hub within 1 + 2 bits. Two members within three bits share
    such a point, and both link to its hub, so no link between components is lost. Members that are
    connected already need no more links, so fewer are kept than there are members.
    """
    points = (group[:, None] ^ _BIT[None, :]).ravel()
    order = np.argsort(points, kind="stable")
    points, hubs = points[order], np.repeat(np.arange(len(group)), 65)[order]
    first = np.concatenate([[True], points[1:] != points[:-1]])
    points, hubs = points[first], hubs[first]
    root = np.arange(len(group))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for change in [0, *(int(x) for x in _BIT[1:]), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]:
        own = group ^ np.uint64(change)
        at = np.minimum(np.searchsorted(points, own), len(points) - 1)
        found = np.flatnonzero((points[at] == own) & (root[hubs[at]] != root))
        links = []
        for k, hub in zip(found.tolist(), hubs[at[found]].tolist(), strict=True):
            a, b = find(k), find(hub)
            if a != b and int(group[k] ^ group[hub]).bit_count() <= radius:
                root[max(a, b)] = min(a, b)
                links.append((k, hub))
        if links:
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            k, hub = np.array(links).T
            yield group[k], group[hub]


def grid_links(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of one key's group to the first of its component, for a radius of 3.

    A member is a cell of a grid: a row for the changed bit of the key, a column for the 16 bits of the
    left-out block. Members of one row may differ in three bits of the column, of row 0 and another in two, of two
    other rows in one. The smallest label spreads along these until none changes.
    """
    rows, column = np.unique(codes >> 16, return_inverse=True)[1], codes & 0xFFFF
    first_row = int((codes >> 16).min()) == 0
    none = np.int32(len(codes))
    label = np.arange(len(codes), dtype=np.int32)

    def flipped(grid: np.ndarray) -> np.ndarray:
        """The least of each cell and those at one bit from it."""
        out = grid.copy()
        for bit in range(16):
            pairs, new = (x.reshape(len(grid), 1 << (15 - bit), 2, 1 << bit) for x in (grid, out))
            np.minimum(new, pairs[:, :, ::-1], out=new)
        return out

    while True:
        grid = np.full((int(rows.max()) + 1, 1 << 16), none, np.int32)
        np.minimum.at(grid, (rows, column), label)
        one = flipped(grid)
        near = one.min(axis=0)
        two = flipped(one)
        if first_row:
            near = np.minimum(near, two[0])
            of_first = two.min(axis=0)
        seen = np.minimum(flipped(two)[rows, column], near[column])
        if first_row:
            seen = np.where(rows == 0, np.minimum(seen, of_first[column]), seen)
        seen = np.minimum(seen, label)
        while (up := seen[seen]).tobytes() != seen.tobytes():
            seen = up
        if seen.tobytes() == label.tobytes():
            fps = owners(keys, codes)
            others = np.flatnonzero(label != np.arange(len(label)))
            return fps[others], fps[label[others]]
        label = seen


def links_within(keys: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links (smaller, larger; as signed numbers), enough for all components, among fingerprints that share a key."""
    order = np.argsort(keys, kind="stable")
    keys, codes = keys[order], codes[order]
    fps = owners(keys.view(np.uint64), codes)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    near = distance(fps[two], fps[two + 1]) <= radius
    found = [(fps[two][near], fps[two + 1][near])]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if size > LARGE_GROUP:
            found.append(grid_links(keys[start : start + size].view(np.uint64), codes[start : start + size]))
        else:
            found += (small_links if size <= SMALL_GROUP else large_links)(fps[start : start + size], radius)
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
    a, b = a[a != b], b[a != b]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and codes of sorted batches, cut between keys: a group is never divided."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, codes = batch.column("key").to_numpy(), batch.column("code").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # where the last key of this batch begins
        if cut or (held and held[-1][0][-1] != keys[0]):
            held.append((keys[:cut], codes[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((keys[cut:], codes[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def ball_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a < b, among the distinct fingerprints ``fp``, enough for all components."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, codes = variants(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(codes)], ["key", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, codes in whole_groups(batches):
            a, b = links_within(keys, codes)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * 4 * 49 // PART_ROWS))
    emitted = map_batches(distinct.select("fp"), emit, "key long, code int")
    return emitted.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in ``n`` how many rows have it.

    Keys of more than one in ``HOT`` rows, ``HOT`` at most, are joined by broadcast; no other key is hot. ``table``
    should be stored, as it's read three times.
    """
    hot = F.col("n") * HOT > total
    often = F.broadcast(table.where(hot))
    rest = rows.join(often.select(key), key, "left_anti").join(table.where(~hot), key)
    return rows.join(often, key).drop("n").unionByName(rest.drop("n"))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes with a link.

    Rounds of two steps: every node points at the smallest node among its neighbours and itself (large
    star), then so do their smaller ones (small star). They end when the links no longer change.
    """
    edges = stored(links.select("a", "b").where("a <> b"))
    total, before = edges.count(), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = looked_up(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small_least = stored(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = looked_up(down, small_least, "a", total).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s"))
        edges = stored(small.select(F.col("s.a").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total, before = now[0], now


def classes_of(own: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of ``own`` (doc_id, fp), which should be stored."""
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(ball_links(distinct))
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(distinct.select(F.col("fp").alias("node"), "first_id"), "node")
    smallest = stored(members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    total = smallest.agg(F.sum("n")).first()[0] or 0
    known = looked_up(members.select("root", F.col("node").alias("fp")), smallest, "root", total).select("fp", "component_id")
    classes = stored(distinct.join(known, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")))
    return looked_up(own, classes, "fp", own.count()).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return classes_of(stored(fingerprints(docs))).select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates, the one with the smallest id, with all its columns.

    Rows are told apart by their place in the scan, so repeated ids and repeated rows are one class too. The
    numbered rows are written once: another scan can be split otherwise and number them anew. A null text is like
    an empty one; of ids null comes last. An empty table gives no rows.
    """
    row = unused(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(row).alias("row")))
    kept = classes.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(first.alias("k")).select(F.col("k.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)

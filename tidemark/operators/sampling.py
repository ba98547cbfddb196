"""Reproducible samples and splits from hashed keys: the same rows at each run, in any order of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hashed
from tidemark.sources.shared import stored

from .grid import PATIENT, STAY


def stratified_sample(grid: DataFrame, max_rows: int, seed: int = 42) -> DataFrame:
    """About ``max_rows`` rows with the label's shares kept; all rows if there are no more.

    Each label's quota is rounded, and its rows are those of the smallest hashes. The grid is worked out once and
    written to the shared folder; one count of hashes in 65,536 bins gives the labels' numbers and the last bin
    of each, and only that bin's rows are ranked, so no label is sorted in one task.
    """
    h, bin_, rank = "_sample_hash", "_sample_bin", "_sample_rank"
    keyed = stored(grid.withColumn(h, hashed(seed, STAY, "hour")).withColumn(bin_, F.shiftright(h, 16)))
    bins: dict = {}
    for r in keyed.groupBy("label", bin_).count().collect():
        bins.setdefault(r["label"], []).append((r[bin_], r["count"]))
    counts = {label: sum(n for _, n in found) for label, found in bins.items()}
    total = sum(counts.values())
    if total <= max_rows:
        return keyed.select(grid.columns)
    quota = {k: round(max_rows * n / total) for k, n in counts.items()}
    whole, rest, left = F.lit(False), F.lit(False), F.lit(0)
    for label, found in bins.items():
        last, taken = last_bin(found, quota[label])
        same = F.col("label").eqNullSafe(F.lit(label))
        whole = whole | (same & (F.col(bin_) < last))
        rest = rest | (same & (F.col(bin_) == last))
        left = F.when(same, F.lit(quota[label] - taken)).otherwise(left)
    edge = keyed.where(rest).withColumn(rank, F.row_number().over(Window.partitionBy("label").orderBy(h, STAY, "hour"))).where(F.col(rank) <= left)
    return keyed.where(whole).select(grid.columns).union(edge.select(grid.columns))


def last_bin(found: list[tuple[int, int]], quota: int) -> tuple[int, int]:
    """The bin (of (bin, count) pairs) that a quota ends in, and how many the ones before it have."""
    taken = 0
    for b, n in sorted(found):
        if taken + n > quota:
            return b, taken
        taken += n
    return 1 << 16, taken


def group_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, group: str = PATIENT) -> DataFrame:
    """``split``: test for the ceil(share * n) groups of the smallest hashes, else train; groups stay whole.

    Counts of the groups' hashes in 65,536 bins tell the last bin, and only that bin's groups (a 65,536th, about) are ranked
    and looked up by broadcast.
    """
    h = hashed(seed, group)
    groups = df.select(F.col(group).alias("_group")).distinct().withColumn("_group_hash", hashed(seed, "_group"))
    bins = [(r["bin"], r["count"]) for r in groups.groupBy(F.shiftright("_group_hash", 16).alias("bin")).count().collect()]
    quota = math.ceil(test_share * sum(n for _, n in bins) - 1e-9)
    last, taken = last_bin(bins, quota)
    rank = F.row_number().over(Window.orderBy("_group_hash", "_group"))
    edge = groups.where(F.shiftright("_group_hash", 16) == last).withColumn("_rank", rank).where(F.col("_rank") <= quota - taken)
    found = df.join(F.broadcast(edge.select("_group", F.lit(True).alias("_edge"))), F.col(group).eqNullSafe(F.col("_group")), "left")
    test = (F.shiftright(h, 16) < last) | F.coalesce("_edge", F.lit(False))
    return found.select(*(F.col(c) for c in df.columns), F.when(test, "test").otherwise("train").alias("split"))


def capped_stays(stays: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A share of whole stays, so that no stay loses part of its events."""
    return stays.where(hashed(seed, STAY) < F.lit(int(share * 2**32)))


def diagnostics(grid: DataFrame) -> DataFrame:
    """One row: stays, patients, rows and the mean label."""
    return grid.agg(F.countDistinct(STAY).alias("n_stays"), F.countDistinct(PATIENT).alias("n_patients"), F.count("*").alias("n_rows"), F.avg("label").alias("positive_rate"))

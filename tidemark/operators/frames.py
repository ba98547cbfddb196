"""Labels from row frames over scored windows: rolling baseline, future maximum, their difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hours_between

from .grid import PATIENT, START, STAY

PAST, AHEAD = 6, 12


def delta_labels(scores: DataFrame, threshold: float = 2.0, past: int = PAST, ahead: int = AHEAD) -> DataFrame:
    """baseline, future, delta and label for scored windows (stay, window_start, score).

    baseline is the largest score of this and the ``past`` - 1 rows before; future that of the next
    ``ahead`` rows, null unless all of them exist. Nulls are skipped; a null delta has label 0.
    """
    w = Window.partitionBy(STAY).orderBy("window_start")
    after = w.rowsBetween(1, ahead)
    future = F.when(F.count(F.lit(1)).over(after) == ahead, F.max("score").over(after))
    out = scores.withColumns({"baseline": F.max("score").over(w.rowsBetween(1 - past, 0)), "future": future})
    out = out.withColumn("delta", F.col("future") - F.col("baseline"))
    return out.withColumn("label", F.coalesce((F.col("delta") >= threshold).cast("int"), F.lit(0)))


def with_scores(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """All windows with their score, by exact bounds; null where there is none."""
    return windows.join(scores.select(STAY, "window_start", "window_end", "score"), [STAY, "window_start", "window_end"], "left")


def score_grid(labels: DataFrame, stays: DataFrame, min_hours: float = 6) -> DataFrame:
    """Labelled windows as a grid: hour is the window's end, kept from ``min_hours`` after the start on."""
    bounds = stays.dropDuplicates([STAY]).select(STAY, PATIENT, START)
    joined = labels.drop(PATIENT).join(bounds, STAY)
    return joined.where(hours_between(START, "window_end") >= min_hours).select(STAY, PATIENT, F.col("window_end").alias("hour"), "label")


def with_stay_scores(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """Every window with its stay's one ``score``, null if the stay has none: where there are no scores by window."""
    return windows.join(scores.select(STAY, "score").dropDuplicates([STAY]), STAY, "left")

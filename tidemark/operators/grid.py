"""Time grids: one row for each hour, or each window, of a stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hour_floor, hours_between, micros

#: Columns of stays that the operators read.
STAY, PATIENT, START, END = "stay_id", "patient_id", "admission", "discharge"
#: Where a row stands for several hours from ``hour`` on: how many. A table without it has a row for each.
HOURS = "n_hours"


def valid_stays(stays: DataFrame) -> DataFrame:
    """Stays with both bounds and an end after the start."""
    return stays.where(F.col(START).isNotNull() & F.col(END).isNotNull() & (F.col(END) > F.col(START)))


def spread(stays: DataFrame) -> DataFrame:
    """The stays dealt over all cores: they are few and small, and without it the hours of all would come from one or few tasks."""
    return stays.repartition(4 * stays.sparkSession.sparkContext.defaultParallelism)


#: Rows of a grid that one task takes: the widest features aggregate some kilobytes for each.
ROWS_A_TASK = 64_000


def tasks_for(grid: DataFrame) -> int:
    """How many tasks the rows of a grid ask for."""
    return max(1, -(-grid.count() // ROWS_A_TASK), min(grid.sparkSession.sparkContext.defaultParallelism, 64))


def dealt_grid(grid: DataFrame, near: Column | None = None, tasks: int | None = None) -> DataFrame:
    """The (stay, hour) of a grid, each once, dealt by both (or by the stay and ``near``, made from the hour) to as many tasks as their number asks for.

    They are dealt first and made distinct where they arrive, so no task holds more than its share, however few tasks
    the grid came from.
    """
    keys = grid.select(STAY, "hour", *([] if near is None else [near]))
    return keys.repartition(tasks or tasks_for(keys), STAY, keys.columns[-1]).distinct()


def hourly_rows(stays: DataFrame) -> DataFrame:
    """stay_id, patient_id, hour and hours_in: every whole hour from the start's hour on that ends by the stay's end."""
    floor = hour_floor(START)
    n = F.floor((micros(END) - micros(floor)) / 3.6e9).cast("int")
    each = spread(valid_stays(stays)).withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    hour = floor + F.make_dt_interval(hours=F.col("_k"))
    return each.select(STAY, PATIENT, hour.alias("hour"), hours_between(START, hour).alias("hours_in"))


def hourly_grid(stays: DataFrame, min_hours: float = 6) -> DataFrame:
    """The hourly rows that lie ``min_hours`` or more after the stay's (not floored) start."""
    return hourly_rows(stays).where(F.col("hours_in") >= min_hours)


def hour_runs(stays: DataFrame, changes: DataFrame, min_hours: float = 6) -> DataFrame:
    """The hourly grid as runs of hours: stay_id, patient_id, hour (a run's first) and ``HOURS``.

    A run begins with a stay's first hour and with each hour of ``changes`` (stay_id, hour) in its grid. What changes only there, as windows
    do only where they gain or lose a row, is the same in all hours of a run and worked out once.
    """
    floor = hour_floor(START)
    n = F.floor((micros(END) - micros(floor)) / 3.6e9).cast("int")
    first = F.greatest(F.ceil((F.lit(min_hours * 3.6e9).cast("long") + micros(START) - micros(floor)) / 3.6e9), F.lit(0)).cast("int")
    at = [(floor + F.make_dt_interval(hours=k)).alias(name) for k, name in ((first, "hour"), (n, "_end"))]
    starts = valid_stays(stays).where(first < n).select(STAY, PATIENT, *at)
    inside = (F.col("hour") > F.col("_first")) & (F.col("hour") < F.col("_end"))
    later = changes.select(STAY, "hour").distinct().join(starts.withColumnRenamed("hour", "_first"), STAY).where(inside).select(starts.columns)
    end = F.coalesce(F.lead("hour").over(Window.partitionBy(STAY).orderBy("hour")), F.col("_end"))
    return starts.unionByName(later).withColumn(HOURS, ((micros(end) - micros("hour")) / 3.6e9).cast("int")).drop("_end")


def each_hour(runs: DataFrame) -> DataFrame:
    """Runs of hours as a row for each hour."""
    at = F.explode(F.sequence(F.lit(0), F.col(HOURS) - 1)).alias("_k")
    return runs.select("*", at).withColumn("hour", F.col("hour") + F.make_dt_interval(hours=F.col("_k"))).drop(HOURS, "_k")


def cohort_windows(stays: DataFrame) -> DataFrame:
    """Windows of an hour that follow each other from the start on, the last cut at the end: (window_start, window_end]."""
    n = F.ceil(hours_between(START, END)).cast("int")
    each = valid_stays(stays).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col(START) + F.make_dt_interval(hours=F.col("_k"))
    end = F.least(F.col(START) + F.make_dt_interval(hours=F.col("_k") + 1), F.col(END))
    return each.select(STAY, PATIENT, start.alias("window_start"), end.alias("window_end"))


def first_windows(windows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` windows of each stay."""
    rank = F.row_number().over(Window.partitionBy(STAY).orderBy("window_start"))
    return windows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

"""A grid is dealt to as many tasks as its rows ask for, and each (stay, hour) is there once."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import grid, lookback


def test_tasks_grow_with_the_grid(spark, monkeypatch):
    monkeypatch.setattr(grid, "ROWS_A_TASK", 500)
    stays = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("stay_id"), F.lit("p").alias("patient_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("admission"), F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz").alias("discharge"))
    hours = grid.hourly_rows(stays)
    assert hours.count() == 40 * 96 and max(hours.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 40 * 96 / 4
    twice = hours.unionByName(hours)
    dealt = grid.dealt_grid(twice)
    assert dealt.rdd.getNumPartitions() == 16  # 7,680 rows
    assert dealt.count() == 40 * 96 and dealt.exceptAll(hours.select("stay_id", "hour")).isEmpty()


def test_panes_of_a_large_grid_are_dealt_by_its_size(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    stays = spark.range(30).select(F.col("id").cast("string").alias("stay_id"), F.lit("p").alias("patient_id"), F.lit(start).cast("timestamp_ntz").alias("admission"), F.lit(start + dt.timedelta(days=2)).cast("timestamp_ntz").alias("discharge"))
    values = spark.range(6000).select(
        (F.col("id") % 30).cast("string").alias("stay_id"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7 % 2900).cast("int"))).alias("ts"), F.when(F.col("id") % 3 > 0, "sbp").otherwise("map").alias("category"), (F.col("id") % 101).cast("double").alias("value")
    )
    hours, columns = grid.hourly_grid(stays), ["sbp", "map"]
    few = lookback.block(hours, values, columns)
    monkeypatch.setattr(grid, "ROWS_A_TASK", 100)
    many = lookback.block(hours, values, columns)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.fillna(-1.0).collect())
    assert rows(few) == rows(many) and few.count() == 30 * 42
    states, usable = lookback.value_states(F.col("value")), values
    assert lookback.panes(usable, states, ["category"], 13).rdd.getNumPartitions() == 13
    assert many._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3

"""Slopes of two readings a moment apart, and labels of any times, as SQL has them."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import forward, lookback

BEGIN = dt.datetime(2024, 1, 12, 6)


def test_slope_of_two_close_readings_equals_sql(spark, duck):
    at = [BEGIN + dt.timedelta(minutes=2, microseconds=k * 7_654_321) for k in range(8)]
    pairs = [(str(k), t + dt.timedelta(microseconds=d), "a", v) for k, t in enumerate(at) for d, v in ((0, 20.0 + 31 * k), (1_234_567, 4.25))]
    rows = spark.createDataFrame(pairs, "stay_id string, ts timestamp_ntz, category string, value double")
    grid = spark.createDataFrame([(str(k), BEGIN + dt.timedelta(hours=h)) for k in range(8) for h in range(1, 7)], "stay_id string, hour timestamp_ntz")
    expected = {}
    for k in range(8):
        values = ", ".join(f"(TIMESTAMP '{t}', {v}::DOUBLE)" for s, t, _, v in pairs if s == str(k))
        expected[str(k)] = round(duck.sql(f"SELECT regr_slope(v, epoch_us(t) / 3.6e9 - 475000.0) FROM (VALUES {values}) r(t, v)").fetchall()[0][0], 3)
    got = lookback.long_statistics(grid, rows, "row").select("stay_id", F.round("slope", 3).alias("slope")).collect()
    assert len(got) == 48 and all(r["slope"] == expected[r["stay_id"]] for r in got)


def test_range_labels_join_the_grid_once(spark):
    ends = [BEGIN, BEGIN + dt.timedelta(hours=1), BEGIN + dt.timedelta(minutes=30)]
    grid = spark.createDataFrame([("0", BEGIN + dt.timedelta(hours=12 * k, minutes=m)) for k in (-1, 0) for m in (-1, 0, 29, 30, 31)], "stay_id string, hour timestamp_ntz")
    for end in ends:
        events = spark.createDataFrame([("0", end)], "stay_id string, ts timestamp_ntz")
        found = forward.label_range(grid, events, "event")
        assert {r["hour"]: r["event"] for r in found.collect()} == {r["hour"]: r["hour"] < end <= r["hour"] + dt.timedelta(hours=12) for r in grid.collect()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1

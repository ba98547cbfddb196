"""Windows merged from panes against windows of single rows, on a dense source with one hot hour, and against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookback

BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def dense(spark):
    """120 readings in each hour of three stays and 20,000 in one hour; ties, nulls and a value that doesn't change among them."""
    steady = spark.range(3 * 24 * 120).select((F.col("id") % 3).cast("string").alias("stay_id"), (F.col("id") * 10).alias("s"), F.col("id"))
    hot = spark.range(20_000).select(F.lit("0").alias("stay_id"), (F.lit(5 * 3600) + (F.col("id") * 7919) % 3600).alias("s"), (F.col("id") + 10**6).alias("id"))
    rows = steady.unionByName(hot)
    kind = F.when(F.col("id") % 5 == 0, "Steady").when(F.col("id") % 2 == 0, "a").otherwise("b")
    value = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 5 == 0, 36.6).otherwise(F.pmod(F.hash("id"), F.lit(1000)) / 7.0 + 1000)
    ts = F.lit(BEGIN).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))
    return rows.select("stay_id", ts.alias("ts"), kind.alias("category"), value.alias("value")).persist()


@pytest.fixture(scope="module")
def hours_(spark):
    return spark.range(3 * 30).select((F.col("id") % 3).cast("string").alias("stay_id"), (F.lit(BEGIN).cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor(F.col("id") / 3).cast("int"))).alias("hour"))


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1e-7 * max(1, abs(a)))


@pytest.mark.parametrize("mode", ["train", "row"])
def test_panes_equal_single_rows(dense, hours_, mode):
    on_grid = lookback.block(hours_, dense, ["a", "b", "steady"], mode)
    singly = lookback.block(hours_, dense, ["a", "b", "steady"], mode, at_any_time=True)
    got, expected = ({(r["stay_id"], r["hour"]): r.asDict() for r in df.collect()} for df in (on_grid, singly))
    assert got.keys() == expected.keys() and len(got) == 90
    for key, row in expected.items():
        for name, value in row.items():
            assert close(got[key][name], value) if isinstance(value, float) else got[key][name] == value, (key, name)
        assert got[key]["steady_std"] in (0.0, None) and got[key]["steady_slope"] in (0.0, None)


@pytest.mark.parametrize("mode", ["train", "row"])
def test_panes_equal_pandas(dense, hours_, mode):
    got = {(r["stay_id"], r["hour"], r["category"]): r for r in lookback.long_statistics(hours_, dense, mode).collect()}
    e = dense.where("value IS NOT NULL").toPandas()
    e["category"] = e["category"].str.lower()
    e = e.sort_values(["ts", "value"])
    checked = 0
    for r in hours_.collect():
        own = e[(e.stay_id == r["stay_id"]) & (e.ts > pd.Timestamp(r["hour"]) - pd.Timedelta(hours=6)) & (e.ts <= pd.Timestamp(r["hour"]))]
        for kind, w in own.groupby("category"):
            row, v = got[(r["stay_id"], r["hour"], kind)], w.value.to_numpy()
            t = (w.ts - w.ts.iloc[-1]).dt.total_seconds().to_numpy() / 3600
            first = w[w.ts == w.ts.iloc[0]].value.min()
            slope = (v[-1] - first) / (t[-1] - t[0]) if mode == "train" else np.polyfit(t, v, 1)[0]
            assert close(row["last"], v[-1]) and close(row["mean"], v.mean()) and (row["min"], row["max"]) == (v.min(), v.max())
            assert abs(row["std"] - v.std(ddof=int(mode == "train"))) < 1e-5 and abs(row["slope"] - slope) < 1e-4
            checked += 1
    assert checked == len(got) > 200


def test_a_pane_is_one_row_whatever_its_readings(dense):
    states = lookback.value_states(F.col("value"))
    made = lookback.panes(dense.where("value IS NOT NULL").withColumn("category", F.lower("category")), states, ["category"])
    usable = dense.where("value IS NOT NULL").count()
    # What windows are dealt: six of each pane, instead of six of each reading.
    assert made.count() * 3 < usable
    hot = made.where("stay_id = '0'").orderBy(F.desc("_n")).first()
    assert hot["_n"] > 7000 and made.groupBy("stay_id", "_pane", "category").count().where("count > 1").count() == 0


def test_parts_of_one_pass_keep_apart(spark):
    at = [BEGIN + dt.timedelta(minutes=10 * k) for k in range(12)]
    rows = spark.createDataFrame([("0", t, float(k), "Urine" if k % 2 else None) for k, t in enumerate(at)], "stay_id string, ts timestamp_ntz, amount double, fluid_name string")
    grid = spark.createDataFrame([("0", BEGIN + dt.timedelta(hours=h)) for h in range(4)] + [("1", BEGIN)], "stay_id string, hour timestamp_ntz")
    parts = [lookback.fluid_part(rows), lookback.medication_part(rows.withColumnRenamed("amount", "dose")), lookback.last_part(rows, ["amount", "fluid_name"])]
    got = {(r["stay_id"], r["hour"].hour): r for r in lookback.in_one_pass(grid, parts).collect()}
    assert got["0", 1]["urine_output"] == 1 + 3 + 5 and got["0", 1]["vasopressor_max_dose"] == 6 and got["0", 1]["amount"] == 6 and got["0", 1]["fluid_name"] == "Urine" and got["0", 1]["_rows"] == 7
    assert got["1", 0]["urine_output"] is None and got["1", 0]["vasopressor_active"] == 0 and got["1", 0]["_rows"] is None
    assert got["0", 1]["net_fluid"] is None

"""Evaluations and importances count rows of equal codes together, cuts are exact where values are few, and the last mode is a number that orders as its text."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_boosting import frame, table
from tidemark.operators import boosting, lookback, model


def test_importance_of_distinct_codes_is_that_of_all_rows(spark):
    x, y = table(8, 300)
    x, y = np.repeat(x, 4, 0), np.repeat(y, 4)
    columns = [f"f{k}" for k in range(x.shape[1])]
    rows = frame(spark, x, y).repartition(3)
    fitted = model.RiskModel(boosting.train_forest(rows, columns, rounds=3, depth=3), x[:9])
    few = boosting.distinct_codes(fitted.forest, rows, label=True).collect()
    codes = {(c.tobytes(), int(k)) for c, k in zip(fitted.forest.codes(x), y, strict=True)}
    assert len(few) == len(codes) < len(x) and sum(r["n"] for r in few) == len(x)
    keyed = rows.withColumns({"stay_id": F.lit("a"), "hour": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    whole = {r["feature"]: r["mean_abs"] for r in model.importance(model.explain(fitted, keyed), columns).collect()}
    found = {r["feature"]: r["mean_abs"] for r in model.mean_importance(fitted, rows).collect()}
    assert found == pytest.approx(whole, abs=1e-12)
    assert model.mean_importance(fitted, rows.limit(0)).count() == 0
    assert fitted.forest.margins_once(x, {}).tolist() == fitted.forest.margins(x).tolist()


def test_sixty_three_values_are_all_cuts_and_64_are_quantiles(spark):
    rows = spark.range(2000).select((F.col("id") % 63).cast("double").alias("a"), (F.col("id") % 64).alias("b"), F.lit(None).cast("double").alias("c"), F.lit(float("nan")).alias("d"))
    cuts = boosting.cuts_of(rows.repartition(5), ["a", "b", "c", "d"])
    assert cuts[0].tolist() == list(range(1, 63)) and len(cuts[1]) <= 63 and cuts[1].min() > 0 and not len(cuts[2]) and not len(cuts[3])


def test_last_mode_by_place_is_last_mode_by_text(spark):
    at, values = dt.datetime(2024, 1, 1, 10), ["b", "d"]
    texts = ["a", "b", "bb", "c", "d", "e", None]
    rows = [(f"{i}{k}", at, t) for i, first in enumerate(texts) for k, second in enumerate(texts) for t in (first, second)]
    events = spark.createDataFrame(rows, "stay_id string, ts timestamp_ntz, category string")
    grid = events.select("stay_id", F.col("ts").alias("hour")).distinct()
    by_text = lookback.last_part(events, ["category"], finish=lambda df: lookback.one_hot(df, "category", values).drop("category", "_rows"))
    one, two = (lookback.in_one_pass(grid, [p]) for p in (by_text, lookback.mode_part(events, "category", values)))
    assert one.columns == two.columns and sorted(one.collect()) == sorted(two.collect()) and one.count() == 49
    assert "SortAggregate" not in two._jdf.queryExecution().executedPlan().toString().split("Generate")[0]

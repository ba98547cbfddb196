"""Runs of hours with equal windows stand for their hours: in grids, features, labels, training, quantiles and attributions."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_boosting import frame, table
from tidemark.operators import boosting, forward, grid, lookback, model
from tidemark.operators.grid import HOURS
from tidemark.plans import inputs, registry


def same(one, two):
    assert one.columns == two.columns and one.exceptAll(two).count() == 0 == two.exceptAll(one).count()


def test_runs_are_the_hourly_grid(spark):
    at = dt.datetime(2024, 1, 1)
    bounds = [("00:00:00", 9), ("00:59:59.999999", 9), ("01:00:00.000001", 30), ("00:30:00", 6.5), ("00:30:00", 5), ("00:00:00", 6), ("02:00:00", 7), ("03:00:00", -2), ("05:45:00", 400)]
    rows = []
    for k, (start, length) in enumerate(bounds):
        begin = dt.datetime.fromisoformat(f"2024-01-01 {start}")
        rows.append((str(k), "p", begin, begin + dt.timedelta(hours=length)))
    stays = spark.createDataFrame([*rows, ("none", "p", at, None)], "stay_id string, patient_id string, admission timestamp_ntz, discharge timestamp_ntz")
    changes = spark.createDataFrame([(str(k), at + dt.timedelta(hours=h)) for k in range(len(bounds)) for h in (-3, 0, 6, 7, 7, 8, 20, 500)], "stay_id string, hour timestamp_ntz")
    for least in (6, 0, 2.5):
        runs = grid.hour_runs(stays, changes, least)
        whole = grid.hourly_grid(stays, least).drop("hours_in")
        assert runs.where(F.col(HOURS) < 1).count() == 0 and 0 < runs.count() < whole.count() / 4
        same(grid.each_hour(runs), whole)


def test_runs_have_the_features_and_labels_of_their_hours(spark):
    kept = registry._kept_labelled(spark, SMALL)
    hourly = registry._labelled(spark, SMALL)
    assert kept.count() < hourly.count() / 3 and kept.agg(F.sum(HOURS)).first()[0] == hourly.count()
    columns = hourly.columns
    near = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in hourly.dtypes]
    same(grid.each_hour(kept).select(columns).select(near), hourly.select(near))


def test_windows_of_runs_with_busy_hours_and_many_tasks(spark, monkeypatch):
    """Panes of parts dealt to many tasks, stays without a row in any window, and rows before the grid's first hour."""
    monkeypatch.setattr(grid, "ROWS_A_TASK", 7)
    at = dt.datetime(2024, 1, 1)
    rows = [(str(k), at + dt.timedelta(minutes=7 * i * (k + 1)), "view", float(i % 5)) for k in range(3) for i in range(150)]
    events = spark.createDataFrame(rows, "stay_id string, ts timestamp_ntz, category string, value double")
    stays = spark.createDataFrame([(str(k), "p", at, at + dt.timedelta(hours=200)) for k in range(4)], "stay_id string, patient_id string, admission timestamp_ntz, discharge timestamp_ntz")
    runs = grid.hour_runs(stays, lookback.window_changes(events).unionByName(forward.label_changes(events)))
    part = [lookback.block_part(events, ["view"]), lookback.mode_part(events, "category", ["click", "view"])]
    found = grid.each_hour(lookback.in_one_pass(runs, part).join(runs.drop("patient_id"), ["stay_id", "hour"]))
    hourly = lookback.in_one_pass(grid.hourly_grid(stays), part)
    near = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in hourly.dtypes]
    same(found.select(hourly.columns).select(near), hourly.select(near))


def runs_of(spark, n, seed):
    """A frame of runs with every number of hours up to nine, and its hours."""
    x, y = table(seed, n)
    keys = F.row_number().over(grid.Window.orderBy(*(f"f{k}" for k in range(x.shape[1])), "label"))
    runs = frame(spark, x, y).withColumn("_at", keys).withColumn(HOURS, (F.col("_at") % 9 + 1).cast("int"))
    hour = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("_at") * 10).cast("int"))
    runs = runs.withColumns({"stay_id": (F.col("_at") % 7).cast("string"), "hour": hour}).drop("_at").persist()
    return runs, grid.each_hour(runs), x, [f"f{k}" for k in range(x.shape[1])]


def test_a_model_of_runs_is_that_of_their_hours(spark):
    runs, hours, x, columns = runs_of(spark, 300, 11)
    one, two = model.train(runs, 3, 3), model.train(hours, 3, 3)
    assert one.columns == two.columns == columns and (one.forest.margins(x) == two.forest.margins(x)).all()
    assert len(one.background) == model.BACKGROUND and np.array_equal(one.background, two.background, equal_nan=True)
    assert model.mean_importance(one, runs).collect() == model.mean_importance(two, hours).collect()
    counts = [sorted(boosting.round_counts(one.forest, rows).collect()) for rows in (runs, hours)]
    assert counts[0] == counts[1]


def test_top_contributions_of_runs_are_those_of_their_hours(spark, monkeypatch):
    runs, hours, x, columns = runs_of(spark, 300, 12)
    fitted = model.train(runs, 4, 4)
    shown = model.top_contributions(model.explain(fitted, hours), columns, 3)
    for rows in (runs, hours):
        same(model.top_of_rows(fitted, rows, 3), shown)
    assert model.top_of_rows(fitted, runs).count() == hours.count() * len(columns)
    # A run is worked out once, however many hours it has.
    monkeypatch.setattr(boosting.Explainer, "values", lambda self, x: np.zeros_like(x))
    explainer, asked = boosting.Explainer(fitted.forest, fitted.background), []
    monkeypatch.setattr(boosting.Explainer, "values", lambda self, x: asked.append(len(x)) or np.zeros_like(x))
    explainer.values_once(np.repeat(x, 9, 0), {})
    assert sum(asked) <= len(x)


def test_rounding_is_that_of_round(spark):
    values = np.concatenate([[0.1234565, -0.1234565, 2.5e-6, -5e-7, 4.9999999e-7, 0.0, -0.0, -1e-9, 1.5e9, 123456789.1234565], np.random.default_rng(1).normal(size=500)])
    expected = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert model.six_places(values).tolist() == expected


def test_quantiles_of_chunks_are_near_those_of_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values, weight = rng.gamma(0.5, size=30_000), rng.integers(1, 7, 30_000)
    whole = np.sort(np.repeat(values, weight))
    rows = spark.createDataFrame(zip(values.tolist(), weight.tolist(), strict=True), f"a double, {HOURS} int").repartition(3)
    for chunk in (1 << 16, 4000):
        monkeypatch.setattr(boosting, "CHUNK", chunk)
        cuts = boosting.cuts_of(rows, ["a"])[0]
        share = np.searchsorted(whole, cuts, "right") / len(whole)
        assert len(cuts) == boosting.BINS - 1 and np.abs(share - np.arange(1, boosting.BINS) / boosting.BINS).max() < 1.5 / (20 * boosting.BINS)
    few, weights = boosting.points(np.array([3.0, 1, 3, 2]), np.array([1, 5, 2, 4]), 10)
    assert few.tolist() == [1, 2, 3] and weights.tolist() == [5, 4, 3]


def test_an_explained_moment_reads_the_events_once_and_of_its_stay(spark, monkeypatch):
    rows = registry._features(spark, SMALL).withColumn("label", (F.coalesce("view_last", F.lit(0.0)) > 100).cast("int"))
    fitted = model.train(rows, trees=2, depth=2)
    monkeypatch.setattr(registry, "_trained", lambda spark, sf_dir: fitted)
    found = registry.queries()["model_explain_moment"](spark, SMALL)
    assert not any("events" in f for f in found.inputFiles())
    first = registry._moments(spark, SMALL).orderBy("stay_id", F.desc("hour")).limit(1)
    same(found, model.explain_moment(fitted, registry._features(spark, SMALL, first)))
    assert found.count() == 15 and inputs.events(spark, SMALL).count() > 0

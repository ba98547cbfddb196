"""The risk model and its attributions, and the streaming forms against the batch forms."""

import datetime as dt

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators import lookback, model
from tidemark.plans import inputs, registry
from tidemark.streaming.lookback import label_stream, lookback_stream


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(str(k % 40), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(k % 7) if k % 5 else None, float(k % 3), int(k % 7 > 3), "train" if k % 4 else "test") for k in range(400)]
    return spark.createDataFrame(rows, "stay_id string, hour timestamp_ntz, a double, b double, label int, split string")


def test_model_learns_and_explains(spark, matrix, tmp_path):
    fitted = model.train(matrix, trees=4, depth=2)
    assert fitted.columns == ["a", "b"]
    scored = fitted.score(matrix)
    assert scored.where("a IS NOT NULL").select(F.avg(((F.col("risk") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0] > 0.9
    explained = model.explain(fitted, matrix)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    raw = F.log(F.col("risk") / (1 - F.col("risk")))
    assert explained.join(scored.select("stay_id", "hour", raw.alias("raw")), ["stay_id", "hour"]).select(F.max(F.abs(total - F.col("raw")))).first()[0] < 1e-9
    assert model.importance(explained, fitted.columns).first()["feature"] == "a"
    top = model.top_contributions(explained, fitted.columns, 1)
    assert top.count() == 400 and {r[0] for r in top.select("rank").distinct().collect()} == {1}
    # A loaded model gives the same scores and attributions.
    fitted.save(spark, f"{tmp_path}/m")
    loaded = model.RiskModel.load(spark, f"{tmp_path}/m")
    assert loaded.score(matrix).collect() == scored.collect() and model.explain(loaded, matrix).collect() == explained.collect()


def test_absent_features_are_what_nothing_measured_gives(spark, matrix):
    renamed = matrix.withColumnsRenamed({"a": "x_missing", "b": "mode_x"})
    fitted = model.train(renamed, trees=3, depth=2)
    keys = renamed.select("stay_id", "hour")
    assert fitted.score(keys).select("risk").collect() == fitted.score(keys.withColumns({"x_missing": F.lit(1), "mode_x": F.lit(0)})).select("risk").collect()
    assert fitted.score(keys).columns == ["stay_id", "hour", "risk"]


def test_model_queries_train_all_rounds(spark, monkeypatch):
    class Asked(Exception):
        pass

    def asked(rows, columns, rounds, depth):
        raise Asked(rounds, depth)

    monkeypatch.setattr(model, "train_forest", asked)
    with pytest.raises(Asked) as found:
        registry.queries()["model_predictions"](spark, SMALL)
    assert found.value.args == (100, 6)


def test_a_moment_on_the_grid_is_explained_like_its_row(spark):
    """From tables to drivers at a whole hour: the same as the row of the whole matrix, features made off the grid or on it."""
    events = inputs.events(spark, SMALL)
    hour = inputs.grid(spark, SMALL).orderBy("stay_id", F.desc("hour")).limit(1)
    rows = registry._features(spark, SMALL).withColumn("label", (F.col("view_last") > 100).cast("int")).fillna({"label": 0})
    fitted = model.train(rows, trees=3, depth=3)
    at = hour.collect()[0]
    on_grid = rows.where((F.col("stay_id") == at["stay_id"]) & (F.col("hour") == at["hour"]))
    shown = model.explain_moment(fitted, on_grid.drop("label"))
    found = model.explain_moment(fitted, registry._features(spark, SMALL, hour))
    assert sorted(found.collect()) == sorted(shown.collect()) and found.count() == 15
    assert found.agg(F.min("rank"), F.max("rank")).first() == (1, 15) and events.count() > 0


def run_stream(spark, tmp_path, transform, mode):
    events = inputs.events(spark, SMALL)
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = transform(stream).writeStream.format("memory").queryName("found").outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return events, spark.table("found")


def test_lookback_stream_equals_batch(spark, tmp_path):
    events, got = run_stream(spark, tmp_path, lookback_stream, "complete")
    rows = lookback.dealt(events).groupBy("stay_id", "hour", "category").agg(F.max_by("value", F.struct("ts", "value")).alias("last"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    found = got.select("stay_id", "hour", "category", "last", F.round("mean", 6).alias("mean"), "n")
    assert found.exceptAll(rows).count() == 0 == rows.exceptAll(found).count()


def test_label_stream_counts_forward_events(spark, tmp_path):
    events, got = run_stream(spark, tmp_path, label_stream, "complete")
    from tidemark.operators.forward import hours_before

    rows = events.select("stay_id", F.explode(hours_before(F.col("ts"))).alias("hour")).groupBy("stay_id", "hour").agg(F.count("*").alias("n"))
    assert got.exceptAll(rows).count() == 0 == rows.exceptAll(got).count()

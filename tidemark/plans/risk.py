"""The whole risk job: tables to labelled grid, features, model, predictions, metrics and importances."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import hashed, utc
from tidemark.operators import assemble, forward, frames, grid, metrics, model, sampling, serve
from tidemark.operators.grid import END, PATIENT, START, STAY
from tidemark.sources.cache import FolderCache
from tidemark.sources.tables import Settings, cap_stays, load_catalog, load_table, write_results

_EXPLAINED = FolderCache()
#: Rows of the grid beyond which a run says how many there are.
MANY_WINDOWS = 1_000_000


def as_stays(catalog: dict[str, DataFrame | None]) -> dict[str, DataFrame | None]:
    """The catalog with the operators' names for stays and their bounds."""
    names = {"hospitalization_id": STAY, "admission_dttm": START, "discharge_dttm": END}
    return {k: None if df is None else df.withColumnsRenamed(names) for k, df in catalog.items()}


def score_labels(spark: SparkSession, settings: Settings, stays: DataFrame, prefix: str = "") -> DataFrame:
    """Labels from the table ``scores`` (stay_id, window_start, window_end, score)."""
    scores = load_table(spark, settings.data_directory, "scores", prefix)
    scored = frames.with_scores(grid.cohort_windows(stays), scores)
    return frames.score_grid(frames.delta_labels(scored, settings.score_delta), stays)


def labelled_rows(spark: SparkSession, settings: Settings, prefix: str = "") -> tuple[DataFrame, dict[str, DataFrame | None]]:
    """stay_id, patient_id, hour and label; and the catalog. Stays, not rows of tables, are what a cap leaves out."""
    catalog = load_catalog(spark, settings.data_directory, prefix)
    if settings.max_rows_per_table is not None:
        catalog = cap_stays(catalog, settings.max_rows_per_table, settings.seed)
    catalog = as_stays(catalog)
    stays = grid.valid_stays(catalog["hospitalization"].select(STAY, PATIENT, START, END))
    labels = score_labels(spark, settings, stays, prefix) if settings.score_labels else forward.labelled_grid(grid.hourly_grid(stays), catalog)
    labels = labels.select(STAY, PATIENT, "hour", "label")
    return (labels if settings.max_windows is None else sampling.stratified_sample(labels, settings.max_windows, settings.seed)), catalog


def run(spark: SparkSession, settings: Settings, prefix: str = "") -> dict[str, float | None]:
    """Writes predictions, feature list, metrics and importances under ``out_directory``; returns the test side's metrics."""
    labels, catalog = labelled_rows(spark, settings, prefix)
    labels = labels.persist()
    facts = sampling.diagnostics(labels).first()
    if not facts["n_rows"]:
        raise ValueError("the labelled grid is empty")
    if facts["n_rows"] > MANY_WINDOWS:
        print(f"{facts['n_rows']} windows")
    features = assemble.clinical_features(labels, catalog)
    rows = sampling.group_split(assemble.with_labels(features, labels).join(labels.select(STAY, PATIENT).distinct(), STAY), settings.test_share, settings.seed)
    fitted = model.train(rows, seed=settings.seed)
    scored = fitted.score(rows)
    test = scored.where("split = 'test'").select(F.col("risk").alias("score"), "label")
    out = {"auroc": metrics.auroc(test).first()[0], "average_precision": metrics.average_precision(test).first()[0]}
    to = settings.out_directory
    write_results(assemble.prediction_table(scored), f"{to}/predictions.parquet")
    fitted.save(spark, f"{to}/model")
    share = min(1.0, settings.explain_rows / facts["n_rows"])
    sample = rows.where(hashed(settings.seed, STAY, "hour") < int(share * 2**32))
    write_results(model.importance(model.explain(fitted, sample), fitted.columns), f"{to}/importance.csv", "csv")
    small = {"features": json.dumps(fitted.columns), "metrics": json.dumps(out), "settings": json.dumps(asdict(settings), default=str)}
    write_results(spark.createDataFrame(sorted(small.items()), "name string, json string"), f"{to}/artifacts.json", "json")
    labels.unpersist()
    return out


def moment_features(spark: SparkSession, catalog: dict[str, DataFrame | None], fitted: model.RiskModel, stay: str, moment: str) -> DataFrame:
    """The features of one stay at one moment, on the hour or off it, from the rows of that stay only."""
    own = {k: df.where(F.col(STAY) == stay) if df is not None and STAY in df.columns else df for k, df in catalog.items()}
    at = spark.range(1).select(F.lit(stay).alias(STAY), utc(F.lit(moment)).alias("hour"))
    modes = [c.removeprefix("mode_") for c in fitted.columns if c.startswith("mode_")]
    return assemble.clinical_features(at, own, modes=modes, at_any_time=True)


def explain(spark: SparkSession, settings: Settings, stay: str, moment: str, prefix: str = "") -> DataFrame:
    """One row on a prediction of a finished run: its risk and label, the drivers of the moment and the series before it.

    The prediction is looked up in ``out_directory``; LookupError if there is none. The model is loaded from there, and features and series
    are made from the tables for that moment. Answers are kept until the tables or the run change.
    """
    out = settings.out_directory
    tables = load_catalog(spark, settings.data_directory, prefix)
    found = spark.read.parquet(f"{out}/predictions.parquet")
    predictions = found.withColumnsRenamed({"timestamp": "hour", "risk_score": "risk"})
    row = serve.lookup(predictions, stay, moment).first()
    if row is None:
        raise LookupError(f"no prediction of {stay} at {moment}")

    def make(path: str) -> None:
        fitted, catalog = model.RiskModel.load(spark, f"{out}/model"), as_stays(tables)
        drivers = model.explain_moment(fitted, moment_features(spark, catalog, fitted, stay, moment))
        listed = drivers.groupBy(STAY).agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "value", "contribution", "direction"))).alias("drivers"))
        own = {k: df for k, df in catalog.items() if df is not None and STAY in df.columns}
        series = serve.moment_series(own, stay, moment).agg(F.map_from_entries(F.collect_list(F.struct("key", "points"))).alias("series"))
        about = [F.lit(row[c]).alias(c) for c in (PATIENT, "label", "split")]
        # Both sides are one row.
        one = listed.withColumn("_one", F.lit(1)).join(series.withColumn("_one", F.lit(1)), "_one")
        one.select(STAY, *about, utc(F.lit(moment)).alias("moment"), F.lit(row["risk"]).alias("risk"), "drivers", "series").coalesce(1).write.parquet(path)

    inputs = [found, spark.read.parquet(f"{out}/model/nodes"), *(df for df in tables.values() if df is not None)]
    return spark.read.parquet(_EXPLAINED.folder(spark, f"explain {stay} {moment} {out}", inputs, make))

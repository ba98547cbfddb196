"""Risk model: boosted trees on the feature matrix, its predictions, and exact attributions of features.

Nulls are values of their own to the trees, which learn a side for them at each split. Attributions are Shapley values of the raw score
against a sample of ``BACKGROUND`` training rows that belongs to the model, so a row's attributions and the base value add up to its raw
score. A saved model has its trees, columns and background, and is loaded without training data. Features that a table to be
scored lacks are what they are where nothing was measured: 0 for flags and doses, 1 for ``*_missing``, else null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hashed

from .assemble import feature_columns
from .boosting import CHUNK, Explainer, Forest, distinct_codes, features_of, matrix, round_counts, train_forest
from .grid import HOURS, STAY, each_hour

#: Training rows that attributions compare with.
BACKGROUND = 200
#: Attributions shown of one moment.
DRIVERS = 15


def without_measurements(column: str) -> Column:
    """A feature's value where its table has nothing in the window."""
    if column.startswith("mode_") or column in ("vasopressor_active", "vasopressor_max_dose"):
        return F.lit(0.0)
    return F.lit(1.0) if column.endswith("_missing") else F.lit(None).cast("double")


class RiskModel(NamedTuple):
    forest: Forest
    background: np.ndarray

    @property
    def columns(self) -> list[str]:
        return self.forest.columns

    def aligned(self, df: DataFrame) -> DataFrame:
        """``df`` with all of the model's columns as doubles; others are left as they are."""
        return df.withColumns({c: F.col(c).cast("double") if c in df.columns else without_measurements(c) for c in self.columns})

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` and its ``risk``."""
        forest, width = self.forest, len(self.columns)

        @F.arrow_udf("double")
        def risk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[bytes, float] = {}
            for x in batches:
                yield pa.array(1 / (1 + np.exp(-forest.margins_once(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), known))))

        full = self.aligned(df).withColumn("risk", risk(features_of(self.columns)))
        return full.select(*df.columns, "risk")

    def save(self, spark: SparkSession, path: str) -> None:
        self.forest.save(spark, path)
        spark.createDataFrame([(row.tolist(),) for row in self.background], "x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/background")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        forest = Forest.load(spark, path)
        rows = [r["x"] for r in spark.read.parquet(f"{path}/background").collect()]
        return cls(forest, np.array(rows, float).reshape(-1, len(forest.columns)))


def train(df: DataFrame, trees: int = 100, depth: int = 6, seed: int = 42) -> RiskModel:
    """From a feature matrix with ``label`` and ``split`` (rows of the test side aren't looked at); of runs of hours if it has ``HOURS``."""
    rows = df.where("split = 'train'") if "split" in df.columns else df
    columns = feature_columns(rows)
    return RiskModel(train_forest(rows, columns, trees, depth), background_of(rows, columns, seed))


def background_of(rows: DataFrame, columns: list[str], seed: int = 42) -> np.ndarray:
    """The features of the ``BACKGROUND`` hours with the smallest hashes; rows with ``HOURS`` stand for as many hours."""
    keys = rows.select(STAY, "hour", F.col("hour").alias("_row"), *(c for c in rows.columns if c == HOURS))
    each = each_hour(keys) if HOURS in keys.columns else keys
    least = each.select(F.col(STAY).alias("_stay"), "_row", hashed(seed, STAY, "hour").alias("_h")).orderBy("_h", "_stay", "_row").limit(BACKGROUND)
    found = rows.join(F.broadcast(least), (F.col(STAY) == F.col("_stay")) & (F.col("hour") == F.col("_row"))).select("_h", features_of(columns).alias("x")).orderBy("_h", "x")
    return np.array([r["x"] for r in found.collect()], float).reshape(-1, len(columns))


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``CHUNK`` rows, about: the more rows, the more of them are alike."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def explain(model: RiskModel, df: DataFrame) -> DataFrame:
    """stay_id, hour, base and ``contributions`` (one for each of the model's columns, in order) of each row."""
    explainer = df.sparkSession.sparkContext.broadcast(Explainer(model.forest, model.background))
    n = len(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in in_chunks(batches):
            values, m = explainer.value.values_once(matrix(batch, "x", n), known), batch.num_rows
            each = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(STAY), batch.column("hour"), pa.array(np.full(m, explainer.value.base)), each], [STAY, "hour", "base", "contributions"])

    rows = model.aligned(df).select(F.col(STAY).cast("string").alias(STAY), "hour", features_of(model.columns).alias("x"))
    return rows.mapInArrow(run, f"{STAY} string, hour timestamp_ntz, base double, contributions array<double>")


def rounds(model: RiskModel, df: DataFrame) -> DataFrame:
    """round and average_precision of the model after each round, on rows with ``label``: an evaluation set.

    Scores count in steps of a ten-thousandth; rows of equal step are one threshold.
    """
    counts = round_counts(model.forest, model.aligned(df))
    above = Window.partitionBy("round").orderBy(F.col("step").desc())  # one row for each step at most
    tp, seen = F.sum("pos").over(above), F.sum(F.col("pos") + F.col("neg")).over(above)
    each = counts.select("round", "pos", (tp / seen * F.col("pos")).alias("gained"))
    return each.groupBy("round").agg((F.sum("gained") / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def explain_moment(model: RiskModel, features: DataFrame, k: int = DRIVERS) -> DataFrame:
    """rank, feature, its value, contribution and direction, risk and base for each row of ``features``: the ``k`` that count most."""
    full = model.aligned(features)
    scored = model.score(features).select(F.col(STAY).cast("string").alias(STAY), "hour", "risk")
    values = full.select(F.col(STAY).cast("string").alias(STAY), "hour", F.array(*(F.col(c) for c in model.columns)).alias("_values"))
    explained = explain(model, features)
    top = top_contributions(explained, model.columns, k)
    place = F.array_position(F.array(*map(F.lit, model.columns)), F.col("feature")).cast("int")
    found = top.join(values, [STAY, "hour"]).join(scored, [STAY, "hour"]).join(explained.select(STAY, "hour", "base"), [STAY, "hour"])
    return found.select(STAY, "hour", "rank", "feature", F.get("_values", place - 1).alias("value"), "contribution", "direction", "risk", "base")


def importance(explained: DataFrame, columns: list[str]) -> DataFrame:
    """feature and its mean absolute contribution, the largest first."""
    each = explained.select(F.posexplode(F.col("contributions")).alias("k", "c")).groupBy("k").agg(F.avg(F.abs("c")).alias("mean_abs"))
    names = F.array(*(F.lit(c) for c in columns))
    return each.select(F.element_at(names, F.col("k") + 1).alias("feature"), "mean_abs").orderBy(F.desc("mean_abs"), "feature")


def mean_importance(model: RiskModel, df: DataFrame) -> DataFrame:
    """``importance`` over all rows of ``df``, each distinct row of the forest's codes explained once and counted as often as it occurs."""
    explainer = df.sparkSession.sparkContext.broadcast(Explainer(model.forest, model.background))
    n = len(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(n), 0
        for batch in batches:
            times = batch.column("n").to_numpy()
            total += times @ np.abs(explainer.value.values(matrix(batch, "x", n)))
            rows += int(times.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(np.full(n, rows))], ["k", "total", "n"])

    each = distinct_codes(model.forest, model.aligned(df)).mapInArrow(run, "k long, total double, n long")
    means = each.groupBy("k").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_abs")).where("mean_abs IS NOT NULL")
    names = F.array(*(F.lit(c) for c in model.columns))
    return means.select(F.element_at(names, F.col("k").cast("int") + 1).alias("feature"), "mean_abs").orderBy(F.desc("mean_abs"), "feature")


def six_places(values: np.ndarray) -> np.ndarray:
    """Rounded to six places as ``round`` does: halves of the value's shortest decimal go away from zero."""
    scaled = np.abs(values) * 1e6
    whole = np.floor(scaled)
    out = np.copysign((whole + (scaled - whole > 0.5)) / 1e6, values)
    for at in np.flatnonzero((np.abs(scaled - whole - 0.5) < 1e-6) | (scaled > 1e9)):  # too near to a half to tell by these
        out.flat[at] = float(Decimal(repr(float(values.flat[at]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out + 0.0


def top_of_rows(model: RiskModel, df: DataFrame, k: int = DRIVERS) -> DataFrame:
    """``top_contributions`` of ``explain`` for all rows of ``df``. Those with ``HOURS`` are explained once, and then a row for each of their hours.

    Contributions are ordered where they are worked out, and only the ``k`` leave it.
    """
    explainer = df.sparkSession.sparkContext.broadcast(Explainer(model.forest, model.background))
    n, columns = len(model.columns), model.columns
    by_name = np.array(sorted(range(n), key=columns.__getitem__), int)
    k = min(k, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in in_chunks(batches):
            values = explainer.value.values_once(matrix(batch, "x", n), known)[:, by_name]
            at = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :k]  # of equal ones the first by name
            ends = pa.array(np.arange(batch.num_rows + 1) * k, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(a.ravel())) for a in (by_name[at].astype(np.int32), six_places(np.take_along_axis(values, at, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(STAY), batch.column("hour"), batch.column(HOURS), *lists], [STAY, "hour", HOURS, "_features", "_values"])

    times = F.col(HOURS).cast("int") if HOURS in df.columns else F.lit(1)
    rows = model.aligned(df).select(F.col(STAY).cast("string").alias(STAY), "hour", times.alias(HOURS), features_of(columns).alias("x"))
    found = each_hour(rows.mapInArrow(run, f"{STAY} string, hour timestamp_ntz, {HOURS} int, _features array<int>, _values array<double>"))
    each = found.select(STAY, "hour", "_values", F.posexplode("_features").alias("_at", "_feature")).withColumn("contribution", F.get("_values", F.col("_at")))
    named = F.get(F.array(*map(F.lit, columns)), F.col("_feature"))
    return each.select(STAY, "hour", (F.col("_at") + 1).alias("rank"), named.alias("feature"), "contribution", direction_of("contribution").alias("direction"))


def direction_of(contribution: str) -> Column:
    return F.when(F.col(contribution) > 0, "raises").when(F.col(contribution) < 0, "lowers").otherwise("none")


def top_contributions(explained: DataFrame, columns: list[str], k: int = DRIVERS) -> DataFrame:
    """The ``k`` features that count most in each row: rank, feature, contribution (six places) and its direction."""
    names = F.array(*(F.lit(c) for c in columns))
    pairs = F.transform("contributions", lambda c, i: F.struct((-F.abs(c)).alias("order"), F.element_at(names, i + 1).alias("feature"), F.round(c, 6).alias("contribution")))
    top = F.slice(F.array_sort(pairs), 1, k)
    each = explained.select(STAY, "hour", F.posexplode(top).alias("rank", "t"))
    return each.select(STAY, "hour", (F.col("rank") + 1).alias("rank"), "t.feature", "t.contribution", direction_of("t.contribution").alias("direction"))

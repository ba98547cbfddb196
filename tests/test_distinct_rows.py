"""Rows of equal bins are one weighted row to boosting, and one row to scores and attributions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_boosting import exhaustive, frame, table
from tidemark.operators import boosting
from tidemark.operators.model import RiskModel, explain
from tidemark.sources.shared import discard


def test_equal_rows_are_one_weighted_row(spark):
    x, y = table(6, 60)
    x, y = np.repeat(x, 50, 0), np.repeat(y, 50)
    rows, columns = frame(spark, x, y).repartition(5), [f"f{k}" for k in range(x.shape[1])]
    data = boosting.blocks(rows, columns, boosting.cuts_of(rows, columns), 0.0)
    weights = np.concatenate([np.frombuffer(r["weight"]) for r in data.collect()])
    discard(data)
    assert weights.sum() == len(y) == 3000 and len(weights) <= 60
    forest = boosting.train_forest(rows, columns, rounds=3, depth=3)
    assert np.abs(forest.margins(x) - exhaustive(x, y, 3, 3)).max() < 1e-9


def test_scores_and_attributions_of_distinct_rows_are_those_of_all(spark, monkeypatch):
    x, y = table(7, 400)
    columns = [f"f{k}" for k in range(x.shape[1])]
    forest = boosting.train_forest(frame(spark, x, y), columns, rounds=4, depth=3)
    explainer = boosting.Explainer(forest, x[:9])
    few, own = forest.distinct(x)
    assert len(few) < len(x) and (forest.margins(few)[own] == forest.margins(x)).all()
    for most in (boosting.KNOWN, 7):
        monkeypatch.setattr(boosting, "KNOWN", most)
        known = {}
        got = np.concatenate([explainer.values_once(x[at : at + 90], known) for at in range(0, len(x), 90)])
        assert (got == explainer.values(x)).all() and 0 < len(known) <= most
    model = RiskModel(forest, x[:9])
    rows = frame(spark, x, y).withColumns({"stay_id": F.monotonically_increasing_id().cast("string"), "hour": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    values = {r["stay_id"]: r for r in explain(model, rows).collect()}
    scored = model.score(rows).toPandas()
    for r in scored.itertuples():
        margin = values[r.stay_id]["base"] + sum(values[r.stay_id]["contributions"])
        assert abs(1 / (1 + np.exp(-margin)) - r.risk) < 1e-12
    assert len(scored) == 400 and isinstance(scored, pd.DataFrame)

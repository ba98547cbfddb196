"""Boosting against exhaustive splits on small tables, and Shapley values against all subsets of features."""

import itertools
import os
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.sources.shared import shared_folder


def exhaustive(x, y, rounds, depth, rate=0.3, ridge=1.0, least=1.0):
    """Margins of trees that try every value of every feature as a cut, with nulls on either side."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def score(own, g=g, h=h):
            return g[own].sum() ** 2 / (h[own].sum() + ridge)

        def grow(own, level, g=g, h=h):
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    values = x[:, f]
                    for cut in [*np.unique(values[~np.isnan(values)])[1:], np.inf]:
                        for nulls in (False, True):
                            left = own & np.where(np.isnan(values), nulls, values < cut)
                            right = own & ~left
                            if h[left].sum() >= least and h[right].sum() >= least:
                                gain = score(left) + score(right) - score(own)
                                if gain > best[0] + 1e-12:
                                    best = gain, (left, right)
            if best[1] is None:
                margin[own] += -rate * g[own].sum() / (h[own].sum() + ridge)
            else:
                for part in best[1]:
                    grow(part, level + 1)

        grow(np.ones(len(y), bool), 0)
    return margin


def table(seed, n=300, features=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, features)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6) ^ (rng.random(n) < 0.2)).astype(int)
    x[rng.random(x.shape) < 0.25] = np.nan
    y[np.isnan(x[:, 2])] = 1
    return x, y


def frame(spark, x, y):
    rows = pd.DataFrame(x, columns=[f"f{k}" for k in range(x.shape[1])]).assign(label=y)
    return spark.createDataFrame(rows).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in rows.columns if c != "label"})


@pytest.mark.parametrize("direct", [boosting.DIRECT, 0])
def test_splits_equal_exhaustive_search(spark, monkeypatch, direct):
    monkeypatch.setattr(boosting, "DIRECT", direct)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    monkeypatch.setattr(boosting, "FOLD", 2)
    x, y = table(1)
    columns = [f"f{k}" for k in range(x.shape[1])]
    before = set(os.listdir(shared_folder(spark).removeprefix("file://")))
    forest = boosting.train_forest(frame(spark, x, y).repartition(3), columns, rounds=3, depth=3)
    assert set(os.listdir(shared_folder(spark).removeprefix("file://"))) == before  # no blocks are left behind
    assert np.abs(forest.margins(x) - exhaustive(x, y, 3, 3)).max() < 1e-9
    # Bins and values lead to the same leaves.
    cuts = boosting.cuts_of(frame(spark, x, y), columns)
    for tree in forest.trees:
        assert (tree.nodes(boosting.binned_rows(x, cuts)) == tree.leaves(x)).all()


def test_no_worse_than_trees_with_filled_nulls(spark):
    """Held-out ranking, against Spark's trees on medians with the same rounds and depth."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators.metrics import auroc

    x, y = table(2, 1500)
    rows = frame(spark, x, y).withColumn("test", F.rand(3) < 0.3).persist()
    columns = [f"f{k}" for k in range(x.shape[1])]
    train, test = rows.where("NOT test"), rows.where("test")
    forest = boosting.train_forest(train, columns, rounds=8, depth=3)
    pdf = test.toPandas()
    ours = auroc(spark.createDataFrame(pd.DataFrame({"score": forest.margins(pdf[columns].to_numpy(float)), "label": pdf["label"]}))).first()[0]
    filled = rows.fillna(4.0, columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(filled)
    gbt = GBTClassifier(featuresCol="v", labelCol="label", maxIter=8, maxDepth=3, seed=1).fit(vectors.where("NOT test"))
    theirs = auroc(gbt.transform(vectors.where("test")).select(vector_to_array("rawPrediction")[1].alias("score"), "label")).first()[0]
    assert ours >= theirs and ours > 0.75


def test_constant_empty_and_one_sided_features(spark):
    rows = spark.range(40).select(F.lit(1.0).alias("same"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") % 2 == 0, 3.0).alias("only"), (F.col("id") % 2).cast("int").alias("label"))
    forest = boosting.train_forest(rows, ["same", "none", "only"], rounds=3, depth=2)
    assert {int(f) for t in forest.trees for f in t.feature} <= {-1, 2}
    odd, even = forest.margins(np.array([[1, np.nan, np.nan], [1, np.nan, 3.0]]))
    assert odd > 0 > even
    one_class = boosting.train_forest(rows.withColumn("label", F.lit(1)), ["only"], rounds=2, depth=2)
    assert one_class.margins(np.array([[3.0]]))[0] > 5


def test_shapley_values_equal_all_subsets():
    rng, features = np.random.default_rng(1), 8
    trees = []
    for _ in range(5):
        tree = boosting.Tree.empty(4)
        for k in range(15):
            if (k == 0 or tree.feature[(k - 1) // 2] >= 0) and rng.random() < 0.85:
                tree.feature[k], tree.threshold[k], tree.null_left[k] = rng.integers(features), rng.normal(), rng.random() < 0.5
        tree.value[:] = rng.normal(size=len(tree.value))
        trees.append(tree)
    forest = boosting.Forest([str(k) for k in range(features)], 0.3, trees)
    background, x = rng.normal(size=(13, features)), rng.normal(size=(4, features))
    for a in (background, x):
        a[rng.random(a.shape) < 0.2] = np.nan
    explainer = boosting.Explainer(forest, background)
    got = explainer.values(x)
    assert np.abs(got.sum(1) + explainer.base - forest.margins(x)).max() < 1e-12
    for row, own in zip(x, got, strict=True):
        worth = {}
        for n in range(features + 1):
            for some in itertools.combinations(range(features), n):
                mixed = background.copy()
                mixed[:, list(some)] = row[list(some)]
                worth[some] = forest.margins(mixed).mean()
        for f in range(features):
            value = sum(factorial(len(s)) * factorial(features - len(s) - 1) / factorial(features) * (worth[tuple(sorted((*s, f)))] - w) for s, w in worth.items() if f not in s)
            assert abs(value - own[f]) < 1e-12


def test_rounds_equal_sql_over_written_margins(spark, duck, tmp_path):
    x, y = table(4, 400)
    rows = frame(spark, x, y)
    columns = [f"f{k}" for k in range(x.shape[1])]
    forest = boosting.train_forest(rows, columns, rounds=5, depth=3)
    from tidemark.operators.model import RiskModel, rounds

    got = {r["round"]: r["average_precision"] for r in rounds(RiskModel(forest, x[:5]), rows).collect()}
    staged = pd.concat(pd.DataFrame({"round": k + 1, "step": np.rint(s * boosting.STEPS), "label": y}) for k, s in enumerate(boosting.staged_scores(forest, x)))
    staged.to_parquet(f"{tmp_path}/staged.parquet")
    sql = f"""WITH c AS (SELECT round, step, sum(label) AS pos, count(*) AS n FROM '{tmp_path}/staged.parquet' GROUP BY ALL),
      a AS (SELECT round, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY round ORDER BY step DESC))
      SELECT round, sum(tp / seen * pos) / sum(pos) FROM a GROUP BY round"""
    expected = dict(duck.sql(sql).fetchall())
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert got[5] > got[1]

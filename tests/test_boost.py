import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from daymark.operators import boost
from daymark.operators import predict as pr


def deviance(y, mean):
    part = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mean), 0.0)
    return 2 * np.mean(part - (y - mean))


@pytest.fixture(scope="module")
def counts(spark):
    """Skewed counts whose mean is a product of effects, in two halves."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = rng.poisson(np.exp(1.3 * x[:, 0] - 1.0 * (x[:, 1] > 0.5) + 0.5)).astype(float)
    both = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "half": np.arange(3000) % 2})
    df = spark.createDataFrame(both).cache()
    return df.where("half = 0"), df.where("half = 1")


def test_one_round_by_hand(spark):
    rows = [(0.0, y) for y in (0, 0, 1, 3)] + [(1.0, y) for y in (4, 6, 2, 8)]
    df = spark.createDataFrame(rows, "a double, label int")
    model = boost.PoissonTrees(["a"], rounds=1, step=0.5, min_leaf=1, row_share=1.0, feature_share=1.0).fit(df)
    mean = 3.0
    want = {a: mean * math.exp(0.5 * sum(y - mean for b, y in rows if b == a) / (4 * mean * math.exp(boost.DAMP))) for a in (0.0, 1.0)}
    got = {r["a"]: r["prediction"] for r in model.transform(df).select("a", "prediction").distinct().collect()}
    assert got == pytest.approx(want) and model.base == pytest.approx(math.log(mean))


def test_deviance_falls_and_beats_squared_loss(counts):
    train, test = counts
    options = {"rounds": 6, "step": 0.6}
    model = boost.PoissonTrees(["a", "b", "c"], min_leaf=100, write_every=3, track=True, **options).fit(train)
    assert all(b < a for a, b in zip(model.deviances, model.deviances[1:]))
    scored = model.transform(test).select("label", "prediction").toPandas()
    own = deviance(scored["label"].to_numpy(), scored["prediction"].to_numpy())
    assert own < 0.7 * deviance(scored["label"].to_numpy(), math.exp(model.base))
    made = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    trees = GBTRegressor(maxIter=options["rounds"], stepSize=options["step"], maxDepth=5, minInstancesPerNode=100, subsamplingRate=0.9, seed=42)
    squared = trees.fit(made.transform(train)).transform(made.transform(test)).toPandas()
    assert own < deviance(squared["label"].to_numpy(), np.maximum(squared["prediction"].to_numpy(), 1e-3))
    leaves = boost.tree_nodes(test.sparkSession, model.trees, ["a", "b", "c"]).where("left_node IS NULL")
    assert leaves.agg(F.min("rows")).first()[0] >= 100


def test_node_table_agrees_with_the_printed_trees(spark, counts):
    features = ["a", "b", "c"]
    model = boost.PoissonTrees(features, rounds=2, step=0.3, min_leaf=50).fit(counts[0])
    nodes = boost.tree_nodes(spark, model.trees, features)
    got = {r["feature"]: r for r in boost.split_importance(nodes, features).collect()}
    printed = re.findall(r"If \(feature (\d+) ", model.trees.toDebugString)
    assert {f: r["importance"] for f, r in got.items()} == {f: printed.count(str(i)) for i, f in enumerate(features)}
    assert sum(r["importance"] for r in got.values()) == nodes.where("left_node IS NOT NULL").count() == nodes.where("feature IS NOT NULL").count()
    assert [got[f]["gain_share"] for f in features] == pytest.approx(list(model.featureImportances.toArray()))
    nothing = boost.split_importance(nodes.where("false"), features).collect()
    assert sorted(tuple(r) for r in nothing) == [(f, 0, 0.0) for f in features]


def test_counts_that_cannot_be_boosted_say_so(spark):
    df = spark.range(60).selectExpr("id as user_id", "cast(id % 3 as double) as a", "if(id = 59, 0, 0) as zero", "id % 4 as y")
    with pytest.raises(ValueError, match="0 everywhere"):
        boost.PoissonTrees(["a"], label="zero").fit(df)
    row = pr.fit_count(df, "y", ["a"], rounds=0, baseline=False).metrics[0]
    assert "at least one round" in row["error"]

"""Boosted trees for counts with Poisson loss, and tree ensembles as tables of nodes.

Spark's own boosting has squared and absolute loss for numbers.  Here a count's mean is exp(margin): each round fits one of
Spark's regression trees to the working response of the Poisson likelihood, weighted, so that a leaf holds the Newton
step of its rows, and adds a small share of it to the margin.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.session import checkpoint_dir, settle

DAMP = 0.7  # fixed value: the curvature is taken at margin + DAMP, which keeps steps short where few counts are large
LIMIT = 30.0  # margins stay within this of 0, far beyond any count


def poisson_deviance(label: Column, mean: Column) -> Column:
    """Mean Poisson deviance as an aggregate."""
    log_part = F.when(label > 0, label * F.log(label / mean)).otherwise(F.lit(0.0))
    return 2 * F.avg(log_part - (label - mean))


@dataclass
class BoostedCounts:
    """A fitted ensemble; the mean is exp(base + the trees' weighted sum)."""

    base: float
    trees: GBTRegressionModel
    features: Sequence[str]
    deviances: list[float] = field(default_factory=list)

    @property
    def featureImportances(self):  # noqa: N802
        return self.trees.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `prediction`, the mean count."""
        made = VectorAssembler(inputCols=list(self.features), outputCol="_x").transform(df)
        margin = F.greatest(F.least(F.col("_margin") + self.base, F.lit(LIMIT)), F.lit(-LIMIT))
        model = self.trees.copy().setFeaturesCol("_x").setPredictionCol("_margin")
        return model.transform(made).withColumn("prediction", F.exp(margin)).drop("_x", "_margin")


@dataclass(frozen=True)
class PoissonTrees:
    """Settings of the boosting.  `write_every` rounds the margins are written, so that no round depends on a long chain of
    trees; `track` also measures the training deviance after every round.
    """

    features: Sequence[str]
    label: str = "label"
    rounds: int = 250
    step: float = 0.05
    depth: int = 5
    min_leaf: int = 100
    row_share: float = 0.9
    feature_share: float = 0.9
    seed: int = 42
    write_every: int = 10
    track: bool = False

    def fit(self, train: DataFrame) -> BoostedCounts:
        """Fit to the rows of `train`; the label is not negative, not NULL and not 0 everywhere."""
        if self.rounds < 1:
            raise ValueError("at least one round is needed")
        spark = train.sparkSession
        made = VectorAssembler(inputCols=list(self.features), outputCol="features").transform(train)
        label = F.col(self.label).cast("double")
        state = settle(made.select("features", label.alias("label")))
        mean = state.agg(F.avg("label")).first()[0]
        if not mean or mean <= 0:
            raise ValueError("counts are 0 everywhere")
        base = math.log(mean)
        state = state.withColumn("margin", F.lit(base))
        learner = RandomForestRegressor(
            featuresCol="features", labelCol="response", weightCol="weight", numTrees=1, bootstrap=False,
            subsamplingRate=self.row_share, featureSubsetStrategy=str(self.feature_share), maxDepth=self.depth,
            minInstancesPerNode=self.min_leaf,
        )
        trees, deviances = [], []
        for n in range(self.rounds):
            expected = F.exp("margin")
            work = state.withColumn("weight", expected * math.exp(DAMP)).withColumn("response", (F.col("label") - expected) / F.col("weight"))
            tree = learner.setSeed(self.seed + n).fit(work).trees[0]
            trees.append(tree)
            moved = F.col("margin") + self.step * F.col("_leaf")
            moved = F.greatest(F.least(moved, F.lit(LIMIT)), F.lit(-LIMIT))
            state = tree.setPredictionCol("_leaf").transform(state).withColumn("margin", moved).drop("_leaf")
            if (n + 1) % self.write_every == 0 and n + 1 < self.rounds:
                state = settle(state)
            if self.track:
                deviances.append(state.agg(poisson_deviance(F.col("label"), F.exp("margin"))).first()[0])
        return BoostedCounts(base, _ensemble(spark, trees, self.step, len(self.features)), self.features, deviances)


def _ensemble(spark, trees: list, step: float, width: int) -> GBTRegressionModel:
    """Spark's own model class around the trees, so that it scores, saves and loads like any other."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    held = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for n, tree in enumerate(trees):
        held[n], weights[n] = tree._java_obj, step
    name = f"GBTRegressor_{uuid.uuid4().hex[:12]}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(name, held, weights, width))


NODES = (
    "tree int, node int, feature string, threshold double, gain double, rows long, weight double, prediction double, "
    "left_node int, right_node int"
)


def tree_nodes(spark, model, features: Sequence[str]) -> DataFrame:
    """The trees of a fitted ensemble as a table, one row per node, read from the model as Spark saves it.

    Inner nodes have the feature, the threshold (rows up to it go left), the gain and both children; leaves have NULL
    there.  `rows` counts training rows, `weight` sums their weights.
    """
    path = f"{checkpoint_dir(spark)}/daymark-model-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    names = F.array(*[F.lit(f) for f in features])
    return saved.select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.col("rawCount").alias("rows"),
        F.get("impurityStats", F.lit(0)).alias("weight"),
        "prediction",
        F.when(inner, F.col("leftChild")).alias("left_node"),
        F.when(inner, F.col("rightChild")).alias("right_node"),
    )


def split_importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance, gain_share): how many inner nodes split on each feature, and its share of the weighted gain.

    A feature without splits has zeros; with no split at all every share is 0.
    """
    spark = nodes.sparkSession
    gain = F.sum(F.col("gain") * F.col("weight"))
    used = nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("importance"), gain.alias("gain"))
    every = spark.createDataFrame([(f,) for f in features], "feature string")
    total = used.agg(F.sum("gain")).scalar()
    return every.join(F.broadcast(used), "feature", "left").select(  # one row per feature
        "feature",
        F.coalesce("importance", F.lit(0)).cast("long").alias("importance"),
        F.coalesce(F.try_divide(F.col("gain"), total), F.lit(0.0)).alias("gain_share"),
    )

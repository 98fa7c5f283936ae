"""Targets, splits, models and ranking measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import num, safe_div, to_binary
from daymark.operators.boost import BoostedCounts, PoissonTrees, split_importance, tree_nodes
from daymark.operators.cluster import quotas
from daymark.operators.ordering import hash_cuts, hash_ranked, quantile_values, quantiles, running, seeded_hash
from daymark.operators.segments import top_per_group
from daymark.session import checkpoint_dir, fit_parts, settle


def binary(df: DataFrame, col: str) -> Column:
    """A column of any type as 0/1."""
    return to_binary(col, df.schema[col].dataType.typeName())


def relation_experience(df: DataFrame, receive: str = "received_vote_yn_d0_3", send: str = "sent_vote_experience_d0_3") -> Column:
    """1 when the user received or sent anything in the first days."""
    parts = [binary(df, c) for c in (receive, send) if c in df.columns]
    return F.greatest(*parts) if len(parts) > 1 else (parts[0] if parts else F.lit(0))


def derive_targets(
    df: DataFrame, targets: Mapping[str, str], high_active: int = 3
) -> tuple[DataFrame, dict[str, str]]:
    """Add relation experience, churn, high activity, repeat payment and high value; returns the longer map.

    High value means at least the upper quartile among payers with a positive amount; without one it is left out.
    """
    out = df.withColumn("relation_experience_d0_3", relation_experience(df))
    names = {**targets, "relation_experience": "relation_experience_d0_3"}
    if "active_days" in targets:
        active = num(targets["active_days"])
        out = out.withColumns(
            {"churn_d4_plus": (active == 0).cast("int"), "high_active_d4_plus": (active >= high_active).cast("int")}
        )
        names |= {"churn": "churn_d4_plus", "high_active": "high_active_d4_plus"}
    if "payment_count" in targets:
        out = out.withColumn("repeat_paid_d4_plus", (num(targets["payment_count"]) >= 2).cast("int"))
        names["repeat_paid"] = "repeat_paid_d4_plus"
    if "bought_hearts" in targets:
        hearts = num(targets["bought_hearts"])
        payers = out.where(hearts > 0)
        if "paid" in targets:
            payers = payers.where(binary(df, targets["paid"]) == 1)
        cap = quantile_values(payers.select(hearts.alias("v")), ["v"], 0.75)["v"]
        if cap is not None:
            out = out.withColumn("high_value_paid_d4_plus", (hearts >= F.lit(cap)).cast("int"))
            names["high_value_paid"] = "high_value_paid_d4_plus"
    return out, names


def stratified_split(
    df: DataFrame, y: str | None, share: float = 0.3, seed: int = 42, id_col: str = "user_id", out: str = "is_test"
) -> DataFrame:
    """Add the test flag: exactly ceil(share * rows) rows in seeded hash order, shared among the classes of `y`."""
    by = [] if y is None else [y]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
    size = F.ceil(F.round(F.lit(float(share)) * F.sum("c").over(Window.partitionBy()), 9)).cast("long")
    if y is None:
        counts = counts.select(F.lit(0).alias("_all"), "c")
        return hash_ranked(df.withColumn("_all", F.lit(0)), [], id_col, seed).join(
            quotas(counts, size, least=0).select("_all", "quota"), "_all"
        ).withColumn(out, F.col("n_before") < F.col("quota")).select(*df.columns, out)
    ranked = hash_ranked(df, by, id_col, seed)
    return ranked.join(quotas(counts, size, least=0).select(y, "quota"), y).withColumn(
        out, F.col("n_before") < F.col("quota")
    ).select(*df.columns, out)


def threshold_metrics(df: DataFrame, y: str, score: str, t: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold, 0 where undefined."""
    yes, hit = F.col(y) == 1, F.col(score) >= t
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(yes).alias("positive_count"),
        F.count_if(yes & hit).alias("_tp"),
        F.count_if(~yes & hit).alias("_fp"),
        F.count_if(yes == hit).alias("_right"),
    )
    return one.select(
        "row_count",
        "positive_count",
        safe_div("positive_count", "row_count").alias("positive_rate"),
        F.lit(float(t)).alias("threshold"),
        safe_div("_right", "row_count").alias("accuracy"),
        safe_div("_tp", F.col("_tp") + F.col("_fp")).alias("precision"),
        safe_div("_tp", "positive_count").alias("recall"),
        safe_div(F.col("_tp") * 2, F.col("_tp") * 2 + F.col("_fp") + F.col("positive_count") - F.col("_tp")).alias("f1"),
    )


def score_table(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row per different score: positives p and rows n at it, those at lower scores, and the totals."""
    per_score = (
        df.where(F.col(score).isNotNull())
        .groupBy((F.col(score).cast("double") + F.lit(0.0)).alias("score"))
        .agg(F.count_if(F.col(y) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    )
    return running(per_score, "score", ["p", "n"])


def _ranking_cells() -> list[Column]:
    """ROC AUC (ties count half) and average precision as aggregates over a score table."""
    p, m = F.col("p"), F.col("n") - F.col("p")
    lower = F.col("n_before") - F.col("p_before")
    hits, upward = F.col("p_total") - F.col("p_before"), F.col("n_total") - F.col("n_before")
    both = F.max(F.col("p_total") * (F.col("n_total") - F.col("p_total")).cast("double"))
    ap = F.try_divide(F.sum(p * F.try_divide(hits.cast("double"), upward)), F.max("p_total"))
    return [
        F.try_divide(F.sum(p * (lower + m / 2.0)), F.nullif(both, F.lit(0.0))).alias("roc_auc"),
        F.when(both > 0, ap).alias("pr_auc"),
    ]


def ranking_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC AUC and average precision in one pass over the different scores; NULL for one class."""
    return score_table(df, y, score).agg(*_ranking_cells())


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    return ranking_metrics(df, y, score).select("roc_auc")


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    return ranking_metrics(df, y, score).select("pr_auc")


def confusion(df: DataFrame, y: str, score: str, t: float = 0.5) -> DataFrame:
    """All four cells of actual x predicted."""
    yes, hit = F.col(y) == 1, F.col(score) >= t
    cells = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(b).alias("predicted"),
            F.count_if((yes if a else ~yes) & (hit if b else ~hit)).alias("count"),
        )
        for a in (0, 1)
        for b in (0, 1)
    ]
    return df.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))


TIE_SEED = 42
LIFT_SHARES = (0.01, 0.03, 0.05, 0.10)  # fixed values: shares of the ranking that are reported


def _lift_cells(ks: Sequence[float]) -> list[Column]:
    """Per share, the score group its cut falls into, as aggregates over a score table."""
    above = F.col("n_total") - F.col("n_before") - F.col("n")
    p_above = F.col("p_total") - F.col("p_before") - F.col("p")
    out = [F.max("n_total").alias("_n"), F.max("p_total").alias("_p")]
    for i, k in enumerate(ks):
        top = F.greatest(F.lit(1), F.ceil(F.round(F.col("n_total") * float(k), 9))).cast("long")
        group = F.struct(
            F.col("score"), top.alias("top"), (top - above).alias("take"), F.col("n"), p_above.alias("p_above"), F.col("p")
        )
        out.append(F.max(F.when((above < top) & (top <= above + F.col("n")), group)).alias(f"_k{i}"))
    return out


def _lift_rows(df: DataFrame, y: str, score: str, id_col: str, ks: Sequence[float], head) -> list[dict]:
    """Lift rows from the aggregated cells; a group of equal scores that a cut divides is in order of hashed id."""
    total, positives = head["_n"] or 0, head["_p"] or 0
    groups = {k: head[f"_k{i}"] for i, k in enumerate(ks)} if total else {}
    inside = {k: g["p"] for k, g in groups.items()}
    split = {k: g for k, g in groups.items() if g["take"] < g["n"]}
    if split:
        value = F.col(score).cast("double") + F.lit(0.0)
        ties = df.where(value.isin(*{g["score"] for g in split.values()})).select(
            F.col(id_col).alias("_id"),
            seeded_hash(id_col, TIE_SEED).alias("_h"),
            value.alias("_s"),
            (F.col(y) == 1).cast("long").alias("_y"),
            F.lit(1).alias("one"),
        )
        cells = [
            F.sum(F.when((F.col("_s") == g["score"]) & (F.col("one_before") < g["take"]), F.col("_y"))).alias(f"c{i}")
            for i, g in enumerate(split.values())
        ]
        ordered = running(ties, "_h", ["one"], by=["_s"], cuts=hash_cuts(ties), then=["_id"])
        row = ordered.agg(*cells).first()
        inside |= {k: row[f"c{i}"] or 0 for i, k in enumerate(split)}
    base = positives / total if total else 0.0
    rows = []
    for k, g in groups.items():
        n, top = g["top"], int(g["p_above"] + inside[k])
        rows.append(
            {
                "top_k": f"Top {round(k * 100)}%",
                "top_k_rate": float(k),
                "top_n": n,
                "base_positive_rate": base,
                "top_positive_rate": top / n,
                "lift": top / n / base if base > 0 else None,
                "captured_positive_count": top,
                "capture_rate": top / positives if positives else None,
            }
        )
    return rows


LIFT_SCHEMA = (
    "top_k string, top_k_rate double, top_n long, base_positive_rate double, top_positive_rate double, "
    "lift double, captured_positive_count long, capture_rate double"
)


def lift(
    df: DataFrame, y: str, score: str, ks: Sequence[float] = LIFT_SHARES, id_col: str = "user_id"
) -> DataFrame:
    """Positive rate, lift and capture of the top share of the ranking.

    Whole score groups are added up; only a group that a cut divides is ordered, by `seeded_hash` of the id and then by
    the id in its own type, range by range.  A score shared by a third of the rows is thus counted, not sorted in
    one task, and any kind of id will do.
    """
    head = score_table(df, y, score).agg(*_lift_cells(ks)).first()
    return df.sparkSession.createDataFrame(_lift_rows(df, y, score, id_col, ks, head), LIFT_SCHEMA)


def judge_classes(scored: DataFrame, y: str, score: str, id_col: str, t: float = 0.5) -> tuple[dict, list, list]:
    """All class measures, lift rows and confusion cells of a scored table from one pass over its score table."""
    p, m, up = F.col("p"), F.col("n") - F.col("p"), F.col("score") >= t
    counts = {"tp": (p, up), "fp": (m, up), "fn": (p, ~up), "tn": (m, ~up)}
    cells = [F.coalesce(F.sum(F.when(gate, v)), F.lit(0)).alias(n) for n, (v, gate) in counts.items()]
    head = score_table(scored, y, score).agg(*_ranking_cells(), *_lift_cells(LIFT_SHARES), *cells).first()
    tp, fp, fn, tn = (int(head[c]) for c in ("tp", "fp", "fn", "tn"))
    n, pos = tp + fp + fn + tn, tp + fn
    over = lambda a, b: a / b if b else 0.0
    row = {
        "row_count": n, "positive_count": pos, "positive_rate": over(pos, n), "threshold": float(t),
        "accuracy": over(tp + tn, n), "precision": over(tp, tp + fp), "recall": over(tp, pos),
        "f1": over(2 * tp, 2 * tp + fp + fn), "roc_auc": head["roc_auc"], "pr_auc": head["pr_auc"],
    }
    four = [
        {"actual": a, "predicted": b, "count": c} for a, b, c in ((0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp))
    ]
    return row, _lift_rows(scored, y, score, id_col, LIFT_SHARES, head), four


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MAE, RMSE, R2 and target statistics."""
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(t).alias("target_mean"),
        F.try_divide(F.count_if(t > 0), F.count(F.lit(1))).alias("target_positive_rate"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))).alias("r2"),
    )
    middle = quantiles(df.select(t.alias("v")), ["v"], {"target_median": 0.5}).select("target_median")
    return one.withColumn("target_median", middle.scalar())


METRIC_FIELDS = {
    "row_count": "long", "positive_count": "long", "positive_rate": "double", "threshold": "double",
    "accuracy": "double", "precision": "double", "recall": "double", "f1": "double", "roc_auc": "double",
    "pr_auc": "double", "target_mean": "double", "target_median": "double", "target_positive_rate": "double",
    "mae": "double", "rmse": "double", "r2": "double",
}
INFO_FIELDS = {
    "task": "string", "target_name": "string", "target_col": "string", "population": "string",
    "feature_set": "string", "feature_count": "int", "model_type": "string",
    "train_row_count": "long", "test_row_count": "long", "error": "string",
}


@dataclass
class ModelResult:
    """Rows of a model run: measures, lift, importances and confusion cells (lists of dicts, a few per model)."""

    metrics: list[dict]
    topk: list[dict]
    importance: list[dict]
    confusion: list[dict]

    @classmethod
    def empty(cls) -> ModelResult:
        return cls([], [], [], [])

    def __add__(self, other: ModelResult) -> ModelResult:
        return ModelResult(
            self.metrics + other.metrics,
            self.topk + other.topk,
            self.importance + other.importance,
            self.confusion + other.confusion,
        )

    def metrics_frame(self, spark) -> DataFrame:
        fields = {**INFO_FIELDS, **METRIC_FIELDS}
        schema = ", ".join(f"{n} {t}" for n, t in fields.items())
        return spark.createDataFrame([tuple(r.get(n) for n in fields) for r in self.metrics], schema)

    def rows_frame(self, spark, part: str) -> DataFrame | None:
        rows = getattr(self, part)
        return spark.createDataFrame(rows) if rows else None


def _numeric(df: DataFrame, features: Sequence[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [
        (F.coalesce(F.col(c), F.lit(False)).cast("double") if kinds[c] == "boolean" else num(c, dtype=kinds[c])).alias(c)
        for c in features
    ]


def _prepared(df: DataFrame, y: Column, features: Sequence[str], population, id_col: str) -> DataFrame:
    kept = df if population is None else df.where(F.coalesce(F.expr(population) if isinstance(population, str) else population, F.lit(False)))
    return kept.select(F.col(id_col), y.alias("label"), *_numeric(df, features))


def _stages(features: Sequence[str], scale: bool) -> list:
    if not scale:
        return [VectorAssembler(inputCols=list(features), outputCol="features")]
    filled = [f"_f_{c}" for c in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features"),
    ]


def _unfitted(names: Sequence[str], info: Mapping, why: str) -> ModelResult:
    return ModelResult([{**info, "model_type": name, "error": why} for name in names], [], [], [])


# what Spark's learners say of data they cannot be fitted to
UNFITTED = ("SingularMatrixException", "requirement failed")


def _run(models, train: DataFrame, test: DataFrame, info: Mapping, features, judge) -> ModelResult:
    out = ModelResult.empty()
    for name, pipe, score, boosted in models:
        about = {**info, "model_type": name}
        try:
            fitted = pipe.fit(train)
            scored = score(fitted.transform(test)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                out = out + judge(scored, about)
            finally:
                scored.unpersist()
        except (IllegalArgumentException, AnalysisException, ArithmeticException, ValueError, Py4JJavaError) as exc:
            # one model that cannot be fitted to its data must not lose the others; failed tasks and bugs go through
            if isinstance(exc, Py4JJavaError) and not any(x in str(exc.java_exception) for x in UNFITTED):
                raise
            out.metrics.append({**about, "error": f"{type(exc).__name__}: {str(exc).splitlines()[0][:200]}"})
            continue
        if boosted:
            trees = fitted.trees if isinstance(fitted, BoostedCounts) else fitted.stages[-1]
            keep = {k: about[k] for k in ("target_name", "population", "feature_set", "model_type")}
            rows = split_importance(tree_nodes(train.sparkSession, trees, features), features).collect()
            out.importance.extend({**r.asDict(), **keep} for r in rows)
    return out


def fit_binary(
    df: DataFrame,
    y: str,
    features: Sequence[str],
    population: str | Column | None = None,
    name: str = "target",
    population_name: str = "all",
    feature_set: str = "all",
    id_col: str = "user_id",
    rounds: int = 250,
    seed: int = 42,
    share: float = 0.3,
    min_leaf: int = 100,
    baseline: bool = True,
) -> ModelResult:
    """Balanced logistic baseline and boosted trees on a stratified split, judged on the test part.

    Every call gives a row per model; where there is nothing to fit (no such column, a single class, no rows to test) or
    a model fails, the row says so in `error`.  `min_leaf` is the least number of training rows in a leaf.
    Boosted trees are Spark's, so scores differ from other boosting libraries; importances are split counts and gain shares.
    """
    names = [*["Baseline Logistic"][: int(baseline)], "Boosted"]
    info = {
        "task": "classification", "target_name": name, "target_col": y, "population": population_name,
        "feature_set": feature_set, "feature_count": len(features),
    }
    if y not in df.columns:
        return _unfitted(names, info, "no such column")
    checkpoint_dir(df.sparkSession)
    data = _prepared(df, binary(df, y), features, population, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = data.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
        n, p = size["n"], size["p"] or 0
        if p in (0, n):
            return _unfitted(names, {**info, "row_count": n, "positive_count": int(p)}, "a single class" if n else "no rows")
        parts = stratified_split(data, "label", share, seed, id_col).persist(StorageLevel.MEMORY_AND_DISK)
        cells = {(r["label"], r["is_test"]): r["c"] for r in parts.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("c")).collect()}
        train_n, test_n = (sum(c for (_, t), c in cells.items() if t == part) for part in (False, True))
        pos = cells.get((1, False), 0)
        neg = train_n - pos
        info |= {"train_row_count": train_n, "test_row_count": test_n}
        if not (pos and neg and test_n):
            return _unfitted(names, {**info, "row_count": n, "positive_count": int(p)}, "too few rows to split")
        w = lambda a, b: F.when(F.col("label") == 1, F.lit(a)).otherwise(F.lit(b))
        train = parts.where(~F.col("is_test")).withColumns(
            {"_balanced": w(train_n / (2.0 * pos), train_n / (2.0 * neg)), "_pos": w(neg / pos, 1.0)}
        ).coalesce(fit_parts(df.sparkSession, train_n)).persist(StorageLevel.MEMORY_AND_DISK)
        test = parts.where("is_test").coalesce(fit_parts(df.sparkSession, test_n))
        logit = LogisticRegression(maxIter=500, regParam=1.0 / train_n, weightCol="_balanced", standardization=False)
        trees = GBTClassifier(
            maxIter=rounds, stepSize=0.05, maxDepth=5, minInstancesPerNode=min_leaf,
            subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed, weightCol="_pos",
        )
        prob = lambda f: f.select(id_col, "label", vector_to_array("probability")[1].alias("score"))
        models = [("Boosted", Pipeline(stages=[*_stages(features, False), trees]), prob, True)]
        if baseline:
            models.insert(0, ("Baseline Logistic", Pipeline(stages=[*_stages(features, True), logit]), prob, False))
        def judge(scored: DataFrame, about: dict) -> ModelResult:
            row, top, cells = judge_classes(scored, "label", "score", id_col)
            tag = {k: about[k] for k in ("target_name", "population", "feature_set", "model_type")}
            return ModelResult([{**row, **about}], [{**r, **tag} for r in top], [], [{**c, **tag} for c in cells])

        try:
            return _run(models, train, test, info, features, judge)
        finally:
            train.unpersist()
            parts.unpersist()
    finally:
        data.unpersist()


def fit_count(
    df: DataFrame,
    y: str,
    features: Sequence[str],
    population: str | Column | None = None,
    name: str = "target",
    population_name: str = "all",
    feature_set: str = "all",
    id_col: str = "user_id",
    rounds: int = 250,
    seed: int = 42,
    share: float = 0.3,
    min_leaf: int = 100,
    baseline: bool = True,
) -> ModelResult:
    """Poisson baseline and boosted trees with Poisson loss for a count; predictions are kept at 0 or above."""
    names = [*["Baseline Poisson"][: int(baseline)], "Boosted"]
    info = {
        "task": "regression", "target_name": name, "target_col": y, "population": population_name,
        "feature_set": feature_set, "feature_count": len(features),
    }
    if y not in df.columns:
        return _unfitted(names, info, "no such column")
    checkpoint_dir(df.sparkSession)
    data = _prepared(df, F.greatest(num(y, dtype=dict(df.dtypes)[y]), F.lit(0.0)), features, population, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = data.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
        if size["lo"] == size["hi"]:
            return _unfitted(names, {**info, "row_count": size["n"]}, "a constant target" if size["n"] else "no rows")
        parts = stratified_split(data, None, share, seed, id_col).persist(StorageLevel.MEMORY_AND_DISK)
        train_n, test_n = parts.agg(F.count_if(~F.col("is_test")), F.count_if("is_test")).first()
        info |= {"train_row_count": train_n, "test_row_count": test_n}
        if not (train_n and test_n):
            return _unfitted(names, {**info, "row_count": size["n"]}, "too few rows to split")
        train = parts.where(~F.col("is_test")).coalesce(fit_parts(df.sparkSession, train_n)).persist(StorageLevel.MEMORY_AND_DISK)
        test = parts.where("is_test").coalesce(fit_parts(df.sparkSession, test_n))
        glm = GeneralizedLinearRegression(family="poisson", link="log", regParam=1e-4, maxIter=300)
        trees = PoissonTrees(features, rounds=rounds, min_leaf=min_leaf, seed=seed)
        pred = lambda f: f.select(id_col, "label", F.greatest(F.col("prediction"), F.lit(0.0)).alias("pred"))
        models = [("Boosted", trees, pred, True)]
        if baseline:
            models.insert(0, ("Baseline Poisson", Pipeline(stages=[*_stages(features, True), glm]), pred, False))
        def judge(scored: DataFrame, about: dict) -> ModelResult:
            return ModelResult([{**regression_metrics(scored, "label", "pred").first().asDict(), **about}], [], [], [])

        try:
            return _run(models, train, test, info, features, judge)
        finally:
            train.unpersist()
            parts.unpersist()
    finally:
        data.unpersist()


COUNT_TARGETS = ("payment_count", "active_days", "bought_hearts")


def model_grid(
    df: DataFrame,
    populations: Mapping[str, str | Column | None],
    feature_sets: Mapping[str, Sequence[str]],
    targets: Mapping[str, str],
    counts: Sequence[str] = COUNT_TARGETS,
    late: str = "d4_",
    workers: int = 4,
    **options,
) -> ModelResult:
    """Every target in every population with every feature set; a feature from the target period is refused.

    The fits do not depend on each other: `workers` of them are submitted side by side, so that the small stages of one
    fill the gaps of another.
    """
    leaks = sorted({c for cols in feature_sets.values() for c in cols if late in c})
    if leaks:
        raise ValueError(f"features from the target period: {leaks}")
    df = settle(df)  # every fit reads it again
    jobs = [
        (fit_count if name in counts else fit_binary, col, cols, rule, name, pop, fs)
        for pop, rule in populations.items()
        for fs, cols in feature_sets.items()
        for name, col in targets.items()
    ]

    def run(job) -> ModelResult:
        fit, *rest = job
        return fit(df, *rest, **options)

    with ThreadPoolExecutor(workers) as pool:
        return sum(pool.map(inheritable_thread_target(run), jobs), ModelResult.empty())


def best_models(metrics: DataFrame) -> DataFrame:
    """Best run per target: by ROC AUC for classes, by R2 for counts."""
    judged = metrics.withColumn("measure", F.coalesce("roc_auc", "r2"))
    return top_per_group(judged, ["target_name"], "measure", "population", ["feature_set", "model_type", "task"])

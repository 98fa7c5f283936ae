import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daymark.operators import predict as pr
from daymark.session import fit_parts
from daymark.plans import d3_models


def scored(spark, seed=0, n=500, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.clip(0.3 * y + rng.random(n), 0, 1)
    s[: n // 3] = 0.5  # a third of the rows share one score
    if ties:
        s = s.round(2)
    pdf = pd.DataFrame({"user_id": rng.permutation(n), "y": y, "score": s})
    return pdf, spark.createDataFrame(pdf)


def test_lift_with_a_tied_third(spark):
    pdf, df = scored(spark)
    ks = (0.01, 0.1, 0.4, 0.5, 1.0)
    pdf["h"] = [int(hashlib.md5(f"{pr.TIE_SEED}|{i}".encode()).hexdigest()[:15], 16) for i in pdf.user_id]
    ordered = pdf.sort_values(["score", "h"], ascending=[False, True])
    got = {r["top_k_rate"]: r for r in pr.lift(df, "y", "score", ks).collect()}
    for k in ks:
        n = max(1, math.ceil(len(pdf) * k))
        hits = int(ordered.y.head(n).sum())
        assert (got[k]["top_n"], got[k]["captured_positive_count"]) == (n, hits)
        assert got[k]["lift"] == pytest.approx(hits / n / pdf.y.mean())
    assert got[1.0]["lift"] == pytest.approx(1) and got[1.0]["capture_rate"] == 1


@pytest.mark.parametrize("ids", [[f"u-{i}" for i in range(200)], [2**60 + i for i in range(200)]])
def test_lift_takes_any_id_in_any_row_order(spark, ids):
    pdf = pd.DataFrame({"user_id": ids, "y": [i % 3 == 0 for i in range(200)], "score": 0.5})
    pdf["y"] = pdf.y.astype(int)
    h = [int(hashlib.md5(f"{pr.TIE_SEED}|{i}".encode()).hexdigest()[:15], 16) for i in ids]
    ordered = pdf.iloc[np.argsort(h)]
    for rows_ in (pdf, pdf.iloc[::-1]):
        got = pr.lift(spark.createDataFrame(rows_), "y", "score").collect()
        assert [r["captured_positive_count"] for r in got] == [int(ordered.y.head(r["top_n"]).sum()) for r in got]


def test_auc_and_average_precision(spark):
    pdf, df = scored(spark, 3)
    pos, neg = pdf[pdf.y == 1].score.to_numpy(), pdf[pdf.y == 0].score.to_numpy()
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    ap = 0.0
    for s in sorted(set(pdf.score), reverse=True):
        at, above = pdf[pdf.score == s], pdf[pdf.score >= s]
        ap += at.y.sum() / pdf.y.sum() * above.y.mean()
    got = pr.ranking_metrics(df, "y", "score").first()
    assert got["roc_auc"] == pytest.approx(pairs / len(pos) / len(neg)) and got["pr_auc"] == pytest.approx(ap)


def test_one_class_has_no_ranking_measures(spark):
    _pdf, df = scored(spark)
    got = pr.ranking_metrics(df.withColumn("y", F.lit(0)), "y", "score").first()
    assert got["roc_auc"] is None and got["pr_auc"] is None
    top = pr.lift(df.withColumn("y", F.lit(0)), "y", "score").first()
    assert top["lift"] is None and top["capture_rate"] is None


def test_judging_in_one_pass_equals_the_single_measures(spark):
    _pdf, df = scored(spark, 4)
    row, top, cells = pr.judge_classes(df, "y", "score", "user_id")
    one = pr.threshold_metrics(df, "y", "score").first().asDict() | pr.ranking_metrics(df, "y", "score").first().asDict()
    assert row == pytest.approx(one)
    assert sorted(tuple(c.values()) for c in cells) == sorted(tuple(r) for r in pr.confusion(df, "y", "score").collect())
    assert [t["captured_positive_count"] for t in top] == [r["captured_positive_count"] for r in pr.lift(df, "y", "score").collect()]


def test_regression(spark):
    rng = np.random.default_rng(1)
    y, p = rng.poisson(2, 300).astype(float), rng.random(300) * 4
    got = pr.regression_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    assert got["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["target_median"] == np.median(y)


def test_split_sizes(spark):
    df = spark.range(101).selectExpr("id as user_id", "if(id < 11, 1, 0) as y")
    parts = pr.stratified_split(df, "y", 0.3)
    got = {(r["y"], r["is_test"]): r["count"] for r in parts.groupBy("y", "is_test").count().collect()}
    assert got[(0, True)] == 28 and got[(1, True)] == 3
    whole = pr.stratified_split(df, None, 0.3)
    assert whole.where("is_test").count() == 31
    rare = pr.stratified_split(spark.range(51).selectExpr("id as user_id", "if(id = 0, 1, 0) as y"), "y", 0.3)
    assert rare.where("is_test").count() == 16 and rare.where("is_test and y = 1").isEmpty()


def test_derived_targets(spark, rows):
    df = spark.createDataFrame(
        [("a", 0, 0, 0.0, 0, "0", False), ("b", 3, 1, 10.0, 1, "1", False), ("c", 2, 2, 30.0, 1, "no", True)],
        "user_id string, active int, n int, hearts double, paid int, received_vote_yn_d0_3 string, sent_vote_experience_d0_3 boolean",
    )
    out, names = pr.derive_targets(df, {"active_days": "active", "payment_count": "n", "bought_hearts": "hearts", "paid": "paid"})
    cols = [names[k] for k in ("relation_experience", "churn", "high_active", "repeat_paid", "high_value_paid")]
    assert rows(out, "user_id", *cols) == [("a", 0, 1, 0, 0, 0), ("b", 1, 0, 1, 0, 0), ("c", 1, 0, 0, 1, 1)]
    nobody, names = pr.derive_targets(df.withColumn("hearts", F.lit(0.0)), {"bought_hearts": "hearts"})
    assert "high_value_paid" not in names


def learnable(spark, n=240):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"user_id": range(n), "a": x[:, 0], "b": x[:, 1]})
    pdf["y"] = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    pdf["c"] = rng.poisson(np.exp(0.5 * x[:, 0])).astype(float)
    return spark.createDataFrame(pdf)


def test_fits_guards_and_error_rows(spark):
    df = learnable(spark)
    r = pr.fit_binary(df, "y", ["a", "b"], name="y", rounds=3, min_leaf=10)
    by = {m["model_type"]: m for m in r.metrics}
    assert by["Baseline Logistic"]["roc_auc"] > 0.85 and by["Boosted"]["roc_auc"] > 0.8
    assert by["Boosted"]["train_row_count"] + by["Boosted"]["test_row_count"] == 240 and by["Boosted"]["test_row_count"] == 72
    assert len(r.topk) == 8 and len(r.confusion) == 8 and {i["feature"] for i in r.importance} == {"a", "b"}
    assert pr.best_models(r.metrics_frame(spark)).count() == 1
    c = pr.fit_count(df, "c", ["a", "b"], name="c", rounds=3, min_leaf=10)
    assert {m["model_type"] for m in c.metrics} == {"Baseline Poisson", "Boosted"} and all(m["mae"] > 0 for m in c.metrics)
    errors = lambda r: [m.get("error") for m in r.metrics]
    assert errors(pr.fit_binary(df, "absent", ["a"])) == ["no such column"] * 2
    assert errors(pr.fit_binary(df, "y", ["a"], population="user_id < 90", rounds=1)) == [None, None]
    assert errors(pr.fit_binary(df.withColumn("y", F.lit(1)), "y", ["a"])) == ["a single class"] * 2
    assert errors(pr.fit_binary(df, "y", ["a"], population="false", baseline=False)) == ["no rows"]
    assert errors(pr.fit_count(df.withColumn("c", F.lit(2)), "c", ["a"])) == ["a constant target"] * 2
    broken = pr.fit_binary(df, "y", ["a", "b"], name="y", rounds=-1)
    assert [bool(m.get("error")) for m in broken.metrics] == [False, True]


def test_features_from_the_target_period_are_refused(spark):
    with pytest.raises(ValueError, match="target period"):
        pr.model_grid(learnable(spark), {"all": None}, {"bad": ["paid_d4_28"]}, {"y": "y"})


def test_check_list_covers_what_is_present():
    names = [*d3_models.ENV, *d3_models.RECEIVE, *d3_models.SEND, *d3_models.TARGETS, *d3_models.DERIVED]
    full = d3_models.checks(names)
    assert len(full) == 60  # with the repeated-key check and the leakage refusal: the 62 published ones
    assert len({c["check"] for c in full}) == len(full)
    assert d3_models.checks(["friends_d3"]) == [{"check": "friends_d3: negative", "severity": "error", "condition": "cast(`friends_d3` as double) < 0"}]


def test_few_rows_are_fitted_in_few_partitions(spark, monkeypatch):
    """Every round of boosting is several jobs: a small table must not be spread over all shuffle partitions."""
    seen = []
    monkeypatch.setattr(pr, "_run", lambda models, train, test, *rest: seen.append(train.rdd.getNumPartitions()) or pr.ModelResult.empty())
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pr.fit_binary(learnable(spark), "y", ["a", "b"], rounds=1)
        pr.fit_count(learnable(spark), "y", ["a", "b"], rounds=1)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert seen == [1, 1]
    cores = spark.sparkContext.defaultParallelism
    assert [fit_parts(spark, n) for n in (0, 50_000, 50_001, 10**6 * cores, 10**6 * cores + 1)] == [1, 1, 2, cores, cores + 1]


def test_registered_grid_keeps_every_round(spark, monkeypatch):
    import inspect

    from daymark.catalog import load, models

    asked = {}
    monkeypatch.setattr(models, "_grid_mart", lambda s, d: None)
    monkeypatch.setattr(models, "_grid_report", lambda result, s: s.range(1))
    monkeypatch.setattr(models.d3_models, "basic_grid", lambda mart, **options: asked.update(options))
    load().queries["model_grid"](spark, "")
    for fit in (pr.fit_binary, pr.fit_count):
        rounds = inspect.signature(fit).parameters["rounds"].default
        assert rounds == 250 and asked.get("rounds", rounds) == rounds

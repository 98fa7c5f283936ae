import random
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from daymark.operators.cluster import quota_sample, quotas
from daymark.operators.ordering import average_ranks, hash_ranked, quantiles, range_cuts, running

pandas = pytest.importorskip("pandas")


def frame(spark, values, by=None):
    rows = [(str(b), float(v) if v is not None else None) for b, v in zip(by or ["g"] * len(values), values)]
    return spark.createDataFrame(rows, "g string, v double")


PROBS = {"p1": 0.01, "p33": 1 / 3, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_interpolate_like_numpy(spark, values):
    got = quantiles(frame(spark, values), ["v"], PROBS).first()
    for name, q in PROBS.items():
        assert got[name] == pytest.approx(float(np.quantile(values, q)), rel=1e-9, abs=1e-9)


def test_quantiles_with_a_value_holding_most_rows(spark):
    rng = np.random.default_rng(0)
    values = [0.0] * 700 + list(rng.lognormal(3, 2, 300)) + [None, float("nan")]
    by = ["a" if i % 3 else "b" for i in range(len(values))]
    got = {r["g"]: r for r in quantiles(frame(spark, values, by), ["v"], PROBS, ["g"]).collect()}
    for g in "ab":
        mine = [v for v, b in zip(values, by) if b == g and v is not None and v == v]
        for name, q in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(mine, q), rel=1e-9)


def test_published_example(spark):
    assert quantiles(frame(spark, [1, 2, 3, 10]), ["v"], {"q": 0.99}).first()["q"] == pytest.approx(9.79)


def test_running_totals_match_a_sorted_scan(spark):
    rng = np.random.default_rng(1)
    pdf = pandas.DataFrame({"k": rng.integers(0, 3, 500), "o": rng.permutation(500), "x": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    got = running(df, "o", ["x"], by=["k"]).toPandas().sort_values(["k", "o"])
    want = pdf.sort_values(["k", "o"])
    assert (got["x_before"].to_numpy() == (want.groupby("k")["x"].cumsum() - want["x"]).to_numpy()).all()
    assert (got["x_total"].to_numpy() == want.groupby("k")["x"].transform("sum").to_numpy()).all()


def test_no_range_holds_the_whole_group(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) as v")
    cuts = range_cuts(df, ["v"])
    sizes = np.diff([0, *cuts, 10_000])
    assert len(cuts) == 7 and sizes.max() < 2_500


def test_average_ranks_share_ties(spark):
    got = {r["value"]: r["rank"] for r in average_ranks(frame(spark, [5, 1, 1, 7, 5, 5]), ["v"]).collect()}
    assert got == {1.0: 1.5, 5.0: 4.0, 7.0: 6.0}


def test_empty_frame(spark):
    assert quantiles(frame(spark, [None]), ["v"], {"q": 0.5}).count() == 0


def test_quotas(spark):
    def shared(counts, n, **options):
        df = spark.createDataFrame(list(counts.items()), "label string, c long")
        return {r["label"]: r["quota"] for r in quotas(df, n, **options).collect()}

    assert shared({"a": 90, "b": 9, "c": 1}, 10) == {"a": 7, "b": 2, "c": 1}  # one each, then 7 among 89, 8 and 0
    assert shared({"a": 50, "b": 30, "c": 20}, 9) == {"a": 4, "b": 3, "c": 2}
    assert shared({"a": 5, "b": 5}, 100) == {"a": 5, "b": 5}
    assert shared({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}  # n below the number of labels
    assert shared({"a": 50, "b": 1}, 16, least=0) == {"a": 16, "b": 0}
    assert shared({}, 5) == {}
    rng = random.Random(1)
    for _ in range(5):
        counts = {f"k{i}": rng.randrange(1, 60) for i in range(rng.randrange(1, 9))}
        n = rng.randrange(sum(counts.values()) + 5)
        got = shared(counts, n)
        assert sum(got.values()) == min(n, sum(counts.values())) and all(0 <= got[k] <= c for k, c in counts.items())


def test_quota_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000).selectExpr("id as user_id", "if(id % 10 = 0, 'rare', 'usual') as label")
    a = quota_sample(df, "label", 50, seed=3)
    assert {r["label"]: r["count"] for r in a.groupBy("label").count().collect()} == {"rare": 6, "usual": 44}
    b = quota_sample(df.repartition(13), "label", 50, seed=3)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    c = quota_sample(df, "label", 50, seed=4)
    assert not a.exceptAll(c).isEmpty()


def test_hash_order_is_a_permutation(spark):
    got = hash_ranked(spark.range(300).withColumnRenamed("id", "user_id"), [], "user_id", 1)
    assert sorted(r["n_before"] for r in got.collect()) == list(range(300))

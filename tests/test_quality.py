import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.functions import MetricSpec
from daymark.operators import quality as ql
from daymark.operators.tables import bucketize, date_list_metrics, dedup, exclude_ids, fill_defaults, flag_member, pivot_fill

pd = pytest.importorskip("pandas")
INF = float("inf")


def mart(spark, n=200):
    return spark.range(n).selectExpr("cast(id as string) as user_id", "if(id < 1, 5.0D, 0.0D) as rare", "cast(id as double) as v")


def test_dedup_keeps_the_least_in_order(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None), (None, 1, "n")], "k string, o int, p string")
    assert rows(dedup(df, ["k"], ["o"])) == rows(
        spark.createDataFrame([("a", 1, "y"), ("b", 5, None), (None, 1, "n")], "k string, o int, p string")
    )


def test_duplicate_audit(spark):
    cells = [("k1", "a"), ("k1", "a"), ("k1", "b"), ("k2", "c"), ("k2", "c")]
    got = ql.duplicate_audit(spark.createDataFrame(cells, "k string, v string"), ["k"]).first()
    assert (got["row_count"], got["full_row_duplicates"], got["key_duplicates"], got["key_not_row_duplicates"]) == (5, 2, 3, 1)
    assert got["duplicated_key_groups"] == 2 and got["full_share_pct"] == pytest.approx(200 / 3)


def test_winsor_modes_differ_only_at_a_zero_cap(spark):
    clip = ql.winsorize(mart(spark), ["rare", "v"], 0.99, "clip").agg(F.max("rare"), F.max("v")).first()
    skip = ql.winsorize(mart(spark), ["rare", "v"], 0.99, "skip").agg(F.max("rare"), F.max("v")).first()
    assert clip[0] == 0.0 and skip[0] == 5.0
    assert clip[1] == skip[1] == pytest.approx(np.quantile(range(200), 0.99))
    low = ql.winsorize(spark.createDataFrame([(-4.0,), (1.0,), (None,)], "v double"), ["v"], 1.0, "clip")
    assert sorted(r["v"] for r in low.collect()) == [0.0, 0.0, 1.0]
    low = ql.winsorize(spark.createDataFrame([(-4.0,), (1.0,), (None,)], "v double"), ["v"], 1.0, "skip")
    assert sorted(r["v"] for r in low.collect()) == [-4.0, 0.0, 1.0]


def test_bounds(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("b", 30, -1), ("c", None, 2)], "user_id string, d int, n int")
    rules = [{"column": "d", "min": 0, "max": 29, "reason": "days"}, {"column": "n", "min": 0, "reason": "sign"}, {"column": "zz", "max": 1}]
    kept, audit, removed = ql.apply_bounds(df, rules)
    assert rows(kept, "user_id") == [("a",), ("c",)]
    assert rows(removed, "user_id", "invalid_reasons") == [("b", "days; sign")]
    assert rows(audit, "column", "invalid_count") == [("d", 1), ("n", 1)]


def test_isolated_extremes(spark, rows):
    df = spark.range(1000).selectExpr("id as user_id", "if(id = 7, 5000, id % 10) as x", "id % 10 as y")
    audit, found = ql.isolated_extremes(df, ["x", "y"])
    assert rows(audit.where("is_isolated"), "column") == [("x",)]
    assert rows(found, "user_id", "column", "value") == [(7, "x", 5000.0)]
    assert exclude_ids(df, found, "user_id").count() == 999
    none = ql.isolated_extremes(df, ["y"])[1]
    assert none.count() == 0 and none.columns == found.columns


def test_outlier_holder_is_the_least_id(spark):
    df = spark.createDataFrame([(3, 9.0), (1, 9.0), (2, None)], "user_id long, x double")
    got = ql.outlier_profile(df, ["x"], expected_max={"x": 8}).first()
    assert got["max_id"] == 1 and got["above_expected_max_count"] == 2 and got["non_null_count"] == 2


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.poisson(0.2, 400).astype(float), "b": rng.normal(size=400), "c": 1.0})
    pdf["t"] = pdf.a * 2 + rng.normal(size=400)
    df = spark.createDataFrame(pdf)
    got = {(r["target"], r["feature"]): r["spearman_corr"] for r in ql.spearman(df, ["a", "b"], ["t"]).collect()}
    want = pdf.corr(method="spearman") if _has_scipy() else pdf.rank().corr()
    assert got[("t", "a")] == pytest.approx(want.loc["t", "a"]) and got[("t", "b")] == pytest.approx(want.loc["t", "b"])
    pear = {(r["x"], r["y"]): r["corr"] for r in ql.pearson(df, ["a", "b", "c"]).collect()}
    assert set(pear) == {(x, y) for x in "ab" for y in "ab"}
    assert pear[("a", "b")] == pytest.approx(pdf.corr().loc["a", "b"])


def _has_scipy():
    try:
        import scipy  # noqa: F401
    except ImportError:
        return False
    return True


def test_validation_levels(spark):
    df = spark.createDataFrame([("a", 0)], "k string, v int")
    assert ql.validate_result(df, "r", ["k"], ["v"]).first()["status"] == "warn"
    assert ql.validate_result(df, "r", ["k"], ["v"], allow_all_zero=False).first()["status"] == "error"
    assert ql.validate_result(df, "r", ["k"], [], min_rows=2).first()["status"] == "error"
    with pytest.raises(ValueError, match="missing columns: w"):
        ql.validate_result(df, "r", ["k"], ["w"], strict=True)


def test_describe_replaces_bad_values(spark):
    df = spark.createDataFrame([(1.0, True), (float("inf"), False), (float("nan"), None), (None, True)], "x double, f boolean")
    got = {r["column"]: r for r in ql.describe(df, ["x", "f"]).collect()}
    assert got["x"]["count"] == 4 and got["x"]["max"] == 1.0 and got["x"]["p50"] == 0.0
    assert got["f"]["mean"] == 0.5
    assert ql.missing(df).where("column = 'x'").first()["missing_count"] == 2


def test_targets(spark):
    df = spark.createDataFrame([(1, 0)], "returned_d4_28 int, paid_flag_d4_7 int")
    chosen, audit, window = ql.resolve_targets(df)
    assert chosen == {"returned": "returned_d4_28", "paid": "paid_flag_d4_7"} and window == "mixed"
    assert ql.resolve_targets(df.select("returned_d4_28"))[2] == "D4-D28"
    assert audit.where("target_key = 'active_days'").first()["selected_column"] is None


def test_histogram_matrix_and_shapes(spark, rows):
    df = spark.createDataFrame([(0, 1), (1, 5), (2, None), (40, 2)], "x int, y int")
    hist = ql.bucket_histogram(df, "x", [0, 1, 5, 10, INF], ["1", "2-5", "6-10", "11+"])
    assert [(r[0], r[2], r[3]) for r in hist.orderBy("bucket_ord").collect()] == [("1", 2, 50.0), ("2-5", 1, 25.0), ("6-10", 0, 0.0), ("11+", 1, 25.0)]
    cut = bucketize(df, "x", [-0.1, 0, INF], ["zero", "some"], "b")
    assert rows(pivot_fill(cut, ["b"], "y", F.count(F.lit(1)), [1, 5]), "b", "1", "5") == [("some", 0, 1), ("zero", 1, 0)]
    filled = fill_defaults(spark.createDataFrame([(None, None, None, "k")], "a int, b boolean, s string, user_id string"))
    assert rows(filled) == [(0, False, None, "k")]
    ids = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert rows(flag_member(df, ids, "x", "hit"), "x", "hit") == [(0, False), (1, True), (2, False), (40, False)]


def test_consistency_counts_repeats(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 2), ("b", None, 1)], "user_id string, p int, q int")
    got = ql.consistency(df, [{"check": "p>q", "condition": "p > q"}], "user_id")
    assert {r["check"]: (r["violations"], round(r["rate"], 3)) for r in got.collect()} == {"p>q": (1, 0.333), "user_id repeated": (1, 0.333)}
    assert ql.violations(got).count() == 2


def test_date_lists_per_row(spark, rows):
    df = spark.createDataFrame([(1, "['2024-01-01', '2024-01-02']"), (2, None)], "id int, l string")
    assert rows(date_list_metrics(df, "id", "l"), "id", "day_count", "longest_streak") == [(1, 2, 2), (2, 0, 0)]


def test_sensitivity_keeps_vanished_groups(spark, rows):
    df = spark.createDataFrame([("g", 1), ("h", 3)], "g string, v int")
    out = ql.sensitivity(df, df.where("g = 'g'"), ["g"], [MetricSpec("n", "rows")])
    assert rows(out) == [("g", 1, 1, 0), ("h", 1, None, None)]

import pytest

from daymark.functions import MetricSpec
from daymark.operators import segments as sg
from daymark.operators.daily import coverage, payer_split, repeat_split
from daymark.operators.peers import active_peers, edge_degrees, edge_summary, funnel, group_sizes

M = [MetricSpec("n", "rows"), MetricSpec("m", "mean", "v"), MetricSpec("s", "sum", "v"), MetricSpec("r", "rate", "f"), MetricSpec("z", "nonzero", "v")]


def frame(spark):
    return spark.createDataFrame(
        [("a", 1, True), ("a", None, None), ("b", 0, False), (None, 7, True)], "g string, v int, f boolean"
    )


def test_empty_labels_and_missing_keys(spark):
    got = {r["g"]: r for r in sg.summarize(frame(spark), ["g"], M, {"g": ["b", "a", "c"]}).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["n"], got["a"]["m"], got["a"]["s"], got["a"]["r"], got["a"]["z"], got["a"]["g_ord"]) == (2, 1.0, 1, 50.0, 1, 1)
    assert (got["c"]["n"], got["c"]["m"], got["c"]["s"], got["c"]["r"]) == (0, None, 0, None)
    assert sg.summarize(frame(spark), ["g"], M, keep_null_keys=True).count() == 3


def test_shares_and_zero_totals(spark, rows):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 0)], "g string, c string, n int")
    assert rows(sg.with_share(df, "n", ["g"]), "g", "c", "ratio_pct") == [("a", "x", 25.0), ("a", "y", 75.0), ("b", "x", 0.0)]
    assert sum(r["ratio_pct"] for r in sg.with_share(df, "n").collect()) == pytest.approx(100)


def test_top_per_group_breaks_ties_by_label(spark, rows):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "w", 2.0), ("b", "x", None), ("c", "q", 1.0)], "g string, label string, v double")
    assert rows(sg.top_per_group(df, ["g"], "v", "label")) == [("a", "w", 2.0), ("c", "q", 1.0)]


def test_difference_text(spark):
    df = spark.createDataFrame([("yes", 41.3, 3.0), ("no", 40.0, 4.5)], "g string, r double, d double")
    out = sg.compare_to_base(df, "g", "no", {"r": "rate %+.1f%%p", "d": "days %+.2f"})
    got = {r["g"]: r["interpretation"] for r in out.collect()}
    assert got == {"yes": "rate +1.3%p, days -1.50", "no": "base group"}
    assert sg.compare_to_base(df, "g", "none", {"r": "%f"}).first()["interpretation"] == ""


def test_dominant_axis_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("l", 0.0, 2.0)], "c string, a double, b double")
    out = sg.describe_rows(df, {"A": "a", "B": "b"}, "%s leads with %s", ["c", "dominant_axis"])
    assert [r["interpretation"] for r in out.orderBy("c").collect()] == ["k leads with A", "l leads with B"]


def test_conditional_means_from_published_totals(spark):
    df = spark.createDataFrame([(10, 4, 0)], "s int, n int, z int")
    got = sg.conditional_means(df, [("s", "n", "m"), ("s", "z", "none")]).first()
    assert (got["m"], got["none"]) == (2.5, 0.0)


def test_peers(spark, rows):
    u = spark.createDataFrame([("a", "k", True), ("b", "k", False), ("c", "k", True), ("d", None, True), ("e", "solo", True)], "user_id string, key string, is_active boolean")
    sized = group_sizes(u, {"key": "total"})
    got = active_peers(sized, {"key": ("class", "total")})
    assert rows(got, "user_id", "total", "class_active_d0_7", "class_active_ratio_d0_7") == [
        ("a", 3, 1, 0.5), ("b", 3, 2, 1.0), ("c", 3, 1, 0.5), ("d", 0, 0, 0.0), ("e", 1, 0, 0.0),
    ]
    assert rows(funnel(u, {"all": "true", "on": "is_active", "k": "key = 'k'"})) == [("all", 5), ("k", 3), ("on", 4)]


def test_edges(spark, rows):
    e = spark.createDataFrame([("a", "b", True), ("a", "b", False), ("a", "c", False), ("b", "a", True), (None, "a", True)], "send_user_id string, receive_user_id string, accepted boolean")
    assert rows(edge_degrees(e)) == [("a", 3, 1, 2, 1, 1, 1), ("b", 1, 1, 1, 2, 1, 1), ("c", 0, 0, 0, 1, 0, 1)]
    assert dict(rows(edge_summary(e))) == {"rows": 5, "senders": 2, "receivers": 3, "pairs": 3, "accepted": 3}


def test_splits(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "n int")
    assert rows(repeat_split(df, {"c": "n >= 2"})) == [("c", "repeat", 2, 50.0), ("c", "single", 2, 50.0)]
    u = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "user_id string")
    p = spark.createDataFrame([("a", 3)], "user_id string, payment_distinct_at int")
    assert rows(payer_split(u, p)) == [("paid", 1, 3.0, 25.0), ("unpaid", 3, None, 75.0)]
    assert rows(coverage({"u": (u, "user_id"), "p": (p, "user_id")})) == [("p", 1), ("u", 4)]

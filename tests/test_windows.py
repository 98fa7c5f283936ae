from datetime import date, timedelta

import numpy as np
import pandas as pd

from daymark.functions import MetricSpec
from daymark.operators.metrics import (
    attendance_summary,
    leave_one_out,
    longest_streak,
    payment_amount,
    payment_metrics,
    receiver_rates,
    session_behaviour,
    user_mart,
)
from daymark.operators.windows import (
    after_anchor,
    assemble,
    compare,
    distinct_in_windows,
    first_in_window,
    lookup_or_self,
    outer_merge,
    pick,
    resolve_identity,
    signup_offset,
    window_metrics,
)

D0 = date(2024, 1, 10)


def day(n):
    return D0 + timedelta(days=n)


def users(spark, *ids):
    return spark.createDataFrame([(i, D0) for i in ids], "user_id string, signup_date date")


def facts(spark, cells):
    return spark.createDataFrame([(u, day(n) if n is not None else None, v) for u, n, v in cells], "user_id string, day date, v int")


EDGES = [
    ("a", -1, 1), ("a", 0, 1), ("a", 7, 1), ("a", 8, 1), ("a", 28, 1), ("a", 29, 1), ("a", 7, 1),
    ("x", 3, 1), (None, 3, 1), ("a", None, 1),
]


def test_window_edges_unknown_users_and_dense_base(spark, rows):
    M = [MetricSpec("n", "rows"), MetricSpec("d", "days"), MetricSpec("s", "sum", "v"), MetricSpec("hit", "flag")]
    got = window_metrics(facts(spark, EDGES), users(spark, "a", "b"), pick("d0_7", "d8_28"), M)
    assert rows(got) == [
        ("a", 3, 2, 3, True, 2, 2, 2, True),
        ("b", 0, 0, 0, False, 0, 0, 0, False),
    ]


def test_offsets_keep_unknown_users_outside(spark, rows):
    got = signup_offset(facts(spark, EDGES), users(spark, "a"))
    assert got.where("user_id = 'x'").first()["day_offset"] is None
    assert got.where("user_id = 'a' and v = 1 and day = date'2024-01-09'").first()["day_offset"] == -1


def test_extremes_and_means_are_null_without_rows(spark, rows):
    M = [MetricSpec("lo", "min", "v"), MetricSpec("hi", "max", "v"), MetricSpec("avg", "mean", "v")]
    got = window_metrics(facts(spark, [("a", 0, 4), ("a", 0, 2), ("a", 1, 9)]), users(spark, "a", "b"), {"d0": (0, 0)}, M)
    assert rows(got) == [("a", 2, 4, 3.0), ("b", None, None, None)]


def random_facts(seed, n=4000, hot=0.4):
    rng = np.random.default_rng(seed)
    who = np.where(rng.random(n) < hot, 0, rng.integers(0, 60, n))
    return pd.DataFrame(
        {
            "user_id": [f"u{i}" for i in who],
            "off": rng.integers(-2, 32, n),
            "p": rng.integers(0, 300, n),
            "q": rng.integers(0, 20, n),
        }
    )


def brute(pdf, ids, windows):
    out = []
    for u in ids:
        mine, row = pdf[pdf.user_id == u], [u]
        for a, b in windows.values():
            part = mine[(mine.off >= a) & (mine.off <= b)]
            row += [len(part), part.off.nunique(), part.p.nunique(), part.q.nunique()]
        out.append(tuple(row))
    return sorted(out)


def hot_case(spark):
    pdf = random_facts(5)
    W = pick("d0", "d0_7", "d8_28")
    ids = [f"u{i}" for i in range(62)]
    df = spark.createDataFrame([(r.user_id, day(int(r.off)), int(r.p), int(r.q)) for r in pdf.itertuples()], "user_id string, day date, p int, q int")
    M = [MetricSpec("n", "rows"), MetricSpec("d", "days"), MetricSpec("p", "distinct", "p"), MetricSpec("q", "distinct", "q")]
    return window_metrics(df, users(spark, *ids), W, M), brute(pdf, ids, W)


def test_distinct_counts_with_one_user_holding_a_third(spark, rows):
    got, want = hot_case(spark)
    assert sorted(rows(got)) == want


def test_hot_user_join_is_split_when_tables_are_large(spark, rows):
    """With size limits scaled down, the join that meets unaggregated (user, item, day) rows is split."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got, want = hot_case(spark)
        collected = sorted(tuple(r) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert collected == want
        assert "skew=true" in plan, plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_plan_has_one_scan_path_per_grain(spark):
    """All windows share one aggregate: two exchanges of the fact, one of the users."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        M = [MetricSpec("n", "rows"), MetricSpec("d", "days")]
        df = window_metrics(facts(spark, EDGES), users(spark, "a"), pick("d0", "d0_7", "d8_28"), M)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3 and "Python" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_streaks(spark, rows):
    days = [("a", 0), ("a", 1), ("a", 1), ("a", 2), ("a", 5), ("b", 21), ("b", 22), ("c", 3), ("d", None)]
    df = spark.createDataFrame([(u, day(n) if n is not None else None) for u, n in days], "user_id string, day date")
    assert rows(longest_streak(df)) == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(attendance_summary(df)) == [("a", 4, 3, True), ("b", 2, 2, True), ("c", 1, 1, False)]


def test_anchor_day_counts_and_window_cuts(spark, rows):
    u = users(spark, "a", "b", "c")
    first = first_in_window(facts(spark, [("a", 3, 1), ("a", 5, 1), ("b", 8, 1), ("c", 0, 1)]), u, "d0_7")
    assert rows(first) == [("a", 3, day(3)), ("c", 0, day(0))]
    acts = facts(spark, [("a", 2, 1), ("a", 3, 1), ("a", 3, 1), ("a", 28, 1), ("a", 29, 1), ("b", 9, 1)])
    assert rows(after_anchor(acts, first, u, "d0_28", "n")) == [("a", 3, True), ("c", 0, False)]
    assert rows(after_anchor(acts, first, u, "d0_28", "n", days=True)) == [("a", 2, True), ("c", 0, False)]


def test_receiver_rates(spark, rows):
    df = spark.createDataFrame(
        [("a", 4, 3, 2), ("b", 0, 0, None), ("c", 1, 2, 0)],
        "user_id string, received_count_d0_7 int, received_read_count_d0_7 int, first_offset int",
    )
    out = receiver_rates(df)
    cols = ["user_id", "received_read_rate_d0_7", "unread_received_count_d0_7", "first_day_filled", "early_received_score_d0_7"]
    assert rows(out, *cols) == [("a", 0.75, 1, 2, 6), ("b", 0.0, 0, 8, 0), ("c", 1.0, 0, 0, 8)]


def test_leave_one_out_gap(spark, rows):
    def f(cells):
        return spark.createDataFrame([(u, day(n)) for u, n in cells], "user_id string, activity_date date")

    frames = {"sent": f([("a", 1), ("a", 2), ("a", 2)]), "read": f([("a", 2), ("a", 9)])}
    got = leave_one_out(frames, users(spark, "a", "b"), "sent", pick("d0_28"))
    assert rows(got) == [("a", 3, 2, 1), ("b", 0, 0, 0)]


def test_sessions_resolve_before_windows(spark, rows):
    ev = spark.createDataFrame(
        [("s1", "open", day(0)), ("s1", "open", day(0)), ("s1", "done", day(1)), ("s2", "open", day(2)), ("s9", "open", day(0)), ("s1", "other", day(0)), ("s1", "done", day(1)), ("s1", "done", day(1))],
        "session_id string, event_key string, day date",
    )
    ids = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a"), ("s3", None)], "session_id string, user_id string")
    fam = {"start": ["open"], "complete": ["done"], "skip": ["skip"]}
    got = session_behaviour(ev, ids, users(spark, "a"), fam, pick("d0_7"))
    assert rows(got) == [("a", 3, 3, 0, 3, 1.0, 0.0)]
    more = session_behaviour(ev.where("day > date'2024-01-10'"), ids, users(spark, "a"), fam, pick("d0_7"), clip=False)
    assert more.first()["question_completion_rate_d0_7"] == 3.0


def test_joins_do_not_match_missing_keys(spark, rows):
    df = spark.createDataFrame([("k1", 1), (None, 2), ("k9", 3)], "k string, v int")
    dim = spark.createDataFrame([("k1", "x"), (None, "y")], "k string, val string")
    assert rows(lookup_or_self(df, dim, "k", "val", "out"), "v", "out") == [(1, "x"), (2, None), (3, "k9")]
    assert rows(resolve_identity(df, dim.withColumnRenamed("val", "user_id"), "k"), "v", "user_id") == [(1, "x")]


def test_assembly_and_merges(spark, rows):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, x int")
    b = spark.createDataFrame([("b", 3), ("c", 4)], "user_id string, y int")
    assert rows(outer_merge(a, b)) == [("a", 1, None), ("b", 2, 3), ("c", None, 4)]
    assert rows(assemble(a, b)) == [("a", 1, None), ("b", 2, 3)]
    assert rows(user_mart(a, b, defaults={"z": 0, "x": 9})) == [("a", 1, 0, 0), ("b", 2, 3, 0)]
    side = compare(a, a.where("x > 1"), ["user_id"], ["x"])
    assert rows(side) == [("a", 1, None, None), ("b", 2, 2, 0)]


def test_amount_source(spark, rows):
    pay = spark.createDataFrame([("a", day(0), "heart.50"), ("a", day(9), "none")], "user_id string, day date, productId string")
    assert payment_amount(pay)[1] == "productId_digits"
    got = payment_metrics(pay, users(spark, "a"), pick("d0_28"))
    assert rows(got) == [("a", 2, 2, 50.0, True)]
    priced = pay.selectExpr("user_id", "day", "productId", "'1,200' as Price")
    assert payment_amount(priced)[1] == "Price"
    assert payment_metrics(priced, users(spark, "a"), pick("d0_28")).first()["payment_amount_d0_28"] == 2400.0


def test_distinct_counts_keep_narrow_rows(spark):
    """The grouping of (user, column, item) holds numbers only, and the rows that meet the signup day are not sorted."""
    users = spark.sql("select 1L as user_id, date'2024-01-01' as signup_date")
    facts = spark.sql("select 1L as user_id, date'2024-01-02' as day, 5L as a, 6L as b")
    out = distinct_in_windows(facts, users, {"a": "a", "b": "b"}, {"d0_7": (0, 7)}, "user_id", "day")
    assert out.collect()[0].asDict() == {"user_id": 1, "a_d0_7": 1, "b_d0_7": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy" in plan or "rightHint=(strategy" in plan
    assert "name = a" not in plan

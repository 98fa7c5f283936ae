from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.functions import MetricSpec
from daymark.functions import daymask as dm
from daymark.operators.metrics import leave_each_out, source_masks
from daymark.operators.windows import Fact, fact_metrics, pick, window_metrics

START = date(2024, 1, 31)


def frame(spark, cells):
    return spark.createDataFrame([(u, None if d is None else START + timedelta(days=int(d))) for u, d in cells], "user_id string, activity_date date")


def people(spark, *names):
    # different signup days, so that calendar blocks are cut at different places
    return spark.createDataFrame([(n, START + timedelta(days=17 * i)) for i, n in enumerate(names)], "user_id string, signup_date date")


def test_bit_operations_match_day_lists(spark):
    rng = np.random.default_rng(4)
    lists = [[], [0], [62], list(range(63)), *[sorted(set(rng.integers(0, 63, rng.integers(1, 50)).tolist())) for _ in range(40)]]
    df = spark.createDataFrame([(i, sum(1 << d for d in days)) for i, days in enumerate(lists)], "i int, m long")
    got = df.select("i", dm.days_in("m", 3, 20), dm.first_day("m"), dm.last_day("m"), dm.longest_run("m"), dm.days_in("m")).collect()
    for i, n, lo, hi, run, every in got:
        days = lists[i]
        best = max((sum(1 for _ in iter_run(days, d)) for d in days), default=0)
        assert (n, lo, hi, run, every) == (sum(3 <= d <= 20 for d in days), min(days, default=None), max(days, default=None), best, len(days))
    with pytest.raises(ValueError, match="do not fit"):
        dm.span_mask(0, 63)


def iter_run(days, d):
    have = set(days)
    while d in have:
        yield d
        d += 1


def test_every_source_left_out_in_one_call(spark):
    rng = np.random.default_rng(5)
    names = ["a", "b", "c", "d"]
    cells = {s: [(names[0] if r % 3 == 0 else names[int(rng.integers(0, 3))], rng.integers(-40, 160)) for r in range(200)] for s in ("x", "y", "z")}
    cells["x"] += [(None, 3), ("a", None), ("stranger", 4)]
    users = people(spark, *names)
    W = {"d0_7": (0, 7), "d8_62": (8, 62)}
    got = {r["user_id"]: r for r in leave_each_out({s: frame(spark, c) for s, c in cells.items()}, users, W).collect()}
    assert set(got) == set(names)  # a user without rows stays, others' rows do not appear
    for i, u in enumerate(names):
        days = {s: {int(d) - 17 * i for v, d in c if v == u and d is not None} for s, c in cells.items()}
        days = {s: {d for d in v if 0 <= d <= 62} for s, v in days.items()}
        every = set().union(*days.values())
        for w, (a, b) in W.items():
            assert got[u][f"active_days_{w}"] == sum(a <= d <= b for d in every)
            for s in days:
                rest = set().union(*[v for o, v in days.items() if o != s])
                assert got[u][f"active_days_excl_{s}_{w}"] == sum(a <= d <= b for d in rest)
                assert got[u][f"{s}_gap_{w}"] == got[u][f"active_days_{w}"] - got[u][f"active_days_excl_{s}_{w}"]
        assert got[u]["first_active_day"] == min(every, default=None) and got[u]["last_active_day"] == max(every, default=None)


def test_masks_read_each_source_once(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.to_date("ts").alias("activity_date"))
    users = ev.groupBy("user_id").agg(F.min("activity_date").alias("signup_date"))
    plan = source_masks({k: ev.where(F.col("event_type") == k) for k in ("click", "view")}, users)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3  # two sources and the users


def test_many_facts_equal_one_by_one(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if r % 3 == 0 else "bcd"[int(rng.integers(0, 3))], int(rng.integers(-5, 40)), int(rng.integers(-9, 9)), float(rng.normal())) for r in range(500)]
    rows += [(None, 1, 1, 1.0), ("a", None, 1, 1.0), ("zz", 1, None, None), ("b", 2, None, None)]
    df = spark.createDataFrame(
        [(u, None if o is None else START + timedelta(days=o), v, x) for u, o, v, x in rows], "user_id string, day date, v int, x double"
    )
    users, W, V = people(spark, "a", "b", "c", "e"), pick("d0_3", "d0_28"), pick("d0", "d8_28")
    M = [
        MetricSpec("n", "rows"), MetricSpec("pos", "rows", where="v > 0"), MetricSpec("vs", "count", "v"), MetricSpec("total", "sum", "v"),
        MetricSpec("mid", "mean", "x", where="v < 5"), MetricSpec("least", "min", "day"), MetricSpec("most", "max", "v"), MetricSpec("any", "flag"),
        MetricSpec("kinds", "distinct", "v"),
    ]
    N = [MetricSpec("other", "rows"), MetricSpec("sum2", "sum", "x")]
    days = MetricSpec("days", "days", where="v > 0")
    neg = df.where("v < 0")
    got = fact_metrics([Fact(df, [(W, M), (V, [days])]), Fact(neg, [(V, N), (V, [MetricSpec("days", "days")])])], users)
    both = df.where("v <> 0")  # the days of either fact
    want = window_metrics(df, users, W, M).join(window_metrics(neg, users, V, N), "user_id").join(
        window_metrics(both, users, V, [MetricSpec("days", "days")]), "user_id"
    )
    a = {r["user_id"]: r.asDict() for r in got.collect()}
    b = {r["user_id"]: r.asDict() for r in want.collect()}
    assert set(a) == set(b) == {"a", "b", "c", "e"} and set(got.columns) == set(want.columns)
    for u in b:
        for c, v in b[u].items():
            assert a[u][c] == (pytest.approx(v) if isinstance(v, float) else v), (u, c)


def test_facts_must_agree_on_shared_metrics(spark):
    df = frame(spark, [("a", 1)]).withColumnRenamed("activity_date", "day")
    users, W = people(spark, "a"), pick("d0_7")
    with pytest.raises(ValueError, match="two kinds"):
        fact_metrics([Fact(df, [(W, [MetricSpec("m", "rows")])]), Fact(df, [(W, [MetricSpec("m", "days")])])], users)
    with pytest.raises(ValueError, match="beyond a day mask"):
        fact_metrics([Fact(df, [({"d0_90": (0, 90)}, [MetricSpec("m", "days")])])], users)
    assert fact_metrics([Fact(df.limit(0), [(W, [MetricSpec("m", "rows")])])], users).first()["m_d0_7"] == 0

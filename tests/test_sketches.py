import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.operators import quality as ql
from daymark.operators import sketches as sk


def rank_range(values, v):
    return np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)


def test_rank_error_on_skewed_days(spark):
    rng = np.random.default_rng(3)
    parts = {d: rng.lognormal(d / 3, 2.0, 4000 * (d + 1)) for d in range(5)}
    parts[0][:2500] = 0.0  # one value holds most of a day
    rows = [(d, float(v)) for d, vs in parts.items() for v in vs]
    df = spark.createDataFrame([*rows, (1, None), (2, float("nan")), (9, None)], "d int, v double").repartition(16)
    daily = sk.sketch(df, ["v"], ["d"])
    probs = {f"p{i}": i / 100 for i in (1, 25, 50, 75, 90, 99)}
    bound = sk.rank_error()
    for frame, groups in ((daily, parts), (sk.merge(daily, []), {None: np.concatenate(list(parts.values()))})):
        for r in sk.read_quantiles(frame, probs).collect():
            values = np.sort(groups[r["d"] if "d" in r else None])
            assert r["n"] == len(values) and r["min"] == values[0] and r["max"] == values[-1] and r["mean"] == pytest.approx(values.mean())
            for name, q in probs.items():
                low, high = rank_range(values, r[name])
                assert low - bound <= q <= high + bound
    assert daily.where("d = 9").first()["sketch"] is None and sk.read_quantiles(daily, probs).where("d = 9").count() == 0
    assert sk.merge(daily.limit(0), []).count() == 0


def test_sketch_scans_once_and_stays_small(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    daily = sk.sketch(lines, ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_shipdate"])
    assert daily._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    one = sk.sketch(spark.range(400_000).select(F.rand(1).alias("v")), ["v"], []).select(F.length("sketch")).first()[0]
    assert one < 60_000


def test_audit_of_maps_structs_and_zeros(spark):
    df = spark.sql("""
      SELECT * FROM VALUES
        ('a', map('x', 1, 'y', 2), named_struct('p', 0.0D, 'q', CAST(NULL AS STRING)), array(1, NULL)),
        ('a', map('y', 2, 'x', 1), named_struct('p', -0.0D, 'q', CAST(NULL AS STRING)), array(1, NULL)),
        ('a', map('x', 1, 'y', 2), named_struct('p', 0.0D, 'q', 'null'), array(1, NULL)),
        ('b', map(), named_struct('p', 1.0D, 'q', ''), array()),
        ('b', NULL, named_struct('p', 1.0D, 'q', ''), array()),
        (NULL, NULL, NULL, NULL), (NULL, NULL, NULL, NULL)
      AS t(k, m, s, l)""")
    got = ql.duplicate_audit(df, ["k"]).first()
    assert (got["row_count"], got["full_row_duplicates"], got["key_duplicates"], got["key_not_row_duplicates"]) == (7, 2, 4, 2)
    empty = ql.duplicate_audit(df.limit(0), ["k"]).first()
    assert (empty["row_count"], empty["key_duplicates"], empty["full_share_pct"]) == (0, 0, None)


def test_audit_is_exact_when_digests_collide(spark):
    df = spark.range(600).selectExpr("id % 4 as k", "cast(id % 50 as string) as v", "timestamp_micros(id % 3) as at")
    want = ql.duplicate_audit(df, ["k"]).first()
    for digest in (lambda t: F.lit("same"), lambda t: F.substring(F.md5(t), 1, 1)):
        assert ql.duplicate_audit(df, ["k"], digest=digest).first() == want
    kinds = df.distinct().count()
    assert want["full_row_duplicates"] == 600 - kinds


def test_rank_matrix_matches_pandas(spark):
    pd = pytest.importorskip("pandas")
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({f"c{i}": rng.poisson(0.3 + i, 500).astype(float) for i in range(8)} | {"flat": 2.0, "cont": rng.normal(size=500)})
    pdf["c0"] += pdf.c1
    df = spark.createDataFrame(pdf)
    cols = list(pdf.columns)
    got = {(r["x"], r["y"]): r["corr"] for r in ql.spearman_matrix(df, cols).collect()}
    want = pdf.drop(columns="flat").rank().corr()
    assert set(got) == {(a, b) for a in want for b in want}
    assert all(got[a, b] == pytest.approx(want.loc[a, b]) for a, b in got)
    plans = [ql.rank_columns(df, cols[:n])._jdf.queryExecution().optimizedPlan().toString().count("Join") for n in (2, 8)]
    assert plans[0] == plans[1]  # joins do not grow with the columns

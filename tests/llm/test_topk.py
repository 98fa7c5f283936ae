import heapq
import math
import random

from daymark.llm import topk


def brute(rows, k, is_query):
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, a in ints.items():
        if is_query(q):
            scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ints.items() if i != q]
            out[q] = [(i, -s) for s, i in heapq.nsmallest(k, scored)]
    return out


def read(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_given_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=10, block=64, query_block=3)
    assert read(found) == brute(rows, 10, lambda i: i % 50 == 0)


def test_ties_sparse_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([0, 0, 0, 1, -1])) for _ in range(rng.choice([4, 6]))]) for i in range(200)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 4), (903, [float("inf"), 1.0]), (None, [1.0] * 4), (904, [])]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, score double, query_id string")
    assert read(topk.top_k(df, df.where("vec_id % 10 = 0"), k=7)) == brute(rows, 7, lambda i: i % 10 == 0)


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert read(topk.top_k(df, df, k=10)) == brute([(0, [1.0, 2.0]), (1, [3.0, -1.0])], 10, lambda i: True)
    assert topk.top_k(df.where("false"), df.where("false"), k=3).count() == 0
    assert topk.top_k(df, df.where("false"), k=3).count() == 0

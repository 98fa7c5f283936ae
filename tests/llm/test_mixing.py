import hashlib
import math
import re
from collections import Counter

import pytest

from daymark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Give by weight, stop at twice the size, share the excess again until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / open_ >= 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s]) if s in full else rest * weight[s] / open_ for s in names}
        full |= over


def part(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def brute(rows):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    targets, out = brute_targets(sizes), []
    for s, target in targets.items():
        own = sorted(
            ((n, hashlib.md5("|".join([mixing.SEED, *([str(i)] if i is not None else [])]).encode()).hexdigest(), i) for i, x, n in sized if x == s),
            key=lambda r: (r[0], r[1]),
        )
        rate, off = (target / sizes[s] if sizes[s] else 0.0), part(f"{mixing.SEED}|{'-' if s is None else '=' + s}")
        for k, (n, _, i) in enumerate(own):
            copies = min(math.floor(off + rate * (k + 1)) - math.floor(off + rate * k), math.ceil(rate))
            out.append((i, n, sizes[s], round(target, 6), copies))
    return Counter(out)


def read(df):
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in df.collect())


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    drawn = mixing.sample(docs)
    assert read(drawn) == brute(rows)
    for r in drawn.groupBy("source_key").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 2 * r["max(size)"]
    assert drawn.where("taken > 2 * size OR taken <> copies * size").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in drawn.where("copies > 0").collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 80}, {"a": 1, "b": 500, "c": 3, "d": 40, None: 7}, {"x": 0, "y": 5}, {"z": 9}, {"p": 0}])
def test_targets(spark, sizes):
    rows = [("-" if s is None else "=" + s, s, n) for s, n in sizes.items()]
    df = spark.createDataFrame(rows, "source_key string, source string, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.targets(df).collect()}
    want = {"-" if s is None else "=" + s: t for s, t in brute_targets(sizes).items()}
    assert got == pytest.approx(want)


def test_odd_rows(odd_docs, no_docs):
    assert read(mixing.sample(odd_docs)) == brute([(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()])
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    want = Counter()
    for r in mixing.sample(odd_docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.sample(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

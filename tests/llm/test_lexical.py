import math
import random
from collections import Counter

import numpy as np
import pytest

from daymark.llm import lexical

LETTERS = set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in LETTERS or ord(c) > 127:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, items, k=10):
    """Sorted (item, rank, doc, score) by scoring every document for every item."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, tuple(sorted(set(plain_terms(t))))) for i, t in items}:
        hits = []
        for doc, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                for t in text if t in c
            )
            if score > 0:
                hits.append((-score, doc is None, doc))
        out += [(item, rank, h[2], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def texts(seed, n, words=400, copies=0.3):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        if out and rng.random() < copies:
            out.append(rng.choice(out))
        else:
            out.append(" ".join(names[min(words - 1, int(rng.expovariate(1 / 60)))] for _ in range(rng.choice([3, 20, 80, 300]))))
    return out


def test_split_table_is_the_term_rule():
    every = "".join(map(chr, range(128))) + "É中 ß Ω"
    assert [t.decode() for t in lexical.terms(every.encode())] == plain_terms(every)
    assert lexical.terms(None) == lexical.terms(b"") == lexical.terms(b" .,\x00") == []


@pytest.mark.parametrize("small", [False, True])
def test_matches_scoring_everything(spark, monkeypatch, small):
    if small:  # many buckets per task, several blocks of queries
        monkeypatch.setattr(lexical, "BUCKET", 16)
        monkeypatch.setattr(lexical, "FOCUS", 3)
    docs = list(enumerate(texts(1, 700)))
    items = [(i, " ".join(t.split()[:12])) for i, t in enumerate(texts(2, 40, copies=0.1))]
    items += [(100, docs[5][1]), (101, "w1"), (102, "none of these"), (102, "none of these"), (103, "w2 w3"), (103, "w399 w398")]
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
        spark.createDataFrame(items, "item_id long, text string"),
        block_bytes=400 if small else lexical.BLOCK_BYTES,
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)


def test_bounds_leave_no_document_out():
    """Survivors hold every row that reaches the threshold, and the bounds do leave rows out."""
    rng = np.random.default_rng(3)
    cut = 0
    for _ in range(200):
        n, width = 60, 30
        rows = [np.sort(rng.choice(width, rng.integers(1, 8), replace=False)) for _ in range(n)]
        impacts = [rng.integers(1, 10 ** rng.integers(1, 9), len(r)) for r in rows]
        norms = np.array([math.sqrt(float((v.astype(float) ** 2).sum())) * (1 + lexical.MARGIN) for v in impacts])
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        bucket = lexical.Bucket(list(range(n)), norms, at, np.concatenate(rows), np.concatenate(impacts))
        query = rng.choice(width, rng.integers(1, 12), replace=False)
        wanted = np.isin(np.arange(width), query)
        scores = bucket.scores(np.arange(n), wanted)
        assert scores.tolist() == [int(v[wanted[r]].sum()) for r, v in zip(rows, impacts, strict=True)]
        for least in (1, int(np.median(scores)), int(scores.max())):
            left = bucket.survivors(query, least)
            assert set(np.flatnonzero(scores >= max(least, 1))) <= set(left)
            cut += n - len(left)
    assert cut > 10000


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "other words SECOND text", None), (None, "mail and ring", "x"), (2, None, "x"), (3, " .,", "x"), (1, "other words SECOND text", "y")],
        "item_id long, text string, rank string",
    )
    found = lexical.search(odd_docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "other words SECOND text"), (None, "mail and ring")])
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert lexical.search(no_docs, items).count() == 0
    assert lexical.search(odd_docs, items.where("false")).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), (None, "red fox"), ("c", "blue")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "fox"), ("q2", "blue")], "item_id string, text string")
    got = sorted((r["item_id"], r["rank"], r["doc_id"]) for r in lexical.search(docs, items, k=2).collect())
    assert got == [("q", 1, "a"), ("q", 2, "b"), ("q2", 1, "c")]

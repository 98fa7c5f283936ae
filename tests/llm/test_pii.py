import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daymark.llm import pii

# the contract's patterns, word for word
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def stays(kind, s):
        digits = [int(c) for c in s if c.isascii() and c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [d * 2 - 9 * (d * 2 > 9) if k % 2 else d for k, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if stays(k, m[0])]


@pytest.mark.parametrize("alphabet", ["ab1.@-+", "0123456789 -", "12.5", "+1 ()-.9", "a@b.c@ d", "4539 1488-0343 6467"])
def test_base_spans_match_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute(text), text


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.find(docs).withColumn("spans", pii.span_text(F.col("spans"))).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r["doc_id"]])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert {k: r[f"n_{k}"] for k in PATTERNS} == {k: Counter(x[0] for x in base)[k] for k in PATTERNS}
        assert set(told.split(",")) <= set(r["spans"].split(","))
        order = [(list(PATTERNS).index(k), int(s)) for k, s, _ in (x.split(":") for x in r["spans"].split(",") if x)]
        assert order == sorted(order)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1" + " " * 300_000, "a@" * 150_000, "1-" * 200_000):
        pii.redact_text(text, set())


def test_em_tells_good_from_bad_labelers():
    rng = random.Random(2)
    right = {"s": 0.95, "h": 0.9, "c": 0.55}
    counts = Counter()
    for _ in range(6000):
        yes = rng.random() < 0.3
        vote = lambda p: "+-"[(rng.random() < p) != yes]
        counts["0" + vote(right["s"]) + vote(right["h"]) + vote(right["c"]) + "0"] += 1
    q, prior, table = pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.06
    assert min(table[1, 0, 0], table[2, 0, 0]) > table[3, 0, 0] + 0.2
    assert q["0+++0"] > 0.9 and q["0---0"] < 0.05


def test_wide_spans_are_added_where_votes_agree(spark):
    rows = [(i, f"please mail jo{i}@mail.example.com or call +1 (555) 010-44{i % 90 + 10} today") for i in range(60)]
    rows += [(100 + i, f"my email is jo{i} [at] mail [dot] com, phone 555 010 44{i % 90 + 10} please") for i in range(30)]
    rows += [(200 + i, f"see build 123 456 78{i % 90 + 10} of release page ref") for i in range(30)]
    rows += [(300, "words only, nothing private in here"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find(docs).collect()}
    assert all(got[i] == {"email", "phone"} for i in range(60))
    assert all("email" in got[100 + i] for i in range(30))
    assert not any(got[200 + i] for i in range(30)) and not got[300] and not got[301]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "please mail [EMAIL] or call [PHONE] today"
    assert clean[300] == rows[-2][1] and clean[301] is None


def test_redacting_overlaps():
    text = "x 4539148803436467 +4539148803436 a@b.co"
    assert pii.redact_text(text, set()) == "x [CARD] [PHONE] [EMAIL]"


def test_odd_rows(odd_docs, no_docs):
    got = pii.find(odd_docs).collect()
    assert len(got) == odd_docs.count()
    row = next(r for r in got if r["doc_id"] == 8)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 0, 1)
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert pii.find(no_docs).count() == 0 and pii.redact(no_docs).count() == 0

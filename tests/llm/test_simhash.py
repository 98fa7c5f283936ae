import random
import re
from collections import Counter

import pytest
import xxhash

from daymark.llm import simhash
from daymark.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id per component by comparing all pairs; `prints` maps id to fingerprint."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_every_close_pair_meets_in_a_table():
    tables = simhash.masks()
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in tables)


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("spread", [1, 3, 6])
def test_crowded_tables_lose_no_link(spark, spread):
    rng = random.Random(spread)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(300):
        fp = rng.choice(seeds)
        for _ in range(rng.randrange(spread + 1)):
            fp ^= 1 << rng.randrange(64)
        prints[i] = fp
    first = {}
    for i, fp in sorted(prints.items()):
        first.setdefault(fp, i)
    points = spark.createDataFrame([((False, i, simhash.signed(fp)),) for fp, i in first.items()], "p struct<unnamed: boolean, id: long, fp: long>")
    found = {r["node"]["id"]: r["root"]["id"] for r in components(simhash.links(points)).collect()}
    want = brute_components({i: fp for fp, i in first.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_long_texts_are_summed_in_pieces(monkeypatch):
    texts = [b"one two three four five six seven eight nine ten", b"a b", b"", None, b"x y z " * 50]
    whole = simhash.fingerprint_array(texts).tolist()
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert simhash.fingerprint_array(texts).tolist() == whole
    assert [v % (1 << 64) for v in whole] == [brute_fingerprint(t.decode() if t else t) for t in texts]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    blank = {(r["doc_id"], r["component_id"]) for r in got if r["fp"] == 0}
    assert blank == {(None, 4), (4, 4), (5, 4), (6, 4)}
    assert Counter((r["doc_id"], r["component_id"]) for r in got)[1, 1] == 2
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == {1: 1, 2: 1, None: 1, 4: 1, 7: 2, 8: 1}
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0


def test_keep_first_with_unique_ids(spark):
    text = "these words make up a text of which there are two copies"
    docs = spark.createDataFrame([(3, text, 1), (2, text, 2), (9, "unlike all others this one stands alone here", 3)], "doc_id long, text string, id int")
    assert sorted((r["doc_id"], r["id"]) for r in simhash.keep_first(docs).collect()) == [(2, 2), (9, 3)]

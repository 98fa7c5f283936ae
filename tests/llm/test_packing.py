import itertools
import random
import types
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daymark.llm import chunks, packing
from daymark.llm.catalog import registry

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_layout(pieces, total, length=2048):
    """Sequences are gapless and, but for powers of two, full; returns them as lists of pieces."""
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append(r)
    for rows in held.values():
        rows.sort(key=lambda r: r["offset"])
        ends = list(itertools.accumulate(r["length"] for r in rows))
        assert [r["offset"] for r in rows] == [0, *ends[:-1]] and all(r["length"] > 0 for r in rows)
        assert ends[-1] == length or (ends[-1] < length and ends[-1].bit_count() == 1)
    assert sum(r["length"] for r in pieces) == total
    return held


def test_query_against_plain_encoding(spark, sf_dir, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = registry.queries["op11_packing"](spark, sf_dir).collect()
    ids = {i: plain(t) for i, t in texts.items()}
    held = check_layout(pieces, sum(map(len, ids.values())))
    assert sorted(held) == list(range(len(held)))
    seen = defaultdict(list)
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
    for i, own in ids.items():
        starts = sorted(seen[i])
        assert [s for s, _ in starts] == [0, *itertools.accumulate(n for _, n in starts)][:-1]
        assert sum(n for _, n in starts) == len(own)


def test_words_one_by_one_give_the_same_ids(plain):
    rng = random.Random(7)
    signs = [*"aZ09 \t\n\r\x0b\x0c\x1c\x85\xa0'.-|", "́", "　", "İ", "Σ", "ς", "ﬁ", "中", "日本", "\U0001f600", "'s", "é", "<|endoftext|>", " ", "\x00"]
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, "rb") as file:
        memo, kind = packing._memo(types.SimpleNamespace(value=file.read()))
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        words = text.encode().split()
        assert [i for w in words for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids] == plain(text)[:-1], repr(text)
        for by_word in (True, False):
            memo.join = bytes.__add__ if by_word else None
            ids = np.frombuffer(b"".join(memo([words if by_word else [text.encode()]])[0]), kind)
            assert ids.tolist() == plain(text)[:-1], repr(text)


def test_memo_starts_anew(monkeypatch):
    asked = []
    memo = chunks.Memo(lambda pieces: asked.extend(pieces) or {p: p.upper() for p in pieces})
    assert memo([["a", "b", "a"], []]) == [["A", "B", "A"], []]
    assert memo([["b"]]) == [["B"]] and len(asked) == 2
    monkeypatch.setattr(chunks, "HELD", 1)
    assert memo([["b"]]) == [["B"]] and len(asked) == 3


@pytest.mark.parametrize(("dims", "bits"), [(3, 3), (2, 5), (3, 1)])
def test_hilbert_visits_every_cell_step_by_step(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = packing.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cuts():
    assert packing.cuts(0, 8) == [0]
    assert packing.cuts(16, 8) == [16]
    assert packing.cuts(29, 8) == [24, 28, 29]


def test_neighbours_share_sequences(spark):
    """Texts of one topic meet far more often in a sequence than by chance."""
    rng = random.Random(5)
    topics = [[f"{chr(97 + t)}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}ing" for _ in range(40)] for t in range(8)]
    docs = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(60))) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, by_word=True).collect()
    held = check_layout(pieces, sum(r["length"] for r in pieces))
    pairs = [(a["doc_id"] % 8, b["doc_id"] % 8) for rows in held.values() for a, b in itertools.combinations(rows, 2)]
    assert sum(a == b for a, b in pairs) > 0.5 * len(pairs)  # one in eight by chance


def test_odd_rows(spark, odd_docs, no_docs, plain):
    for by_word in (True, False):
        pieces = packing.pack(odd_docs, PATH, length=16, by_word=by_word)
        assert pieces.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        rows = pieces.collect()
        want = sorted([r["doc_id"] is None, r["doc_id"] or 0, plain(r["text"])] for r in odd_docs.collect())
        check_layout(rows, sum(len(x[2]) for x in want), 16)
        whole = b"".join(r["ids"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])))
        ends = sorted(map(len, whole.split(np.array([1], "<u4").tobytes())))
        assert sum(ends) <= len(whole)
        joined = {r["sequence_id"]: (r["n"], r["ids"]) for r in packing.sequences(pieces).collect()}
        assert b"".join(x for _, (_, x) in sorted(joined.items())) == whole
        starts = [r for r in rows if r["start"] == 0]
        assert sorted([r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]] for r in starts) == sorted([a, b, len(c)] for a, b, c in want)
    assert packing.pack(no_docs, PATH).count() == 0


def test_copies_spread_over_ranges(spark):
    """A third of all rows equal, ids included: ranges stay even and positions distinct."""
    docs = [(7, "the same words over and over")] * 300 + [(i, f"text number {i} of many") for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    pieces = packing.pack(frame, PATH, by_word=True).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    check_layout(pieces, sum(r["length"] for r in pieces))

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from daymark.llm import aligning
from daymark.llm.bpe import byte_characters
from daymark.llm.catalog import registry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole-text encoding and a group walk, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_characters().items()}
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab().items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a, of_b = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return []
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (of_a, of_b)]
        out = []
        for side, ids, sizes in ((0, a, of_a), (1, b, of_b)):
            at, group = 0, 0
            for i, x in zip(ids, sizes, strict=True):
                if len(out) == group:
                    out.append(([], []))
                out[group][side].append(i)
                at += len(x)
                group += at in ends[0] and at in ends[1]
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def brute(plain, texts):
    groups = [plain.groups(t) for t in texts]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in groups]
    count = Counter(pair for found in links for pair in found)
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for gs, found in zip(groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((
            sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(found.values()),
            sum(n for (a, b), n in found.items() if count[a, b] == top[a]), sum(n * count[p] for p, n in found.items()),
            hashlib.sha256(written.encode()).hexdigest() if gs else "",
        ))
    return out, count


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_query_against_plain_walk(spark, sf_dir, plain, monkeypatch, small):
    if small:  # many blocks, lists in several rows, wide groups through their different ids
        for name, value in (("PAIRS", 3000), ("LIST", 100), ("WIDE", 2), ("ROWS", 4)):
            monkeypatch.setattr(aligning, name, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute(plain, [r["text"] for r in docs])
    got = registry.queries["op12_tokenizer_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(tuple(r) for r in got.collect()) == sorted((r["doc_id"], *w) for r, w in zip(docs, want, strict=True))


def odd_text(rng):
    signs = [*"ab Z9 \t\n\r\x0b\x1c\x85\xa0'.-|\x00", "  ", "́", "　", "▁", "ﬁ", "中", "日本", "\U0001f600", "'s", "é", "<|endoftext|>", "<s>", "<0x41>", " word", " the", " don't", "Été,", "İ.", "the.", "x\ny", "\n", "×", "÷", " ?!"]
    return "".join(rng.choice(signs) for _ in range(rng.randrange(40)))


def test_pieces_give_the_tokens_of_whole_texts(plain):
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = aligning.Pair(a.read(), b.read())
    assert pair.by_piece
    rng = random.Random(4)
    texts = [odd_text(rng) for _ in range(4000)] + [None, ""]
    s = aligning.Slice(pair, texts)
    for n, text in enumerate(texts):
        groups = s.groups[s.at[n] : s.at[n + 1]]
        got = [(s.a[a0:a1].tolist(), s.b[b0:b1].tolist()) for a0, a1, b0, b1 in groups]
        assert got == plain.groups(text), repr(text)
    pair.by_piece = False
    whole = aligning.Slice(pair, texts)
    assert (whole.a == s.a).all() and (whole.groups == s.groups).all()


@pytest.mark.parametrize("lane", [1, 3, 50, 10**6])
def test_lockstep_lanes_agree(lane):
    rng = np.random.default_rng(lane)
    for _ in range(100):
        sizes = rng.integers(1, 80, rng.integers(1, 6))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        a, b = (np.union1d(bounds[1:], rng.integers(1, bounds[-1] + 1, rng.integers(0, 60))) for _ in range(2))
        cuts = np.concatenate([[0], np.intersect1d(a, b)])
        want = [(np.searchsorted(a, x, "right"), np.searchsorted(a, y, "right"), np.searchsorted(b, x, "right"), np.searchsorted(b, y, "right")) for x, y in zip(cuts, cuts[1:])]
        assert aligning.lockstep(a, b, bounds, lane).tolist() == [list(map(int, w)) for w in want]


def test_links_survive_packing():
    rng = np.random.default_rng(1)
    places = np.unique(rng.integers(0, 1 << 24, 500))
    times = rng.integers(1, 1 << 20, len(places))
    back = aligning.unpack_links(aligning.pack_links(places, times))
    assert (back[0] == places).all() and (back[1] == times).all()


def test_odd_rows(spark, odd_docs, no_docs, plain):
    rng = random.Random(9)
    texts = [r["text"] for r in odd_docs.collect()] + [odd_text(rng) for _ in range(50)]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(texts[odd_docs.count() :], 100)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    want, count = brute(plain, texts)
    got = aligning.alignments(docs, A, B).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {((r["a"], r["b"]), r["n"]) for r in aligning.link_counts(docs, A, B).collect()} == set(count.items())
    assert aligning.alignments(no_docs, A, B).count() == aligning.link_counts(no_docs, A, B).count() == 0


def test_align_gives_tokens_and_group_ends(spark, plain):
    texts = ["the Umbrella said café 中文", "", None, "a  b\n c"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F

    for r in frame.select("i", aligning.align(F.col("text"), spark, A, B).alias("g")).collect():
        groups = plain.groups(texts[r["i"]])
        assert r["g"]["a"] == [i for g in groups for i in g[0]] and r["g"]["b"] == [i for g in groups for i in g[1]]
        assert r["g"]["a_ends"] == np.cumsum([len(g[0]) for g in groups]).tolist()
        assert r["g"]["b_ends"] == np.cumsum([len(g[1]) for g in groups]).tolist()


def test_other_pre_tokenizers_take_whole_texts():
    model = json.load(open(A))
    assert aligning.Pair._a_splits(model)
    model["pre_tokenizer"]["add_prefix_space"] = True
    assert not aligning.Pair._a_splits(model)

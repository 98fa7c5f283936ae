import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from daymark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.Codec(spark, PATH, PATTERN)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_given_documents(spark, sf_dir, own):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = bpe.token_digests(docs, PATH, PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


def test_any_characters(own):
    tokenizer, _ = bpe.parse(bpe.model_json(bpe.read_ranks(PATH), PATTERN))
    rng = random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) for c in points[i : i + 64]) for i in range(0, 0x30000, 64)]
    texts += ["".join(chr(rng.choice(points)) for _ in range(40)) for _ in range(300)]
    alphabet = "aaabe -'s  \n\t..__==é中\U0001f600<|endoftext|>0123"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += [c * n for c in "a-= \n.0é中" for n in range(1, 80)]
    for text, found in zip(texts, bpe._encoded(tokenizer, __import__("pyarrow").array(texts)), strict=True):
        assert found == own.encode_ordinary(text), repr(text)


def test_spans_and_decoding(spark, codec):
    texts = ["", None, "plain text, twice  spaced", "café 中文 \U0001f600\U0001f600 x", "\x00\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", codec.encode(F.col("text")).alias("t"))
    for r in df.select("text", "t", codec.decode(F.col("t.ids")).alias("back")).collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["back"]) == raw
        assert r["t"]["starts"] == ([0] + r["t"]["ends"][:-1] if raw else [])
        assert not raw or r["t"]["ends"][-1] == len(raw)
    # a token may hold part of a character: each half decodes to its bytes
    halves = df.where("text LIKE '%\U0001f600%'").select(F.explode("t.ids").alias("i")).select(codec.decode(F.array("i")).alias("b"))
    assert b"".join(bytes(r["b"]) for r in halves.collect()) == texts[3].encode()


def test_ranks_that_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError):
        bpe.model_json(ranks, PATTERN)


def test_odd_rows(odd_docs, no_docs, own):
    got = bpe.token_digests(odd_docs, PATH, PATTERN).collect()
    want = sorted(len(own.encode_ordinary(r["text"] or "")) for r in odd_docs.collect())
    assert sorted(r["n_tokens"] for r in got) == want
    assert bpe.token_digests(no_docs, PATH, PATTERN).count() == 0

import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from daymark.llm import bpe, mixing, pii, quality
from daymark.llm.catalog import registry


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, after[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        after.append(spark.read.parquet(f"{tmp_path}/{k}"))
    raw, good, single, clean, mixed, coded = after
    assert all(df.columns == docs.columns for df in after[:-1])

    kept = {r["doc_id"] for r in quality.judge(raw).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept

    from test_simhash import brute_components, brute_fingerprint

    roots = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in good.collect()})
    assert {r["doc_id"] for r in single.collect()} == set(roots.values())
    assert single.count() < good.count()

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    now = {r["doc_id"]: r for r in clean.collect()}
    assert set(now) == set(before)
    for i, r in now.items():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        assert pii.base_spans(before[i]) or r["text"] == before[i] or "[" in r["text"]

    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.sample(clean).where("copies > 0").collect()})
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)))
    rows = coded.collect()
    assert Counter(r["doc_id"] for r in rows) == copies
    for r in rows:
        text = now[r["doc_id"]]["text"]
        assert r["n_tokens"] == len(own.encode_ordinary(text))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()

    result = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert result == sorted(tuple(r) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries)
    assert numbers == list(range(1, 14))

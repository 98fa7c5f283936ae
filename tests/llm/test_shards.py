import glob
import zlib

import pyarrow.parquet as pq

from daymark.llm import shards
from daymark.session import checkpoint_dir


def brute(rows, n):
    """Order by id (NULL first), then cut at equal byte targets by the middle of each document."""
    sized = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, out, slots = sum(r[1] for r in sized), 0, [], {}
    for i, size, crc in sized:
        shard = (2 * before + size) * n // (2 * total)
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return out


def read(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 24)
    assert read(shards.shard_by_bytes(docs, 24)) == sorted(want, key=str)
    sizes = {}
    for _, size, _, shard, _ in want:
        sizes[shard] = sizes.get(shard, 0) + size
    mean, largest = sum(sizes.values()) / 24, max(w[1] for w in want)
    assert set(sizes) == set(range(24)) and all(abs(s - mean) <= largest for s in sizes.values())


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert read(shards.shard_by_bytes(odd_docs, 5)) == sorted(brute(rows, 5), key=str)
    assert shards.shard_by_bytes(no_docs, 5).count() == 0


def test_ids_of_any_type(spark):
    texts = ["a", "bb" * 40, "ccc", None, "dd" * 30, "e" * 9]
    for ids, kind in ((["k10", "k9", None, "k1", "k9", ""], "string"), ([2**53 + 1, 2**53, 2**53 + 2, None, 2**62, 2**53], "long")):
        rows = list(zip(ids, texts, strict=True))
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        total, before, want, slots = sum(len(t or "") + 8 for t in texts), 0, [], {}
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or ("" if kind == "string" else 0), zlib.crc32((r[1] or "").encode()))):
            size = len(t or "") + 8
            shard = (2 * before + size) * 3 // (2 * total)
            want.append((i, size, zlib.crc32((t or "").encode()), shard, slots.setdefault(shard, 0)))
            slots[shard] += 1
            before += size
        assert read(shards.shard_by_bytes(df, 3)) == sorted(want, key=str)


def test_rows_that_repeat_one_id_are_spread(spark):
    """A third of all rows is one row over and over, another third one id with many texts."""
    df = spark.range(9000).selectExpr(
        "if(id < 6000, 5L, id) as doc_id", "if(id < 3000, 'same text', concat('text ', id)) as text"
    )
    seen = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/daymark-*"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert [r[:4] for r in read(shards.shard_by_bytes(df, 7))] == [r[:4] for r in sorted(brute(rows, 7), key=str)]
    new = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/daymark-*")) - seen
    parts = [pq.read_table(n)["part"].to_pylist() for n in new if "part" in pq.read_schema(glob.glob(f"{n}/*.parquet")[0]).names]
    assert len(parts) == 1 and max(map(parts[0].count, set(parts[0]))) < 0.25 * 9000

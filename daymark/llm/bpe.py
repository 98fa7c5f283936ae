"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

The rank file (one base64 token and its rank per line) becomes a byte-level BPE model: bytes are written as the usual
printable characters, and each token's merge is the pair into which the lower ranks alone join its bytes.  In a
rank file where every token has such a pair (checked when it is read) this gives the ids that merging by lowest rank
gives.  The model text, bounded by the vocabulary, is built once on the driver and broadcast; a Python worker parses it
once.

Ids, spans and decoded bytes are exact: decoding maps ids back to bytes through the same table, so a token that
holds part of a character decodes to its bytes and only whole texts are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ROWS = 32  # texts encoded at once
DIGEST = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"
TOKENS = "struct<ids: array<int>, starts: array<int>, ends: array<int>>"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _pair(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts into which merges of rank below the token's own join its bytes."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A `tokenizers` model file for the ranks; each match of `pattern` is encoded by itself, nothing is special."""
    shown = byte_characters()
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts = _pair(token, ranks)
        if len(parts) != 2:
            raise ValueError(f"rank {ranks[token]} cannot be made by merges of lower rank")
        merges.append(["".join(shown[b] for b in part) for part in parts])
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
        "vocab": {"".join(shown[b] for b in token): rank for token, rank in ranks.items()}, "merges": merges,
    }
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None,
        "decoder": level, "model": model,
    })


def parse(text: str) -> tuple[Tokenizer, list[bytes]]:
    """The model and the bytes of every id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    tokenizer = Tokenizer.from_str(text)
    back = {c: b for b, c in byte_characters().items()}
    table = [b""] * (1 + max(tokenizer.get_vocab().values(), default=-1))
    for token, i in tokenizer.get_vocab().items():
        table[i] = bytes(back[c] for c in token)
    return tokenizer, table


def _parsed(model: Broadcast) -> tuple[Tokenizer, list[bytes]]:
    """The broadcast model, parsed once per Python worker: a worker keeps its broadcasts from task to task."""
    if not hasattr(model, "parsed"):
        model.parsed = parse(model.value)
    return model.parsed


class Codec:
    """A rank file ready for use in a session's tasks."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.model = spark.sparkContext.broadcast(model_json(read_ranks(path), pattern))

    def encode(self, text: Column) -> Column:
        """ids with the start and end of each token in bytes of the UTF-8 text; NULL and empty texts have none."""
        model = self.model

        @F.arrow_udf(TOKENS)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer, table = _parsed(model)
            lengths = [len(t) for t in table]
            for texts in batches:
                ids, starts, ends = [], [], []
                for row in _encoded(tokenizer, texts):
                    at, first, last = 0, [], []
                    for i in row:
                        first.append(at)
                        at += lengths[i]
                        last.append(at)
                    ids.append(row)
                    starts.append(first)
                    ends.append(last)
                yield pa.StructArray.from_arrays(
                    [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends)], ["ids", "starts", "ends"]
                )

        return run.asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of a list of ids as binary; NULL lists and NULL ids give no bytes, unknown ids an error."""
        model = self.model

        @F.arrow_udf("binary")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            _, table = _parsed(model)
            for lists in batches:
                yield pa.array(
                    [b"".join(table[i] for i in row or () if i is not None) for row in lists.to_pylist()], pa.binary()
                )

        return run(ids)

    def digest(self, text: Column) -> Column:
        """n_tokens, and SHA-256 of the comma-joined ids and of the bytes decoded from them, text by text."""
        model = self.model

        @F.arrow_udf(DIGEST)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer, table = _parsed(model)
            numbers = [str(i) for i in range(len(table))]
            for texts in batches:
                rows = [
                    (
                        len(ids),
                        hashlib.sha256(",".join([numbers[i] for i in ids]).encode()).hexdigest(),
                        hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest(),
                    )
                    for ids in _encoded(tokenizer, texts)
                ]
                n, of_ids, of_bytes = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    ["n_tokens", "ids_sha256", "decoded_sha256"],
                )

        return run.asNondeterministic()(text)


def _encoded(tokenizer, texts: pa.Array) -> Iterator[list[int]]:
    for at in range(0, len(texts), ROWS):
        some = [t or "" for t in texts.slice(at, ROWS).to_pylist()]
        for found in tokenizer.encode_batch_fast(some, add_special_tokens=False):
            yield found.ids


def token_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of `docs`: id, n_tokens, ids_sha256, decoded_sha256.

    NULL texts count as empty, with no tokens and the digests of nothing.  NULL and repeated ids are rows like any
    other; other columns are not read; an empty table gives an empty result.
    """
    codec = Codec(docs.sparkSession, path, pattern)
    return docs.select(F.col(id_col), codec.digest(F.col(text_col)).alias("t")).select(id_col, "t.*")

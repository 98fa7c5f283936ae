"""Packing documents into token sequences along a space-filling curve.

1. Each text becomes ids, and its ids a vector: counts (damped by a square root) of ids hashed to `BUCKETS` places, at unit
   length, projected by fixed random directions to three dimensions.
2. The three coordinates, cut to 2^10 steps between their least and greatest value in the table, give the document's
   place on a Hilbert curve through the cube: places near each other on the curve are near each other in the cube.
3. Documents are sorted into ranges by that key.  Copies of a text share it, so ties are ordered by a hash of id and
   text and then by row, and a group of copies of any size spreads over ranges.  Range totals give every document its
   first position in one long row of tokens.
4. The row is cut every `length` tokens, so sequences hold neighbours along the curve and no padding.  What is left at
   the end is cut into powers of two, which need none either.  A document that crosses a cut has a piece on each side.

Ids are written once beside their key and meet their position by row number; the sort itself moves only narrow rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from daymark.llm.chunks import JOINED, WORD_BYTES, Memo, parts
from daymark.llm.text import slices
from daymark.session import settle, shuffle_parts

LENGTH, END = 2048, 1
ROWS = 128  # texts encoded at once
BUCKETS, DIMS, BITS, SEED = 1 << 12, 3, 10, 42
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the split of the public word tokenizer
RANGE_ROWS = 1 << 18  # documents of one range of the curve


def directions() -> np.ndarray:
    """Random directions of the projection, one row per bucket."""
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))


def project(documents: list[np.ndarray], along: np.ndarray) -> np.ndarray:
    """Coordinates of documents' hashed vectors, one row each; a document without ids is at the origin."""
    sizes = np.array([len(ids) for ids in documents])
    ids = np.concatenate([*documents, np.zeros(0, np.int64)]).astype(np.uint64)
    places = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    places += np.repeat(np.arange(len(documents)) * BUCKETS, sizes)
    counts = np.bincount(places, minlength=len(documents) * BUCKETS).reshape(-1, BUCKETS)
    row, place = np.nonzero(counts)
    weight = np.sqrt(counts[row, place] / sizes[row])
    return np.stack([np.bincount(row, weight * axis[place], len(documents)) for axis in along.T], axis=1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve through a cube of 2^bits steps a side, for rows of whole coordinates.

    From the highest bit down, the part of the cube a point lies in turns or mirrors the axes of the rest; the turned
    coordinates, read as a Gray code across axes, are the place.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in range(dims):
            upper = (x[axis] & bit) != 0
            swapped = np.where(upper, 0, (x[0] ^ x[axis]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swapped)
            x[axis] ^= swapped
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            place = place << 1 | x[axis] >> level & 1
    return place


def cuts(total: int, length: int) -> list[int]:
    """Where the sequences of the last, shorter part begin and end: at full length up to it, then by powers of two."""
    at = [total // length * length]
    left = total - at[0]
    for level in range(left.bit_length() - 1, -1, -1):
        if left >> level & 1:
            at.append(at[-1] + (1 << level))
    return at


def _tokens(rows: DataFrame, path: str, end: int, by_word: bool) -> DataFrame:
    """(id, tie, ids, n, v): ids as little-endian numbers of `width` bytes, closed by `end`, and the coordinates."""
    fields = [rows.schema["id"], rows.schema["tie"], T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType())]
    fields += [T.StructField("v", T.ArrayType(T.DoubleType()))]
    with open(path, "rb") as file:
        model = rows.sparkSession.sparkContext.broadcast(file.read())
    along = directions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, kind = _memo(model)
        memo.join = bytes.__add__ if by_word else None
        close = np.array([end], kind).tobytes()
        for batch in batches:
            for some in slices(batch, ROWS):
                texts = [t or b"" for t in some["text"].cast(pa.large_binary()).to_pylist()]
                found = [b"".join(x) + close for x in memo([t.split() if by_word else [t] for t in texts])]
                ids = [np.frombuffer(x, kind) for x in found]
                columns = [
                    some["id"], some["tie"], pa.array(found, pa.binary()), pa.array(map(len, ids), pa.int64()),
                    pa.array(list(project([x[:-1] for x in ids], along)), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tie", "ids", "n", "v"])

    return rows.mapInArrow(run, T.StructType(fields))


def _memo(model: Broadcast) -> tuple[Memo, str]:
    """Remembered encoding with the broadcast tokenizer, made once per Python worker, and the number format of ids."""
    if not hasattr(model, "memo"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        tokenizer = Tokenizer.from_buffer(model.value)
        kind = _kind(tokenizer)
        text = json.loads(model.value)
        suffix = text["model"].get("end_of_word_suffix")
        added = [re.escape(t["content"].encode()) for t in text["added_tokens"]]
        special = re.compile(b"|".join(added)) if added else None
        of_words = Tokenizer.from_str(json.dumps(_for_words(text)))
        closes = np.zeros(1 << 16 if kind == "<u2" else 1 + max(tokenizer.get_vocab().values()), bool)
        closes[[i for token, i in tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True

        def alone(words: list[bytes]) -> Iterator[bytes]:
            for at in range(0, len(words), 4096):
                some = [w.decode() for w in words[at : at + 4096]]
                for found in tokenizer.encode_batch_fast(some, add_special_tokens=False):
                    yield np.array(found.ids, kind).tobytes()

        def encode(words: list[bytes]) -> dict[bytes, bytes]:
            """Words of letters end with one id that closes a word, so many are encoded as one text; others one by one."""
            found, plain = {}, [w for w in words if WORD_BYTES.fullmatch(w)] if suffix else []
            groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
            joined = [b" ".join(g).decode() for g in groups]
            for group, ids in zip(groups, of_words.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                split = parts(ids.ids, closes, True, kind)
                if len(split) == len(group):
                    found.update(zip(group, split, strict=True))
            rest = [w for w in words if w not in found]
            found.update(zip(rest, alone(rest), strict=True))
            return found

        model.memo = Memo(encode, special=special), kind
    return model.memo


def _for_words(model: dict) -> dict:
    """The tokenizer for Latin words between blanks, without the steps that leave such words as they are.

    These are NFC and folding of white space before the split, and a split by classes of characters.  Another tokenizer stays
    as it is.
    """
    before, split = model["normalizer"] or {}, model["pre_tokenizer"] or {}
    steps = before.get("normalizers", [])
    idle = [s for s in steps if s["type"] == "NFC" or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ")]
    kinds = [s["type"] for s in split.get("pretokenizers", [])]
    if len(idle) + 1 != len(steps) or steps[-1] != {"type": "Lowercase"} or kinds != ["Split", "ByteLevel"]:
        return model
    if split["pretokenizers"][0]["pattern"] != {"Regex": LETTER_RUNS}:
        return model
    by_blank = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split["pretokenizers"][1]]}
    return model | {"normalizer": steps[-1], "pre_tokenizer": by_blank}


def _kind(tokenizer: Tokenizer) -> str:
    return "<u2" if max(tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4"


def _curve(v: Column, least: list[float], most: list[float]) -> Column:
    low = np.array(least)
    step = (1 << BITS) / np.maximum(np.array(most) - low, 1e-300)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            cells = np.clip(((points - low) * step).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.array(hilbert(cells), pa.int64())

    return run(v)


def _positions(tokens: DataFrame) -> DataFrame:
    """(row, before): how many tokens come before each document along the curve."""
    edges = [f(F.col("v")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(DIMS)]
    rows, *edges = tokens.agg(F.count(F.lit(1)), *edges).first()
    ranges = max(shuffle_parts(tokens.sparkSession), -(-rows // RANGE_ROWS))
    edges = [e or 0.0 for e in edges]  # NULL without rows
    keyed = tokens.select("row", "tie", "n", _curve(F.col("v"), edges[:DIMS], edges[DIMS:]).alias("place"))
    order = ["place", "tie", "row"]
    ranged = settle(settle(keyed).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("row", "part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within"))
    return local.join(totals, "part").select("row", (F.col("base") + F.col("within")).alias("before"))


def _cut(placed: DataFrame, length: int, total: int, kind: str, id_field: T.StructField) -> DataFrame:
    last = np.array(cuts(total, length))
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([id_field, *long, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, ROWS):
                source, facts, cut = [], [], []
                rows = zip(some["ids"].to_pylist(), some["before"].to_pylist(), strict=True)
                for row, (ids, before) in enumerate(rows):
                    ids = np.frombuffer(ids, kind).astype("<u4")
                    after = before + len(ids)
                    full = range((before // length + 1) * length, min(after, int(last[0])), length)
                    edges = [before, *full, *last[(last > before) & (last < after)].tolist(), after]
                    for low, high in zip(edges, edges[1:], strict=False):
                        if low < last[0]:
                            sequence, base = low // length, low // length * length
                        else:
                            k = int(np.searchsorted(last, low, "right")) - 1
                            sequence, base = int(last[0]) // length + k, int(last[k])
                        source.append(row)
                        facts.append((low - before, high - low, len(ids), sequence, low - base))
                        cut.append(ids[low - before : high - before].tobytes())
                numbers = [pa.array(c, pa.int64()) for c in zip(*facts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some["id"].take(pa.array(source, pa.int64())), *numbers, pa.array(cut, pa.binary())], schema.names
                )

    return placed.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    end: int = END,
    by_word: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids): which tokens of a document lie where.

    `path` is a `tokenizers` file, `end` the id that closes each document, `ids` the piece's ids as little-endian 32-bit
    numbers, `doc_tokens` the document's ids with the closing one.  `length` should be a power of two.  `by_word` says
    that the tokenizer joins no characters across ASCII white space nor a Latin letter with ASCII punctuation after it,
    so words can be looked up one by one.

    NULL and empty texts are the closing id alone.  NULL and repeated ids are documents like any other; repeated rows lie
    side by side.  An empty table gives no pieces; other columns are not read.
    """
    tie = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), tie.alias("tie"), F.col(text_col).alias("text"))
    tokens = settle(_tokens(rows, path, end, by_word).withColumn("row", F.monotonically_increasing_id()))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    places = settle(_positions(tokens))
    placed = tokens.select("row", "id", "ids").join(places.hint("shuffle_hash"), "row").select("id", "ids", "before")
    kind = _kind(Tokenizer.from_file(path))
    return _cut(placed, length, total, kind, rows.schema["id"]).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, ids): each sequence's ids, put together from its pieces; a group holds one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.unhex(F.array_join(parts.getField("ids"), "")).alias("ids"))

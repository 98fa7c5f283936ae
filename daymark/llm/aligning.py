"""Alignment of two tokenizers' tokens by lockstep merging, and how often their ids link in the corpus.

A text's tokens of A and of B both cover its bytes.  Offsets where tokens of both end cut them into groups; all tokens of
A and of B inside a group are linked.

Merging: all documents of a slice are merged at once.  One pointer into A's ends and one into B's per lane are held in
vectors; each step compares the ends under all pointers, moves the pointer with the lesser end (both where they agree) and,
where they agree, emits the group that closes, as ranges of A and B tokens: a cut and, in short, its links.  Lanes
that are done are dropped from the vectors.  A document has a lane per `LANE` bytes, so a long one needs no more steps than
others; a lane owns the groups that begin in its bytes, looks for the first cut there and leaves the rest to the lane before.

Counting: a document's different id pairs are written as places in the sorted list of all pairs of its block.  Blocks are
bounded by `PAIRS`; only their lists (pair, number of documents) meet in the shuffle, where the counts are summed, each A
id's highest is found and both come back to the block that asked.  Frequent pairs are one row per block, so no key is hot,
and documents never travel pair by pair.

Texts are tokenized piece by piece (see `chunks`) where neither tokenizer joins characters across a single blank between
words; whether that holds is read from the tokenizers, else texts are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from daymark.llm.bpe import byte_characters
from daymark.llm.chunks import JOINED, LETTER, WORD, Memo, parts
from daymark.llm.text import slices
from daymark.session import settle

ROWS = 128  # texts merged at once
LANE = 512  # bytes of one lane
PAIRS = 1 << 20  # pairs of documents in one block
LIST = 1 << 16  # pairs in one row of a block's list
WIDE = 1 << 12  # groups with more links are linked by their different ids and how often each occurs
ID_BITS = 20
GROUPS = "struct<a: array<int>, b: array<int>, a_ends: array<int>, b_ends: array<int>>"
BLANK, LINE = re.compile(r" (?=\S)(?<=\S )"), re.compile(r"\n(?=\S)(?<=\S\n)")  # one between other characters
AFTER = re.compile(LETTER + r"[!-/:-@\[-`{-~]")  # a letter joined with punctuation after it


class Pair:
    """Both tokenizers, ready for use in a worker."""

    def __init__(self, a_model: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.a, self.b = Tokenizer.from_buffer(a_model), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        back = {c: b for b, c in byte_characters().items()}
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values(), default=-1))
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(back[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies beyond {1 << ID_BITS} ids are not supported")
        self.a_size, self.b_size = (np.array([*map(len, t), 0], np.int64) for t in (self.a_bytes, self.b_bytes))
        a_text = [(f"{i},".encode(), f"{i}|".encode()) for i in range(len(self.a_bytes))]
        b_text = [(f"{i},".encode(), f"{i};".encode()) for i in range(len(self.b_bytes))]
        self.text = [x for pair in a_text + b_text for x in pair]
        self.a_begins, self.b_begins = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size()) if not self.b.is_byte(i)]
        self.by_piece = self._a_splits(json.loads(a_model)) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        by_stem = self.by_piece and not any(AFTER.search(p) for p in pieces if p not in ("<s>", "</s>", "<unk>"))
        self.memo = Memo(self._encode, (lambda x, y: (x[0] + y[0], x[1] + y[1]) if x and y else ()) if by_stem else None)

    @staticmethod
    def _a_splits(model: dict) -> bool:
        """Whether A's own pattern begins a new token at a single blank between other characters."""
        before = model["pre_tokenizer"] or {}
        return not model["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes] | tuple]:
        """Ids of A and B of pieces; nothing where their bytes are not the piece's.

        Words of letters with a blank before them have one id of each tokenizer that begins with that blank, so many are
        encoded as one text; other pieces one by one.
        """
        found, plain = {}, [p for p in pieces if WORD.fullmatch(p)] if self.by_piece else []
        for at in range(0, len(plain), JOINED):
            group = plain[at : at + JOINED]
            text = "".join(group)
            a, b, same = self._ids(text)
            of_a, of_b = parts(a, self.a_begins, False, "<i4"), parts(b, self.b_begins, False, "<i4")
            if same and len(of_a) == len(of_b) == len(group):
                found.update(zip(group, zip(of_a, of_b, strict=True), strict=True))
        for piece in pieces:
            if piece not in found:
                a, b, same = self._ids(piece)
                found[piece] = (np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else ()
        return found

    def _ids(self, text: str) -> tuple[list[int], list[int], bool]:
        """A's and B's ids, and whether their bytes are the text's.  B puts a first blank itself; a piece that has none is
        encoded behind a line's end, which B joins with nothing."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:]) if text[:1] == " " else self.b.encode("\n" + text)[len(self.b.encode("\n")) :]
        own = text.encode()
        return a, b, b"".join([self.a_bytes[i] for i in a]) == own == b"".join([self.b_bytes[i] for i in b])

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of each text; none for NULL, empty and unfaithful texts."""
        pieces = [(self._split(t) if self.by_piece else [" " + t]) if t else [] for t in texts]
        found = self.memo(pieces)
        for n, of_pieces in enumerate(found):
            if not all(of_pieces):
                found[n] = self._whole(" " + texts[n])
        joined = [[b"".join([p[side] for p in of_pieces]) for of_pieces in found] for side in (0, 1)]
        return tuple([np.frombuffer(x, "<i4") for x in side] for side in joined)

    @staticmethod
    def _split(text: str) -> list[str]:
        """Blank+text cut before single blanks and around single line ends."""
        first, *lines = LINE.split(" " + text)
        head, *words = BLANK.split(first)
        out = [head, *[" " + w for w in words]] if head else [" " + w for w in words]
        for line in lines:
            head, *words = BLANK.split(line)
            out += ["\n", head, *[" " + w for w in words]]
        return out

    def _whole(self, text: str) -> list[tuple[bytes, bytes]]:
        a, b, same = self._ids(text)
        return [(np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes())] if same else []


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Groups as rows (a_from, a_to, b_from, b_to) in order.

    Ends ascend through all documents laid one after another; `bounds` are the documents' borders from 0 to the last end,
    all of them ends of both.
    """
    sizes = np.diff(bounds)
    lanes = -(-sizes // lane)
    of = np.repeat(np.arange(len(sizes)), lanes)
    start = bounds[of] + lane * (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(start + lane, bounds[of + 1])
    i, j = np.searchsorted(a_ends, start, "right"), np.searchsorted(b_ends, start, "right")
    on = start == 0
    inner = np.flatnonzero((i > 0) & (j > 0))
    on[inner] |= (a_ends[i[inner] - 1] == start[inner]) & (b_ends[j[inner] - 1] == start[inner])
    a_from, b_from = np.where(on, i, -1), np.where(on, j, -1)
    closed = []
    while len(i):
        a, b = a_ends[i], b_ends[j]
        i, j = i + (a <= b), j + (b <= a)
        past = np.minimum(a, b) >= stop
        cut = np.flatnonzero(a == b)
        if len(cut):
            owned = cut[a_from[cut] >= 0]
            closed.append(np.stack([a_from[owned], i[owned], b_from[owned], j[owned]], axis=1))
            a_from[cut], b_from[cut] = i[cut], j[cut]
            done = past & ((a == b) | (a_from < 0))
        else:
            done = past & (a_from < 0)
        if done.any():
            stay = ~done
            i, j, a_from, b_from, stop = i[stay], j[stay], a_from[stay], b_from[stay], stop[stay]
    groups = np.concatenate(closed) if closed else np.zeros((0, 4), np.int64)
    return groups[np.argsort(groups[:, 0])]


class Slice:
    """The tokens and groups of some texts."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        a, b = pair.encode(texts)
        self.pair = pair
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([*side, np.zeros(0, "<i4")]).astype(np.int64) for side in (a, b))
        a_ends, b_ends = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        bounds = np.concatenate([[0], a_ends])[self.a_at]
        self.groups = lockstep(a_ends, b_ends, np.unique(bounds))
        # groups of a document follow each other; a document without tokens has none
        self.at = np.searchsorted(self.groups[:, 0], self.a_at)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Different (document, a, b) as one number each, ascending, and how often each is linked."""
        a_from, a_to, b_from, b_to = self.groups.T
        of = np.searchsorted(self.a_at, a_from, "right") - 1
        p, q = a_to - a_from, b_to - b_from
        small = p * q <= WIDE
        n = (p * q)[small]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(q[small], n)
        left = self.a[np.repeat(a_from[small], n) + place // width]
        right = self.b[np.repeat(b_from[small], n) + place % width]
        keys, times = np.unique(np.repeat(of[small], n) << 2 * ID_BITS | left << ID_BITS | right, return_counts=True)
        wide = [(keys, times)]
        for g in np.flatnonzero(~small):
            left, n_left = np.unique(self.a[a_from[g] : a_to[g]], return_counts=True)
            right, n_right = np.unique(self.b[b_from[g] : b_to[g]], return_counts=True)
            both = of[g] << 2 * ID_BITS | left[:, None] << ID_BITS | right
            wide.append((both.ravel(), np.outer(n_left, n_right).ravel()))
        if len(wide) > 1:
            keys, inverse = np.unique(np.concatenate([k for k, _ in wide]), return_inverse=True)
            summed = np.zeros(len(keys), np.int64)
            np.add.at(summed, inverse, np.concatenate([t for _, t in wide]))
            times = summed
        return keys, times

    def facts(self) -> list[tuple[int, int, int, int, str]]:
        """n_a, n_b, n_groups, n_links and the digest of the groups, per text."""
        a_from, a_to, b_from, b_to = self.groups.T
        p, q = a_to - a_from, b_to - b_from
        total = np.concatenate([[0], np.cumsum(p * q)])
        # every group's A tokens are followed by its B tokens; a group's last token of a side closes it
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        closes = np.zeros(len(self.a), np.int64)
        closes[a_to - 1] = 1
        order[np.arange(len(self.a)) + np.repeat(b_from, p)] = 2 * self.a + closes
        closes = np.zeros(len(self.b), np.int64)
        closes[b_to - 1] = 1
        order[np.arange(len(self.b)) + np.repeat(a_to, q)] = 2 * (len(self.pair.a_bytes) + self.b) + closes
        text, out = self.pair.text.__getitem__, []
        for a0, a1, b0, b1, g0, g1 in zip(
            self.a_at, self.a_at[1:], self.b_at, self.b_at[1:], self.at, self.at[1:], strict=False
        ):
            written = b"".join(map(text, order[a0 + b0 : a1 + b1].tolist()))[:-1]
            digest = hashlib.sha256(written).hexdigest() if written else ""
            out.append((int(a1 - a0), int(b1 - b0), int(g1 - g0), int(total[g1] - total[g0]), digest))
        return out


def pack_links(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and their counts, as compressed differences."""
    numbers = np.concatenate([np.diff(places, prepend=0), times]).astype("<u4")
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(numbers[: len(numbers) // 2]), numbers[len(numbers) // 2 :]


def _pair(models: Broadcast) -> Pair:
    """The broadcast models, parsed once per Python worker."""
    if not hasattr(models, "pair"):
        models.pair = Pair(*models.value)
    return models.pair


def _models(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    found = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            found.append(file.read())
    return spark.sparkContext.broadcast(tuple(found))


def align(text: Column, spark: SparkSession, a_path: str, b_path: str) -> Column:
    """The ids of both tokenizers and, per group, how many tokens of each end with it; none for texts without tokens."""
    models = _models(spark, a_path, b_path)

    @F.arrow_udf(GROUPS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = _pair(models)
        for texts in batches:
            rows = []
            for some in slices(texts, ROWS):
                s = Slice(pair, some.to_pylist())
                for n in range(len(some)):
                    groups = s.groups[s.at[n] : s.at[n + 1]]
                    rows.append({
                        "a": s.a[s.a_at[n] : s.a_at[n + 1]], "b": s.b[s.b_at[n] : s.b_at[n + 1]],
                        "a_ends": groups[:, 1] - s.a_at[n], "b_ends": groups[:, 3] - s.b_at[n],
                    })
            fields = [pa.array([r[f] for r in rows], pa.list_(pa.int32())) for f in ("a", "b", "a_ends", "b_ends")]
            yield pa.StructArray.from_arrays(fields, ["a", "b", "a_ends", "b_ends"])

    return run.asNondeterministic()(text)


def _blocks(rows: DataFrame, models: Broadcast) -> DataFrame:
    """Rows of two kinds: one per document (block, id, facts, links) and the lists of each block (block, first, pairs, docs)."""
    long = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([
        T.StructField("block", T.LongType()), rows.schema["id"], *long, T.StructField("groups_sha256", T.StringType()),
        T.StructField("links", T.BinaryType()), T.StructField("first", T.IntegerType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(T.IntegerType())),
    ])

    def flush(block: int, held: list) -> Iterator[pa.RecordBatch]:
        """The documents of a block and its list of pairs."""
        keys = np.concatenate([k for _, _, k, _ in held])
        pairs, places = np.unique(keys & (1 << 2 * ID_BITS) - 1, return_inverse=True)
        docs = np.bincount(places, minlength=len(pairs))
        at = 0
        for ids, facts, k, times in held:
            own = places[at : at + len(k)]
            at += len(k)
            cuts = np.searchsorted(k, np.arange(len(facts) + 1) << 2 * ID_BITS)
            links = [pack_links(own[x:y], times[x:y]) if y > x else b"" for x, y in zip(cuts, cuts[1:], strict=False)]
            numbers = [pa.array(c, pa.int64()) for c in list(zip(*facts, strict=True))[:4]]
            n = len(facts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * n, pa.int64()), ids, *numbers, pa.array([f[4] for f in facts], pa.string()),
                    pa.array(links, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())),
                    pa.nulls(n, pa.list_(pa.int32())),
                ],
                schema.names,
            )
        empty = held[0][0].type
        for first in range(0, len(pairs), LIST):
            some = slice(first, first + LIST)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.nulls(1, empty), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.binary()), pa.array([first], pa.int32()), pa.array([pairs[some]], pa.list_(pa.int64())),
                    pa.array([docs[some].astype(np.int32)], pa.list_(pa.int32())),
                ],
                schema.names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, held, size = _pair(models), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for some in slices(batch, ROWS):
                found = Slice(pair, some["text"].to_pylist())
                keys, times = found.links()
                held.append((some["id"], found.facts(), keys, times))
                size += len(keys)
                if size >= PAIRS:
                    yield from flush(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from flush(block, held)

    return rows.mapInArrow(run, schema)


def _listed(held: DataFrame) -> DataFrame:
    """(block, place, pair, docs) of every block's list."""
    each = F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "of")
    lists = held.where("pairs IS NOT NULL").select("block", "first", each)
    return lists.select("block", (F.col("first") + F.col("at")).alias("place"), F.col("of.pairs").alias("pair"), F.col("of.docs").alias("docs"))


def _counted(listed: DataFrame) -> DataFrame:
    """(pair, n): documents that link the pair, corpus-wide."""
    return listed.groupBy("pair").agg(F.sum("docs").alias("n"))


def link_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """(a, b, n): for every pair of ids linked somewhere, the number of rows of `docs` that hold it linked."""
    rows = docs.select(F.lit(None).cast("int").alias("id"), F.col(text_col).alias("text"))
    counts = _counted(_listed(settle(_blocks(rows, _models(docs.sparkSession, a_path, b_path)))))
    low = F.lit((1 << ID_BITS) - 1)
    return counts.select(F.shiftright("pair", ID_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(low).cast("int").alias("b"), "n")


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of `docs`.

    A is a `tokenizers` file of byte-level tokens and encodes blank+text; B is a `sentencepiece` model, which puts that blank
    itself.  n_best counts the links whose pair is in as many documents as any pair of its A id, count_sum sums the
    documents of the links' pairs.  NULL and empty texts, and those whose tokens' bytes are not blank+text, have zeros and
    an empty digest.  NULL and repeated ids and repeated rows are documents like any other.  An empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = settle(_blocks(rows, _models(docs.sparkSession, a_path, b_path)))
    listed = _listed(held)
    counts = settle(_counted(listed))
    a = F.shiftright("pair", ID_BITS)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # at most one row per id of A
    rated = counts.join(F.broadcast(top), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    asked = listed.select("block", "place", "pair").join(rated.hint("merge"), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    texts = held.where("pairs IS NULL").drop("first", "pairs", "docs")
    fields = [f for f in texts.schema if f.name not in ("block", "links")]
    schema = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def rate(texts: pa.Table, asked: pa.Table) -> pa.Table:
        places = asked["place"].to_numpy()
        n, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        n[places], best[places] = asked["n"].to_numpy(), asked["best"].to_numpy()
        n_best, count_sum = [], []
        for packed in texts["links"].to_pylist():
            if packed:
                own, times = unpack_links(packed)
                n_best.append(int(times @ best[own]))
                count_sum.append(int(times @ n[own]))
            else:
                n_best.append(0)
                count_sum.append(0)
        kept = texts.select([f.name for f in fields])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    rated = texts.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(rate, schema)
    names = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rated.select(names)

"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Fingerprint: 64 majority bits over the XXH64 hashes of a text's word shingles, repeats included.  Texts link when their
fingerprints differ in at most two bits.

Candidate search: bit i gets the label (i mod 7) + 1, a non-zero vector of three bits.  Mask v = 1..7 keeps the bits
whose label has an odd inner product with v.  For any two bits there is a v orthogonal to both labels, so two
fingerprints that differ in at most two bits agree on all bits of some mask: every linked pair meets in one of the seven
tables, none is missed.

Links inside a table: a key with two fingerprints is one comparison.  A key with more is not paired out.  Two
fingerprints are within two bits of each other exactly when some 64-bit value is within one bit of both, so each
member names itself and its neighbours at one flipped free bit, and members that name the same value are linked to the
least of them.  At most 65 fingerprints can name one value, so this is linear in the members and no group is large.

Everything works on different fingerprints; rows that share one are counted once, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.graph import components
from daymark.llm.text import unused
from daymark.session import settle

BITS, LABELS, SEED = 64, 7, 42
CHUNK = 1 << 16  # shingles whose bits are spread out at once, which bounds memory for texts of any length


def masks() -> list[int]:
    """The seven covering masks as unsigned 64-bit numbers."""
    return [sum(1 << i for i in range(BITS) if ((i % LABELS + 1) & v).bit_count() % 2) for v in range(1, LABELS + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _hashes(text: bytes | None, width: int) -> list[int]:
    words = (text or b"").lower().split()  # on bytes: A-Z only, and exactly the separators of the word rule
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint_array(texts: Iterable[bytes | None], width: int = 3) -> np.ndarray:
    """Fingerprints as int64, one per text; no words: zero."""
    counts, totals, held = [], [], []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if held:
            values = np.fromiter((h for _, hs in held for h in hs), "<u8", waiting)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *(len(hs) for _, hs in held[:-1])])
            for (i, _), row in zip(held, np.add.reduceat(bits, starts, axis=0, dtype=np.int64), strict=True):
                counts[i] += row
            held.clear()
            waiting = 0

    for i, text in enumerate(texts):
        counts.append(np.zeros(BITS, np.int64))
        found = _hashes(text, width)
        totals.append(len(found))
        for at in range(0, len(found), CHUNK):
            part = found[at : at + CHUNK]
            held.append((i, part))
            waiting += len(part)
            if waiting >= CHUNK:
                flush()
    flush()
    if not totals:
        return np.zeros(0, np.int64)
    over = 2 * np.vstack(counts) > np.array(totals)[:, None]
    return np.packbits(over, axis=1, bitorder="little").reshape(-1, 8).copy().view("<i8").ravel()


def fingerprint(text: Column, width: int = 3) -> Column:
    """The 64-bit fingerprint of a text column as a long."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprint_array(texts.cast(pa.large_binary()).to_pylist(), width), pa.int64())

    return fp(text)


def links(points: DataFrame) -> DataFrame:
    """(a, b) links that connect all points whose `fp` differ in at most two bits.

    `points` has one column `p`, a struct ending in `fp`, one row per fingerprint, already written (it is read twice).
    The links are stars, not all pairs; their components are those of the full link graph.
    """
    keyed = points.select(
        "p",
        F.explode(
            F.array(*[
                F.struct(F.lit(v).alias("v"), F.col("p.fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                for v, m in enumerate(masks())
            ])
        ).alias("t"),
    ).select("p", "t.v", "t.key")
    tables = settle(
        keyed.groupBy("v", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("a"), F.max("p").alias("b"))
        .where("n > 1")
    )
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    pairs = tables.where(F.col("n") == 2).where(near).select("a", "b")

    free = F.element_at(F.array(*[F.lit(signed(~m & (1 << BITS) - 1)) for m in masks()]), F.col("v") + 1)
    crowded = tables.where("n > 2").select("v", "key")
    members = (
        keyed.join(crowded, ["v", "key"]).select("p", free.alias("free")).groupBy("p").agg(F.bit_or("free").alias("free"))
    )
    flips = F.filter(
        F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS)]),
        lambda f: f.bitwiseAND(F.col("free")) == f,
    )
    named = members.select("p", F.explode(flips).alias("flip")).select(
        "p", F.col("p.fp").bitwiseXOR(F.col("flip")).alias("value")
    )
    stars = (
        named.groupBy("value").agg(F.collect_set("p").alias("ps")).where(F.size("ps") > 1)
        .select(F.array_min("ps").alias("b"), F.explode("ps").alias("a"))
    )
    return pairs.unionByName(stars.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id): one row per row of `docs`, with the least id of its group of linked texts.

    NULL and empty texts have fingerprint zero and link like any other.  A NULL id stays NULL and counts as the least
    only of a group without any other id.  Rows that repeat an id are rows of their own.  Other columns are not read.
    """
    prints = settle(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")))
    # NULL ids after all others, so that the least point of a group carries its least id
    point = F.struct(F.col("first").isNull().alias("unnamed"), F.col("first").alias("id"), F.col("fp").alias("fp"))
    points = settle(prints.groupBy("fp").agg(F.min("id").alias("first")).select("fp", point.alias("p")))
    roots = components(links(points.select("p"))).select(F.col("node.fp").alias("fp"), F.col("root").alias("root"))
    named = settle(
        points.join(roots, "fp", "left").select(
            "fp",
            F.coalesce("root", "p").getField("id").alias("component_id"),
            F.coalesce("root", "p").getField("fp").alias("root_fp"),
        )
    )
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root_fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each group of linked texts, with the columns of `docs`: the row of least id, then least fingerprint.

    NULL ids come after all others.  Where ids are unique the rows are found by id alone; else the fingerprint is part
    of the key, and one of the rows that share both is kept.  Extra columns, whatever their names, stay as they are.
    """
    groups = settle(near_duplicates(docs, id_col, text_col, width).withColumnRenamed(id_col, "id"))
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "fp")
    firsts = settle(groups.groupBy("root_fp").agg(F.min(row).alias("first")).select("first.id", "first.fp"))
    unclear = groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    first_id, first_fp, own_fp = unused(docs, "first_id"), unused(docs, "first_fp"), unused(docs, "own_fp")
    firsts = firsts.toDF(first_id, first_fp).hint("merge")  # grows with the documents: never broadcast
    if unclear.isEmpty():
        return docs.join(firsts.select(first_id), F.col(id_col) == F.col(first_id), "left_semi")
    same = F.col(id_col).eqNullSafe(F.col(first_id)) & (F.col(own_fp) == F.col(first_fp))
    kept = docs.withColumn(own_fp, fingerprint(F.col(text_col), width)).join(firsts, same, "left_semi")
    return kept.dropDuplicates([id_col, own_fp]).drop(own_fp)

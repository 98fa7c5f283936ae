"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Targets: sources in code-point order (NULL last) weigh 5, 2, 1, repeating, and share 150 % of all words; a source gets
at most twice its own words, and what it cannot take goes to the others by weight.  That level is found in closed form
from the sources ordered by ceiling per weight (one row per source).

Copies: a document's expected copies are its source's target over its source's words.  Within a source the expected
copies are summed up in order of size, then of a hash, one offset drawn from the seed and the source is added, and a
document is emitted once for every whole number its part of that line crosses.  In order of size the words taken stay
within about one large document of the target.  The order is never one task's work: the rank comes from sums over ranges
of (size, hash), so a source with a third of all rows is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.text import key, n_words
from daymark.operators.ordering import running
from daymark.session import settle

# fixed values of the data contract
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
SEED = "mix-1"


def _part(draw: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of a hash."""
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(sources: DataFrame, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source_key, source_size, target) from one row per source with its words."""
    everything = Window.partitionBy()
    weighed = sources.select(
        "source_key",
        "source_size",
        F.element_at(
            F.array(*[F.lit(w) for w in WEIGHTS]),
            ((F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"),
        ).alias("weight"),
    ).withColumn("ceiling", F.col("source_size") * ceiling)
    by_ratio = everything.orderBy(F.col("ceiling") / F.col("weight"), "source_key")
    level = weighed.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("ceiling").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        F.row_number().over(by_ratio).alias("at"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.col("level") * F.col("weight") < F.col("ceiling")  # the first source below its ceiling sets the level
    found = F.min(F.when(fits, F.struct("at", "level"))).over(everything).getField("level")
    ceil_ = F.col("ceiling").cast("double")
    return level.select(
        "source_key", "source_size", F.coalesce(F.least(ceil_, found * F.col("weight")), ceil_).alias("target")
    )


def sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    ceiling: int = CEILING,
    seed: str = SEED,
) -> DataFrame:
    """Per row of `docs`: id, size, source_size, target, copies (0 to `ceiling`) and taken, which is copies * size.

    A NULL text has no words.  A source without words has target 0 and emits nothing.  A NULL source is a source.
    Repeated ids and rows are rows of their own; rows alike in id, size and text share their group's copies in no
    particular order.  The same table and seed give the same result.  An empty table gives an empty result.
    """
    sized = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            key(F.col(source_col)).alias("source_key"),
            n_words(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("draw"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            F.lit(1).cast("long").alias("one"),
        ).withColumn("place", F.col("size") + _part(F.col("draw")))
    )
    sources = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rates = settle(
        targets(sources, share, ceiling).select(
            "*",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
            _part(F.md5(F.concat_ws("|", F.lit(seed), "source_key").cast("binary"))).alias("offset"),
        )
    )
    ranked = running(sized, "place", ["one"], by=["source_key"], then=["size", "draw", "id", "text_hash"])
    placed = settle(ranked.select("id", "source_key", "size", "text_hash", F.col("one_before").alias("rank")))
    crossed = F.floor(F.col("offset") + F.col("rate") * (F.col("rank") + 1)) - F.floor(
        F.col("offset") + F.col("rate") * F.col("rank")
    )
    copies = F.least(crossed, F.ceil("rate"))
    return placed.join(rates, "source_key").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        "source_key",
        "text_hash",
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings
) -> DataFrame:
    """The mixed rows with the columns of `docs`, a document as often as `sample` says; same edge cases.

    Where ids are unique, copies join by id; else the source and a hash of the text belong to the key, copies of rows
    alike in all three are summed, and one of them is emitted that often.
    """
    drawn = settle(sample(docs, id_col, text_col, source_col, **settings).withColumnRenamed(id_col, "_id"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"))
    keys = ["_id"]
    if not drawn.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR _id IS NULL").isEmpty():
        keys = ["_id_key", "source_key", "text_hash"]
        drawn = drawn.withColumn("_id_key", key(F.col("_id"))).groupBy(*keys).agg(F.sum("copies").alias("copies"))
        packed = packed.select(
            "row",
            key(F.col("_id")).alias("_id_key"),
            key(F.col(f"row.{source_col}")).alias("source_key"),
            F.xxhash64(F.col(f"row.{text_col}")).alias("text_hash"),
        ).dropDuplicates(keys)
    chosen = settle(drawn.where("copies > 0").select(*keys, F.col("copies").cast("int").alias("copies")))
    # `chosen` grows with the documents: joined by sorting at every size, so that small inputs show the plan of large ones
    return packed.join(chosen.hint("merge"), keys).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")

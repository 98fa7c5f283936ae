"""Contiguous shards of near-equal byte size, cut from a global prefix sum.

Documents are in id order (then text checksum, size and a hash of the text).  Spark range-partitions the narrow rows (id,
size, hashes) by that whole order and a number of the row, so neither equal ids nor equal rows meet in one task.  The few
partition totals are accumulated, and each partition adds its own running sum.  A document goes to the shard
in which the middle of its bytes falls among equal targets; a shard is then off its target by less than the largest
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.session import settle, shuffle_parts

EXTRA = 8  # bytes counted per document besides its text, fixed by the data contract


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in its shard).

    Ids may be of any type that has an order.  A NULL text has no bytes and the checksum of the empty text; NULL ids come
    first; rows with equal ids follow each other by checksum, size and then a hash of the row's text, and wholly equal rows
    in any order.  Empty and tiny tables leave shards empty.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # written before it is sampled and sorted, so that the row numbers stay as they are
    sizes = settle(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + EXTRA).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = [F.asc_nulls_first("id"), F.asc("text_crc32"), F.asc("size"), F.asc("text_hash"), F.asc("row")]
    ranged = settle(
        sizes.repartitionByRange(shuffle_parts(docs.sparkSession), *order).withColumn("part", F.spark_partition_id())
    )
    # one row per partition: their number is set by the session, not by the data
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(across), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(across), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    local = ranged.select(
        "*",
        F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bytes_in"),
        (F.row_number().over(inside) - 1).alias("rows_in"),
    )
    middle = 2 * (F.col("bytes_before") + F.col("bytes_in")) + F.col("size")
    cut = settle(
        local.join(F.broadcast(offsets), "part").select(
            "id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("rows_in")).alias("rank"),
            F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes"))).cast("int").alias("shard"),
        )
    )
    firsts = cut.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )

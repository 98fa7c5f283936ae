"""Daily partial aggregates that follow their source day by day.

The source is a folder of Parquet files partitioned by day.  The partials lie in a folder partitioned by the same day, beside
a small table that holds, per day, what the day's files were when it was last aggregated: number, bytes and a digest of
names, sizes and times.  A refresh lists the files, reads only the days that differ (new days, late or replaced files, days
that are gone) and overwrites exactly these.  The file table is written last, so a refresh that dies is done again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import settle
from daymark.sources.stored import _files


class Refreshed(NamedTuple):
    frame: DataFrame  # all partials
    days: list  # the days read by this refresh, in order


def _listed(spark: SparkSession, source: str, day_col: str) -> DataFrame:
    """Per day the number, bytes and order-free digest of its files; their contents are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    return files.groupBy(F.col(day_col).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime"))).alias("digest"),
    )


def _overwrite_days(df: DataFrame, folder: str) -> None:
    # rebalance: few files a day, and a hot day in several tasks
    df.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def refresh(
    spark: SparkSession, source: str, folder: str, partial: Callable[[DataFrame], DataFrame], day_col: str = "day"
) -> Refreshed:
    """Bring the partials in `folder` up to the source and return them with the days that were read.

    `partial` turns facts into aggregates that have a column `day` and keep days apart; its result must depend on the facts
    alone, and another function needs another folder.  Rows without a day are left out.  One writer at a time.
    """
    fs, place = _files(spark, f"{folder}/files")
    now = _listed(spark, source, day_col).where("day IS NOT NULL")
    if fs.exists(place):
        then = spark.read.schema("n long, bytes long, digest long, day date").parquet(f"{folder}/files")
        both = now.alias("a").join(then.alias("b"), "day", "full_outer")
        same = F.expr("a.n <=> b.n AND a.bytes <=> b.bytes AND a.digest <=> b.digest")
        gone = F.expr("a.n IS NULL AND b.n = 0")
        changed = both.where(~same & ~gone).select(
            F.coalesce("a.n", F.lit(0)).alias("n"), F.coalesce("a.bytes", F.lit(0)).alias("bytes"), F.coalesce("a.digest", F.lit(0)).alias("digest"), "day"
        )
    else:
        changed = now.select("n", "bytes", "digest", "day")
    changed = settle(changed)  # read before its table is overwritten; one row per day
    days = sorted(r["day"] for r in changed.select("day").collect())
    facts = spark.read.parquet(source).withColumn(day_col, F.col(day_col).cast("date"))
    if days:
        made = partial(facts.where(F.col(day_col).isin(days))).withColumn("_gone", F.lit(False))
        # a row per changed day, so that a day without facts replaces its old partials too
        marks = changed.select("day", F.lit(True).alias("_gone"))
        _overwrite_days(made.unionByName(marks, allowMissingColumns=True), f"{folder}/partials")
        _overwrite_days(changed, f"{folder}/files")
    shape = partial(facts).schema
    kept = spark.read.schema(T.StructType([*shape.fields, T.StructField("_gone", T.BooleanType())])).parquet(f"{folder}/partials")
    kept = kept.where("NOT _gone").select(*shape.names)
    return Refreshed(kept, days)

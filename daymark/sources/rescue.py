"""CSV files read by each file's own header, with the lines that do not fit kept beside the rows.

Spark's reader takes one header for all files and turns what it cannot read into NULL.  Here every file's header decides where
its columns stand, and a line that is short, long, quoted wrongly or holds a value of another type goes to a table of
rejected lines with its file and the reason.  Quoted line breaks are not supported, as in `read_source`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import settle

_QUOTED = r'"([^"]|"")*"'


class Rescued(NamedTuple):
    rows: DataFrame  # the columns of the schema
    rejected: DataFrame  # file, line, reason
    headers: DataFrame  # file, names, missing, extra, reordered


def _bare(line: Column) -> Column:
    """The line without its quoted parts."""
    return F.regexp_replace(line, _QUOTED, "")


def _n_fields(line: Column) -> Column:
    return F.length(F.regexp_replace(_bare(line), "[^,]", "")) + 1


def _fields(line: Column, n: int) -> Column:
    """The first `n` fields of a line as texts; empty and absent ones are NULL."""
    read = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"escape": '"'})
    return F.array(*[read[f"c{i}"] for i in range(n)])


def read_rescued(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> Rescued:
    """The files under `path`, each by its own header.

    Columns may stand in any order and beside others; a byte order mark is dropped; a column that a file lacks is NULL in
    its rows and named in `headers`.  Lines equal to their file's header are headers wherever they stand; empty lines
    are skipped.  A name that a header repeats counts where it stands first.  Files without a line have no header and no row.
    """
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in want.fields]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    first = (
        lines.where("block = 0").withColumn("at", F.monotonically_increasing_id())
        .groupBy("file").agg(F.min_by("line", "at").alias("header"))
    )
    header = settle(first)  # one row per file
    widest = header.agg(F.max(_n_fields(F.col("header")))).first()[0] or 1
    clean = F.regexp_replace("header", "^﻿", "")
    header = header.select(
        "file", "header", F.transform(_fields(clean, widest), lambda c: F.trim(c)).alias("all"), _n_fields(clean).alias("n")
    ).select("file", "header", F.slice("all", F.lit(1), F.col("n")).alias("names"), "n")

    asked = F.array(*[F.lit(n) for n in names])
    known = F.array_distinct(F.filter("names", lambda c: F.array_contains(asked, c)))
    headers = header.select(
        "file",
        "names",
        F.array_except(asked, "names").alias("missing"),
        F.array_except("names", asked).alias("extra"),
        (known != F.array_intersect(asked, "names")).alias("reordered"),
    )
    told = (
        lines.join(header, "file").where("line <> header AND line <> ''")
        .select("file", "line", "names", "n", _n_fields(F.col("line")).alias("found"), _fields(F.col("line"), widest).alias("fields"))
    )
    texts = {n: F.get("fields", F.array_position("names", F.lit(n)).cast("int") - 1) for n in names}
    cast = told.select(
        "file", "line", "n", "found",
        *[texts[f.name].alias(f"_text_{i}") for i, f in enumerate(want.fields)],
        *[texts[f.name].try_cast(f.dataType).alias(f"_value_{i}") for i, f in enumerate(want.fields)],
    )
    reason = F.when(_bare(F.col("line")).contains('"'), "open quote").when(
        F.col("found") != F.col("n"), F.format_string("%d fields, %d in the header", "found", "n")
    )
    for i, f in enumerate(want.fields):
        unread = F.col(f"_text_{i}").isNotNull() & F.col(f"_value_{i}").isNull()
        reason = reason.when(unread, F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
    judged = cast.withColumn("reason", reason)
    return Rescued(
        judged.where("reason IS NULL").select(*[F.col(f"_value_{i}").alias(n) for i, n in enumerate(names)]),
        judged.where("reason IS NOT NULL").select("file", "line", "reason"),
        headers,
    )

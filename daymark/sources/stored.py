"""Aggregates kept on the shared file system that know when they are still valid.

A stored table belongs to a key made of the plan that computes it and of the names, sizes and times of the files the plan reads.
It is reused while the key is the same and rebuilt when the query or any input file changes.  The data lies in a folder of its
own; a manifest, replaced in one step after the data is whole, names the folder, so that a lost driver leaves either the old
table or the new one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"
WIDE = 1_000_000  # columns shown in the text of a plan


class Stored(NamedTuple):
    frame: DataFrame
    reused: bool
    path: str


def plan_text(df: DataFrame) -> str:
    """The analysed plan with column ids normalised and no column left out; the same query gives the same text in any session."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.debug.maxToStringFields")
    conf.set("spark.sql.debug.maxToStringFields", WIDE)
    try:
        return df._jdf.queryExecution().normalized().canonicalized().toString()
    finally:
        conf.set("spark.sql.debug.maxToStringFields", before)


def input_state(df: DataFrame) -> str:
    """Number, bytes and a 128-bit order-free digest of (path, size, time) of the files that the frame reads.

    Spark lists the files; their contents are not opened.
    """
    files = df.inputFiles()
    if not files:
        return "no files"
    spark = df.sparkSession
    row = (
        spark.read.format("binaryFile")
        .load(files)
        .select("path", "length", F.unix_micros("modificationTime").alias("at"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("length").alias("bytes"),
            F.bit_xor(F.xxhash64(F.lit(1), "path", "length", "at")).alias("a"),
            F.bit_xor(F.xxhash64(F.lit(2), "at", "path", "length")).alias("b"),
        )
        .first()
    )
    return " ".join(str(v) for v in row)


def state_key(df: DataFrame, version: str = "") -> str:
    """Key of the frame; `version` stands for what a plan does not show, such as the code of a Python function."""
    return hashlib.sha256("\n".join([version, plan_text(df), input_state(df)]).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _read_manifest(spark: SparkSession, folder: str) -> dict | None:
    fs, place = _files(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, folder: str, content: dict) -> None:
    """Written aside, then moved over the old one in one step."""
    jvm = spark._jvm
    fs, draft = _files(spark, f"{folder}/_draft-{uuid.uuid4().hex}.json")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(content), "utf-8"))
    finally:
        out.close()
    _, place = _files(spark, f"{folder}/{MANIFEST}")
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(place), how)


def stored(df: DataFrame, folder: str, version: str = "", keep: int = 1) -> Stored:
    """The rows of `df` from the table stored in `folder`, computed only if there is none for its key.

    A rebuilt table replaces the old one; the last `keep` older ones stay for queries that still read them, those before
    are removed.  A frame that reads a table written anew by each run (`settle`) has a new key each time: store
    what is computed straight from the sources.  Two writers at once both write whole tables and the last manifest counts.
    """
    spark = df.sparkSession
    key = state_key(df, version)
    known = _read_manifest(spark, folder)
    if known and known["key"] == key:
        return Stored(spark.read.schema(df.schema).parquet(f"{folder}/{known['data']}"), True, f"{folder}/{known['data']}")
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{data}")
    older = [known["data"], *known["older"]] if known else []
    _write_manifest(spark, folder, {"key": key, "data": data, "older": older[:keep]})
    for name in older[keep:]:
        fs, place = _files(spark, f"{folder}/{name}")
        fs.delete(place, True)
    return Stored(spark.read.schema(df.schema).parquet(f"{folder}/{data}"), False, f"{folder}/{data}")

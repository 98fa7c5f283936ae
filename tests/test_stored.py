import os
import time

import pytest
from pyspark.sql import functions as F

from daymark.sources.stored import _read_manifest, state_key, stored


@pytest.fixture()
def source(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(100).selectExpr("id % 5 as k", "id as v").repartition(3).write.parquet(path)
    return path


def totals(spark, path):
    return spark.read.parquet(path).groupBy("k").agg(F.sum("v").alias("t"))


def test_second_call_reads_no_source(spark, rows, source, tmp_path):
    folder = str(tmp_path / "store")
    first = stored(totals(spark, source), folder)
    again = stored(totals(spark, source), folder)
    assert not first.reused and again.reused and again.path == first.path
    assert rows(again.frame) == rows(totals(spark, source))
    assert all(f"/{os.path.basename(again.path)}/" in f for f in again.frame.inputFiles())


def test_changed_files_and_plans_rebuild(spark, rows, source, tmp_path):
    folder = str(tmp_path / "store")
    seen = [stored(totals(spark, source), folder).path]
    spark.range(5).selectExpr("id as k", "1000L as v").write.mode("append").parquet(source)  # one more file
    more = stored(totals(spark, source), folder)
    assert not more.reused and rows(more.frame) == rows(totals(spark, source))
    part = next(os.path.join(source, f) for f in sorted(os.listdir(source)) if f.endswith(".parquet"))
    os.utime(part, (time.time() + 9, time.time() + 9))  # same name and size, other time
    assert not stored(totals(spark, source), folder).reused
    other = stored(totals(spark, source).where("t > 3"), folder)  # another query
    assert not other.reused and stored(totals(spark, source).where("t > 3"), folder).reused
    assert not stored(totals(spark, source).where("t > 3"), folder, version="2").reused
    kept = [d for d in os.listdir(folder) if d.startswith("data-")]
    assert len(kept) == 2 and os.path.basename(seen[0]) not in kept  # the table and the one before
    assert not [d for d in os.listdir(folder) if d.startswith("_draft")]


def test_key_sees_every_column(spark, source):
    wide = spark.read.parquet(source).select(*[(F.col("v") + i).alias(f"c{i}") for i in range(60)])
    last = spark.read.parquet(source).select(*[(F.col("v") + i).alias(f"c{i}") for i in range(59)], (F.col("v") + 77).alias("c59"))
    assert state_key(wide) != state_key(last) and state_key(wide) == state_key(wide.select("*"))


def test_broken_write_leaves_the_old_table(spark, rows, source, tmp_path):
    folder = str(tmp_path / "store")
    good = stored(totals(spark, source), folder)
    bad = spark.read.parquet(source).select(F.raise_error(F.lit("boom")).cast("long").alias("k"))
    with pytest.raises(Exception, match="boom"):
        stored(bad, folder)
    assert os.path.basename(good.path) == _read_manifest(spark, folder)["data"]
    assert stored(totals(spark, source), folder).reused

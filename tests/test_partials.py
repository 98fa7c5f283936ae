import shutil

import pytest
from pyspark.sql import functions as F

from daymark.sources.partials import refresh


def per_day(facts):
    return facts.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@pytest.fixture()
def arrive(spark, tmp_path):
    def go(*rows):
        df = spark.createDataFrame(rows, "user_id long, v long, day string").withColumn("day", F.to_date("day"))
        df.write.mode("append").partitionBy("day").parquet(str(tmp_path / "facts"))

    return go


def test_only_changed_days_are_read(spark, rows, arrive, tmp_path):
    source, store = str(tmp_path / "facts"), str(tmp_path / "store")

    def check(days):
        done = refresh(spark, source, store, per_day)
        assert [str(x)[-2:] for x in done.days] == days
        want = per_day(spark.read.parquet(source).withColumn("day", F.col("day").cast("date")))
        assert rows(done.frame.select(*want.columns)) == rows(want)

    arrive((1, 5, "2024-01-01"), (1, 6, "2024-01-01"), (2, 7, "2024-01-02"), (None, 1, "2024-01-02"), (3, 3, None))
    done = refresh(spark, source, store, per_day)
    assert len(done.days) == 2 and done.frame.where("day IS NULL").count() == 0
    shutil.rmtree(tmp_path / "facts" / "day=__HIVE_DEFAULT_PARTITION__")
    check([])
    arrive((2, 9, "2024-01-03"), (4, 1, "2024-01-01"))  # a new day and a late file
    check(["01", "03"])
    check([])
    shutil.rmtree(tmp_path / "facts" / "day=2024-01-02")  # a day is withdrawn, then comes again
    check(["02"])
    check([])
    arrive((9, 9, "2024-01-02"))
    check(["02"])


def test_a_refresh_that_died_is_done_again(spark, rows, arrive, tmp_path):
    source, store = str(tmp_path / "facts"), str(tmp_path / "store")
    arrive((1, 5, "2024-01-01"), (2, 7, "2024-01-02"))
    refresh(spark, source, store, per_day)
    shutil.rmtree(tmp_path / "store" / "files")  # partials were written, the file table not
    done = refresh(spark, source, store, per_day)
    assert len(done.days) == 2 and done.frame.count() == 2

from pyspark.sql import functions as F

from daymark.operators.daily import user_payments

PAID = (
    "(1L, '2024-01-01 10:00:00', 'a'), (1L, '2024-01-01 10:00:00', 'a'), (1L, '2024-01-01 11:00:00', 'b'), (1L, '2024-01-02 10:00:00', null), "
    "(1L, null, 'b'), (1L, null, 'c'), (2L, null, null), (2L, null, null), (3L, '2024-01-01 10:00:00', 'a'), (null, '2024-01-01 10:00:00', 'a')"
)


def paid(spark, kind):
    return spark.sql(f"select user_id, cast(at as {kind}) as created_at, product_id from values {PAID} t(user_id, at, product_id)")


def test_payments_of_moments_and_of_days(spark, rows):
    """Rows that come twice, without moment, product or user, by moments and by dates."""
    assert rows(user_payments(paid(spark, "timestamp"))) == [(1, 6, 3, 2, 3), (2, 2, 0, 0, 0), (3, 1, 1, 1, 1)]
    assert rows(user_payments(paid(spark, "date"))) == [(1, 6, 2, 2, 3), (2, 2, 0, 0, 0), (3, 1, 1, 1, 1)]
    assert rows(user_payments(paid(spark, "date").limit(0))) == []


def test_payment_groups_are_not_merged_into_few_tasks(spark):
    """Adaptive merging made a dozen parts of any number of groups; dealt by user and day or product, a hot user comes apart too."""
    made = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("user_id"),
        F.timestamp_seconds(F.col("id") * 40_000).alias("created_at"),
        (F.col("id") % 700).alias("product_id"),
    )
    for df in (made, made.withColumn("created_at", F.to_date("created_at"))):
        out = user_payments(df)
        hot = {r["user_id"]: tuple(r)[1:] for r in out.collect()}[0]
        assert hot == (2000, df.where("user_id = 0").select("created_at").distinct().count(), made.where("user_id = 0").select(F.to_date("created_at")).distinct().count(), 350)
        lines = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].splitlines()
        dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(user_id" in line and line.split("hashpartitioning")[1].count("#") == 2]
        assert len(dealt) == 2, lines  # no third shuffle from moments to days
        assert not any("AQEShuffleRead" in line for i in dealt for line in lines[i - 2 : i]), lines

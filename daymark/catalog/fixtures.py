"""Roles of the reference's tables played by the given ones, in Spark and as SQL common table expressions.

events: attendance = any event, sent = click, received = view, point use = error, payment = purchase.
deals: order lines as requests from a customer to a supplier, ids of both sides in one id space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import digits


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("value").cast("decimal(18,2)").alias("value"),
        digits("props").cast("long").alias("item_id"),
        F.to_date("ts").alias("day"),
        "ts",
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.min("day").alias("signup_date"))


def of_type(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )


def buyers(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy("user_id").agg(F.min("day").alias("signup_date"))


def deals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_suppkey").alias("partner_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.to_date("l_shipdate").alias("ship_day"),
    )
    return lines.join(orders(spark, d).select("o_orderkey", "user_id", "day"), "o_orderkey")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with nation as class and region as grade, and their order counts."""
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance"),
    )
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return c.join(nation, "n_nationkey", "left")


ORDER_WINDOWS = {"d0": (0, 0), "d0_90": (0, 90), "d0_365": (0, 365), "d8_365": (8, 365)}

EV = """ev AS (
  SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id, CAST(ts AS DATE) AS day, ts
  FROM events)"""
US = "us AS (SELECT user_id, min(day) AS signup_date FROM ev GROUP BY user_id)"
# events with their offset
EO = "eo AS (SELECT ev.*, us.signup_date, date_diff('day', us.signup_date, ev.day) AS off FROM ev JOIN us USING (user_id))"
ORD = """ord AS (
  SELECT o_orderkey, o_custkey AS user_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority FROM orders)"""
BUY = "buy AS (SELECT user_id, min(day) AS signup_date FROM ord GROUP BY user_id)"
DEALS = """deals AS (
  SELECT l_orderkey AS o_orderkey, l_suppkey AS partner_id, l_partkey AS item_id, l_returnflag AS flag,
         l_linestatus AS line_status, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_shipdate AS DATE) AS ship_day, ord.user_id, ord.day
  FROM lineitem JOIN ord ON l_orderkey = ord.o_orderkey)"""
CUST = """cust AS (
  SELECT c_custkey AS user_id, c_nationkey AS n_nationkey, c_mktsegment AS segment,
         CAST(c_acctbal AS DECIMAL(18,2)) AS balance, n_regionkey
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

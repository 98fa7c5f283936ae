"""Sources, scalar expressions, reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daymark.catalog import registry
from daymark.catalog.fixtures import (
    CUST,
    EV,
    ORD,
    customers,
    ctes,
    events,
    orders,
    table,
)
from daymark.functions import (
    bucket_label,
    digits,
    first_non_null,
    flag_label,
    group_key,
    key_family,
    list_len,
    money,
    norm_id,
    num,
    read_flag,
    safe_div,
    status_in,
    to_binary,
    to_day,
)
from daymark.operators.tables import (
    bucketize,
    date_list_metrics,
    dedup,
    exclude_ids,
    fill_defaults,
    flag_member,
    melt,
    pivot_fill,
    require,
    union_all,
)
from daymark.session import checkpoint_dir
from daymark.sources import check_sources, read_mart, read_source, reload_output, resolve_column, write_output

add = registry.add
INF = float("inf")


@add("read_source", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(s, d):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    return read_source(s, f"{d}/orders.parquet", schema, ["o_orderkey", "o_custkey", "o_orderstatus"])


@add(
    "read_mart",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(s, d):
    return read_mart(s, f"{d}/customer.parquet", id_col="c_custkey")


@add("write_and_reload", ctes(ORD) + "SELECT user_id, day, count(*) AS n FROM ord GROUP BY 1, 2")
def _(s, d):
    per_day = orders(s, d).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return reload_output(s, write_output(per_day, f"{checkpoint_dir(s)}/orders-{uuid.uuid4().hex}"))


@add(
    "check_sources",
    """
    SELECT 'orders' AS table_key, true AS present, 'o_orderkey, o_custkey' AS required_columns, '' AS missing_columns,
      'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS actual_columns, 'ok' AS status,
      (SELECT count(*) FROM orders) AS row_count, (SELECT count(*) FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL) AS filled_row_count
    UNION ALL SELECT 'events', true, 'event_id, device_id', 'device_id',
      'event_id, ts, user_id, event_type, value, props', 'error', (SELECT count(*) FROM events), (SELECT count(event_id) FROM events)
    UNION ALL SELECT 'sessions', false, 'session_id', 'session_id', '', 'error', NULL, NULL
    """,
)
def _(s, d):
    frames = {"orders": table(s, d, "orders"), "events": table(s, d, "events")}
    required = {
        "orders": ["o_orderkey", "o_custkey"],
        "events": ["event_id", "device_id"],
        "sessions": ["session_id"],
    }
    return check_sources(s, frames, required, strict=False)


@add(
    "resolve_column",
    "SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id",
)
def _(s, d):
    ev = events(s, d)
    found = resolve_column(ev, ["amount", "price", "VALUE"])
    return ev.groupBy("user_id").agg(F.sum(found).alias("total"))


@add(
    "norm_id",
    """
    SELECT CASE WHEN event_id % 5 = 1 OR event_id % 5 = 2 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS id,
      count(*) AS n FROM events GROUP BY 1
    """,
)
def _(s, d):
    text = F.col("user_id").cast("string")
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.concat(text, F.lit(".0")))
        .when(kind == 1, F.concat(text, F.lit(".5")))
        .when(kind == 2, F.concat(F.lit("u"), text))
        .otherwise(F.concat(F.lit(" "), text))
    )
    return table(s, d, "events").groupBy(norm_id(raw).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "to_day",
    """
    SELECT CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(ts AS DATE) END AS day, count(*) AS n
    FROM events GROUP BY 1
    """,
)
def _(s, d):
    text = F.when(F.col("event_id") % 3 == 2, F.lit("not a date")).otherwise(F.col("ts").cast("string"))
    return table(s, d, "events").groupBy(to_day(text).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "list_len",
    ctes(EV)
    + """
    SELECT event_id, CASE WHEN item_id < 25 THEN 0 WHEN item_id < 50 THEN 1 WHEN item_id < 75 THEN 2
      WHEN item_id < 90 THEN 3 ELSE 0 END AS n FROM ev
    """,
)
def _(s, d):
    k = F.col("item_id")
    text = (
        F.when(k < 25, F.lit("[]"))
        .when(k < 50, F.format_string("[%d]", k))
        .when(k < 75, F.format_string("['%d', 'x, y']", k))
        .when(k < 90, F.format_string("[%d, None, 7]", k))
        .when(k < 95, F.lit("broken ["))
    )
    return events(s, d).select("event_id", list_len(text).alias("n"))


@add(
    "date_list_metrics",
    ctes(EV)
    + """
    SELECT event_id, CASE WHEN item_id < 20 THEN 0 WHEN item_id < 60 THEN 3 ELSE 4 END AS day_count,
      CASE WHEN item_id < 20 THEN 0 WHEN item_id < 60 THEN 2 ELSE 3 END AS longest_streak FROM ev
    """,
)
def _(s, d):
    k = F.col("item_id")

    def day(n):
        return F.concat(F.lit("'"), F.date_add("day", n).cast("string"), F.lit("'"))

    short = F.concat(F.lit("["), F.concat_ws(", ", day(3), day(0), day(1), day(1)), F.lit("]"))
    long = F.concat(F.lit("["), F.concat_ws(", ", day(9), day(4), day(2), day(3)), F.lit("]"))
    text = F.when(k >= 60, long).when(k >= 20, short).when(k >= 10, F.lit("none")).otherwise(F.lit("[]"))
    ev = events(s, d).withColumn("dates", text)
    return date_list_metrics(ev, "event_id", "dates").select("event_id", "day_count", "longest_streak")


@add(
    "number_coercion",
    """
    SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN value ELSE 0.0 END AS v,
      CASE WHEN event_id % 4 = 2 THEN -1.0 WHEN event_id % 4 = 3 THEN -1.0 ELSE value END AS w FROM events
    """,
)
def _(s, d):
    kind = F.col("event_id") % 4
    text = (
        F.when(kind <= 1, F.col("value").cast("string")).when(kind == 2, F.lit("n/a")).otherwise(F.lit("Infinity"))
    )
    return table(s, d, "events").select("event_id", num(text).alias("v"), num(text, -1).alias("w"))


@add(
    "binary_coercion",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS from_text,
      CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS from_bool,
      CASE WHEN o_custkey > 0 THEN 1 ELSE 0 END AS from_number FROM orders
    """,
)
def _(s, d):
    text = F.when(F.col("o_orderstatus") == "F", " Paid ").when(F.col("o_orderstatus") == "P", "YES")
    return table(s, d, "orders").select(
        "o_orderkey",
        to_binary(text, "string").alias("from_text"),
        to_binary(F.col("o_totalprice") > 200000, "boolean").alias("from_bool"),
        to_binary("o_custkey", "long").alias("from_number"),
    )


@add(
    "safe_div",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS r,
      CASE WHEN l_discount = 0 THEN 0.0 ELSE least(l_tax / l_discount, 1.0) END AS clipped FROM lineitem
    """,
)
def _(s, d):
    return table(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        safe_div("l_tax", "l_discount").alias("r"),
        safe_div("l_tax", "l_discount", clip=(0, 1)).alias("clipped"),
    )


@add(
    "text_digits",
    """
    SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS qty, CAST(NULL AS DOUBLE) AS none
    FROM part
    """,
)
def _(s, d):
    return table(s, d, "part").select("p_partkey", digits("p_brand").alias("qty"), digits("p_type").alias("none"))


@add(
    "amount_text",
    """
    SELECT o_orderkey, o_totalprice AS by_comma, o_totalprice AS by_strip, CAST(NULL AS DOUBLE) AS unreadable
    FROM orders
    """,
)
def _(s, d):
    text = F.format_number("o_totalprice", 2)
    return table(s, d, "orders").select(
        "o_orderkey",
        money(text).alias("by_comma"),
        money(F.concat(F.lit("KRW "), text), strip_all=True).alias("by_strip"),
        money(F.concat(F.lit("KRW "), text)).alias("unreadable"),
    )


@add(
    "status_flags",
    """
    SELECT o_orderkey, o_orderstatus = 'F' AS is_f, o_orderstatus IN ('O', 'P') AS in_set,
      false AS wrong_case FROM orders
    """,
)
def _(s, d):
    return table(s, d, "orders").select(
        "o_orderkey",
        status_in(F.lower("o_orderstatus"), ["F"], "upper").alias("is_f"),
        status_in("o_orderstatus", ["o", "p"], "lower").alias("in_set"),
        status_in("o_orderstatus", ["o", "p", "f"]).alias("wrong_case"),
    )


@add(
    "role_flags",
    ctes(EV)
    + """
    SELECT event_id, (item_id > 50 OR value > 20) AS was_read,
      CASE WHEN event_type = 'view' THEN day ELSE day + 1 END AS effective_day,
      CASE WHEN event_type = 'click' THEN 'sent' ELSE 'not sent' END AS sender_group,
      CASE WHEN event_type IN ('view') THEN 'start' WHEN event_type IN ('click', 'purchase') THEN 'complete'
        WHEN event_type = 'error' THEN 'skip' END AS family FROM ev
    """,
)
def _(s, d):
    ev = events(s, d)
    seen = F.when(F.col("event_type") == "view", F.col("day"))
    return ev.select(
        "event_id",
        read_flag(F.col("item_id") - 50, F.col("value") - 20).alias("was_read"),
        first_non_null(seen, F.date_add("day", 1)).alias("effective_day"),
        flag_label(F.col("event_type") == "click", "sent", "not sent").alias("sender_group"),
        key_family(
            "event_type", {"start": ["view"], "complete": ["click", "purchase"], "skip": ["error"]}
        ).alias("family"),
    )


@add(
    "group_key",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment END AS k
    FROM customer
    """,
)
def _(s, d):
    part = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", group_key("c_nationkey", part).alias("k"))


@add(
    "fill_and_require",
    """
    SELECT d.doc_id, coalesce(quality, 0) AS quality, quality IS NOT NULL AND toxic = 1 AS flagged, d.lang
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL
    """,
)
def _(s, d):
    docs = require(table(s, d, "documents").select("doc_id", "lang"), ["lang"])
    labels = table(s, d, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("flagged"))
    return fill_defaults(docs.join(labels, "doc_id", "left"), keys=["doc_id"])


QTY_EDGES, QTY_LABELS = [-0.1, 0, 3, 10, 50, INF], ["0", "1-3", "4-10", "11-50", "51+"]


@add(
    "bucketize",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_quantity <= 0 THEN '0' WHEN l_quantity <= 3 THEN '1-3' WHEN l_quantity <= 10 THEN '4-10'
        WHEN l_quantity <= 50 THEN '11-50' ELSE '51+' END AS bucket,
      CASE WHEN l_quantity <= 0 THEN 0 WHEN l_quantity <= 3 THEN 1 WHEN l_quantity <= 10 THEN 2
        WHEN l_quantity <= 50 THEN 3 ELSE 4 END AS bucket_ord,
      CASE WHEN l_quantity < 4 THEN NULL WHEN l_quantity <= 10 THEN '4-10' WHEN l_quantity <= 30 THEN '11-30' ELSE '31+' END AS narrow,
      CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber <= 3 THEN 'early' ELSE 'late' END AS place
    FROM lineitem
    """,
)
def _(s, d):
    lines = bucketize(table(s, d, "lineitem"), "l_quantity", QTY_EDGES, QTY_LABELS, "bucket")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "bucket",
        "bucket_ord",
        bucket_label("l_quantity", [3.999, 10, 30, INF], ["4-10", "11-30", "31+"]).alias("narrow"),
        bucket_label("l_linenumber", [1, 1.5, 3, INF], ["first", "early", "late"], include_lowest=True).alias("place"),
    )


@add(
    "exclude_ids",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def _(s, d):
    big = table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return exclude_ids(table(s, d, "customer").select("c_custkey", "c_mktsegment"), big, "c_custkey")


@add(
    "flag_member",
    "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_big FROM customer",
)
def _(s, d):
    big = table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return flag_member(table(s, d, "customer").select("c_custkey"), big, "c_custkey", "is_big")


@add(
    "melt",
    """
    SELECT day, 'order_count' AS metric, count(*) AS value FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey FROM orders) GROUP BY day
    UNION ALL
    SELECT day, 'buyer_count', count(DISTINCT o_custkey) FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey FROM orders) GROUP BY day
    """,
)
def _(s, d):
    per_day = orders(s, d).groupBy("day").agg(
        F.count(F.lit(1)).alias("order_count"), F.count_distinct("user_id").alias("buyer_count")
    )
    return melt(per_day, ["day"], ["order_count", "buyer_count"])


@add(
    "pivot_fill",
    ctes(EV)
    + """
    SELECT day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
      0 AS absent FROM ev WHERE event_type IN ('click', 'purchase') GROUP BY day
    """,
)
def _(s, d):
    kept = events(s, d).where("event_type in ('click', 'purchase')")
    return pivot_fill(kept, ["day"], "event_type", F.count(F.lit(1)), ["click", "purchase", "absent"])


@add(
    "dedup",
    ctes(ORD)
    + """
    SELECT user_id, day, o_orderkey, CAST(amount AS DOUBLE) AS amount FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, o_orderkey) AS rn FROM ord) WHERE rn = 1
    """,
)
def _(s, d):
    o = orders(s, d).select("user_id", "day", "o_orderkey", "amount")
    return dedup(o, ["user_id"], ["day", "o_orderkey"])


@add(
    "union_all",
    """
    SELECT o_custkey AS id, 'order' AS src FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer
    """,
)
def _(s, d):
    return union_all(
        table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("order").alias("src")),
        table(s, d, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id")),
    )


@add(
    "population_flag",
    ctes(CUST)
    + """
    SELECT user_id, coalesce(balance > 1000 AND n_regionkey >= 1, false) AS in_population FROM cust
    """,
)
def _(s, d):
    from daymark.operators.peers import population

    return population(customers(s, d), ["balance > 1000", F.col("n_regionkey") >= 1]).select("user_id", "in_population")

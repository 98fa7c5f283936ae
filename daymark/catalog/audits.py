"""Distribution, quality and correlation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daymark.catalog import registry
from daymark.catalog.days import event_d3_mart
from daymark.catalog.fixtures import (
    BUY,
    CUST,
    DEALS,
    EO,
    EV,
    ORD,
    US,
    buyers,
    ctes,
    customers,
    deals,
    events,
    of_type,
    orders,
    table,
    users,
)
from daymark.functions import MetricSpec, digits
from daymark.operators import ordering as od
from daymark.operators import quality as ql
from daymark.operators import sketches as sk
from daymark.operators.tables import exclude_ids
from daymark.session import checkpoint_dir, settle
from daymark.sources.partials import refresh
from daymark.sources.rescue import read_rescued
from daymark.sources.stored import stored

add = registry.add
INF = float("inf")

# a per-customer mart to audit: orders, days, spend, lines
MART = """
    , lines AS (SELECT user_id, count(*) AS line_count, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) FILTER (flag = 'A') AS accepted
      FROM deals GROUP BY 1),
    m AS (SELECT c.user_id, c.segment, CAST(c.balance AS DOUBLE) AS balance, c.n_regionkey, coalesce(o.n, 0) AS order_count,
      coalesce(o.dd, 0) AS order_days, coalesce(o.t, 0) AS spend, coalesce(l.line_count, 0) AS line_count,
      coalesce(l.quantity, 0) AS quantity, coalesce(l.accepted, 0) AS accepted FROM cust c
      LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT day) AS dd, CAST(sum(amount) AS DOUBLE) AS t FROM ord GROUP BY 1) o USING (user_id)
      LEFT JOIN lines l USING (user_id))
    """
MART_SQL = ctes(CUST, ORD, DEALS) + MART


def customer_mart(s, d):
    o = orders(s, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.count_distinct("day").alias("order_days"), F.sum("amount").cast("double").alias("spend")
    )
    x = deals(s, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("quantity"), F.count_if(F.col("flag") == "A").alias("accepted")
    )
    c = customers(s, d).select("user_id", "segment", F.col("balance").cast("double").alias("balance"), "n_regionkey")
    return c.join(o, "user_id", "left").join(x, "user_id", "left").fillna(
        0, ["order_count", "order_days", "spend", "line_count", "quantity", "accepted"]
    )


def settled_mart(s, d):
    """The mart written once, for operators that read it several times."""
    return settle(customer_mart(s, d))


@add(
    "quantiles",
    """
    SELECT l_returnflag, 'l_extendedprice' AS "column", quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50,
      quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1
    UNION ALL
    SELECT l_returnflag, 'l_quantity', quantile_cont(l_quantity, 0.1), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.99)
    FROM lineitem GROUP BY 1
    """,
)
def _(s, d):
    lines = table(s, d, "lineitem")
    return od.quantiles(lines, ["l_extendedprice", "l_quantity"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["l_returnflag"])


@add(
    "running_totals",
    """
    WITH v AS (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_totalprice, n, coalesce(sum(n) OVER (ORDER BY o_totalprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before,
      sum(n) OVER () AS n_total FROM v
    """,
)
def _(s, d):
    v = table(s, d, "orders").groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("n"))
    return od.running(v, "o_totalprice", ["n"])


@add(
    "average_ranks",
    """
    WITH r AS (SELECT l_quantity AS value, rank() OVER (ORDER BY l_quantity) AS rk, count(*) OVER (PARTITION BY l_quantity) AS n FROM lineitem)
    SELECT DISTINCT value, rk + (n - 1) / 2.0 AS rank FROM r
    """,
)
def _(s, d):
    return od.average_ranks(table(s, d, "lineitem"), ["l_quantity"]).select("value", "rank")


@add(
    "distribution",
    MART_SQL
    + """
    SELECT count(*) AS count, avg(order_count) AS mean, quantile_cont(order_count, 0.5) AS median,
      quantile_cont(order_count, 0.75) AS p75, quantile_cont(order_count, 0.9) AS p90, max(order_count) AS max FROM m
    """,
)
def _(s, d):
    return ql.distribution(settled_mart(s, d), "order_count")


@add(
    "distribution_by_group",
    """
    SELECT lang, count(*) AS count, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75,
      quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS max FROM documents GROUP BY 1
    """,
)
def _(s, d):
    return ql.distribution(table(s, d, "documents"), "n_chars", "lang")


H_EDGES, H_LABELS = [0, 1, 5, 10, 20, INF], ["0-1", "2-5", "6-10", "11-20", "21+"]


@add(
    "bucket_histogram",
    MART_SQL
    + """
    , b AS (SELECT CASE WHEN order_count <= 1 THEN 0 WHEN order_count <= 5 THEN 1 WHEN order_count <= 10 THEN 2
      WHEN order_count <= 20 THEN 3 ELSE 4 END AS o, count(*) AS n FROM m GROUP BY 1)
    SELECT bucket, bucket_ord, coalesce(n, 0) AS user_count, coalesce(n, 0) * 100.0 / sum(n) OVER () AS ratio_pct
    FROM (VALUES ('0-1', 0), ('2-5', 1), ('6-10', 2), ('11-20', 3), ('21+', 4)) l(bucket, bucket_ord) LEFT JOIN b ON bucket_ord = o
    """,
)
def _(s, d):
    return ql.bucket_histogram(customer_mart(s, d), "order_count", H_EDGES, H_LABELS, count="user_count")


@add(
    "bucket_matrix",
    MART_SQL
    + """
    , c AS (SELECT CASE WHEN order_count <= 0 THEN 'none' WHEN order_count <= 10 THEN 'some' ELSE 'many' END AS x, accepted FROM m)
    SELECT l.x AS order_count, count(*) FILTER (accepted <= 0) AS a0, count(*) FILTER (accepted > 0 AND accepted <= 10) AS a1,
      count(*) FILTER (accepted > 10 AND accepted <= 20) AS a2, count(*) FILTER (accepted > 20) AS a3,
      l.o AS order_count_ord FROM (VALUES ('none', 0), ('some', 1), ('many', 2), ('huge', 3)) l(x, o) LEFT JOIN c USING (x) GROUP BY 1, 6
    """,
)
def _(s, d):
    x = ([-0.1, 0, 10, 1e6, INF], ["none", "some", "many", "huge"])
    y = ([-0.1, 0, 10, 20, INF], ["a0", "a1", "a2", "a3"])
    return ql.bucket_matrix(customer_mart(s, d), "order_count", "accepted", x, y)


JOINED_DOCS = "WITH j AS (SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)\n"


def _docs(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(s, d, "labels"), "doc_id", "left")


DOC_COLS = ["doc_id", "lang", "n_chars", "quality", "toxic"]


@add(
    "missing",
    JOINED_DOCS
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) AS missing_rate,
        count({c}) AS non_missing_count FROM j"""
        for c in DOC_COLS
    ),
)
def _(s, d):
    return ql.missing(_docs(s, d))


@add(
    "dtypes",
    JOINED_DOCS
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(DISTINCT {c}) AS nunique, (SELECT string_agg(v, ', ' ORDER BY v) FROM
        (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM j WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values FROM j"""
        for c, t in zip(DOC_COLS, ["bigint", "string", "bigint", "int", "int"])
    ),
)
def _(s, d):
    return ql.dtypes(_docs(s, d))


@add(
    "describe",
    JOINED_DOCS
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS count, avg(coalesce({c}, 0)) AS mean, round(stddev_samp(coalesce({c}, 0)), 6) AS std,
        min(coalesce({c}, 0)) AS min, max(coalesce({c}, 0)) AS max, """
        + ", ".join(f"quantile_cont(coalesce({c}, 0), {p / 100}) AS p{p}" for p in (1, 5, 50, 95, 99))
        + " FROM j"
        for c in ("n_chars", "quality", "toxic")
    ),
)
def _(s, d):
    return ql.describe(_docs(s, d), ["n_chars", "quality", "toxic"]).withColumn("std", F.round("std", 6))


@add(
    "zero_rate",
    MART_SQL
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) FILTER ({c} = 0) / count(*) AS zero_rate,
        count(*) FILTER ({c} <> 0) AS nonzero_count, round(avg({c}), 6) AS mean, max({c}) AS max FROM m"""
        for c in ("order_count", "accepted", "spend")
    ),
)
def _(s, d):
    return ql.zero_rate(customer_mart(s, d), ["order_count", "accepted", "spend"]).withColumn("mean", F.round("mean", 6))


@add(
    "duplicate_audit",
    """
    WITH f AS (SELECT lang, source, n_chars FROM documents), r AS (SELECT *, count(*) AS n FROM f GROUP BY ALL),
    k AS (SELECT n_chars, lang, sum(n) AS n, count(*) AS kinds FROM r GROUP BY 1, 2)
    SELECT 'documents' AS table_name, 'n_chars, lang' AS dedup_key, sum(n) AS row_count, (SELECT sum(n - 1) FROM r) AS full_row_duplicates,
      sum(n - 1) AS key_duplicates, sum(n - 1) - (SELECT sum(n - 1) FROM r) AS key_not_row_duplicates,
      count(*) FILTER (n > 1) AS duplicated_key_groups, (SELECT sum(n - 1) FROM r) * 100.0 / sum(n - 1) AS full_share_pct FROM k
    """,
)
def _(s, d):
    return ql.duplicate_audit(table(s, d, "documents").select("lang", "source", "n_chars"), ["n_chars", "lang"], "documents")


OUT_COLS = ["order_count", "spend", "accepted"]


@add(
    "outlier_profile",
    MART_SQL
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null_count, count(*) FILTER ({c} = 0) AS zero_count, round(avg({c}), 6) AS mean,
        max({c}) AS max, count(*) FILTER ({c} > (SELECT quantile_cont({c}, 0.99) FROM m)) AS above_p99_count,
        {e} AS expected_max, count(*) FILTER ({c} > {e}) AS above_expected_max_count,
        (SELECT min(user_id) FROM m WHERE {c} = (SELECT max({c}) FROM m)) AS max_id,
        (SELECT min_by(segment, user_id) FROM m WHERE {c} = (SELECT max({c}) FROM m)) AS max_group, """
        + ", ".join(f"quantile_cont({c}, {p / 100}) AS p{p}" for p in (50, 75, 90, 95, 99))
        + f""", max({c}) / quantile_cont({c}, 0.99) AS max_to_p99_ratio,
        count(*) FILTER ({c} > (SELECT quantile_cont({c}, 0.99) FROM m)) * 100.0 / count(*) AS above_p99_rate_pct FROM m"""
        for c, e in zip(OUT_COLS, ["20.0", "CAST(NULL AS DOUBLE)", "30.0"])
    ),
)
def _(s, d):
    out = ql.outlier_profile(settled_mart(s, d), OUT_COLS, expected_max={"order_count": 20, "accepted": 30}, group_col="segment")
    return out.withColumn("mean", F.round("mean", 6))


RULES = [
    {"column": "order_count", "min": 1, "max": 18, "reason": "orders outside 1-18"},
    {"column": "spend", "max": 4500000, "reason": "spend too large"},
    {"column": "accepted", "min": 0, "reason": "negative"},
    {"column": "absent", "min": 0, "reason": "column not there"},
]


@add(
    "bounds_kept",
    MART_SQL + "SELECT user_id, order_count, spend FROM m WHERE order_count BETWEEN 1 AND 18 AND spend <= 4500000",
)
def _(s, d):
    return ql.apply_bounds(customer_mart(s, d), RULES)[0].select("user_id", "order_count", "spend")


@add(
    "bounds_audit",
    MART_SQL
    + """
    SELECT 'order_count' AS "column", 1.0 AS min_allowed, 18.0 AS max_allowed, count(*) FILTER (order_count < 1 OR order_count > 18) AS invalid_count,
      max(order_count) AS max_observed, min(order_count) AS min_observed, 'orders outside 1-18' AS reason FROM m
    UNION ALL SELECT 'spend', NULL, 4500000.0, count(*) FILTER (spend > 4500000), max(spend), min(spend), 'spend too large' FROM m
    UNION ALL SELECT 'accepted', 0.0, NULL, count(*) FILTER (accepted < 0), max(accepted), min(accepted), 'negative' FROM m
    """,
)
def _(s, d):
    return ql.apply_bounds(customer_mart(s, d), RULES)[1]


@add(
    "bounds_removed",
    MART_SQL
    + """
    SELECT user_id, concat_ws('; ', CASE WHEN order_count < 1 OR order_count > 18 THEN 'orders outside 1-18' END,
      CASE WHEN spend > 4500000 THEN 'spend too large' END) AS invalid_reasons, order_count, spend, accepted FROM m
    WHERE order_count < 1 OR order_count > 18 OR spend > 4500000
    """,
)
def _(s, d):
    return ql.apply_bounds(customer_mart(s, d), RULES)[2]


# spend with one inflated row per table: the largest spender counts twentyfold
EXTREME = MART_SQL + """
    , x AS (SELECT user_id, CASE WHEN spend = (SELECT max(spend) FROM m) THEN spend * 20 ELSE spend END AS spend, order_count, segment FROM m),
    q AS (SELECT quantile_cont(spend, 0.99) AS p99, max(spend) / quantile_cont(spend, 0.99) AS ratio,
      (SELECT count(*) FROM x WHERE spend > (SELECT quantile_cont(spend, 0.99) FROM x)) AS above FROM x)
    """


def _inflated(s, d):
    m = settled_mart(s, d).select("user_id", "spend", "order_count", "segment")
    top = m.agg(F.max("spend").alias("t"))
    return m.withColumn("spend", F.when(F.col("spend") == top.scalar(), F.col("spend") * 20).otherwise(F.col("spend")))


@add(
    "isolated_extremes_audit",
    EXTREME
    + """SELECT 'spend' AS "column", p99, ratio AS max_to_p99_ratio, above AS above_p99_count, ratio >= 10 AND above BETWEEN 1 AND 500 AS is_isolated FROM q""",
)
def _(s, d):
    audit, _rows = ql.isolated_extremes(_inflated(s, d), ["spend"], at_most=500)
    return audit.select("column", "p99", "max_to_p99_ratio", "above_p99_count", "is_isolated")


@add(
    "isolated_extremes",
    EXTREME
    + """SELECT user_id, 'spend' AS "column", spend AS value, p99, ratio AS max_to_p99_ratio, segment FROM x, q
    WHERE spend > p99 AND ratio >= 10 AND above BETWEEN 1 AND 500""",
)
def _(s, d):
    return ql.isolated_extremes(_inflated(s, d), ["spend", "order_count"], at_most=500, group_col="segment")[1]


@add(
    "sensitivity",
    MART_SQL
    + """
    , a AS (SELECT segment, count(DISTINCT user_id) AS user_count, avg(order_count) AS mean_orders FROM m GROUP BY 1),
    b AS (SELECT segment, count(DISTINCT user_id) AS user_count, avg(order_count) AS mean_orders FROM m
      WHERE order_count <= (SELECT quantile_cont(order_count, 0.99) FROM m) GROUP BY 1)
    SELECT segment, a.user_count AS user_count_base, b.user_count AS user_count_excluded, a.mean_orders AS mean_orders_base,
      b.mean_orders AS mean_orders_excluded, b.user_count - a.user_count AS user_count_diff,
      round(b.mean_orders - a.mean_orders, 9) AS mean_orders_diff FROM a FULL JOIN b USING (segment)
    """,
)
def _(s, d):
    m = settled_mart(s, d)
    cap = od.quantile_values(m, ["order_count"], 0.99)["order_count"]
    reduced = exclude_ids(m, m.where(F.col("order_count") > cap), "user_id")
    M = [MetricSpec("user_count", "distinct", "user_id"), MetricSpec("mean_orders", "mean", "order_count")]
    return ql.sensitivity(m, reduced, ["segment"], M).withColumn("mean_orders_diff", F.round("mean_orders_diff", 9))


CHECKS = [
    ("accepted > line_count", "error", "accepted > line_count"),
    ("order_days > order_count", "error", "order_days > order_count"),
    ("orders but no lines", "review", "order_count > 0 AND line_count = 0"),
    ("several orders on one day", "warning", "order_days < order_count"),
    ("negative balance", "review", "balance < 0"),
]


def consistency_sql(source: str, checks, key: str) -> str:
    parts = [
        f"""SELECT '{n}' AS "check", '{sev}' AS severity, count(*) FILTER ({c}) AS violations,
        count(*) FILTER ({c}) / count(*) AS rate, '' AS action FROM {source}"""
        for n, sev, c in checks
    ]
    parts.append(
        f"""SELECT '{key} repeated', 'error', count(*) - count(DISTINCT {key}), (count(*) - count(DISTINCT {key})) / count(*),
        'rebuild or dedup' FROM {source}"""
    )
    return " UNION ALL ".join(parts)


def _checks():
    return [{"check": n, "severity": sev, "condition": c} for n, sev, c in CHECKS]


@add("consistency", MART_SQL + consistency_sql("m", CHECKS, "user_id"))
def _(s, d):
    return ql.consistency(customer_mart(s, d), _checks(), "user_id")


@add("violations", MART_SQL + "SELECT * FROM (" + consistency_sql("m", CHECKS, "user_id") + ") WHERE violations > 0")
def _(s, d):
    return ql.violations(ql.consistency(customer_mart(s, d), _checks(), "user_id"))


@add(
    "validate_result",
    MART_SQL
    + """
    SELECT 'mart' AS result_key, 'ok' AS status, count(*) AS row_count, CAST(sum(order_count) + sum(accepted) AS DOUBLE) AS abs_sum, '' AS message FROM m
    UNION ALL SELECT 'zeros', 'warn', count(*), 0.0, 'all values are 0' FROM m
    UNION ALL SELECT 'absent', 'error', count(*), 0.0, 'missing columns: nothing' FROM m
    """,
)
def _(s, d):
    m = settled_mart(s, d).withColumn("zero", F.lit(0))
    return (
        ql.validate_result(m, "mart", ["user_id"], ["order_count", "accepted"])
        .unionByName(ql.validate_result(m, "zeros", ["user_id"], ["zero"]))
        .unionByName(ql.validate_result(m, "absent", ["user_id"], ["nothing"]))
    )


P_COLS = ["order_count", "spend", "line_count", "accepted", "balance"]


@add(
    "pearson",
    MART_SQL
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM m" for a in P_COLS for b in P_COLS
    ),
)
def _(s, d):
    m = settled_mart(s, d).withColumn("constant", F.lit(3))
    return ql.pearson(m, [*P_COLS, "constant"]).withColumn("corr", F.round("corr", 6))


@add(
    "spearman",
    MART_SQL
    + ", r AS (SELECT "
    + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in P_COLS
    )
    + " FROM m) "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{f}' AS feature, round(corr({t}, {f}), 6) AS spearman_corr, round(abs(corr({t}, {f})), 6) AS abs_corr FROM r"
        for t in ("order_count", "spend")
        for f in ("line_count", "accepted", "balance")
    ),
)
def _(s, d):
    out = ql.spearman(customer_mart(s, d), ["line_count", "accepted", "balance"], ["order_count", "spend"])
    return out.withColumns({c: F.round(c, 6) for c in ("spearman_corr", "abs_corr")})


@add(
    "spearman_matrix",
    MART_SQL
    + ", r AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in P_COLS)
    + " FROM m) "
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM r" for a in P_COLS for b in P_COLS),
)
def _(s, d):
    return ql.spearman_matrix(settled_mart(s, d), P_COLS).withColumn("corr", F.round("corr", 6))


@add(
    "duplicate_audit_nested",
    """
    WITH f AS (SELECT user_id, event_type, props, CAST(ts AS DATE) AS day FROM events),
    r AS (SELECT *, count(*) AS n FROM f GROUP BY ALL), k AS (SELECT user_id, sum(n) AS n, count(*) AS kinds FROM r GROUP BY 1)
    SELECT 'events' AS table_name, 'user_id' AS dedup_key, sum(n) AS row_count, sum(n - kinds) AS full_row_duplicates,
      sum(n - 1) AS key_duplicates, sum(kinds - 1) AS key_not_row_duplicates, count(*) FILTER (n > 1) AS duplicated_key_groups,
      sum(n - kinds) * 100.0 / nullif(sum(n - 1), 0) AS full_share_pct FROM k
    """,
)
def _(s, d):
    # a map column cannot be grouped by: rows meet as digests
    rows = table(s, d, "events").select(
        "user_id", F.create_map(F.lit("type"), "event_type", F.lit("props"), "props").alias("cells"), F.to_date("ts").alias("day")
    )
    return ql.duplicate_audit(rows, ["user_id"], "events")


S_COLS = ["l_quantity", "l_extendedprice"]


@add(
    "sketch_quantiles",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, CAST(avg({c}) AS DOUBLE) AS mean, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max, true AS within_bound FROM lineitem GROUP BY 1"""
        for c in S_COLS
    ),
)
def _(s, d):
    """Sketches per ship day and flag, merged over the days; each quantile's rank is checked against the exact ranks."""
    lines = table(s, d, "lineitem").select("l_returnflag", "l_shipdate", *[F.col(c).cast("double").alias(c) for c in S_COLS])
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    found = sk.read_quantiles(sk.merge(sk.sketch(lines, S_COLS, ["l_returnflag", "l_shipdate"]), ["l_returnflag"]), probs)
    long = lines.select("l_returnflag", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in S_COLS])))
    ranks = long.join(found.select("l_returnflag", "column", *probs), ["l_returnflag", "column"]).groupBy("l_returnflag", "column").agg(
        *[x for p in probs for x in (F.count_if(F.col("value") < F.col(p)).alias(f"lo_{p}"), F.count_if(F.col("value") <= F.col(p)).alias(f"hi_{p}"))]
    )
    slack = F.col("n") * sk.rank_error()
    within = F.lit(True)
    for p, q in probs.items():
        within = within & (F.col(f"lo_{p}") - slack <= F.col("n") * q) & (F.col("n") * q <= F.col(f"hi_{p}") + slack)
    return found.join(ranks, ["l_returnflag", "column"]).select("l_returnflag", "column", "n", "mean", "min", "max", within.alias("within_bound"))


@add(
    "stored_aggregate",
    "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS event_count, CAST(sum(value) AS DOUBLE) AS value, true AS reused "
    "FROM (SELECT event_type, ts, CAST(value AS DECIMAL(18,2)) AS value FROM events) GROUP BY 1, 2",
)
def _(s, d):
    """Stored on the first call; the second finds the table by its key and reads no event."""
    folder = f"{checkpoint_dir(s)}/daymark-stored/daily_events"

    def daily():
        return events(s, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("value"))

    stored(daily(), folder)
    again = stored(daily(), folder)
    return again.frame.withColumn("reused", F.lit(again.reused))


@add(
    "daily_partials",
    ctes(EV, US, EO)
    + """
    , n AS (SELECT count(DISTINCT day) AS n_days FROM ev)
    SELECT us.user_id, count(*) FILTER (off BETWEEN 0 AND 7) AS events_d0_7, count(*) FILTER (off BETWEEN 8 AND 28) AS events_d8_28,
      CAST(coalesce(sum(value) FILTER (off BETWEEN 0 AND 7), 0) AS DOUBLE) AS value_d0_7,
      CAST(coalesce(sum(value) FILTER (off BETWEEN 8 AND 28), 0) AS DOUBLE) AS value_d8_28,
      any_value(n_days) - 1 AS days_first, 2::BIGINT AS days_second, 0::BIGINT AS days_third
    FROM us JOIN eo USING (user_id) CROSS JOIN n GROUP BY us.user_id
    """,
)
def _(s, d):
    """Events arrive by day: all days but the last, then the last day and late errors of the first; the second refresh
    reads these two days only, the third none."""
    home = f"{checkpoint_dir(s)}/daymark-partials/{uuid.uuid4().hex}"
    facts = events(s, d).select("user_id", "event_type", "value", "day")
    first, last = facts.agg(F.min("day"), F.max("day")).first()
    late = ((F.col("day") == first) & (F.col("event_type") == "error")) | (F.col("day") == last)

    def arrive(rows):
        rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{home}/facts")

    def per_day(rows):
        return rows.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))

    read = []
    for part in (~F.coalesce(late, F.lit(False)), late, None):
        if part is not None:
            arrive(facts.where(part))
        done = refresh(s, f"{home}/facts", f"{home}/store", per_day)
        read.append(len(done.days))
    base = done.frame.groupBy("user_id").agg(F.min("day").alias("signup_date"))
    off = F.date_diff("day", "signup_date")
    windows = {"d0_7": off.between(0, 7), "d8_28": off.between(8, 28)}
    sums = [
        F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(f"{c}_{name}") for c in ("events", "value") for name, w in windows.items()
    ]
    counted = done.frame.join(base, "user_id").groupBy("user_id").agg(*sums)
    return counted.select("*", *[F.lit(n).cast("long").alias(f"days_{k}") for k, n in zip(("first", "second", "third"), read, strict=True)])


def _csv_files(s, d):
    """Customers as CSV: files with a byte order mark, an extra column and another order; files without a segment, with
    unreadable balances and short lines."""
    home = f"{checkpoint_dir(s)}/daymark-csv/{uuid.uuid4().hex}"
    c = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"), "c_mktsegment", "c_nationkey", "c_name")
    own = c.where("c_nationkey < 12")
    own.select(F.col("c_acctbal").alias("\ufeffc_acctbal"), F.col("c_name").alias("note"), "c_custkey", "c_mktsegment").write.csv(
        f"{home}/a", header=True, escape='"'
    )
    line = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey").cast("string")).otherwise(
        F.concat_ws(",", "c_custkey", F.when(F.col("c_acctbal") < 0, F.lit("unknown")).otherwise(F.col("c_acctbal").cast("string")))
    )
    c.where("c_nationkey >= 12").select(line.alias("c_custkey,c_acctbal")).write.csv(f"{home}/b", header=True, sep="\t")
    return read_rescued(s, [f"{home}/a", f"{home}/b"], "c_custkey long, c_mktsegment string, c_acctbal decimal(18,2)")


@add(
    "csv_rescue",
    """
    SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS c_acctbal
    FROM customer WHERE c_nationkey < 12 OR (c_mktsegment <> 'BUILDING' AND c_acctbal >= 0)
    """,
)
def _(s, d):
    return _csv_files(s, d).rows


@add(
    "csv_rejected",
    """
    SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || ',unknown' END AS line,
      CASE WHEN c_mktsegment = 'BUILDING' THEN '1 fields, 2 in the header' ELSE 'c_acctbal is no decimal(18,2)' END AS reason, 'c_mktsegment' AS missing
    FROM customer WHERE c_nationkey >= 12 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)
    """,
)
def _(s, d):
    found = _csv_files(s, d)
    return found.rejected.join(found.headers, "file").select("line", "reason", F.array_join("missing", ", ").alias("missing"))


@add(
    "winsorize_clip",
    MART_SQL
    + """
    SELECT user_id, least(greatest(spend, 0), (SELECT quantile_cont(spend, 0.99) FROM m)) AS spend,
      least(greatest(balance, 0), (SELECT quantile_cont(balance, 0.99) FROM m)) AS balance,
      least(CASE WHEN user_id < 3 THEN 5.0 ELSE 0.0 END, (SELECT quantile_cont(CASE WHEN user_id < 3 THEN 5.0 ELSE 0.0 END, 0.99) FROM m)) AS rare FROM m
    """,
)
def _(s, d):
    # rare is 0 for all but a few users; from a few hundred users on its p99 is 0 and clipping empties it
    m = settled_mart(s, d).select("user_id", "spend", "balance", F.when(F.col("user_id") < 3, 5.0).alias("rare"))
    return ql.winsorize(m, ["spend", "balance", "rare"], 0.99, "clip")


@add(
    "winsorize_skip",
    MART_SQL
    + """
    SELECT user_id, least(spend, (SELECT quantile_cont(spend, 0.9) FROM m)) AS spend, least(balance, (SELECT quantile_cont(balance, 0.9) FROM m)) AS balance,
      CASE WHEN user_id < 3 THEN 5.0 ELSE 0.0 END AS rare FROM m
    """,
)
def _(s, d):
    m = settled_mart(s, d).select("user_id", "spend", "balance", F.when(F.col("user_id") < 3, 5.0).alias("rare"))
    return ql.winsorize(m, ["spend", "balance", "rare"], 0.9, "skip")


VS_CTES = ctes(EV, US, EO)


def _vs(name: str, value: str, cond: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS source, '{w}' AS "window", count(*) AS event_count, count(DISTINCT user_id) AS user_count,
        CAST(coalesce(sum({value}), 0) AS DOUBLE) AS total_value FROM eo WHERE {cond} AND off BETWEEN {a} AND {b}"""
        for w, (a, b) in {"d0_28": (0, 28), "d8_28": (8, 28)}.items()
    )


@add(
    "value_sources",
    VS_CTES
    + " UNION ALL ".join(
        [
            _vs("product_digits", "item_id", "event_type = 'purchase'"),
            _vs("positive_delta", "value - 10", "value > 10"),
            _vs("negative_delta", "10 - value", "value < 10"),
            """SELECT 'balance', 'snapshot', count(*), count(DISTINCT CASE WHEN item_id <> 0 THEN user_id END), CAST(sum(item_id) AS DOUBLE) FROM ev""",
        ]
    ),
)
def _(s, d):
    ev = events(s, d).withColumn("delta", F.col("value") - 10)
    sources = {
        "product_digits": (of_type(s, d, "purchase"), "item_id", None),
        "positive_delta": (ev, "delta", "delta > 0"),
        "negative_delta": (ev, F.abs("delta"), "delta < 0"),
    }
    W = {"d0_28": (0, 28), "d8_28": (8, 28)}
    out = ql.value_sources(sources, users(s, d), W, {"balance": (ev, "item_id")})
    return out.withColumn("total_value", F.round("total_value", 2))


@add(
    "product_check",
    ctes(ORD, DEALS)
    + """
    , p AS (SELECT deals.*, CASE WHEN p_size > 25 THEN p_brand END AS product FROM deals LEFT JOIN part ON item_id = p_partkey)
    SELECT product, count(*) AS payment_rows, count(DISTINCT user_id) AS paid_user_count,
      min(CAST(nullif(regexp_extract(product, '([0-9]+)', 1), '') AS DOUBLE)) AS product_qty,
      count(*) FILTER (product IS NULL) AS product_qty_missing,
      count(*) * coalesce(min(CAST(nullif(regexp_extract(product, '([0-9]+)', 1), '') AS DOUBLE)), 0) AS estimated_total_qty FROM p GROUP BY 1
    """,
)
def _(s, d):
    part = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("product"))
    return ql.product_check(deals(s, d).join(part, "item_id", "left"), "product", digits("product"))


@add(
    "metric_check",
    VS_CTES
    + """
    , u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND off BETWEEN 8 AND 9) > 0 AS paid,
      count(*) FILTER (event_type = 'click' AND off BETWEEN 0 AND 7) AS n FROM eo GROUP BY 1)
    SELECT 'paid_d8_9_rate' AS metric, count(*) FILTER (paid) * 100.0 / count(*) AS value FROM u
    UNION ALL SELECT 'payers', count(*) FILTER (paid) FROM u UNION ALL SELECT 'senders', count(*) FILTER (n > 0) FROM u
    UNION ALL SELECT 'sent_mean', avg(n) FROM u UNION ALL SELECT 'sent_max', max(n) FROM u
    """,
)
def _(s, d):
    from daymark.operators.windows import window_metrics

    u = users(s, d)
    paid = window_metrics(of_type(s, d, "purchase"), u, {"d8_9": (8, 9)}, [MetricSpec("paid", "flag")])
    sent = window_metrics(of_type(s, d, "click"), u, {"d0_7": (0, 7)}, [MetricSpec("n", "rows")])
    M = [
        MetricSpec("paid_d8_9_rate", "rate", "paid_d8_9"),
        MetricSpec("payers", "rows", where="paid_d8_9"),
        MetricSpec("senders", "nonzero", "n_d0_7"),
        MetricSpec("sent_mean", "mean", "n_d0_7"),
        MetricSpec("sent_max", "max", "n_d0_7"),
    ]
    return ql.metric_check(paid.join(sent, "user_id"), M)


@add(
    "target_overview",
    MART_SQL
    + " UNION ALL ".join(
        f"""SELECT '{k}' AS target_key, '{c}' AS "column", count({c}) AS row_count, count(*) - count({c}) AS missing_count, round(avg({c}), 6) AS mean,
        min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} > 0) AS positive_count, count(*) FILTER ({c} > 0) / count(*) AS positive_rate,
        quantile_cont({c}, 0.5) AS median FROM m"""
        for k, c in {"payment_count": "order_count", "bought": "spend"}.items()
    ),
)
def _(s, d):
    out = ql.target_overview(settled_mart(s, d), {"payment_count": "order_count", "bought": "spend"})
    return out.withColumn("mean", F.round("mean", 6))


TARGET_NAMES = ("returned", "paid", "payment_count", "active_days", "bought_hearts")


@add(
    "target_audit",
    "WITH d3 AS ("
    + registry.sql["d3_mart"]
    + ") "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS target_key, '{t}_d4_28' AS selected_column, '{t}_d4_28' AS available_candidates, true AS preferred_window_available,"
        f" count({t}_d4_28) AS value_count, count(*) FILTER ({t}_d4_28 > 0) AS positive_count FROM d3"
        for t in TARGET_NAMES
    ),
)
def _(s, d):
    return ql.resolve_targets(settle(event_d3_mart(s, d)))[1]


@add(
    "varying_columns",
    MART_SQL
    + """SELECT 'spend' AS "column", min(spend) <> max(spend) AS varies FROM m UNION ALL SELECT 'constant', false""",
)
def _(s, d):
    return ql.varying(customer_mart(s, d).withColumn("constant", F.lit(3)), ["spend", "constant"])

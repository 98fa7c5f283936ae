"""Outcome summaries by bucket, group and cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import registry
from daymark.catalog.audits import MART_SQL, customer_mart, settled_mart
from daymark.catalog.days import win
from daymark.catalog.fixtures import EO, EV, US, ctes, events, of_type, users
from daymark.functions import MetricSpec, bucket_label
from daymark.operators import segments as sg
from daymark.operators.metrics import leave_one_out, user_mart
from daymark.operators.tables import bucketize
from daymark.operators.windows import after_anchor_parts, pick, window_metrics
from daymark.session import settle

add = registry.add
INF = float("inf")
LABELS = ["0", "1-3", "4-10", "11-50", "51+"]
EDGES = [-0.1, 0, 3, 10, 50, INF]

# one row per user: early clicks, later return and purchase
INTENSITY = ctes(EV, US, EO) + """
    , u AS (SELECT user_id, count(*) FILTER (event_type = 'click' AND off BETWEEN 0 AND 7) AS clicks,
      count(DISTINCT CASE WHEN event_type = 'click' AND off BETWEEN 0 AND 7 THEN day END) AS click_days,
      count(*) FILTER (off BETWEEN 1 AND 1) > 0 AS back, count(*) FILTER (event_type = 'purchase' AND off BETWEEN 8 AND 9) AS buys,
      CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND off BETWEEN 8 AND 9 THEN value END), 0) AS DOUBLE) AS spent,
      count(DISTINCT CASE WHEN off BETWEEN 8 AND 28 THEN day END) AS later FROM eo GROUP BY 1),
    b AS (SELECT *, CASE WHEN clicks <= 0 THEN '0' WHEN clicks <= 3 THEN '1-3' WHEN clicks <= 10 THEN '4-10' WHEN clicks <= 50 THEN '11-50' ELSE '51+' END AS bucket,
      CASE WHEN clicks > 0 THEN 'experienced' ELSE 'none' END AS sender_group FROM u)
    """
LABEL_VALUES = "(VALUES ('0', 0), ('1-3', 1), ('4-10', 2), ('11-50', 3), ('51+', 4)) l(bucket, bucket_ord)"


def intensity_mart(s, d):
    """Clicks of days 0-7, return on day 1, purchases of days 8-9 and later days, all from one scan of the events."""
    u = users(s, d)
    W = pick("d0_7", "d8_28") | {"d1": (1, 1), "d8_9": (8, 9)}
    click, bought = "event_type = 'click'", "event_type = 'purchase'"
    M = [
        MetricSpec("clicks", "rows", where=click),
        MetricSpec("click_days", "days", where=click),
        MetricSpec("back", "flag"),
        MetricSpec("later", "days"),
        MetricSpec("payment_count", "rows", where=bought),
        MetricSpec("payment_amount", "sum", "value", where=bought),
        MetricSpec("paid_flag", "flag", where=bought),
    ]
    mart = window_metrics(events(s, d), u, W, M).select(
        "user_id", "clicks_d0_7", "click_days_d0_7", "back_d1", "later_d8_28",
        "payment_count_d8_9", "payment_amount_d8_9", "paid_flag_d8_9",
    )
    return bucketize(mart, "clicks_d0_7", EDGES, LABELS, "bucket").withColumn(
        "sender_group", F.when(F.col("clicks_d0_7") > 0, "experienced").otherwise("none")
    )


INTENSITY_METRICS = [
    MetricSpec("user_count", "distinct", "user_id"),
    MetricSpec("back_d1_rate", "rate", "back_d1"),
    MetricSpec("paid_d8_9_rate", "rate", "paid_flag_d8_9"),
    MetricSpec("payment_count_mean", "mean", "payment_count_d8_9"),
    MetricSpec("payment_count_sum", "sum", "payment_count_d8_9"),
    MetricSpec("payment_amount_sum", "sum", "payment_amount_d8_9"),
    MetricSpec("paid_user_count", "rows", where="paid_flag_d8_9"),
    MetricSpec("clicks_sum", "sum", "clicks_d0_7"),
    MetricSpec("click_user_count", "nonzero", "clicks_d0_7"),
]
TRIPLES = [
    ("payment_count_sum", "paid_user_count", "payment_count_paid_user_mean"),
    ("payment_amount_sum", "paid_user_count", "payment_amount_paid_user_mean"),
    ("clicks_sum", "click_user_count", "clicks_sender_mean"),
]
INTENSITY_SELECT = """count(DISTINCT user_id) AS user_count, count(*) FILTER (back) * 100.0 / count(*) AS back_d1_rate,
      count(*) FILTER (buys > 0) * 100.0 / count(*) AS paid_d8_9_rate, avg(buys) AS payment_count_mean, CAST(sum(buys) AS BIGINT) AS payment_count_sum,
      round(sum(spent), 2) AS payment_amount_sum, count(*) FILTER (buys > 0) AS paid_user_count, CAST(sum(clicks) AS BIGINT) AS clicks_sum,
      count(*) FILTER (clicks > 0) AS click_user_count"""


@add(
    "intensity_outcomes",
    INTENSITY
    + f"""
    , g AS (SELECT bucket, {INTENSITY_SELECT} FROM b GROUP BY 1)
    SELECT bucket, bucket_ord, coalesce(user_count, 0) AS user_count, back_d1_rate, paid_d8_9_rate, payment_count_mean,
      coalesce(payment_count_sum, 0) AS payment_count_sum, coalesce(payment_amount_sum, 0) AS payment_amount_sum,
      coalesce(paid_user_count, 0) AS paid_user_count, coalesce(clicks_sum, 0) AS clicks_sum, coalesce(click_user_count, 0) AS click_user_count,
      coalesce(payment_count_sum / nullif(paid_user_count, 0), 0.0) AS payment_count_paid_user_mean,
      coalesce(payment_amount_sum / nullif(paid_user_count, 0), 0.0) AS payment_amount_paid_user_mean,
      coalesce(clicks_sum / nullif(click_user_count, 0), 0.0) AS clicks_sender_mean
    FROM {LABEL_VALUES} LEFT JOIN g USING (bucket)
    """,
)
def _(s, d):
    mart = intensity_mart(s, d).drop("bucket_ord")
    return sg.conditional_means(sg.summarize(mart, ["bucket"], INTENSITY_METRICS, {"bucket": LABELS}), TRIPLES)


@add("summarize", INTENSITY + f"SELECT sender_group, bucket, {INTENSITY_SELECT} FROM b GROUP BY 1, 2")
def _(s, d):
    return sg.summarize(intensity_mart(s, d), ["sender_group", "bucket"], INTENSITY_METRICS)


@add(
    "summarize_quantiles",
    MART_SQL
    + """
    SELECT segment, count(*) AS n, quantile_cont(spend, 0.75) AS p75, quantile_cont(order_count, 0.5) FILTER (order_count > 0) AS median_positive
    FROM m GROUP BY 1
    """,
)
def _(s, d):
    M = [
        MetricSpec("n", "rows"),
        MetricSpec("p75", "quantile", "spend", q=0.75),
        MetricSpec("median_positive", "quantile", "order_count", "order_count > 0", q=0.5),
    ]
    return sg.summarize(settled_mart(s, d), ["segment"], M)


@add(
    "conditional_means",
    MART_SQL
    + """
    SELECT segment, CAST(sum(accepted) AS BIGINT) AS accepted_sum, count(*) FILTER (accepted > 8) AS heavy_users,
      coalesce(sum(accepted) / nullif(count(*) FILTER (accepted > 8), 0), 0.0) AS mean_heavy,
      0.0 AS mean_nobody FROM m GROUP BY 1
    """,
)
def _(s, d):
    M = [MetricSpec("accepted_sum", "sum", "accepted"), MetricSpec("heavy_users", "rows", where="accepted > 8"), MetricSpec("nobody", "rows", where="accepted < 0")]
    out = sg.summarize(customer_mart(s, d), ["segment"], M)
    return sg.conditional_means(
        out, [("accepted_sum", "heavy_users", "mean_heavy"), ("accepted_sum", "nobody", "mean_nobody")]
    ).drop("nobody")


def _outcome_mart(s, d):
    """A mart with the column names of the standard outcome set, from three scans of the events."""
    u, ev = settle(users(s, d)), events(s, d)
    bought, acted = "event_type = 'purchase'", "event_type in ('click', 'view', 'error')"
    M = [
        MetricSpec("retention", "flag"),
        MetricSpec("paid_flag", "flag", where=bought),
        MetricSpec("payment_count", "rows", where=bought),
        MetricSpec("payment_amount", "sum", "value", where=bought),
        MetricSpec("active_days", "days", where=acted),
        MetricSpec("sent_vote_count", "rows", where="event_type = 'click'"),
        MetricSpec("received_vote_count", "rows", where="event_type = 'view'"),
        MetricSpec("candidate_exposure_count", "rows", where="event_type = 'signup'"),
        MetricSpec("first_received", "min", "day", where="event_type = 'view'"),
    ]
    counted = settle(window_metrics(ev, u, pick("d0_7", "d0_28", "d1_28", "d8_28"), M))
    parts = {
        "attendance_after_received_vote": (None, True),
        "point_use_after_received_vote": ("event_type = 'error'", True),
        "payment_after_received_vote": (bought, False),
    }
    anchors = counted.select("user_id", F.col("first_received_d0_7").alias("first_date"))
    mart = user_mart(u, counted.drop("first_received_d0_7"), after_anchor_parts(ev, anchors, u, "d0_28", parts))
    return bucketize(mart, "sent_vote_count_d0_7", EDGES, LABELS, "bucket")


OUTCOME = ctes(EV, US, EO) + """
    , a AS (SELECT user_id, min(day) AS anchor FROM eo WHERE event_type = 'view' AND off BETWEEN 0 AND 7 GROUP BY 1),
    u AS (SELECT eo.user_id, count(*) FILTER (event_type = 'click' AND off BETWEEN 0 AND 7) AS clicks,
      count(*) FILTER (event_type = 'view' AND off BETWEEN 0 AND 7) AS views, count(*) FILTER (event_type = 'signup' AND off BETWEEN 0 AND 7) AS exps,
      count(*) FILTER (off BETWEEN 1 AND 28) > 0 AS r1, count(*) FILTER (off BETWEEN 8 AND 28) > 0 AS r8,
      count(*) FILTER (event_type = 'purchase' AND off BETWEEN 0 AND 28) AS p0, count(*) FILTER (event_type = 'purchase' AND off BETWEEN 8 AND 28) AS p8,
      CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND off BETWEEN 0 AND 28 THEN value END), 0) AS DOUBLE) AS m0,
      CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND off BETWEEN 8 AND 28 THEN value END), 0) AS DOUBLE) AS m8,
      count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND off BETWEEN 0 AND 28 THEN day END) AS a0,
      count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND off BETWEEN 8 AND 28 THEN day END) AS a8,
      count(*) FILTER (day >= anchor AND off BETWEEN 0 AND 28) > 0 AS ya, count(*) FILTER (event_type = 'error' AND day >= anchor AND off BETWEEN 0 AND 28) > 0 AS yp,
      count(*) FILTER (event_type = 'purchase' AND day >= anchor AND off BETWEEN 0 AND 28) > 0 AS yb
      FROM eo LEFT JOIN a USING (user_id) GROUP BY 1),
    b AS (SELECT *, CASE WHEN clicks <= 0 THEN '0' WHEN clicks <= 3 THEN '1-3' WHEN clicks <= 10 THEN '4-10' WHEN clicks <= 50 THEN '11-50' ELSE '51+' END AS bucket FROM u)
    SELECT bucket, count(*) AS user_count, count(*) FILTER (r1) * 100.0 / count(*) AS retention_d1_28_rate, count(*) FILTER (r8) * 100.0 / count(*) AS retention_d8_28_rate,
    """ + ", ".join(
    f"""count(*) FILTER ({p} > 0) * 100.0 / count(*) AS payment_{w}_rate, avg({p}) AS payment_{w}_count_mean, CAST(sum({p}) AS BIGINT) AS payment_{w}_count_sum,
      count(*) FILTER ({p} > 0) AS payment_{w}_paid_user_count, round(avg({m}), 6) AS payment_{w}_amount_mean, round(sum({m}), 2) AS payment_{w}_amount_sum,
      avg({a}) AS active_days_{w}_mean, CAST(sum({a}) AS BIGINT) AS active_days_{w}_sum, count(*) FILTER ({a} > 0) AS active_days_{w}_active_user_count,
      coalesce(sum({p}) / nullif(count(*) FILTER ({p} > 0), 0), 0.0) AS payment_{w}_count_paid_user_mean,
      round(coalesce(sum({m}) / nullif(count(*) FILTER ({p} > 0), 0), 0.0), 6) AS payment_{w}_amount_paid_user_mean,
      coalesce(sum({a}) / nullif(count(*) FILTER ({a} > 0), 0), 0.0) AS active_days_{w}_active_user_mean"""
    for w, p, m, a in (("d0_28", "p0", "m0", "a0"), ("d8_28", "p8", "m8", "a8"))
) + ", " + ", ".join(
    f"""avg({c}) AS {n}_mean, CAST(sum({c}) AS BIGINT) AS {n}_sum, count(*) FILTER ({c} > 0) AS {u},
      coalesce(sum({c}) / nullif(count(*) FILTER ({c} > 0), 0), 0.0) AS {n}_{k}_mean"""
    for c, n, u, k in (
        ("clicks", "sent_vote_count_d0_7", "sent_vote_user_count_d0_7", "sender"),
        ("views", "received_vote_count_d0_7", "received_vote_user_count_d0_7", "receiver"),
        ("exps", "candidate_exposure_count_d0_7", "candidate_exposed_user_count_d0_7", "exposed_user"),
    )
) + """, count(*) FILTER (ya) * 100.0 / count(*) AS attendance_after_received_vote_rate,
      count(*) FILTER (yp) * 100.0 / count(*) AS point_use_after_received_vote_rate,
      count(*) FILTER (yb) * 100.0 / count(*) AS payment_after_received_vote_rate FROM b GROUP BY 1"""


@add("outcome_summary", OUTCOME)
def _(s, d):
    out = sg.outcome_summary(_outcome_mart(s, d), ["bucket"])
    money = [c for c in out.columns if "amount" in c]
    return out.withColumns({c: F.round(c, 2 if c.endswith("_sum") else 6) for c in money})


@add(
    "with_share",
    MART_SQL
    + """
    SELECT segment, n_regionkey, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share_all,
      count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY segment) AS share_segment FROM m GROUP BY 1, 2
    """,
)
def _(s, d):
    n = sg.summarize(customer_mart(s, d), ["segment", "n_regionkey"], [MetricSpec("n", "rows")])
    return sg.with_share(sg.with_share(n, "n", out="share_all"), "n", ["segment"], "share_segment")


@add(
    "profile",
    MART_SQL
    + """
    SELECT segment, count(DISTINCT user_id) AS user_count, avg(order_count) AS order_count, avg(accepted) AS accepted FROM m GROUP BY 1
    """,
)
def _(s, d):
    return sg.profile(customer_mart(s, d), "segment", ["order_count", "accepted"])


SEG = MART_SQL + """
    , s AS (SELECT *, CASE WHEN order_count < 4 THEN NULL WHEN order_count <= 10 THEN '4-10' WHEN order_count <= 30 THEN '11-30' ELSE '31+' END AS bucket FROM m),
    t AS (SELECT bucket, count(DISTINCT user_id) AS total FROM s WHERE bucket IS NOT NULL GROUP BY 1),
    c AS (SELECT bucket, segment AS cluster_label, count(DISTINCT user_id) AS user_count, avg(accepted) AS accepted_mean FROM s WHERE bucket IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT c.*, total AS segment_user_count, user_count * 100.0 / total AS cluster_share_within_segment_pct FROM c JOIN t USING (bucket))
    """


def _segments(s, d):
    m = customer_mart(s, d).withColumnRenamed("segment", "cluster_label")
    m = m.withColumn("bucket", bucket_label("order_count", [3.999, 10, 30, INF], ["4-10", "11-30", "31+"]))
    return sg.segment_clusters(m, "bucket", "cluster_label", [MetricSpec("accepted_mean", "mean", "accepted")])


@add("segment_clusters", SEG + "SELECT * FROM r")
def _(s, d):
    return _segments(s, d)


@add(
    "top_per_group",
    SEG
    + """
    SELECT bucket, cluster_label, cluster_share_within_segment_pct, user_count FROM (
      SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY cluster_share_within_segment_pct DESC, cluster_label) AS rn FROM r) WHERE rn = 1
    """,
)
def _(s, d):
    return sg.top_per_group(_segments(s, d), ["bucket"], "cluster_share_within_segment_pct", "cluster_label", ["user_count"])


CLUSTERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@add(
    "share_matrix",
    SEG
    + "SELECT bucket, "
    + ", ".join(
        f"coalesce(sum(cluster_share_within_segment_pct) FILTER (cluster_label = '{c}'), 0) AS \"{c}\"" for c in CLUSTERS
    )
    + " FROM r GROUP BY 1",
)
def _(s, d):
    return sg.share_matrix(_segments(s, d), "bucket", "cluster_label", "cluster_share_within_segment_pct", CLUSTERS)


@add(
    "compare_to_base",
    INTENSITY
    + """
    , g AS (SELECT bucket, count(*) AS n, count(*) FILTER (buys > 0) * 100.0 / count(*) AS paid_rate, avg(later) AS later_mean FROM b GROUP BY 1),
    z AS (SELECT * FROM g WHERE bucket = '1-3')
    SELECT g.bucket, g.n, g.paid_rate, g.later_mean, g.paid_rate - z.paid_rate AS paid_rate_vs_base, g.later_mean - z.later_mean AS later_mean_vs_base,
      CASE WHEN g.bucket = '1-3' THEN 'base group' ELSE printf('paid %+.1f%%p, later days %+.2f', g.paid_rate - z.paid_rate, g.later_mean - z.later_mean) END AS interpretation
    FROM g, z
    """,
)
def _(s, d):
    M = [MetricSpec("n", "rows"), MetricSpec("paid_rate", "rate", "paid_flag_d8_9"), MetricSpec("later_mean", "mean", "later_d8_28")]
    out = sg.summarize(intensity_mart(s, d), ["bucket"], M)
    out = sg.compare_to_base(out, "bucket", "1-3", {"paid_rate": "paid %+.1f%%p", "later_mean": "later days %+.2f"})
    return out


@add(
    "describe_rows",
    MART_SQL
    + """
    , g AS (SELECT segment, count(*) AS n, avg(order_count) AS o, avg(accepted) AS a, avg(quantity) / 20.0 AS q FROM m GROUP BY 1),
    x AS (SELECT *, CASE WHEN o >= a AND o >= q THEN 'orders' WHEN a >= q THEN 'accepted' ELSE 'volume' END AS dominant_axis FROM g)
    SELECT segment, n, o, a, q, dominant_axis, printf('%s: %d users, mostly %s', segment, n, dominant_axis) AS interpretation FROM x
    """,
)
def _(s, d):
    g = customer_mart(s, d).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("order_count").alias("o"), F.avg("accepted").alias("a"), (F.avg("quantity") / 20.0).alias("q")
    )
    return sg.describe_rows(
        g, {"orders": "o", "accepted": "a", "volume": "q"}, "%s: %d users, mostly %s", ["segment", "n", "dominant_axis"]
    )


LOO = pick("d0_28", "d8_28")


@add(
    "leave_one_out_by_group",
    ctes(EV, US, EO)
    + ", u AS (SELECT user_id, count(*) FILTER (event_type = 'click' AND off BETWEEN 0 AND 7) AS clicks, "
    + win(
        LOO,
        "count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND off BETWEEN {a} AND {b} THEN day END) AS a_{w}, "
        "count(DISTINCT CASE WHEN event_type IN ('view', 'error') AND off BETWEEN {a} AND {b} THEN day END) AS x_{w}",
    )
    + " FROM eo GROUP BY 1) SELECT CASE WHEN clicks > 4 THEN 'many' ELSE 'few' END AS sender_group, count(*) AS user_count, "
    + win(
        LOO,
        "avg(a_{w}) AS active_days_{w}_mean, avg(x_{w}) AS active_days_excl_click_{w}_mean, avg(a_{w} - x_{w}) AS click_gap_{w}_mean",
    )
    + " FROM u GROUP BY 1",
)
def _(s, d):
    u = users(s, d)
    frames = {
        k: of_type(s, d, k).select("user_id", F.col("day").alias("activity_date")) for k in ("click", "view", "error")
    }
    loo = leave_one_out(frames, u, "click", LOO)
    sent = window_metrics(of_type(s, d, "click"), u, pick("d0_7"), [MetricSpec("clicks", "rows")])
    both = loo.join(sent, "user_id").withColumn("sender_group", F.when(F.col("clicks_d0_7") > 4, "many").otherwise("few"))
    M = [MetricSpec("user_count", "rows")] + [
        MetricSpec(f"{c}_{w}_mean", "mean", f"{c}_{w}") for w in LOO for c in ("active_days", "active_days_excl_click", "click_gap")
    ]
    return sg.summarize(both, ["sender_group"], M)

"""Joins, windows, per-user metrics, peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import registry
from daymark.catalog.fixtures import (
    BUY,
    CUST,
    DEALS,
    EO,
    EV,
    ORD,
    ORDER_WINDOWS,
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
from daymark.functions import MetricSpec
from daymark.operators import metrics as mt
from daymark.operators import peers as pr
from daymark.operators import windows as wn
from daymark.operators.windows import Fact, fact_metrics, pick
from daymark.session import settle

add = registry.add
EVENT_CTES = ctes(EV, US, EO)
DEAL_CTES = ctes(ORD, BUY, DEALS)


def win(w: dict[str, tuple[int, int]], template: str) -> str:
    """The template once per window, with {w}, {a}, {b} filled in."""
    return ", ".join(template.format(w=n, a=a, b=b) for n, (a, b) in w.items())


@add("signup_offset", EVENT_CTES + "SELECT event_id, user_id, signup_date, off AS day_offset FROM eo")
def _(s, d):
    return wn.signup_offset(events(s, d), users(s, d)).select("event_id", "user_id", "signup_date", "day_offset")


@add(
    "enrich",
    """
    SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey
    """,
)
def _(s, d):
    c = table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    n = table(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return wn.enrich(c, (n, "n_nationkey"), (table(s, d, "region"), "r_regionkey")).select("c_custkey", "n_name", "r_name")


@add(
    "assemble",
    ctes(CUST, ORD)
    + """
    SELECT c.user_id, a.n_orders, b.n_urgent FROM cust c
    LEFT JOIN (SELECT user_id, count(*) AS n_orders FROM ord GROUP BY user_id) a USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n_urgent FROM ord WHERE priority = '1-URGENT' GROUP BY user_id) b USING (user_id)
    """,
)
def _(s, d):
    o = orders(s, d)
    a = o.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_orders"))
    b = o.where("priority = '1-URGENT'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_urgent"))
    return wn.assemble(customers(s, d).select("user_id"), a, b)


@add(
    "outer_merge",
    DEAL_CTES
    + """
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.sent, b.received FROM
      (SELECT user_id, count(*) AS sent FROM deals GROUP BY 1) a FULL JOIN
      (SELECT partner_id AS user_id, count(*) AS received FROM deals GROUP BY 1) b ON a.user_id = b.user_id
    """,
)
def _(s, d):
    x = deals(s, d)
    a = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sent"))
    b = x.groupBy(F.col("partner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("received"))
    return wn.outer_merge(a, b)


@add(
    "resolve_identity",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS user_id FROM lineitem
    JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
      ON l_orderkey = o_orderkey
    """,
)
def _(s, d):
    ids = table(s, d, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")
    )
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return wn.resolve_identity(lines, ids, "l_orderkey")


@add(
    "lookup_or_self",
    EVENT_CTES
    + """
    SELECT event_id, coalesce(p.p_size, ev.item_id) AS question_id FROM ev
    LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size > 25) p ON ev.item_id = p.p_partkey
    """,
)
def _(s, d):
    dim = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("item_id"), "p_size")
    return wn.lookup_or_self(events(s, d), dim, "item_id", "p_size", "question_id").select(
        "event_id", F.col("question_id").cast("long").alias("question_id")
    )


@add("as_role", DEAL_CTES + "SELECT partner_id AS user_id, count(*) AS n FROM deals GROUP BY 1")
def _(s, d):
    return wn.as_role(deals(s, d), "partner_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@add(
    "compare",
    ctes(ORD)
    + """
    , a AS (SELECT priority, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM ord GROUP BY 1),
    b AS (SELECT priority, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM ord WHERE status <> 'P' GROUP BY 1)
    SELECT priority, a.n AS n_base, b.n AS n_excluded, round(a.total, 2) AS total_base, round(b.total, 2) AS total_excluded,
      b.n - a.n AS n_diff, round(b.total - a.total, 2) AS total_diff FROM a FULL JOIN b USING (priority)
    """,
)
def _(s, d):
    def view(o):
        return o.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))

    o = orders(s, d)
    return wn.compare(view(o), view(o.where("status <> 'P'")), ["priority"], ["n", "total"])


W3 = pick("d0", "d0_7", "d8_28")


@add(
    "window_counts",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        W3,
        "count(*) FILTER (off BETWEEN {a} AND {b}) AS event_count_{w}, "
        "count(DISTINCT CASE WHEN off BETWEEN {a} AND {b} THEN day END) AS active_days_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    M = [MetricSpec("event_count", "rows"), MetricSpec("active_days", "days")]
    return wn.window_metrics(events(s, d), users(s, d), W3, M)


@add(
    "window_sums",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        W3,
        "CAST(coalesce(sum(CASE WHEN off BETWEEN {a} AND {b} THEN value END), 0) AS DOUBLE) AS value_sum_{w}, "
        "CAST(max(CASE WHEN off BETWEEN {a} AND {b} THEN value END) AS DOUBLE) AS value_max_{w}, "
        "CAST(sum(CASE WHEN off BETWEEN {a} AND {b} THEN value END) AS DOUBLE) / nullif(count(CASE WHEN off BETWEEN {a} AND {b} THEN value END), 0) AS value_mean_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    M = [MetricSpec("value_" + k, k, "value") for k in ("sum", "max", "mean")]
    return wn.window_metrics(events(s, d), users(s, d), W3, M)


@add(
    "window_distinct",
    DEAL_CTES
    + "SELECT user_id, "
    + win(
        ORDER_WINDOWS,
        "count(DISTINCT CASE WHEN date_diff('day', signup_date, day) BETWEEN {a} AND {b} THEN partner_id END) AS partners_{w}, "
        "count(DISTINCT CASE WHEN date_diff('day', signup_date, day) BETWEEN {a} AND {b} THEN item_id END) AS items_{w}",
    )
    + " FROM deals JOIN buy USING (user_id) GROUP BY user_id",
)
def _(s, d):
    M = [MetricSpec("partners", "distinct", "partner_id"), MetricSpec("items", "distinct", "item_id")]
    return wn.window_metrics(deals(s, d), users=buyers(s, d), W=ORDER_WINDOWS, M=M).join(
        deals(s, d).select("user_id").distinct(), "user_id", "left_semi"
    )


@add(
    "dense_user_base",
    ctes(CUST, ORD)
    + """
    SELECT c.user_id, count(o.day) FILTER (date_diff('day', DATE '1996-01-01', o.day) BETWEEN 0 AND 365) AS order_count_year
    FROM cust c LEFT JOIN ord o USING (user_id) GROUP BY c.user_id
    """,
)
def _(s, d):
    base = customers(s, d).select("user_id", F.lit("1996-01-01").cast("date").alias("signup_date"))
    return wn.window_metrics(orders(s, d), base, {"year": (0, 365)}, [MetricSpec("order_count", "rows")])


W_RET = pick("d1_28", "d8_28") | {"d1": (1, 1)}


@add(
    "retention",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        W_RET,
        "count(DISTINCT CASE WHEN off BETWEEN {a} AND {b} THEN day END) AS attendance_days_{w}, "
        "count(DISTINCT CASE WHEN off BETWEEN {a} AND {b} THEN day END) >= 1 AS retention_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    return mt.retention(events(s, d), users(s, d), W_RET)


STREAK_SQL = (
    EVENT_CTES
    + """
    , dd AS (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'view'),
    g AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS isl FROM dd),
    r AS (SELECT user_id, isl, count(*) AS n FROM g GROUP BY 1, 2)
    """
)


@add("longest_streak", STREAK_SQL + "SELECT user_id, max(n) AS longest_streak FROM r GROUP BY 1")
def _(s, d):
    return mt.longest_streak(of_type(s, d, "view"))


@add(
    "attendance_summary",
    STREAK_SQL
    + "SELECT user_id, sum(n) AS attendance_days, max(n) AS longest_streak, sum(n) >= 2 AS revisit_flag FROM r GROUP BY 1",
)
def _(s, d):
    return mt.attendance_summary(of_type(s, d, "view"))


W_PAY = pick("d0_28", "d8_28") | {"d8_9": (8, 9)}


@add(
    "payment_metrics",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        W_PAY,
        "count(*) FILTER (event_type = 'purchase' AND off BETWEEN {a} AND {b}) AS payment_count_{w}, "
        "count(DISTINCT CASE WHEN event_type = 'purchase' AND off BETWEEN {a} AND {b} THEN day END) AS payment_active_days_{w}, "
        "CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND off BETWEEN {a} AND {b} THEN value END), 0) AS DOUBLE) AS payment_amount_{w}, "
        "count(*) FILTER (event_type = 'purchase' AND off BETWEEN {a} AND {b}) > 0 AS paid_flag_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    return mt.payment_metrics(of_type(s, d, "purchase"), users(s, d), W_PAY)


@add(
    "payment_amount_fallback",
    ctes(ORD, BUY, DEALS)
    + """
    SELECT b.user_id, CAST(coalesce(sum(CASE WHEN date_diff('day', signup_date, day) BETWEEN 0 AND 365
      THEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) END), 0) AS DOUBLE) AS payment_amount_d0_365
    FROM buy b LEFT JOIN deals x USING (user_id) LEFT JOIN part ON x.item_id = p_partkey GROUP BY 1
    """,
)
def _(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("productId"))
    pay = deals(s, d).select("user_id", "day", "item_id").join(part, "item_id")
    return mt.payment_metrics(pay, buyers(s, d), {"d0_365": (0, 365)}).select("user_id", "payment_amount_d0_365")


OFF = "date_diff('day', signup_date, day)"
W_SENT = {k: ORDER_WINDOWS[k] for k in ("d0", "d0_365")}


@add(
    "sender_metrics",
    DEAL_CTES
    + "SELECT b.user_id, "
    + win(
        W_SENT,
        "count(*) FILTER ({o} BETWEEN {{a}} AND {{b}}) AS sent_count_{{w}}, "
        "count(*) FILTER (flag = 'A' AND {o} BETWEEN {{a}} AND {{b}}) AS sent_complete_count_{{w}}, "
        "count(DISTINCT CASE WHEN {o} BETWEEN {{a}} AND {{b}} THEN day END) AS sent_active_days_{{w}}, "
        "count(*) FILTER ({o} BETWEEN {{a}} AND {{b}}) > 0 AS sent_experience_{{w}}, "
        "count(DISTINCT CASE WHEN {o} BETWEEN {{a}} AND {{b}} THEN partner_id END) AS sent_distinct_receivers_{{w}}, "
        "count(DISTINCT CASE WHEN {o} BETWEEN {{a}} AND {{b}} THEN item_id END) AS sent_distinct_items_{{w}}, "
        "coalesce(count(*) FILTER (flag = 'A' AND {o} BETWEEN {{a}} AND {{b}}) / "
        "nullif(count(*) FILTER ({o} BETWEEN {{a}} AND {{b}}), 0), 0.0) AS sent_complete_rate_{{w}}".format(o=OFF),
    )
    + " FROM buy b LEFT JOIN deals x USING (user_id) GROUP BY 1",
)
def _(s, d):
    parts = {"distinct_receivers": "partner_id", "distinct_items": "item_id"}
    return mt.sender_metrics(deals(s, d), buyers(s, d), W_SENT, "flag = 'A'", parts)


RECEIVER_SQL = (
    DEAL_CTES
    + """
    , r AS (SELECT partner_id AS user_id, day, ship_day, (flag = 'A' OR quantity > 40) AS rd, quantity FROM deals)
    SELECT b.user_id,
    """
    + win(
        W_SENT,
        "count(*) FILTER (date_diff('day', signup_date, {{d}}) BETWEEN {a} AND {b}) AS received_count_{w}, "
        "count(DISTINCT CASE WHEN date_diff('day', signup_date, {{d}}) BETWEEN {a} AND {b} THEN {{d}} END) AS received_days_{w}, "
        "count(*) FILTER (rd AND date_diff('day', signup_date, {{d}}) BETWEEN {a} AND {b}) AS received_read_count_{w}, "
        "CAST(coalesce(sum(CASE WHEN date_diff('day', signup_date, {{d}}) BETWEEN {a} AND {b} THEN quantity END), 0) AS BIGINT) AS received_opened_times_{w}",
    )
    + " FROM buy b LEFT JOIN r USING (user_id) GROUP BY 1"
)


def _received(s, d, date_col):
    x = deals(s, d).withColumn("read_flag", (F.col("flag") == "A") | (F.col("quantity") > 40))
    return mt.receiver_metrics(x, buyers(s, d), W_SENT, date_col, "partner_id", opened="quantity")


@add("receiver_metrics", RECEIVER_SQL.format(d="day"))
def _(s, d):
    return _received(s, d, "day")


@add("receiver_metrics_by_read_day", RECEIVER_SQL.format(d="ship_day"))
def _(s, d):
    return _received(s, d, "ship_day")


@add(
    "first_in_window",
    EVENT_CTES
    + """
    SELECT user_id, min(off) AS first_offset, min(day) AS first_date FROM eo
    WHERE event_type = 'view' AND off BETWEEN 0 AND 7 GROUP BY 1
    """,
)
def _(s, d):
    return wn.first_in_window(of_type(s, d, "view"), users(s, d), "d0_7")


@add(
    "receiver_rates",
    EVENT_CTES
    + """
    , r AS (SELECT user_id, count(*) FILTER (event_type = 'view' AND off BETWEEN 0 AND 7) AS n,
      count(*) FILTER (event_type = 'view' AND off BETWEEN 0 AND 7 AND value > 10) AS rd,
      min(CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 7 THEN off END) AS f FROM eo GROUP BY 1)
    SELECT user_id, n > 0 AS received_yn_d0_7, coalesce(rd / nullif(n, 0), 0.0) AS received_read_rate_d0_7,
      n - rd AS unread_received_count_d0_7, coalesce(f, 8) AS first_day_filled,
      CASE WHEN n > 0 THEN 8 - f ELSE 0 END AS early_received_score_d0_7 FROM r
    """,
)
def _(s, d):
    v, u = of_type(s, d, "view"), users(s, d)
    x = v.withColumn("read_flag", F.col("value") > 10)
    rec = mt.receiver_metrics(x, u, pick("d0_7"), receiver_col="user_id", opened="item_id")
    rec = rec.join(wn.first_in_window(v, u, "d0_7"), "user_id", "left")
    return mt.receiver_rates(rec).select(
        "user_id",
        "received_yn_d0_7",
        "received_read_rate_d0_7",
        "unread_received_count_d0_7",
        "first_day_filled",
        "early_received_score_d0_7",
    )


@add(
    "edge_window_metrics",
    DEAL_CTES
    + "SELECT s.*, "
    + ", ".join(f"friend_received_count_{w}, friend_received_accepted_count_{w}" for w in W_SENT)
    + " FROM (SELECT b.user_id, "
    + win(
        W_SENT,
        f"count(*) FILTER ({OFF} BETWEEN {{a}} AND {{b}}) AS friend_sent_count_{{w}}, "
        f"count(*) FILTER (flag = 'A' AND {OFF} BETWEEN {{a}} AND {{b}}) AS friend_sent_accepted_count_{{w}}",
    )
    + " FROM buy b LEFT JOIN deals x USING (user_id) GROUP BY 1) s JOIN (SELECT b.user_id, "
    + win(
        W_SENT,
        f"count(*) FILTER ({OFF} BETWEEN {{a}} AND {{b}}) AS friend_received_count_{{w}}, "
        f"count(*) FILTER (flag = 'A' AND {OFF} BETWEEN {{a}} AND {{b}}) AS friend_received_accepted_count_{{w}}",
    )
    + " FROM buy b LEFT JOIN (SELECT partner_id, day, flag FROM deals) x ON b.user_id = x.partner_id GROUP BY 1) r USING (user_id)",
)
def _(s, d):
    return mt.edge_window_metrics(
        deals(s, d), buyers(s, d), W_SENT, "user_id", "partner_id", F.col("flag") == "A"
    )


W_POINT = pick("d0_7", "d0_28")


@add(
    "delta_metrics",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        W_POINT,
        "count(*) FILTER (off BETWEEN {a} AND {b}) AS point_event_count_{w}, "
        "count(*) FILTER (value < 10 AND off BETWEEN {a} AND {b}) AS point_use_count_{w}, "
        "CAST(coalesce(sum(CASE WHEN off BETWEEN {a} AND {b} THEN value - 10 END), 0) AS DOUBLE) AS point_delta_sum_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    points = events(s, d).withColumn("delta_point", F.col("value") - 10)
    return mt.delta_metrics(points, users(s, d), W_POINT)


def _activity(s, d):
    return {
        kind: of_type(s, d, kind).select("user_id", F.col("day").alias("activity_date"))
        for kind in ("click", "view", "error")
    }


@add(
    "activity_days",
    EVENT_CTES + "SELECT DISTINCT user_id, day AS activity_date FROM ev WHERE event_type IN ('click', 'view', 'error')",
)
def _(s, d):
    return mt.activity_days(*_activity(s, d).values())


W_ACT = pick("d0_7", "d0_28", "d8_28")


@add(
    "active_day_counts",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        W_ACT,
        "count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND off BETWEEN {a} AND {b} THEN day END) AS active_days_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    return mt.active_day_counts(mt.activity_days(*_activity(s, d).values()), users(s, d), W_ACT)


_ALL = "count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND off BETWEEN {a} AND {b} THEN day END)"
_REST = "count(DISTINCT CASE WHEN event_type IN ('view', 'error') AND off BETWEEN {a} AND {b} THEN day END)"


@add(
    "leave_one_out",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        pick("d0_28", "d8_28"),
        f"{_ALL} AS active_days_{{w}}, {_REST} AS active_days_excl_click_{{w}}, {_ALL} - {_REST} AS click_gap_{{w}}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    return mt.leave_one_out(_activity(s, d), users(s, d), "click", pick("d0_28", "d8_28"))


def _each(a, b):
    every = "count(DISTINCT day) FILTER (event_type IN ('click', 'view', 'error') AND off BETWEEN {a} AND {b})"
    rest = {k: ", ".join(f"'{o}'" for o in ("click", "view", "error") if o != k) for k in ("click", "view", "error")}
    without = {k: f"count(DISTINCT day) FILTER (event_type IN ({o}) AND off BETWEEN {a} AND {b})" for k, o in rest.items()}
    every = every.format(a=a, b=b)
    return every, without


def _each_sql(W):
    cells = []
    for w, (a, b) in W.items():
        every, without = _each(a, b)
        cells.append(f"{every} AS active_days_{w}")
        for k, c in without.items():
            cells.append(f"{c} AS active_days_excl_{k}_{w}, {every} - {c} AS {k}_gap_{w}")
    return ", ".join(cells)


@add(
    "leave_each_out",
    EVENT_CTES
    + f""", seen AS (SELECT DISTINCT user_id, off FROM eo WHERE event_type IN ('click', 'view', 'error') AND off BETWEEN 0 AND 62),
    runs AS (SELECT user_id, off, off - row_number() OVER (PARTITION BY user_id ORDER BY off) AS island FROM seen),
    lengths AS (SELECT user_id, max(n) AS run FROM (SELECT user_id, island, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1),
    ends AS (SELECT user_id, min(off) AS lo, max(off) AS hi FROM seen GROUP BY 1),
    c AS (SELECT user_id, {_each_sql(W_ACT)} FROM eo GROUP BY 1)
    SELECT c.*, lo AS first_active_day, hi AS last_active_day, coalesce(run, 0) AS longest_active_run
    FROM c LEFT JOIN ends USING (user_id) LEFT JOIN lengths USING (user_id)
    """,
)
def _(s, d):
    return mt.leave_each_out(_activity(s, d), users(s, d), W_ACT)


@add(
    "fact_metrics",
    EVENT_CTES
    + "SELECT user_id, "
    + win(
        pick("d0_7", "d0_28"),
        "count(*) FILTER (event_type = 'click' AND off BETWEEN {a} AND {b}) AS clicks_{w}, "
        "count(DISTINCT day) FILTER (event_type IN ('click', 'view') AND off BETWEEN {a} AND {b}) AS active_days_{w}, "
        "CAST(coalesce(sum(value) FILTER (event_type = 'view' AND off BETWEEN {a} AND {b}), 0) AS DOUBLE) AS viewed_{w}, "
        "CAST(avg(value) FILTER (event_type = 'view' AND off BETWEEN {a} AND {b}) AS DOUBLE) AS view_mean_{w}, "
        "min(day) FILTER (event_type = 'error' AND off BETWEEN {a} AND {b}) AS first_error_{w}, "
        "count(DISTINCT item_id) FILTER (event_type = 'click' AND off BETWEEN {a} AND {b}) AS items_{w}",
    )
    + " FROM eo GROUP BY user_id",
)
def _(s, d):
    W, active = pick("d0_7", "d0_28"), MetricSpec("active_days", "days")
    clicks = [MetricSpec("clicks", "rows"), MetricSpec("items", "distinct", "item_id"), active]
    views = [MetricSpec("viewed", "sum", "value"), MetricSpec("view_mean", "mean", F.col("value").cast("double")), active]
    return fact_metrics(
        [
            Fact(of_type(s, d, "click"), [(W, clicks)]),
            Fact(of_type(s, d, "view"), [(W, views)]),
            Fact(of_type(s, d, "error"), [(W, [MetricSpec("first_error", "min", "day")])]),
        ],
        users(s, d),
    )


@add(
    "session_behaviour",
    DEAL_CTES
    + """
    , q AS (SELECT b.user_id, count(*) FILTER (flag = 'N') AS st, count(*) FILTER (flag = 'A') AS co,
      count(*) FILTER (flag = 'R') AS sk, count(DISTINCT ship_day) AS ad
      FROM buy b LEFT JOIN (SELECT user_id AS u, ship_day, flag FROM deals) x ON b.user_id = x.u
        AND date_diff('day', b.signup_date, x.ship_day) BETWEEN 0 AND 365 GROUP BY 1)
    SELECT user_id, st AS question_start_count_y, co AS question_complete_count_y, sk AS question_skip_count_y,
      ad AS question_active_days_y, least(coalesce(co / nullif(st, 0), 0.0), 1.0) AS question_completion_rate_y,
      least(coalesce(sk / nullif(st, 0), 0.0), 1.0) AS question_skip_rate_y FROM q
    """,
)
def _(s, d):
    lines = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_returnflag").alias("event_key"),
        F.to_date("l_shipdate").alias("day"),
    )
    ids = orders(s, d).select(F.col("o_orderkey").alias("session_id"), "user_id")
    families = {"start": ["N"], "complete": ["A"], "skip": ["R"]}
    return mt.session_behaviour(lines, ids, buyers(s, d), families, {"y": (0, 365)})


@add(
    "exposure_metrics",
    EVENT_CTES
    + """
    , v AS (SELECT eo.*, coalesce(CAST(p_size AS BIGINT), item_id) AS q FROM eo
      LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size > 25) ON item_id = p_partkey),
    e AS (SELECT user_id, count(*) FILTER (event_type = 'view' AND off BETWEEN 0 AND 7) AS n,
      count(DISTINCT CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 7 THEN q END) AS u,
      count(DISTINCT CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 7 THEN day END) AS dy,
      count(*) FILTER (event_type = 'click' AND off BETWEEN 0 AND 7) AS r FROM v GROUP BY 1)
    SELECT user_id, n AS exposure_count_d0_7, u AS exposure_unique_questions_d0_7, dy AS exposure_days_d0_7,
      least(coalesce(r / nullif(n, 0), 0.0), 1.0) AS recv_rate_d0_7 FROM e
    """,
)
def _(s, d):
    u, W = users(s, d), pick("d0_7")
    received = wn.window_metrics(of_type(s, d, "click"), u, W, [MetricSpec("received_count", "rows")])
    dim = table(s, d, "part").where("p_size > 25").select(
        F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("question_id")
    )
    return mt.exposure_metrics(of_type(s, d, "view"), u, dim, W, received)


AFTER = EVENT_CTES + """
    , fa AS (SELECT user_id, min(day) AS anchor FROM eo WHERE event_type = 'view' AND off BETWEEN 0 AND 7 GROUP BY 1)
    """


@add(
    "after_anchor",
    AFTER
    + """
    SELECT fa.user_id, count(*) FILTER (event_type = 'purchase' AND day >= anchor AND off BETWEEN 0 AND 9) AS payment_after_d0_9,
      count(*) FILTER (event_type = 'purchase' AND day >= anchor AND off BETWEEN 0 AND 9) > 0 AS payment_after_yn_d0_9
    FROM fa JOIN eo USING (user_id) GROUP BY 1
    """,
)
def _(s, d):
    u = users(s, d)
    anchors = wn.first_in_window(of_type(s, d, "view"), u, "d0_7")
    return wn.after_anchor(of_type(s, d, "purchase"), anchors, u, "d0_9", "payment_after", W={"d0_7": (0, 7), "d0_9": (0, 9)})


@add(
    "responses_after",
    AFTER
    + """
    SELECT fa.user_id,
      count(DISTINCT CASE WHEN day >= anchor AND off BETWEEN 0 AND 28 THEN day END) AS attendance_days_after_d0_28,
      count(DISTINCT CASE WHEN day >= anchor AND off BETWEEN 0 AND 28 THEN day END) > 0 AS attendance_days_after_yn_d0_28,
      count(DISTINCT CASE WHEN event_type = 'error' AND day >= anchor AND off BETWEEN 0 AND 28 THEN day END) AS point_use_after_d0_28,
      count(DISTINCT CASE WHEN event_type = 'error' AND day >= anchor AND off BETWEEN 0 AND 28 THEN day END) > 0 AS point_use_after_yn_d0_28,
      count(*) FILTER (event_type = 'purchase' AND day >= anchor AND off BETWEEN 0 AND 28) AS payment_after_d0_28,
      count(*) FILTER (event_type = 'purchase' AND day >= anchor AND off BETWEEN 0 AND 28) > 0 AS payment_after_yn_d0_28
    FROM fa JOIN eo USING (user_id) GROUP BY 1
    """,
)
def _(s, d):
    u = users(s, d)
    anchors = wn.first_in_window(of_type(s, d, "view"), u, "d0_7")
    sources = {
        "attendance_days_after": (events(s, d), "day", True),
        "point_use_after": (of_type(s, d, "error"), "day", True),
        "payment_after": (of_type(s, d, "purchase"), "day", False),
    }
    return mt.responses_after(anchors, u, sources)


@add(
    "user_mart",
    EVENT_CTES
    + """
    SELECT user_id, signup_date, count(DISTINCT CASE WHEN off BETWEEN 1 AND 28 THEN day END) AS attendance_days_d1_28,
      count(DISTINCT CASE WHEN off BETWEEN 1 AND 28 THEN day END) >= 1 AS retention_d1_28,
      count(*) FILTER (event_type = 'purchase' AND off BETWEEN 8 AND 28) AS payment_count_d8_28,
      CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND off BETWEEN 8 AND 28 THEN value END), 0) AS DOUBLE) AS payment_amount_d8_28,
      coalesce(min(CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 3 THEN off END), 0) AS first_offset,
      0 AS candidate_exposure_count_d0_7 FROM eo GROUP BY 1, 2
    """,
)
def _(s, d):
    u = users(s, d)
    mart = mt.user_mart(
        u,
        mt.retention(events(s, d), u, pick("d1_28")),
        mt.payment_metrics(of_type(s, d, "purchase"), u, pick("d8_28")).select(
            "user_id", "payment_count_d8_28", "payment_amount_d8_28"
        ),
        wn.first_in_window(of_type(s, d, "view"), u, "d0_3").select("user_id", "first_offset"),
        defaults={"candidate_exposure_count_d0_7": 0},
    )
    return mart


@add(
    "behaviour_ratios",
    DEAL_CTES
    + """
    , m AS (SELECT b.user_id, count(*) FILTER (o = 0) AS n0, count(*) AS n, count(DISTINCT CASE WHEN o = 0 THEN day END) AS a0,
        count(DISTINCT day) AS a, count(DISTINCT partner_id) AS p, count(DISTINCT item_id) AS i,
        count(DISTINCT CASE WHEN o = 0 THEN partner_id END) AS p0, count(DISTINCT CASE WHEN o = 0 THEN item_id END) AS i0
      FROM buy b JOIN (SELECT deals.*, date_diff('day', signup_date, day) AS o FROM deals JOIN buy USING (user_id)) x
        ON b.user_id = x.user_id AND x.o BETWEEN 0 AND 365 GROUP BY 1),
    f AS (SELECT buy.user_id, coalesce(n0, 0) AS n0, coalesce(n, 0) AS n, coalesce(a0, 0) AS a0, coalesce(a, 0) AS a,
      coalesce(p, 0) AS p, coalesce(i, 0) AS i, coalesce(p0, 0) AS p0, coalesce(i0, 0) AS i0 FROM buy LEFT JOIN m USING (user_id))
    SELECT user_id, coalesce(n0 / nullif(a0, 0), 0.0) AS sent_per_active_day_d0, coalesce(p0 / nullif(n0, 0), 0.0) AS sent_unique_receivers_ratio_d0,
      coalesce(i0 / nullif(n0, 0), 0.0) AS sent_items_diversity_ratio_d0, coalesce(n / nullif(a, 0), 0.0) AS sent_per_active_day_d0_365,
      coalesce(p / nullif(n, 0), 0.0) AS sent_unique_receivers_ratio_d0_365, coalesce(i / nullif(n, 0), 0.0) AS sent_items_diversity_ratio_d0_365,
      coalesce(n0 / nullif(n, 0), 0.0) AS sent_d0_share_of_d0_365, coalesce(n / nullif(a, 0), 0.0) AS sent_to_start_ratio_d0_365 FROM f
    """,
)
def _(s, d):
    parts = {"distinct_receivers": "partner_id", "distinct_items": "item_id"}
    m = mt.sender_metrics(deals(s, d), buyers(s, d), W_SENT, "flag = 'A'", parts)
    out = mt.behaviour_ratios(
        m,
        list(W_SENT),
        early=("d0", "d0_365"),
        session_start="sent_active_days_d0_365",
        session_window="d0_365",
    )
    return out.select("user_id", *[c for c in out.columns if "ratio" in c or "per_active" in c or "share_of" in c])


def event_d3_mart(s, d):
    """The event table in all roles; peers share the signup day (class) or the signup week (grade)."""
    u = settle(users(s, d).withColumn("week", F.date_trunc("week", "signup_date").cast("date")))
    kind = "event_type = '{}'".format
    roles = {
        "sent": kind("click"), "received": kind("view"), "friend": kind("signup"), "point_use": kind("error"),
        "attendance": kind("signup"), "payment": kind("purchase"), "activity": "event_type in ('click', 'view', 'error')",
    }
    facts = events(s, d).withColumn("partner_id", F.col("item_id"))
    return mt.d3_mart(u, facts, roles, {"class": "signup_date", "grade": "week"}, done="value > 10", amount="value")


@add(
    "d3_mart",
    EVENT_CTES
    + """
    , base AS (SELECT us.*, date_trunc('week', signup_date) AS wk FROM us),
    f AS (SELECT user_id,
      count(DISTINCT CASE WHEN event_type = 'signup' AND off BETWEEN 0 AND 3 THEN item_id END) AS friends_d3,
      count(*) FILTER (event_type = 'click' AND off BETWEEN 0 AND 3) AS sn,
      count(*) FILTER (event_type = 'click' AND value > 10 AND off BETWEEN 0 AND 3) AS sc,
      count(DISTINCT CASE WHEN event_type = 'click' AND off BETWEEN 0 AND 3 THEN day END) AS sd,
      count(DISTINCT CASE WHEN event_type = 'click' AND off BETWEEN 0 AND 3 THEN item_id END) AS si,
      count(*) FILTER (event_type = 'view' AND off BETWEEN 0 AND 3) AS rn,
      count(DISTINCT CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 3 THEN day END) AS rd,
      min(CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 3 THEN off END) AS rf,
      min(CASE WHEN event_type = 'view' AND off BETWEEN 0 AND 3 THEN day END) AS anchor,
      count(*) FILTER (event_type = 'signup' AND off BETWEEN 4 AND 28) AS back,
      count(*) FILTER (event_type = 'purchase' AND off BETWEEN 4 AND 28) AS pn,
      CAST(coalesce(sum(CASE WHEN event_type = 'purchase' AND off BETWEEN 4 AND 28 THEN value END), 0) AS DOUBLE) AS pv,
      count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error') AND off BETWEEN 4 AND 28 THEN day END) AS ad
      FROM eo GROUP BY 1),
    pu AS (SELECT user_id, count(*) AS n FROM eo JOIN f USING (user_id)
      WHERE event_type = 'error' AND off BETWEEN 0 AND 3 AND day >= anchor GROUP BY 1)
    SELECT b.user_id, friends_d3,
      count(*) OVER (PARTITION BY signup_date) AS class_users_d0_3, count(*) OVER (PARTITION BY wk) AS grade_users_d0_3,
      count(*) FILTER (sn > 0) OVER (PARTITION BY signup_date) - CASE WHEN sn > 0 THEN 1 ELSE 0 END AS class_active_users_d0_3,
      count(*) FILTER (sn > 0) OVER (PARTITION BY wk) - CASE WHEN sn > 0 THEN 1 ELSE 0 END AS grade_active_users_d0_3,
      CASE WHEN rn > 0 THEN 1 ELSE 0 END AS received_vote_yn_d0_3, rn AS received_vote_count_d0_3, rd AS received_vote_days_d0_3,
      coalesce(rf, 0) AS first_received_vote_day_d0_3, coalesce(pu.n, 0) AS point_use_after_received_vote_count_d0_3,
      CASE WHEN pu.n > 0 THEN 1 ELSE 0 END AS point_use_after_received_vote_yn_d0_3,
      sn > 0 AS sent_vote_experience_d0_3, sn AS sent_vote_count_d0_3, sc AS sent_vote_complete_count_d0_3, sd AS sent_vote_active_days_d0_3,
      si AS sent_vote_distinct_chosen_users_d0_3, si AS sent_vote_distinct_questions_d0_3,
      coalesce(sc / nullif(sn, 0), 0.0) AS sent_vote_complete_rate_d0_3,
      CASE WHEN back > 0 THEN 1 ELSE 0 END AS returned_d4_28, CASE WHEN pn > 0 THEN 1 ELSE 0 END AS paid_d4_28,
      pn AS payment_count_d4_28, pv AS bought_hearts_d4_28, ad AS active_days_d4_28
    FROM base b JOIN f USING (user_id) LEFT JOIN pu USING (user_id)
    """,
)
def _(s, d):
    return event_d3_mart(s, d)


@add(
    "group_sizes",
    ctes(CUST)
    + """
    SELECT user_id, count(*) OVER (PARTITION BY n_nationkey) AS same_class, count(*) OVER (PARTITION BY n_regionkey) AS same_grade,
      CASE WHEN segment <> 'MACHINERY' THEN count(*) OVER (PARTITION BY segment) ELSE 0 END AS same_segment FROM cust
    """,
)
def _(s, d):
    c = customers(s, d).withColumn("known_segment", F.when(F.col("segment") != "MACHINERY", F.col("segment")))
    keys = {"n_nationkey": "same_class", "n_regionkey": "same_grade", "known_segment": "same_segment"}
    return pr.group_sizes(c, keys).select("user_id", "same_class", "same_grade", "same_segment")


@add(
    "active_peers",
    ctes(CUST)
    + """
    , f AS (SELECT *, coalesce(balance > 5000, false) AS act FROM cust),
    g AS (SELECT user_id, count(*) OVER (PARTITION BY n_nationkey) AS tot,
      count(*) FILTER (act) OVER (PARTITION BY n_nationkey) - CASE WHEN act THEN 1 ELSE 0 END AS n FROM f)
    SELECT user_id, n AS class_active_d0_7, least(coalesce(n / nullif(tot - 1, 0), 0.0), 1.0) AS class_active_ratio_d0_7 FROM g
    """,
)
def _(s, d):
    c = customers(s, d).withColumn("is_active", F.coalesce(F.col("balance") > 5000, F.lit(False)))
    c = pr.group_sizes(c, {"n_nationkey": "total"})
    out = pr.active_peers(c, {"n_nationkey": ("class", "total")})
    return out.select("user_id", "class_active_d0_7", "class_active_ratio_d0_7")


@add(
    "funnel",
    ctes(CUST)
    + """
    SELECT 'all' AS population, count(DISTINCT user_id) AS user_count FROM cust
    UNION ALL SELECT 'rich', count(DISTINCT user_id) FROM cust WHERE balance > 5000
    UNION ALL SELECT 'rich_asia', count(DISTINCT user_id) FROM cust WHERE balance > 5000 AND n_regionkey = 2
    """,
)
def _(s, d):
    steps = {"all": "true", "rich": "balance > 5000", "rich_asia": "balance > 5000 and n_regionkey = 2"}
    return pr.funnel(customers(s, d), steps)


@add(
    "edge_degrees",
    DEAL_CTES
    + """
    , a AS (SELECT user_id, count(*) AS n, count(*) FILTER (flag = 'A') AS ok, count(DISTINCT partner_id) AS u FROM deals GROUP BY 1),
    b AS (SELECT partner_id AS user_id, count(*) AS n, count(*) FILTER (flag = 'A') AS ok, count(DISTINCT deals.user_id) AS u FROM deals GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS friend_sent_rows, coalesce(a.ok, 0) AS friend_sent_accepted,
      coalesce(a.u, 0) AS friend_sent_unique_receivers, coalesce(b.n, 0) AS friend_received_rows,
      coalesce(b.ok, 0) AS friend_received_accepted, coalesce(b.u, 0) AS friend_received_unique_senders
    FROM a FULL JOIN b ON a.user_id = b.user_id
    """,
)
def _(s, d):
    return pr.edge_degrees(deals(s, d), "user_id", "partner_id", F.col("flag") == "A")


@add(
    "edge_summary",
    DEAL_CTES
    + """
    SELECT 'rows' AS metric, count(*) AS value FROM deals UNION ALL SELECT 'senders', count(DISTINCT user_id) FROM deals
    UNION ALL SELECT 'receivers', count(DISTINCT partner_id) FROM deals
    UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT user_id, partner_id FROM deals)
    UNION ALL SELECT 'accepted', count(*) FROM deals WHERE flag = 'A'
    """,
)
def _(s, d):
    return pr.edge_summary(deals(s, d), "user_id", "partner_id", F.col("flag") == "A")

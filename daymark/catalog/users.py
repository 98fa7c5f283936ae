"""Daily, product, role and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import registry
from daymark.catalog.fixtures import CUST, DEALS, EV, ORD, ctes, customers, deals, events, orders, table
from daymark.functions import MetricSpec
from daymark.operators import daily as dy
from daymark.operators.metrics import attendance_summary
from daymark.operators.windows import assemble
from daymark.session import settle

add = registry.add
DEAL = ctes(ORD, DEALS)


@add(
    "daily_group_users",
    ctes(EV)
    + """
    , dd AS (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'purchase'),
    g AS (SELECT user_id, CASE WHEN count(*) >= 20 THEN 'often' ELSE 'seldom' END AS grp FROM dd GROUP BY 1)
    SELECT day, grp, count(*) AS user_count FROM dd JOIN g USING (user_id) GROUP BY 1, 2
    """,
)
def _(s, d):
    bought = events(s, d).where("event_type = 'purchase'")
    groups = attendance_summary(bought).withColumn(
        "grp", F.when(F.col("attendance_days") >= 20, "often").otherwise("seldom")
    )
    return dy.daily_by_group(bought, groups, "day", "grp")


@add(
    "daily_payments",
    ctes(ORD)
    + "SELECT day, count(*) AS payment_count, count(DISTINCT user_id) AS paid_user_count FROM ord GROUP BY 1",
)
def _(s, d):
    M = [MetricSpec("payment_count", "rows"), MetricSpec("paid_user_count", "distinct", "user_id")]
    return dy.daily(orders(s, d), "day", [], M)


PAY = """
    , pay AS (SELECT user_id, ship_day AS created_at, item_id % 50 AS product_id FROM deals)
    """


def _pay(s, d):
    return deals(s, d).select("user_id", F.col("ship_day").alias("created_at"), (F.col("item_id") % 50).alias("product_id"))


@add(
    "user_payments",
    DEAL
    + PAY
    + """
    SELECT user_id, count(*) AS payment_rows, count(DISTINCT created_at) AS payment_distinct_at,
      count(DISTINCT CAST(created_at AS DATE)) AS payment_active_days, count(DISTINCT product_id) AS payment_product_count
    FROM pay GROUP BY 1
    """,
)
def _(s, d):
    return dy.user_payments(_pay(s, d))


@add(
    "product_repeat",
    DEAL
    + PAY
    + """
    , p AS (SELECT product_id, user_id, count(*) AS n, count(DISTINCT created_at) AS a FROM pay GROUP BY 1, 2)
    SELECT product_id, count(DISTINCT user_id) AS distinct_users, count(*) AS user_product_pairs,
      count(*) FILTER (a >= 2) AS repeat_user_product_pairs, sum(n) AS total_payment_rows FROM p GROUP BY 1
    """,
)
def _(s, d):
    return dy.product_repeat(_pay(s, d))


ROLE_SQL = (
    DEAL
    + """
    , x AS (SELECT *, CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS has_read, quantity AS opened_times FROM deals),
    a AS (SELECT user_id, count(*) AS n, count(DISTINCT day) AS dd, sum(has_read) AS r, sum(opened_times) AS o FROM x GROUP BY 1),
    b AS (SELECT partner_id AS user_id, count(*) AS n, count(DISTINCT day) AS dd, sum(has_read) AS r, sum(opened_times) AS o FROM x GROUP BY 1),
    j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS asker_record_count, a.dd AS asker_active_days, a.r AS asker_has_read_sum,
      a.o AS asker_opened_times_sum, a.o / a.n AS asker_opened_times_mean, b.n AS chosen_record_count,
      b.dd AS chosen_active_days, b.r AS chosen_has_read_sum, b.o AS chosen_opened_times_sum,
      b.o / b.n AS chosen_opened_times_mean FROM a FULL JOIN b ON a.user_id = b.user_id)
    """
)


def _roles(s, d):
    x = deals(s, d).withColumns({"has_read": (F.col("flag") == "A").cast("int"), "opened_times": F.col("quantity")})
    return dy.role_records(x, {"asker": "user_id", "chosen": "partner_id"})


@add("role_records", ROLE_SQL + "SELECT * FROM j")
def _(s, d):
    return _roles(s, d)


@add(
    "role_compare",
    ROLE_SQL
    + " UNION ALL ".join(
        f"""SELECT '{r}' AS role, '{c}' AS metric, avg({r}_{c}) AS mean, quantile_cont({r}_{c}, 0.5) AS median,
        max({r}_{c}) AS max FROM j"""
        for r in ("asker", "chosen")
        for c in ("record_count", "has_read_sum", "opened_times_sum")
    ),
)
def _(s, d):
    return dy.role_compare(settle(_roles(s, d)), ["asker", "chosen"], ["record_count", "has_read_sum", "opened_times_sum"])


@add(
    "daily_records",
    DEAL
    + """
    SELECT day, count(*) AS record_count, count(DISTINCT user_id) AS asker_count, count(DISTINCT partner_id) AS chosen_count,
      count(*) FILTER (flag = 'A') AS has_read_count, sum(quantity) AS opened_times_sum FROM deals GROUP BY 1
    """,
)
def _(s, d):
    M = [
        MetricSpec("record_count", "rows"),
        MetricSpec("asker_count", "distinct", "user_id"),
        MetricSpec("chosen_count", "distinct", "partner_id"),
        MetricSpec("has_read_count", "rows", where="flag = 'A'"),
        MetricSpec("opened_times_sum", "sum", "quantity"),
    ]
    return dy.daily(deals(s, d), "day", [], M)


@add(
    "daily_edges",
    DEAL
    + """
    SELECT day, flag, count(*) AS request_count, count(DISTINCT user_id) AS send_user_count,
      count(DISTINCT partner_id) AS receive_user_count FROM deals GROUP BY 1, 2
    """,
)
def _(s, d):
    return dy.daily_edges(deals(s, d), status_col="flag", sender_col="user_id", receiver_col="partner_id")


KEYS = ["view", "click", "error"]


def _log(s, d):
    return events(s, d).select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("event_key"), "day", "value", "event_id"
    )


@add(
    "daily_events",
    ctes(EV)
    + "SELECT day, count(*) AS total_events, count(DISTINCT user_id) AS active_sessions, "
    + ", ".join(f'count(*) FILTER (event_type = \'{k}\') AS "{k}"' for k in KEYS)
    + " FROM ev GROUP BY 1",
)
def _(s, d):
    return dy.daily_events(_log(s, d), KEYS)


@add(
    "session_days",
    ctes(EV)
    + """
    SELECT user_id AS session_id, day, count(*) AS total_event_count, count(*) FILTER (event_type = 'click') AS click_count
    FROM ev GROUP BY 1, 2
    """,
)
def _(s, d):
    return dy.session_days(_log(s, d), "click")


SK = """
    , sk AS (SELECT user_id AS session_id, event_type AS event_key, count(*) AS event_count, count(DISTINCT day) AS active_days
      FROM ev WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2)
    """


@add("session_keys", ctes(EV) + SK + "SELECT * FROM sk")
def _(s, d):
    return dy.session_keys(_log(s, d), KEYS)


@add(
    "session_core",
    ctes(EV)
    + """
    SELECT user_id AS session_id, CAST(max(value) AS DOUBLE) AS value_max, count(*) FILTER (event_type = 'view') AS open_count
    FROM ev GROUP BY 1
    """,
)
def _(s, d):
    return dy.session_core(_log(s, d), "value", "view")


@add(
    "key_summary",
    ctes(EV)
    + SK
    + """
    SELECT event_key, sum(event_count) AS total_count, count(DISTINCT session_id) AS session_count,
      avg(event_count) AS avg_count_per_session, count(*) FILTER (active_days >= 2) AS sessions_2plus_days FROM sk GROUP BY 1
    """,
)
def _(s, d):
    return dy.key_summary(dy.session_keys(_log(s, d), KEYS))


@add(
    "repeat_split",
    ctes(EV)
    + """
    , sd AS (SELECT user_id, day, count(*) AS n, count(*) FILTER (event_type = 'click') AS c FROM ev GROUP BY 1, 2),
    l AS (SELECT 'click' AS criterion, CASE WHEN c >= 2 THEN 'repeat' ELSE 'single' END AS "group" FROM sd
      UNION ALL SELECT 'all', CASE WHEN n >= 2 THEN 'repeat' ELSE 'single' END FROM sd)
    SELECT criterion, "group", count(*) AS row_count, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY criterion) AS ratio_pct
    FROM l GROUP BY 1, 2
    """,
)
def _(s, d):
    per_day = dy.session_days(_log(s, d), "click")
    return dy.repeat_split(per_day, {"click": "click_count >= 2", "all": "total_event_count >= 2"})


@add(
    "key_candidates",
    "SELECT event_type AS event_key, count(*) AS event_count FROM events WHERE regexp_matches(event_type, '(?i)CLICK|iew|skip') GROUP BY 1",
)
def _(s, d):
    return dy.key_candidates(_log(s, d), "CLICK|iew|skip")


@add(
    "coverage",
    """
    SELECT 'customer' AS "table", count(DISTINCT c_custkey) AS unique_user_count FROM customer
    UNION ALL SELECT 'orders', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'events', count(DISTINCT user_id) FROM events
    """,
)
def _(s, d):
    return dy.coverage(
        {
            "customer": (table(s, d, "customer"), "c_custkey"),
            "orders": (table(s, d, "orders"), "o_custkey"),
            "events": (table(s, d, "events"), "user_id"),
        }
    )


@add(
    "payer_split",
    ctes(CUST, ORD)
    + """
    , p AS (SELECT user_id, count(DISTINCT day) AS n FROM ord WHERE status = 'P' GROUP BY 1),
    j AS (SELECT c.user_id, p.n FROM cust c FULL JOIN p USING (user_id))
    SELECT CASE WHEN n IS NULL THEN 'unpaid' ELSE 'paid' END AS "group", count(*) AS user_count, avg(n) AS mean_per_payer,
      count(*) * 100.0 / sum(count(*)) OVER () AS ratio_pct FROM j GROUP BY 1
    """,
)
def _(s, d):
    p = orders(s, d).where("status = 'P'").groupBy("user_id").agg(F.count_distinct("day").alias("payment_distinct_at"))
    return dy.payer_split(customers(s, d), p)


@add(
    "active_day_split",
    ctes(EV)
    + SK
    + """
    SELECT event_key, CASE WHEN active_days >= 12 THEN '12+ days' ELSE 'under 12 days' END AS active_day_group,
      count(DISTINCT session_id) AS session_count FROM sk GROUP BY 1, 2
    """,
)
def _(s, d):
    return dy.active_day_split(dy.session_keys(_log(s, d), KEYS), "event_key", 12)


@add(
    "votes_user_summary",
    ctes(CUST, ORD, DEALS)
    + """
    SELECT c.user_id, coalesce(o.n, 0) AS order_rows, coalesce(x.n, 0) AS line_rows, coalesce(x.a, false) AS any_accepted
    FROM cust c LEFT JOIN (SELECT user_id, count(*) AS n FROM ord GROUP BY 1) o USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n, bool_or(flag = 'A') AS a FROM deals GROUP BY 1) x USING (user_id)
    """,
)
def _(s, d):
    from daymark.operators.tables import fill_defaults

    o = orders(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("order_rows"))
    x = deals(s, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("line_rows"), F.bool_or(F.col("flag") == "A").alias("any_accepted")
    )
    return fill_defaults(assemble(customers(s, d).select("user_id"), o, x))

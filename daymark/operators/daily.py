"""Daily, product, role and session aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.functions import MetricSpec, aggregate_column, col_of
from daymark.operators.ordering import quantiles
from daymark.operators.tables import melt, union_all
from daymark.session import shuffle_parts


def daily(df: DataFrame, day_col: str, by: Sequence[str], M: Sequence[MetricSpec]) -> DataFrame:
    """Metrics per day and group; rows without a day are left out."""
    keep = df
    for key in [day_col, *by]:
        keep = keep.where(F.col(key).isNotNull())
    return keep.groupBy(day_col, *by).agg(*[aggregate_column(m) for m in M])


def daily_by_group(df: DataFrame, groups: DataFrame, day_col: str, group_col: str, user_col: str = "user_id") -> DataFrame:
    """Distinct users per day and user group."""
    days = df.select(user_col, day_col).dropna().distinct()
    return days.join(groups.select(user_col, group_col), user_col).groupBy(day_col, group_col).agg(
        F.count(F.lit(1)).alias("user_count")
    )


def user_payments(
    df: DataFrame, user_col: str = "user_id", at_col: str = "created_at", product_col: str = "product_id"
) -> DataFrame:
    """Payments, different moments, days and products per user.

    Rows collapse to moments, then days, then users, and beside that to products, so no distinct set is expanded.  Hardly any
    user pays twice at one moment, so rows are dealt as they are: by user and day, where moments and days meet without one
    more shuffle, and into a stated number of parts, because adaptive merging goes by packed bytes and makes few parts of
    many groups.  A hot user still comes apart by day and by product.
    """
    parts = shuffle_parts(df.sparkSession)
    paid = df.where(F.col(user_col).isNotNull())
    dealt = paid.select(user_col, at_col, F.to_date(at_col).alias("_day")).repartition(parts, user_col, "_day")
    if dealt.schema[at_col].dataType == T.DateType():  # moments are days already
        days = dealt.groupBy(user_col, "_day").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_at", F.col("_day").isNotNull().cast("long")
        )
    else:
        moments = dealt.groupBy(user_col, "_day", at_col).agg(F.count(F.lit(1)).alias("_n"))
        days = moments.groupBy(user_col, "_day").agg(F.sum("_n").alias("_n"), F.count(at_col).alias("_at"))
    per_user = days.groupBy(user_col).agg(
        F.sum("_n").alias("payment_rows"),
        F.sum("_at").alias("payment_distinct_at"),
        F.count("_day").alias("payment_active_days"),
    )
    products = paid.select(user_col, product_col).repartition(parts, user_col, product_col).distinct()
    bought = products.groupBy(user_col).agg(F.count(product_col).alias("payment_product_count"))
    return per_user.join(bought, user_col)


def product_repeat(
    df: DataFrame, product_col: str = "product_id", user_col: str = "user_id", at_col: str = "created_at"
) -> DataFrame:
    """Buyers, repeat buyers (two different moments or more) and payments per product."""
    pair = (
        df.where(F.col(product_col).isNotNull() & F.col(user_col).isNotNull())
        .groupBy(product_col, user_col)
        .agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(at_col).alias("_at"))
    )
    return pair.groupBy(product_col).agg(
        F.count(F.lit(1)).alias("distinct_users"),
        F.count(F.lit(1)).alias("user_product_pairs"),
        F.count_if(F.col("_at") >= 2).alias("repeat_user_product_pairs"),
        F.sum("_n").alias("total_payment_rows"),
    )


def role_records(
    df: DataFrame, roles: Mapping[str, str], day_col: str = "day", read_col: str = "has_read", opened_col: str = "opened_times"
) -> DataFrame:
    """Records, days, reads, opens and mean opens of every user in each role (role name -> id column)."""
    out = None
    for role, id_col in roles.items():
        p = f"{role}_"
        # days first: a hot user collapses to one row per day before its days are counted
        per_day = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("user_id"), day_col).agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(read_col).alias("_r"),
            F.sum(opened_col).alias("_o"),
            F.count(opened_col).alias("_on"),
        )
        side = per_day.groupBy("user_id").agg(
            F.sum("_n").alias(p + "record_count"),
            F.count(day_col).alias(p + "active_days"),
            F.coalesce(F.sum("_r"), F.lit(0)).alias(p + "has_read_sum"),
            F.coalesce(F.sum("_o"), F.lit(0)).alias(p + "opened_times_sum"),
            F.try_divide(F.sum("_o").cast("double"), F.sum("_on")).alias(p + "opened_times_mean"),
        )
        out = side if out is None else out.join(side, "user_id", "full_outer")
    return out


def daily_edges(
    edges: DataFrame,
    day_col: str = "day",
    status_col: str = "status",
    sender_col: str = "send_user_id",
    receiver_col: str = "receive_user_id",
) -> DataFrame:
    """Requests per day and status with distinct senders and receivers."""
    return daily(
        edges,
        day_col,
        [status_col],
        [
            MetricSpec("request_count", "rows"),
            MetricSpec("send_user_count", "distinct", sender_col),
            MetricSpec("receive_user_count", "distinct", receiver_col),
        ],
    )


def daily_events(
    df: DataFrame, keys: Sequence[str], day_col: str = "day", key_col: str = "event_key", session_col: str = "session_id"
) -> DataFrame:
    """All events, each selected key as a column, and active sessions per day.

    One pass: events collapse to one row per day and session, so sessions need no distinct count.
    """
    per_session = (
        df.where(F.col(day_col).isNotNull())
        .groupBy(day_col, session_col)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(key_col) == k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    )
    return per_session.groupBy(day_col).agg(
        F.sum("_n").alias("total_events"),
        F.count(session_col).alias("active_sessions"),
        *[F.sum(f"_key_{i}").alias(k) for i, k in enumerate(keys)],
    )


def session_days(
    df: DataFrame, click: str, session_col: str = "session_id", day_col: str = "day", key_col: str = "event_key"
) -> DataFrame:
    """All events and events with the key `click` per session and day."""
    return (
        df.where(F.col(session_col).isNotNull() & F.col(day_col).isNotNull())
        .groupBy(session_col, day_col)
        .agg(F.count(F.lit(1)).alias("total_event_count"), F.count_if(F.col(key_col) == click).alias("click_count"))
    )


def session_keys(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    session_col: str = "session_id",
    key_col: str = "event_key",
    day_col: str = "day",
) -> DataFrame:
    """Events and active days per session and key."""
    kept = df.where(F.col(session_col).isNotNull() & F.col(day_col).isNotNull() & F.col(key_col).isNotNull())
    if keys is not None:
        kept = kept.where(F.col(key_col).isin(*keys))
    per_day = kept.groupBy(session_col, key_col, day_col).agg(F.count(F.lit(1)).alias("_n"))
    return per_day.groupBy(session_col, key_col).agg(
        F.sum("_n").alias("event_count"), F.count(F.lit(1)).alias("active_days")
    )


def session_core(
    df: DataFrame,
    value_col: str,
    open_key: str,
    session_col: str = "session_id",
    key_col: str = "event_key",
) -> DataFrame:
    """Largest reported value and number of `open_key` events per session."""
    return (
        df.where(F.col(session_col).isNotNull())
        .groupBy(session_col)
        .agg(F.max(value_col).alias("value_max"), F.count_if(F.col(key_col) == open_key).alias("open_count"))
    )


def key_summary(per_session: DataFrame, session_col: str = "session_id", key_col: str = "event_key") -> DataFrame:
    """Totals, sessions, mean per session and sessions active on two days or more, per key."""
    return per_session.groupBy(key_col).agg(
        F.sum("event_count").alias("total_count"),
        F.count_distinct(session_col).alias("session_count"),
        F.try_divide(F.sum("event_count").cast("double"), F.count("event_count")).alias("avg_count_per_session"),
        F.count_if(F.col("active_days") >= 2).alias("sessions_2plus_days"),
    )


def repeat_split(df: DataFrame, criteria: Mapping[str, str | Column], unit: Column | str | None = None) -> DataFrame:
    """Per criterion, how many rows meet it and how many do not, with the share within the criterion."""
    flags = {n: F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for n, c in criteria.items()}
    cells = [
        F.struct(F.lit(name).alias("criterion"), F.lit(label).alias("group"), F.count_if(flag == met).alias("row_count"))
        for name, flag in flags.items()
        for label, met in (("repeat", True), ("single", False))
    ]
    long = df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
    total = long.groupBy("criterion").agg(F.sum("row_count").alias("_total"))
    return long.where("row_count > 0").join(total, "criterion").select(
        "criterion", "group", "row_count", F.try_divide(F.col("row_count") * 100.0, "_total").alias("ratio_pct")
    )


def key_candidates(df: DataFrame, pattern: str, key_col: str = "event_key") -> DataFrame:
    """How often each key matching the pattern (any case) occurs."""
    return (
        df.where(F.col(key_col).isNotNull())
        .groupBy(key_col)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .where(F.col(key_col).rlike(f"(?i){pattern}"))
    )


def coverage(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct users per source; `frames` maps a name to (frame, id column)."""
    return union_all(
        *[
            df.agg(F.count_distinct(c).alias("unique_user_count")).select(F.lit(name).alias("table"), "unique_user_count")
            for name, (df, c) in frames.items()
        ]
    )


def payer_split(users: DataFrame, payments: DataFrame, user_col: str = "user_id", mean_col: str = "payment_distinct_at") -> DataFrame:
    """Paying and non-paying users with their share; payers carry the mean of `mean_col`."""
    paid = payments.groupBy(user_col).agg(F.max(mean_col).alias("_m"))
    both = users.select(user_col).distinct().join(paid, user_col, "full_outer")
    grouped = both.groupBy(F.when(F.col("_m").isNotNull(), "paid").otherwise("unpaid").alias("group")).agg(
        F.count(F.lit(1)).alias("user_count"), F.avg("_m").alias("mean_per_payer")
    )
    total = grouped.agg(F.sum("user_count").alias("_total"))
    return grouped.withColumn("ratio_pct", F.try_divide(F.col("user_count") * 100.0, total.scalar()))


def active_day_split(df: DataFrame, by: str, at_least: int = 2, session_col: str = "session_id") -> DataFrame:
    """Sessions per key, split by whether they were active on `at_least` days."""
    label = F.when(F.col("active_days") >= at_least, f"{at_least}+ days").otherwise(f"under {at_least} days")
    return df.where(F.col(by).isNotNull()).groupBy(by, label.alias("active_day_group")).agg(
        F.count_distinct(session_col).alias("session_count")
    )


def role_compare(df: DataFrame, roles: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, median and maximum of each measure in each role; columns are named `<role>_<measure>`."""
    long = union_all(
        *[
            melt(
                df.select(F.lit(role).alias("role"), *[F.col(f"{role}_{c}").cast("double").alias(c) for c in cols]),
                ["role"],
                list(cols),
            )
            for role in roles
        ]
    )
    stats = long.groupBy("role", "metric").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    wide = union_all(
        *[df.select(F.lit(role).alias("role"), *[F.col(f"{role}_{c}").alias(c) for c in cols]) for role in roles]
    )
    middle = quantiles(wide, cols, {"median": 0.5}, by=["role"]).withColumnRenamed("column", "metric")
    return stats.join(middle, ["role", "metric"], "left")

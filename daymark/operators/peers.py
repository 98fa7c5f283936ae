"""Peer groups and directed edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions import col_of, safe_div


def group_sizes(users: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Add the number of users sharing each key; `keys` maps key column -> output column, NULL key gives 0.

    Sizes come from an aggregate joined back, not from a window, so a group holding a third of the users is
    counted on the map side instead of being gathered.
    """
    for key, out in keys.items():
        sizes = users.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("user_id").alias(out))
        users = users.join(sizes, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
    return users


def active_peers(
    users: DataFrame, keys: Mapping[str, tuple[str, str]], active: str = "is_active", suffix: str = "d0_7"
) -> DataFrame:
    """Active members of each group other than the user, and their share of the other members.

    `keys` maps key column -> (name, total column); results are `<name>_active_<suffix>` and
    `<name>_active_ratio_<suffix>`.
    """
    out = users
    own = F.coalesce(F.col(active), F.lit(False)).cast("int")
    for key, (name, total) in keys.items():
        n = f"_{name}"
        counts = (
            users.where(F.col(key).isNotNull() & F.col(active)).groupBy(key).agg(F.count_distinct("user_id").alias(n))
        )
        others = F.greatest(F.coalesce(F.col(n), F.lit(0)) - own, F.lit(0))
        rest = F.greatest(F.coalesce(F.col(total), F.lit(0)) - 1, F.lit(0))
        out = (
            out.join(counts, key, "left")
            .withColumn(f"{name}_active_{suffix}", others)
            .withColumn(f"{name}_active_ratio_{suffix}", safe_div(F.col(f"{name}_active_{suffix}"), rest, clip=(0, 1)))
            .drop(n)
        )
    return out


def population(df: DataFrame, rules: Sequence[str | Column], out: str = "in_population") -> DataFrame:
    """Add whether every rule holds; a rule on a missing value does not."""
    hold = F.lit(True)
    for r in rules:
        hold = hold & F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(False))
    return df.withColumn(out, hold)


def funnel(df: DataFrame, conditions: Mapping[str, str | Column], key: str = "user_id") -> DataFrame:
    """Distinct users meeting each condition, one row per step, counted in one pass.

    The rows are first reduced to one per user with a flag per step, so no distinct set is expanded.
    """
    steps = {n: F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for n, c in conditions.items()}
    per_user = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(n) for n, c in steps.items()])
    one = per_user.agg(*[F.count_if(F.col(n)).alias(n) for n in steps])
    return one.unpivot([], list(steps), "population", "user_count")


def edge_degrees(
    edges: DataFrame,
    sender_col: str = "send_user_id",
    receiver_col: str = "receive_user_id",
    accepted: str | Column = "accepted",
    prefix: str = "friend",
) -> DataFrame:
    """Rows, accepted rows and distinct partners per user in both directions.

    Edges are reduced to one row per pair with its counts once; both directions read that.
    """
    pairs = (
        edges.where(F.col(sender_col).isNotNull() & F.col(receiver_col).isNotNull())
        .groupBy(sender_col, receiver_col)
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(col_of(accepted)).alias("_ok"))
    )

    def side(own: str, name: str, partner: str) -> DataFrame:
        return pairs.groupBy(F.col(own).alias("user_id")).agg(
            F.sum("_n").alias(f"{prefix}_{name}_rows"),
            F.sum("_ok").alias(f"{prefix}_{name}_accepted"),
            F.count(F.lit(1)).alias(f"{prefix}_{name}_unique_{partner}"),
        )

    both = side(sender_col, "sent", "receivers").join(side(receiver_col, "received", "senders"), "user_id", "full_outer")
    return both.fillna(0, subset=[c for c in both.columns if c != "user_id"])


def edge_summary(
    edges: DataFrame,
    sender_col: str = "send_user_id",
    receiver_col: str = "receive_user_id",
    accepted: str | Column = "accepted",
) -> DataFrame:
    """Whole-graph counts as (metric, value): rows, senders, receivers, distinct pairs, accepted rows.

    Pairs collapse to one row per sender and, from the same pairs, one per receiver, so no distinct set is expanded and only
    sums reach the last task.
    """
    pairs = edges.groupBy(sender_col, receiver_col).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(col_of(accepted)).alias("_ok")
    )
    per_sender = pairs.groupBy(sender_col).agg(
        F.sum("_n").alias("_n"),
        F.sum("_ok").alias("_ok"),
        F.count_if(F.col(sender_col).isNotNull() & F.col(receiver_col).isNotNull()).alias("_pairs"),
    )
    sent = per_sender.agg(
        F.sum("_n").alias("rows"),
        F.count(sender_col).alias("senders"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("pairs"),
        F.sum("_ok").alias("accepted"),
    )
    received = pairs.groupBy(receiver_col).agg(F.lit(1).alias("_one")).agg(F.count(receiver_col).alias("receivers"))
    return sent.unpivot([], ["rows", "senders", "pairs", "accepted"], "metric", "value").unionByName(
        received.unpivot([], ["receivers"], "metric", "value")
    )

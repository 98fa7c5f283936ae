"""Outcome summaries by bucket, group or cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import MetricSpec, aggregate_column, safe_div
from daymark.operators.ordering import quantiles
from daymark.operators.tables import pivot_fill
from daymark.session import settle


def label_frame(spark: SparkSession, name: str, labels: Sequence[str]) -> DataFrame:
    """A label dimension with its order in `<name>_ord`."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(labels)], f"`{name}` string, `{name}_ord` int")


def summarize(
    df: DataFrame,
    by: Sequence[str],
    M: Sequence[MetricSpec],
    dense_labels: Mapping[str, Sequence[str]] | None = None,
    keep_null_keys: bool = False,
) -> DataFrame:
    """Metrics per group.  NULL groups are left out unless asked for.

    `dense_labels` gives one key's complete list of labels: labels without rows appear with counts 0 and
    means NULL, and `<key>_ord` carries their order.
    """
    by = list(by)
    kept = df
    if not keep_null_keys:
        for key in by:
            kept = kept.where(F.col(key).isNotNull())
    simple = [m for m in M if m.kind != "quantile"]
    out = kept.groupBy(*by).agg(*[aggregate_column(m) for m in simple]) if simple else kept.select(*by).distinct()
    for m in M:
        if m.kind == "quantile":
            part = quantiles(kept.select(*by, m.value().alias("_v")), ["_v"], {m.name: m.q}, by).drop("column")
            out = out.join(part, by, "left") if by else part
    for key, labels in (dense_labels or {}).items():
        zero = {m.name: 0 for m in M if m.kind in ("rows", "count", "sum", "distinct", "nonzero")}
        out = label_frame(df.sparkSession, key, labels).join(out, key, "left").fillna(zero)
    return out


def conditional_means(df: DataFrame, triples: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add `out` = sum / users with a value, for (sum, users, out); 0 where nobody has one."""
    return df.withColumns({out: safe_div(total, users) for total, users, out in triples})


def outcome_metrics(score_cols: Sequence[str] = ()) -> list[MetricSpec]:
    """The standard outcome set over a user mart: rates in percent, means, sums and users with a value."""
    M = [MetricSpec("user_count", "distinct", "user_id")]
    for w in ("d1_28", "d8_28"):
        M.append(MetricSpec(f"retention_{w}_rate", "rate", f"retention_{w}"))
    for w in ("d0_28", "d8_28"):
        M += [
            MetricSpec(f"payment_{w}_rate", "rate", f"paid_flag_{w}"),
            MetricSpec(f"payment_{w}_count_mean", "mean", f"payment_count_{w}"),
            MetricSpec(f"payment_{w}_count_sum", "sum", f"payment_count_{w}"),
            MetricSpec(f"payment_{w}_paid_user_count", "rows", where=f"paid_flag_{w}"),
            MetricSpec(f"payment_{w}_amount_mean", "mean", f"payment_amount_{w}"),
            MetricSpec(f"payment_{w}_amount_sum", "sum", f"payment_amount_{w}"),
            MetricSpec(f"active_days_{w}_mean", "mean", f"active_days_{w}"),
            MetricSpec(f"active_days_{w}_sum", "sum", f"active_days_{w}"),
            MetricSpec(f"active_days_{w}_active_user_count", "nonzero", f"active_days_{w}"),
        ]
    for col, users in (
        ("sent_vote_count_d0_7", "sent_vote_user_count_d0_7"),
        ("received_vote_count_d0_7", "received_vote_user_count_d0_7"),
        ("candidate_exposure_count_d0_7", "candidate_exposed_user_count_d0_7"),
    ):
        M += [
            MetricSpec(f"{col}_mean", "mean", col),
            MetricSpec(f"{col}_sum", "sum", col),
            MetricSpec(users, "nonzero", col),
        ]
    for kind in ("attendance", "point_use", "payment"):
        M.append(MetricSpec(f"{kind}_after_received_vote_rate", "rate", f"{kind}_after_received_vote_yn_d0_28"))
    M += [MetricSpec(f"{c}_mean", "mean", c) for c in score_cols]
    return M


# fixed values: (sum, users, conditional mean) that go with the outcome set
OUTCOME_TRIPLES = [
    ("payment_d0_28_count_sum", "payment_d0_28_paid_user_count", "payment_d0_28_count_paid_user_mean"),
    ("payment_d0_28_amount_sum", "payment_d0_28_paid_user_count", "payment_d0_28_amount_paid_user_mean"),
    ("payment_d8_28_count_sum", "payment_d8_28_paid_user_count", "payment_d8_28_count_paid_user_mean"),
    ("payment_d8_28_amount_sum", "payment_d8_28_paid_user_count", "payment_d8_28_amount_paid_user_mean"),
    ("active_days_d0_28_sum", "active_days_d0_28_active_user_count", "active_days_d0_28_active_user_mean"),
    ("active_days_d8_28_sum", "active_days_d8_28_active_user_count", "active_days_d8_28_active_user_mean"),
    ("sent_vote_count_d0_7_sum", "sent_vote_user_count_d0_7", "sent_vote_count_d0_7_sender_mean"),
    ("received_vote_count_d0_7_sum", "received_vote_user_count_d0_7", "received_vote_count_d0_7_receiver_mean"),
    ("candidate_exposure_count_d0_7_sum", "candidate_exposed_user_count_d0_7",
     "candidate_exposure_count_d0_7_exposed_user_mean"),
]


def outcome_summary(df: DataFrame, by: Sequence[str], score_cols: Sequence[str] = (), dense_labels=None) -> DataFrame:
    """The standard outcome set per group with its conditional means."""
    return conditional_means(summarize(df, by, outcome_metrics(score_cols), dense_labels), OUTCOME_TRIPLES)


def with_share(df: DataFrame, col: str, within: Sequence[str] = (), out: str = "ratio_pct") -> DataFrame:
    """Add the percentage of `col` in the whole table or in its `within` group; 0 for an empty total.

    Totals come from an aggregate, so nothing is gathered however large a group is.
    """
    within = list(within)
    total = df.groupBy(*within).agg(F.sum(col).alias("_total"))
    if within:
        keyed = df.join(total, within, "left")
        return keyed.withColumn(out, safe_div(F.col(col) * 100.0, F.col("_total"))).drop("_total")
    return df.withColumn(out, safe_div(F.col(col) * 100.0, total.scalar()))


def profile(df: DataFrame, by: str, cols: Sequence[str], count_col: str | None = "user_id") -> DataFrame:
    """Mean of every column per segment, with the number of users."""
    head = [F.count_distinct(count_col).alias("user_count")] if count_col else []
    means = [F.try_divide(F.sum(c).cast("double"), F.count(c)).alias(c) for c in cols]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*head, *means)


def top_per_group(df: DataFrame, by: Sequence[str], metric: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """The row with the largest metric in each group, the least label among equals."""
    rest = [c for c in keep if c not in (metric, label)]
    best = F.struct((-F.col(metric).cast("double")).alias("_neg"), label, F.col(metric), *rest)
    picked = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min(best).alias("_best"))
    return picked.select(*by, *[F.col("_best")[c].alias(c) for c in (label, metric, *rest)])


def compare_to_base(
    df: DataFrame, by: str, base: str, metrics: Mapping[str, str], out: str = "interpretation", base_text: str = "base group"
) -> DataFrame:
    """Add `<metric>_vs_base` and a text of the differences; `metrics` maps column -> printf pattern.

    The base group is one row of a summary, read on the driver; the summary is written first, so that what made it runs
    once.
    """
    df = settle(df)
    row = df.where(F.col(by) == base).select(*metrics).first()
    if row is None:
        return df.withColumns({**{f"{m}_vs_base": F.lit(None).cast("double") for m in metrics}, out: F.lit("")})
    diffs = {f"{m}_vs_base": F.col(m).cast("double") - F.lit(None if row[m] is None else float(row[m])) for m in metrics}
    text = F.concat_ws(", ", *[F.format_string(p, F.col(f"{m}_vs_base")) for m, p in metrics.items()])
    return df.withColumns(diffs).withColumn(out, F.when(F.col(by) == base, F.lit(base_text)).otherwise(text))


def describe_rows(
    df: DataFrame, axes: Mapping[str, str], template: str, args: Sequence[str | Column], out: str = "interpretation"
) -> DataFrame:
    """Add the name of the largest axis score (first one among equals) and a sentence.

    `template` is a printf pattern; its arguments are columns, among them `dominant_axis`.
    """
    scores = {name: F.col(c).cast("double") for name, c in axes.items()}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    pick = None
    for name, c in scores.items():
        pick = F.when(c == best, F.lit(name)) if pick is None else pick.when(c == best, F.lit(name))
    return df.withColumn("dominant_axis", pick.otherwise(F.lit("undecided"))).withColumn(
        out, F.format_string(template, *args)
    )


def share_matrix(df: DataFrame, row: str, col: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Shares as a segment x cluster matrix, absent cells 0."""
    return pivot_fill(df, [row], col, F.sum(value), columns)


def segment_clusters(df: DataFrame, segment: str, cluster: str, metrics: Sequence[MetricSpec]) -> DataFrame:
    """Metrics per segment and cluster with the cluster's share of the segment.  Rows without a segment drop out."""
    M = [m for m in metrics if m.name != "user_count"]
    summary = summarize(df, [segment, cluster], [MetricSpec("user_count", "distinct", "user_id"), *M])
    totals = summarize(df, [segment], [MetricSpec("segment_user_count", "distinct", "user_id")])
    return (
        summary.where("user_count > 0")
        .join(totals, segment)
        .withColumn("cluster_share_within_segment_pct", safe_div(F.col("user_count") * 100.0, "segment_user_count"))
    )

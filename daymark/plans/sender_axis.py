"""Sending axis: group table, sensitivity, intensity buckets, leave-one-out, sender clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.functions import MetricSpec
from daymark.operators import cluster as cl
from daymark.operators import quality as ql
from daymark.operators import segments as sg
from daymark.operators.tables import bucketize, exclude_ids
from daymark.plans.three_axis import BUCKETS, feature_spec
from daymark.session import settle

GROUPS = ["보낸 투표 경험 유", "보낸 투표 경험 무"]  # fixed values: sender group labels

# fixed values: largest possible days per window
BOUNDS = {
    "active_days_d0_28": 29, "active_days_d8_28": 21, "payment_active_days_d0_28": 29, "payment_active_days_d8_28": 21,
    "sent_vote_active_days_d0": 1, "sent_vote_active_days_d0_1": 2, "sent_vote_active_days_d0_3": 4,
    "sent_vote_active_days_d0_7": 8, "sent_vote_active_days_d0_14": 15, "sent_vote_active_days_d0_28": 29,
    "session_question_active_days_d0_7": 8,
}
# fixed values
EXTREME_COLUMNS = [
    "payment_count_d0_28", "payment_count_d8_28", "payment_amount_d0_28", "payment_amount_d8_28",
    "sent_vote_count_d0_7", "sent_vote_complete_count_d0_7", "sent_vote_distinct_chosen_users_d0_7",
    "sent_vote_distinct_questions_d0_7", "received_vote_read_count_d0_7", "session_question_start_count_d0_7",
    "session_question_complete_count_d0_7", "session_question_skip_count_d0_7", "active_days_d0_28", "active_days_d8_28",
]
# fixed values
SENDER_FEATURES = [
    "sent_vote_count_d0", "sent_vote_count_d0_3", "sent_vote_count_d0_7", "sent_vote_complete_count_d0_7",
    "sent_vote_active_days_d0_7", "sent_vote_distinct_chosen_users_d0_7", "sent_vote_distinct_questions_d0_7",
    "session_question_start_count_d0_7", "session_question_complete_count_d0_7", "session_question_skip_count_d0_7",
    "session_question_completion_rate_d0_7", "session_question_skip_rate_d0_7",
]
# fixed values
DIFFERENCES = {
    "retention_d1_28_rate": "D1-D28 %+.1f%%p",
    "retention_d8_28_rate": "D8-D28 %+.1f%%p",
    "payment_d0_28_rate": "D0-D28 %+.1f%%p",
    "payment_d8_28_rate": "D8-D28 %+.1f%%p",
    "active_days_d0_28_mean": "D0-D28 %+.2f",
}


def bound_rules() -> list[dict]:
    return [{"column": c, "min": 0, "max": m, "reason": f"{c} outside 0-{m}"} for c, m in BOUNDS.items()]


def group_metrics() -> list[MetricSpec]:
    keep = ("candidate", "received", "point_use")
    M = [m for m in sg.outcome_metrics() if not m.name.startswith(keep) and "after_received" not in m.name]
    early = "sent_vote_count_d0_3"
    return [
        *M,
        MetricSpec(f"{early}_mean", "mean", early),
        MetricSpec(f"{early}_sum", "sum", early),
        MetricSpec("sent_vote_user_count_d0_3", "nonzero", early),
    ]


def group_triples() -> list[tuple[str, str, str]]:
    kept = [t for t in sg.OUTCOME_TRIPLES if not t[0].startswith(("candidate", "received"))]
    return [*kept, ("sent_vote_count_d0_3_sum", "sent_vote_user_count_d0_3", "sent_vote_count_d0_3_sender_mean")]


def group_table(mart: DataFrame) -> DataFrame:
    """Outcomes of senders and non-senders in the home-entry population with differences to the non-senders."""
    home = mart.where("home_entry_population")
    out = sg.summarize(home, ["sender_group"], group_metrics(), {"sender_group": GROUPS})
    return sg.compare_to_base(sg.conditional_means(out, group_triples()), "sender_group", GROUPS[1], DIFFERENCES)


def run(mart: DataFrame, ks: Sequence[int] = range(2, 9), seeds: Sequence[int] = cl.SEEDS) -> dict[str, DataFrame]:
    """Bounds, extremes, group table with sensitivity, intensity table and sender clusters.

    Where fewer than two features vary or there are too few different rows, the cluster tables have no rows and `reason`
    says why; otherwise `reason` is empty.
    """
    mart = settle(mart)
    kept, audit, removed = ql.apply_bounds(mart, bound_rules())
    home = kept.where("home_entry_population")
    here = [c for c in EXTREME_COLUMNS if c in home.columns]
    extremes, candidates = ql.isolated_extremes(home, here, group_col="sender_group")
    reduced = exclude_ids(kept, candidates, "user_id")
    measures = [m for m in group_metrics() if m.name.endswith(("_rate", "_mean")) or m.name == "user_count"]
    col, edges, labels = BUCKETS["sender_intensity_bucket_d0_7"]
    by_intensity = sg.summarize(
        bucketize(home, col, edges, labels, "sent_vote_intensity_bucket_d0_7").drop("sent_vote_intensity_bucket_d0_7_ord"),
        ["sent_vote_intensity_bucket_d0_7"],
        group_metrics(),
        {"sent_vote_intensity_bucket_d0_7": labels},
    )
    out = {
        "bounds_audit": audit,
        "bounds_removed": removed,
        "extremes_audit": extremes,
        "extremes": candidates,
        "groups": group_table(kept),
        "sensitivity": ql.sensitivity(home, reduced.where("home_entry_population"), ["sender_group"], measures),
        "intensity": sg.conditional_means(by_intensity, group_triples()),
    }
    spark = mart.sparkSession
    features = cl.varying_columns(home, [c for c in SENDER_FEATURES if c in home.columns])
    try:
        if len(features) < 2:
            raise cl.TooFewRows(f"too few usable features: {features}")
        scaled, transforms, used = cl.cluster_features(home, feature_spec(features, "skip"))
        scaled = settle(scaled)
        metrics, models = cl.sweep_kmeans(scaled, ks, seeds, min_share=0.0005)
    except cl.TooFewRows as why:
        used = [c for c in SENDER_FEATURES if c in home.columns]
        nobody = home.where("false").withColumns({f"z_{c}": F.lit(0.0) for c in used})
        scaled = VectorAssembler(inputCols=[f"z_{c}" for c in used], outputCol="features").transform(nobody)
        transforms = spark.createDataFrame([], "feature string, transform string, p99 double, used boolean")
        table, model = cl.choose_k_table(spark), cl.Centers([[0.0] * len(used)])
        reason = spark.createDataFrame([(str(why),)], "reason string")
    else:
        best, table = cl.choose_k_by_silhouette(metrics)
        model, reason = models[best], spark.createDataFrame([], "reason string")
    users = cl.assign(model, scaled, "sender_cluster")
    sessions = [c for c in used if c.startswith("session_question_") and "_count_" in c]
    prof = sg.profile(users, "sender_cluster", used)
    for c in ("sent_vote_count_d0_7", *sessions):
        if c not in prof.columns:
            prof = prof.withColumn(c, F.lit(0.0))
    names = cl.unique_labels(cl.sender_labels(prof, "sent_vote_count_d0_7", sessions), "sender_cluster")
    order = ["sent_vote_count_d0_7", *[c for c in ("sent_vote_active_days_d0_7", "sent_vote_distinct_chosen_users_d0_7") if c in prof.columns]]
    mapping = cl.order_clusters(names, [*order, "sender_cluster"])
    labelled = users.join(F.broadcast(mapping.select("sender_cluster", "cluster_label")), "sender_cluster")  # k rows
    outcome = sg.conditional_means(sg.summarize(labelled, ["cluster_label"], group_metrics()), group_triples())
    return out | {"transforms": transforms, "k_metrics": table, "mapping": mapping, "cluster_outcome": outcome, "users": labelled, "reason": reason}

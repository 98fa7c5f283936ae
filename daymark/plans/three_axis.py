"""Sending, receiving and network axes: user mart, clusters, names, outcome tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.functions import MetricSpec, flag_label
from daymark.operators import cluster as cl
from daymark.operators import metrics as mt
from daymark.operators import segments as sg
from daymark.operators.peers import active_peers
from daymark.operators.quality import metric_check
from daymark.operators.tables import bucketize, flag_member, union_all
from daymark.operators.windows import Fact, after_anchor_parts, as_role, fact_metrics, in_window, pick, signup_offset
from daymark.plans import sources as src
from daymark.session import dealt, settle, settle_all

INF = float("inf")

# fixed values: session event keys by family
SESSION_FAMILIES = {
    "start": ["click_question_open", "view_questions_tap", "click_bottom_navigation_questions"],
    "complete": ["complete_question", "click_question_complete", "submit_question", "complete_vote", "click_vote_complete"],
    "skip": ["skip_question"],
}

SENT_WINDOWS = pick("d0", "d0_1", "d0_3", "d0_7", "d0_14", "d0_28")

# fixed values: cluster inputs per axis
AXES = {
    "sender_axis_score": [
        "sent_vote_count_d0_7", "sent_vote_active_days_d0_7", "sent_vote_distinct_chosen_users_d0_7",
        "sent_vote_distinct_questions_d0_7", "sent_vote_complete_rate_d0_7", "session_question_start_count_d0_7",
        "session_question_completion_rate_d0_7",
    ],
    "receiver_axis_score": [
        "received_vote_count_d0_7", "received_vote_days_d0_7", "received_vote_count_d0_3",
        "received_vote_read_count_d0_7", "received_vote_read_rate_d0_7", "unread_received_vote_count_d0_7",
        "early_received_score_d0_7",
    ],
    "network_axis_score": [
        "friend_count", "same_class_active_d0_7", "same_grade_active_d0_7", "candidate_exposure_count_d0_7",
        "candidate_unique_question_count_d0_7", "candidate_to_recv_rate_d0_7", "pending_votes",
    ],
}
# fixed values
PROFILE_ONLY = [
    "same_school_joined_user_count", "same_class_total_users", "same_grade_total_users",
    "same_class_active_ratio_d0_7", "same_grade_active_ratio_d0_7", "candidate_exposure_days_d0_7",
]

# fixed values: intensity and friend buckets (right-closed edges and labels)
BUCKETS = {
    "sender_intensity_bucket_d0_7": (
        "sent_vote_count_d0_7", [-0.1, 0, 3, 10, 50, INF], ["0회", "1-3회", "4-10회", "11-50회", "51회 이상"]),
    "receiver_intensity_bucket_d0_7": (
        "received_vote_count_d0_7", [-0.1, 0, 1, 3, 10, INF], ["0회", "1회", "2-3회", "4-10회", "11회 이상"]),
    "candidate_exposure_bucket_d0_7": (
        "candidate_exposure_count_d0_7", [-0.1, 0, 5, 20, INF], ["노출 없음", "1-5회", "6-20회", "21회 이상"]),
    "friend_count_bucket": (
        "friend_count", [3.999, 10, 30, 70, 150, INF], ["4-10명", "11-30명", "31-70명", "71-150명", "151명 이상"]),
}

# fixed values: words of the cluster names
WORDS = {
    "activity": ("고활동", "저활동"),
    "relation": ("고관계", "저관계"),
    "backlog": ("저적체", "중적체", "고적체"),
    "joint": "·",
    "count": "(n=%,d)",
}
# fixed values
AXIS_NAMES = {
    "발신 행동축": "sender_axis_score_mean",
    "수신 반응축": "receiver_axis_score_mean",
    "관계망 환경축": "network_axis_score_mean",
}


def build_mart(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per user with outcomes, sending, receiving, network, session and exposure metrics."""
    # each fact feeds several metrics: dedup and narrow it once, then read the small copy
    small = settle_all(
        users=src.users_population(frames["users"], frames["groups"], frames["user_properties"]),
        attendance=src.attendance_days(frames["attendance"]),
        pay=src.payments(frames["payment"]).drop("id", "created_at"),
        rec=src.records(frames["question_record"]).drop("id"),
        req=src.requests(frames["friend_request"]),
        pts=src.points(frames["point_history"]),
    )
    users, attendance, pay, rec, req, pts = (small[n] for n in ("users", "attendance", "pay", "rec", "req", "pts"))
    users = dealt(users)  # a row per user: small as a file, not in memory

    # a day is active if any source has a row on it: the facts below share the metric
    active_days = [(pick("d0_7", "d0_28", "d8_28"), [MetricSpec("active_days", "days")])]
    use_days = [(pick("d0_7", "d0_28", "d8_28"), [MetricSpec("active_days", "days", where="delta_point < 0")])]
    near, sources = pick("d0_7", "d0_28"), activity_sources(rec, req, pts, users)
    items = {"distinct_chosen_users": "chosen_user_id", "distinct_questions": "question_id"}
    got_specs = mt.receiver_specs(prefix="received_vote")
    facts = [
        Fact(attendance, [(pick("d1_28", "d8_28"), [MetricSpec("attendance_days", "days")])]),
        Fact(pay, [(pick("d0_28", "d8_28"), mt.payment_specs(mt.payment_amount(pay)[0]))]),
        Fact(rec, [(SENT_WINDOWS, mt.sender_specs(F.col("completed"), items, "sent_vote")), *active_days]),
        Fact(
            as_role(rec, "chosen_user_id"),
            [(pick("d0_3", "d0_7", "d0_28"), got_specs), (pick("d0_7"), [MetricSpec("_first_received", "min", "day")])],
        ),
        Fact(as_role(req, "send_user_id"), [(near, mt.edge_specs("sent")), *active_days]),
        Fact(as_role(req, "receive_user_id"), [(near, mt.edge_specs("received"))]),
        Fact(pts, [(near, mt.delta_specs()), *use_days]),
        *[Fact(sources[n], active_days, date_col="activity_date") for n in ("read", "friend_accept")],
    ]
    once = dealt(settle(fact_metrics(facts, users)))
    sent = mt.complete_rates(once, ["d0_7"], "sent_vote").withColumns(
        {f"retention_{w}": F.col(f"attendance_days_{w}") >= 1 for w in ("d1_28", "d8_28")}
    )
    first = once.where("_first_received_d0_7 is not null").select("user_id", F.col("_first_received_d0_7").alias("first_date"))
    base = sent.join(users.select("user_id", "signup_date"), "user_id").withColumn(
        "first_offset", F.datediff("_first_received_d0_7", "signup_date")
    )
    got = mt.receiver_rates(base.drop("signup_date"), prefix="received_vote")
    got = got.withColumnsRenamed(
        {
            "first_offset": "first_received_vote_day",
            "_first_received_d0_7": "first_received_vote_date",
            "first_day_filled": "first_received_vote_day_filled",
            "early_received_vote_score_d0_7": "early_received_score_d0_7",
        }
    )
    active = once.select("user_id", "active_days_d0_7")
    early = active.where("active_days_d0_7 > 0").select("user_id")
    peers = active_peers(
        flag_member(users, early, "user_id", "is_active_d0_7"),
        {"class_key": ("same_class", "same_class_total_users"), "grade_key": ("same_grade", "same_grade_total_users")},
        "is_active_d0_7",
    ).select(
        "user_id", "same_class_active_d0_7", "same_grade_active_d0_7",
        "same_class_active_ratio_d0_7", "same_grade_active_ratio_d0_7",
    )
    parts = [got, peers]
    if {"session_map", "session_events"} <= set(frames):
        ids = dealt(frames["session_map"].select("session_id", src.norm_id("user_id").alias("user_id")))
        log = src.session_log(frames["session_events"])
        parts.append(mt.session_behaviour(log, ids, users, SESSION_FAMILIES, pick("d0_7"), prefix="session_question"))
    if "candidate_exposure" in frames:
        pieces = frames.get("question_piece")
        if pieces is not None:
            pieces = dealt(
                pieces.select(
                    F.col("id").cast("string").alias("question_piece_id"), F.col("question_id").cast("string").alias("question_id")
                )
            )
        shown = mt.exposure_metrics(
            src.exposures(frames["candidate_exposure"]),
            users,
            pieces,
            pick("d0_7"),
            dealt(got),
            item_col="question_piece_id",
            prefix="candidate_exposure",
            received_col="received_vote_count",
            rate="candidate_to_recv_rate",
        )
        parts.append(
            shown.withColumnRenamed("candidate_exposure_unique_questions_d0_7", "candidate_unique_question_count_d0_7")
        )
    parts.append(reactions(first, users, attendance, pts, pay))
    wanted = [c for cols in AXES.values() for c in cols] + PROFILE_ONLY
    mart = mt.user_mart(users.drop("grade_key", "class_key"), *[dealt(p) for p in parts], defaults={c: 0 for c in wanted})
    return mart.withColumns(
        {
            "sender_group": flag_label(F.col("sent_vote_count_d0_7") > 0, "보낸 투표 경험 유", "보낸 투표 경험 무"),
            "receiver_group": flag_label(F.col("received_vote_count_d0_7") > 0, "받은 투표 경험 유", "받은 투표 경험 무"),
        }
    )


def activity_sources(rec: DataFrame, req: DataFrame, pts: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Days on which a user sent, read, asked or accepted a friend, or used points.

    A read counts when the record was created in days 0-28, on the day it was read.
    """
    read = rec.where("read_flag and chosen_user_id is not null").select(
        F.col("chosen_user_id").alias("user_id"), "day", F.col("read_day").alias("activity_date")
    )
    read = signup_offset(read.distinct(), users).where(in_window("day_offset", "d0_28"))
    return {
        "sent_vote": rec.select("user_id", F.col("day").alias("activity_date")),
        "read": read.select("user_id", "activity_date"),
        "friend_sent": req.select(F.col("send_user_id").alias("user_id"), F.col("day").alias("activity_date")),
        "friend_accept": req.where("accepted").select(
            F.col("receive_user_id").alias("user_id"), F.col("updated_day").alias("activity_date")
        ),
        "point_use": pts.where("delta_point < 0").select("user_id", F.col("day").alias("activity_date")),
    }


def reactions(first: DataFrame, users: DataFrame, attendance: DataFrame, pts: DataFrame, pay: DataFrame) -> DataFrame:
    """Attendance days, point-use days and payments on or after the first receipt."""
    tagged = union_all(
        *[
            f.select("user_id", "day", F.lit(name).alias("_source"))
            for name, f in (("attendance", attendance), ("use", pts.where("delta_point < 0")), ("payment", pay))
        ]
    )
    out = after_anchor_parts(
        dealt(tagged, "merge"),  # a user has many days
        first,
        users,
        "d0_28",
        {
            "attendance_days_after_received_vote": ("_source = 'attendance'", True),
            "point_use_after_received_vote_count": ("_source = 'use'", True),
            "payment_after_received_vote_count": ("_source = 'payment'", False),
        },
    )
    return out.withColumnsRenamed(
        {
            "attendance_days_after_received_vote_yn_d0_28": "attendance_after_received_vote_yn_d0_28",
            "point_use_after_received_vote_count_yn_d0_28": "point_use_after_received_vote_yn_d0_28",
            "payment_after_received_vote_count_yn_d0_28": "payment_after_received_vote_yn_d0_28",
        }
    )


def feature_spec(features: Sequence[str], on_zero_cap: str = "clip") -> cl.FeatureSpec:
    """Transforms by name: rates and ratios are clipped, the early score is bounded, the rest are counts."""
    rates = [c for c in features if "_rate_" in c or "_ratio_" in c]
    timing = {c: 8 for c in features if c == "early_received_score_d0_7"}
    counts = [c for c in features if c not in rates and c not in timing]
    return cl.FeatureSpec(counts, rates, timing, on_zero_cap=on_zero_cap)


def add_buckets(df: DataFrame) -> DataFrame:
    for out, (col, edges, labels) in BUCKETS.items():
        df = bucketize(df, F.coalesce(F.col(col).cast("double"), F.lit(0.0)), edges, labels, out)
    return df


def solution(base: DataFrame, model, features: Sequence[str]) -> dict[str, DataFrame]:
    """Everything that follows from one clustering: users, mapping, profiles, outcomes, segment tables."""
    scored = cl.axis_scores(cl.assign(model, base), AXES)
    means = [
        *AXES, "sent_vote_count_d0_7", "received_vote_count_d0_7", "friend_count", "same_class_active_d0_7",
        "same_grade_active_d0_7", "candidate_exposure_count_d0_7", "pending_votes",
    ]
    named = cl.rule_labels(
        sg.profile(scored, "cluster", means),
        ["sender_axis_score", "receiver_axis_score"],
        ["friend_count", "same_class_active_d0_7", "same_grade_active_d0_7"],
        "pending_votes",
        words=WORDS,
    )
    mapping = cl.order_clusters(
        cl.unique_labels(named, "cluster"),
        ["network_axis_score", "sender_axis_score", "receiver_axis_score", "cluster"],
    )
    names = F.broadcast(mapping.select("cluster", "cluster_label", "cluster_order"))  # one row per cluster
    users = add_buckets(scored.join(names, "cluster"))
    outcome = sg.with_share(sg.outcome_summary(users, ["cluster_label"], list(AXES)), "user_count", out="cluster_share_pct")
    raw = sg.profile(users, "cluster_label", [*features, *PROFILE_ONLY])
    segments = {
        bucket: sg.conditional_means(
            sg.segment_clusters(users, bucket, "cluster_label", sg.outcome_metrics(list(AXES))), sg.OUTCOME_TRIPLES
        )
        for bucket in BUCKETS
    }
    story = sg.describe_rows(
        outcome,
        AXIS_NAMES,
        "%s: %.2f%% (%,d), %s; D1-D28 %.2f%%, D0-D28 %.2f%%, %.2f",
        [
            "cluster_label", "cluster_share_pct", "user_count", "dominant_axis", "retention_d1_28_rate",
            "payment_d0_28_rate", "active_days_d0_28_mean",
        ],
    )
    tops = {
        b: sg.top_per_group(
            t, [b], "cluster_share_within_segment_pct", "cluster_label",
            ["user_count", "retention_d1_28_rate", "payment_d0_28_rate", "active_days_d0_28_mean"],
        )
        for b, t in segments.items()
    }
    return {
        "users": users,
        "mapping": mapping,
        "profile_standardized": sg.profile(
            users, "cluster_label", [f"z_{c}" for c in features if f"z_{c}" in users.columns], None
        ),
        "profile_raw": raw,
        "outcome": outcome,
        "interpretation": story,
        **{f"segments_{b}": t for b, t in segments.items()},
        **{f"top_{b}": t for b, t in tops.items()},
    }


def run(
    mart: DataFrame,
    ks: Sequence[int] = range(2, 9),
    seeds: Sequence[int] = cl.SEEDS,
    manual_k: int | None = None,
    compare_ks: Sequence[int] = (4,),
    min_share: float = 0.01,
) -> dict[str, DataFrame]:
    """Cluster the home-entry population and tabulate.  Tables of a compared k are prefixed `k<k>_`.

    Where fewer than four features vary, or there are too few different rows, no clustering is possible: the tables have their
    columns and no rows, and `reason` says why.  Otherwise `reason` is empty.
    """
    configured = [c for cols in AXES.values() for c in cols]
    base = settle(mart.where("home_entry_population"))
    usable = cl.varying_columns(base, configured)
    if len(usable) < 4:
        return empty(base, usable or configured, f"too few usable features: {usable}")
    scaled, transforms, kept = cl.cluster_features(base, feature_spec(usable))
    scaled = settle(scaled)
    try:
        metrics, models = cl.sweep_kmeans(scaled, ks, seeds, min_share=min_share)
    except cl.TooFewRows as why:
        return empty(base, kept, str(why))
    best, table = cl.choose_k(cl.elbow(metrics), manual=manual_k)
    out = {"transforms": transforms, "k_metrics": table, **solution(scaled, models[best], kept)}
    for k in compare_ks:
        if k != best and k in models:
            out |= {f"k{k}_{n}": t for n, t in solution(scaled, models[k], kept).items()}
    plot, _shares = cl.project_pca(scaled, 2)  # every user; who draws it may sample
    out["pca"] = plot.select("user_id", "pc1", "pc2")
    out["reason"] = mart.sparkSession.createDataFrame([], "reason string")
    return out


def empty(base: DataFrame, features: Sequence[str], why: str) -> dict[str, DataFrame]:
    """The tables of `run` without rows, and the reason."""
    spark = base.sparkSession
    nobody = base.where("false").withColumns({f"z_{c}": F.lit(0.0) for c in features})
    nobody = VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features").transform(nobody)
    metrics = cl.choose_k_table(spark)
    return {
        "transforms": spark.createDataFrame([], "feature string, transform string, p99 double, used boolean"),
        "k_metrics": metrics,
        **solution(nobody, cl.Centers([[0.0] * len(features)]), features),
        "pca": nobody.select("user_id", F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2")),
        "reason": spark.createDataFrame([(why,)], "reason string"),
    }


def window_rates(mart: DataFrame, windows: Sequence[str] = tuple(SENT_WINDOWS), prefix: str = "sent_vote") -> DataFrame:
    """Share of users with experience in each window."""
    return metric_check(mart, [MetricSpec(w, "rate", f"{prefix}_experience_{w}") for w in windows])

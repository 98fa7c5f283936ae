"""Outcome models on days 0-3: checks, basic grid, extra grid, best runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from daymark.operators import predict as pd
from daymark.operators import quality as ql
from daymark.session import settle

# fixed values: features per axis
ENV = ["friends_d3", "class_users_d0_3", "grade_users_d0_3", "class_active_users_d0_3", "grade_active_users_d0_3"]
RECEIVE = [
    "received_vote_yn_d0_3", "received_vote_count_d0_3", "received_vote_days_d0_3", "first_received_vote_day_d0_3",
    "point_use_after_received_vote_yn_d0_3", "point_use_after_received_vote_count_d0_3",
]
SEND = [
    "sent_vote_experience_d0_3", "sent_vote_count_d0_3", "sent_vote_complete_count_d0_3", "sent_vote_active_days_d0_3",
    "sent_vote_distinct_chosen_users_d0_3", "sent_vote_distinct_questions_d0_3", "sent_vote_complete_rate_d0_3",
]
BINARY = [
    "received_vote_yn_d0_3", "point_use_after_received_vote_yn_d0_3", "sent_vote_experience_d0_3", "returned_d4_28",
    "paid_d4_28",
]
TARGETS = ["returned_d4_28", "paid_d4_28", "payment_count_d4_28", "active_days_d4_28", "bought_hearts_d4_28"]
DERIVED = [
    "relation_experience_d0_3", "churn_d4_plus", "high_active_d4_plus", "repeat_paid_d4_plus", "high_value_paid_d4_plus",
]

# (check, severity, violation): inferred from a published list of 62 checks, no code was available
RELATIONS = [
    ("class_active_users > class_users", "error", "class_active_users_d0_3 > class_users_d0_3"),
    ("grade_active_users > grade_users", "error", "grade_active_users_d0_3 > grade_users_d0_3"),
    ("class_users > grade_users", "error", "class_users_d0_3 > grade_users_d0_3"),
    ("received yn=0, count>0", "error", "received_vote_yn_d0_3 = 0 and received_vote_count_d0_3 > 0"),
    ("received yn=1, count=0", "error", "received_vote_yn_d0_3 = 1 and received_vote_count_d0_3 = 0"),
    ("received days > count", "error", "received_vote_days_d0_3 > received_vote_count_d0_3"),
    ("received days beyond window", "error", "received_vote_days_d0_3 > 4"),
    ("first received day outside 0-3", "error", "received_vote_yn_d0_3 = 1 and not first_received_vote_day_d0_3 between 0 and 3"),
    ("not received but first day > 0", "error", "received_vote_yn_d0_3 = 0 and first_received_vote_day_d0_3 > 0"),
    ("point use yn=0, count>0", "error", "point_use_after_received_vote_yn_d0_3 = 0 and point_use_after_received_vote_count_d0_3 > 0"),
    ("point use yn=1, count=0", "error", "point_use_after_received_vote_yn_d0_3 = 1 and point_use_after_received_vote_count_d0_3 = 0"),
    ("point use without receipt", "error", "point_use_after_received_vote_count_d0_3 > 0 and received_vote_count_d0_3 = 0"),
    ("sent experience=0, count>0", "error", "not cast(sent_vote_experience_d0_3 as boolean) and sent_vote_count_d0_3 > 0"),
    ("sent experience=1, count=0", "error", "cast(sent_vote_experience_d0_3 as boolean) and sent_vote_count_d0_3 = 0"),
    ("sent complete > count", "error", "sent_vote_complete_count_d0_3 > sent_vote_count_d0_3"),
    ("sent days > count", "error", "sent_vote_active_days_d0_3 > sent_vote_count_d0_3"),
    ("sent days beyond window", "error", "sent_vote_active_days_d0_3 > 4"),
    ("distinct chosen users > count", "error", "sent_vote_distinct_chosen_users_d0_3 > sent_vote_count_d0_3"),
    ("distinct questions > count", "error", "sent_vote_distinct_questions_d0_3 > sent_vote_count_d0_3"),
    ("complete rate outside 0-1", "error", "not sent_vote_complete_rate_d0_3 between 0 and 1"),
    ("complete rate differs from counts", "warning",
     "abs(sent_vote_complete_rate_d0_3 - coalesce(try_divide(sent_vote_complete_count_d0_3, sent_vote_count_d0_3), 0)) > 1e-6"),
    ("paid=0, payments>0", "error", "paid_d4_28 = 0 and payment_count_d4_28 > 0"),
    ("paid=1, payments=0", "error", "paid_d4_28 = 1 and payment_count_d4_28 = 0"),
    ("payments=0, hearts>0", "error", "payment_count_d4_28 = 0 and bought_hearts_d4_28 > 0"),
    ("payments>0, hearts=0", "warning", "payment_count_d4_28 > 0 and bought_hearts_d4_28 = 0"),
    ("active days outside 0-25", "error", "not active_days_d4_28 between 0 and 25"),
    ("returned=0, active days>0", "review", "returned_d4_28 = 0 and active_days_d4_28 > 0"),
]


def checks(columns: Sequence[str]) -> list[dict]:
    """Relation, sign and binary-range checks for the columns that are present."""
    have = set(columns)
    known = {*ENV, *RECEIVE, *SEND, *TARGETS, *DERIVED}
    out = [
        {"check": n, "severity": s, "condition": c}
        for n, s, c in RELATIONS
        if known & set(re.findall(r"\w+", c)) <= have
    ]
    for c in sorted(known & have):
        out.append({"check": f"{c}: negative", "severity": "error", "condition": f"cast(`{c}` as double) < 0"})
    for c in BINARY:
        if c in have:
            rule = f"cast(`{c}` as double) not in (0, 1)"
            out.append({"check": f"{c}: not binary", "severity": "error", "condition": rule})
    return out


def consistency(mart: DataFrame) -> DataFrame:
    return ql.consistency(mart, checks(mart.columns), "user_id")


def basic_grid(mart: DataFrame, **options) -> pd.ModelResult:
    """All users and users with relation experience x environment and all features x every target."""
    chosen, _audit, _window = ql.resolve_targets(mart)
    df, names = pd.derive_targets(mart, chosen)
    populations = {"all": None, "relation": f"{names['relation_experience']} = 1"}
    return pd.model_grid(df, populations, {"env": ENV, "env+receive+send": ENV + RECEIVE + SEND}, chosen, **options)


def extra_grid(mart: DataFrame, **options) -> pd.ModelResult:
    """Relation experience, churn and high activity, payment by feature family, and value among payers."""
    chosen, _audit, _window = ql.resolve_targets(mart)
    df, names = pd.derive_targets(mart, chosen)
    df = settle(df)
    relation = {"relation": f"{names['relation_experience']} = 1"}
    payers = {"payers": f"{chosen['paid']} = 1"}
    families = {"1_env": ENV, "2_env_send": ENV + SEND, "3_env_receive": ENV + RECEIVE, "4_all": ENV + RECEIVE + SEND}
    out = pd.model_grid(df, {"all": None}, {"env": ENV}, {"relation_experience": names["relation_experience"]}, **options)
    for target in ("churn", "high_active"):
        out = out + pd.model_grid(df, relation, {"env": ENV, "all": ENV + RECEIVE + SEND}, {target: names[target]}, **options)
    out = out + pd.model_grid(df, {"all": None}, {f"A{k}": v for k, v in families.items()}, {"paid": chosen["paid"]}, **options)
    for target in ("repeat_paid", "high_value_paid"):
        if target in names:
            sets = {f"B{k}": v for k, v in families.items()}
            out = out + pd.model_grid(df, payers, sets, {target: names[target]}, **options)
    return out

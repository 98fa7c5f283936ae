"""Per-user metrics built on windowed aggregates: retention, payments, roles, edges, points, sessions, exposure."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import MetricSpec, col_of, digits, money, safe_div
from daymark.functions.daymask import DAYS, day_mask, days_in, first_day, last_day, longest_run, union_mask
from daymark.operators.peers import active_peers, group_sizes
from daymark.operators.tables import fill_defaults, union_all
from daymark.operators.windows import (
    WINDOWS,
    Windows,
    _span,
    after_anchor,
    as_role,
    assemble,
    distinct_in_windows,
    lookup_or_self,
    pick,
    resolve_identity,
    window_metrics,
)
from daymark.session import settle
from daymark.sources.io import AMOUNT_CANDIDATES, resolve_column


def retention(attendance: DataFrame, users: DataFrame, W: Windows, date_col: str = "day") -> DataFrame:
    """Distinct attendance days per window and whether there was one."""
    out = window_metrics(attendance, users, W, [MetricSpec("attendance_days", "days")], date_col=date_col)
    return out.withColumns({f"retention_{w}": F.col(f"attendance_days_{w}") >= 1 for w in W})


def longest_streak(df: DataFrame, user_col: str = "user_id", day_col: str = "day") -> DataFrame:
    """Longest run of consecutive days per user.

    Repeated days are removed before anything is ordered, so a user brings at most one row per calendar day.
    """
    days = df.select(user_col, day_col).dropna().distinct()
    place = F.row_number().over(Window.partitionBy(user_col).orderBy(day_col))
    islands = days.withColumn("_island", F.date_sub(day_col, place)).groupBy(user_col, "_island").count()
    return islands.groupBy(user_col).agg(F.max("count").alias("longest_streak"))


def attendance_summary(attendance: DataFrame, user_col: str = "user_id", day_col: str = "day") -> DataFrame:
    """Attendance days, longest streak and whether the user came on two days or more."""
    days = attendance.select(user_col, day_col).dropna().distinct()
    place = F.row_number().over(Window.partitionBy(user_col).orderBy(day_col))
    islands = days.withColumn("_island", F.date_sub(day_col, place)).groupBy(user_col, "_island").count()
    return islands.groupBy(user_col).agg(
        F.sum("count").alias("attendance_days"),
        F.max("count").alias("longest_streak"),
        (F.sum("count") >= 2).alias("revisit_flag"),
    )


def payment_amount(pay: DataFrame, product_col: str | None = "productId") -> tuple[Column, str]:
    """Amount expression and its source: a known amount column, else the digits of the product code."""
    found = resolve_column(pay, AMOUNT_CANDIDATES)
    if found is not None:
        numeric = dict(pay.dtypes)[found] != "string"
        return F.coalesce(F.col(found) if numeric else money(found), F.lit(0)), found
    return F.coalesce(digits(product_col), F.lit(0.0)), f"{product_col}_digits"


def payment_metrics(
    pay: DataFrame,
    users: DataFrame,
    W: Windows,
    amount_col: str | Column | None = None,
    date_col: str = "day",
) -> DataFrame:
    """Payments, payment days, amount and paid flag per window."""
    amount = payment_amount(pay)[0] if amount_col is None else col_of(amount_col)
    return window_metrics(pay, users, W, payment_specs(amount), date_col=date_col)


def payment_specs(amount: Column) -> list[MetricSpec]:
    return [
        MetricSpec("payment_count", "rows"),
        MetricSpec("payment_active_days", "days"),
        MetricSpec("payment_amount", "sum", amount),
        MetricSpec("paid_flag", "flag"),
    ]


def sender_metrics(
    fact: DataFrame,
    users: DataFrame,
    W: Windows,
    done: str | Column,
    distinct: Mapping[str, str],
    prefix: str = "sent",
    user_col: str = "user_id",
    date_col: str = "day",
) -> DataFrame:
    """Sent records, completions, active days, distinct partners / items, experience and completion rate."""
    out = window_metrics(fact, users, W, sender_specs(done, distinct, prefix), user_col, date_col)
    return complete_rates(out, W, prefix)


def sender_specs(done: str | Column, distinct: Mapping[str, str], prefix: str = "sent") -> list[MetricSpec]:
    return [
        MetricSpec(f"{prefix}_count", "rows"),
        MetricSpec(f"{prefix}_complete_count", "rows", where=done),
        MetricSpec(f"{prefix}_active_days", "days"),
        MetricSpec(f"{prefix}_experience", "flag"),
        *[MetricSpec(f"{prefix}_{name}", "distinct", c) for name, c in distinct.items()],
    ]


def complete_rates(df: DataFrame, windows: Iterable[str], prefix: str = "sent") -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}_complete_rate_{w}": safe_div(
                f"{prefix}_complete_count_{w}", f"{prefix}_count_{w}", clip=(0, 1)
            )
            for w in windows
        }
    )


def receiver_metrics(
    fact: DataFrame,
    users: DataFrame,
    W: Windows,
    date_col: str = "day",
    receiver_col: str = "chosen_user_id",
    read: str | Column = "read_flag",
    opened: str = "opened_times",
    prefix: str = "received",
) -> DataFrame:
    """Received records, days, reads and opens.  `date_col` chooses the creation day or the read day."""
    return window_metrics(as_role(fact, receiver_col), users, W, receiver_specs(read, opened, prefix), date_col=date_col)


def receiver_specs(read: str | Column = "read_flag", opened: str = "opened_times", prefix: str = "received") -> list[MetricSpec]:
    return [
        MetricSpec(f"{prefix}_count", "rows"),
        MetricSpec(f"{prefix}_days", "days"),
        MetricSpec(f"{prefix}_read_count", "rows", where=col_of(read)),
        MetricSpec(f"{prefix}_opened_times", "sum", opened),
    ]


def receiver_rates(df: DataFrame, window: str = "d0_7", prefix: str = "received", last_day: int = 7) -> DataFrame:
    """Read rate, unread backlog, filled first day and early score (0 without a receipt).

    `df` holds the receiver metrics and `first_offset`, the offset of the first receipt in the window.
    """
    got = F.col(f"{prefix}_count_{window}") > 0
    filled = F.when(got, F.col("first_offset")).otherwise(F.lit(last_day + 1))
    return df.withColumns(
        {
            f"{prefix}_yn_{window}": got,
            f"{prefix}_read_rate_{window}": safe_div(
                f"{prefix}_read_count_{window}", f"{prefix}_count_{window}", clip=(0, 1)
            ),
            f"unread_{prefix}_count_{window}": F.greatest(
                F.col(f"{prefix}_count_{window}") - F.col(f"{prefix}_read_count_{window}"), F.lit(0)
            ),
            "first_day_filled": filled,
            f"early_{prefix}_score_{window}": F.when(got, F.lit(last_day + 1) - filled).otherwise(F.lit(0)),
        }
    )


def edge_window_metrics(
    edges: DataFrame,
    users: DataFrame,
    W: Windows,
    sender_col: str = "send_user_id",
    receiver_col: str = "receive_user_id",
    accepted: str | Column = "accepted",
    date_col: str = "day",
    prefix: str = "friend",
) -> DataFrame:
    """Requests sent and received per window with how many were accepted."""

    def side(role_col: str, name: str) -> DataFrame:
        return window_metrics(as_role(edges, role_col), users, W, edge_specs(name, accepted, prefix), date_col=date_col)

    return side(sender_col, "sent").join(side(receiver_col, "received"), "user_id")


def edge_specs(side: str, accepted: str | Column = "accepted", prefix: str = "friend") -> list[MetricSpec]:
    return [
        MetricSpec(f"{prefix}_{side}_count", "rows"),
        MetricSpec(f"{prefix}_{side}_accepted_count", "rows", where=col_of(accepted)),
    ]


def delta_metrics(
    points: DataFrame,
    users: DataFrame,
    W: Windows,
    delta_col: str = "delta_point",
    date_col: str = "day",
    prefix: str = "point",
) -> DataFrame:
    """Balance events, uses (negative deltas) and the sum of deltas per window."""
    return window_metrics(
        points.withColumn(delta_col, F.coalesce(F.col(delta_col), F.lit(0))),
        users,
        W,
        delta_specs(delta_col, prefix),
        date_col=date_col,
    )


def delta_specs(delta_col: str = "delta_point", prefix: str = "point") -> list[MetricSpec]:
    return [
        MetricSpec(f"{prefix}_event_count", "rows"),
        MetricSpec(f"{prefix}_use_count", "rows", where=F.coalesce(F.col(delta_col), F.lit(0)) < 0),
        MetricSpec(f"{prefix}_delta_sum", "sum", F.coalesce(F.col(delta_col), F.lit(0))),
    ]


def activity_days(*frames: DataFrame, user_col: str = "user_id", day_col: str = "activity_date") -> DataFrame:
    """Distinct (user, day) over several activity sources."""
    return union_all(*[f.select(user_col, day_col) for f in frames]).dropna().distinct()


def active_day_counts(
    days: DataFrame, users: DataFrame, W: Windows, name: str = "active_days", date_col: str = "activity_date"
) -> DataFrame:
    """Active days per window."""
    return window_metrics(days, users, W, [MetricSpec(name, "days")], date_col=date_col)


def leave_one_out(
    frames: Mapping[str, DataFrame], users: DataFrame, drop: str, W: Windows, date_col: str = "activity_date"
) -> DataFrame:
    """Active days with and without one source, and the gap.

    Each source is tagged, so both counts come from one pass over the union.
    """
    tagged = union_all(
        *[f.select("user_id", date_col).withColumn("_kept", F.lit(int(name != drop))) for name, f in frames.items()]
    )
    out = window_metrics(
        tagged,
        users,
        W,
        [MetricSpec("active_days", "days"), MetricSpec(f"active_days_excl_{drop}", "days", where="_kept = 1")],
        date_col=date_col,
    )
    return out.withColumns(
        {f"{drop}_gap_{w}": F.col(f"active_days_{w}") - F.col(f"active_days_excl_{drop}_{w}") for w in W}
    )


def source_masks(
    frames: Mapping[str, DataFrame], users: DataFrame, user_col: str = "user_id", date_col: str = "activity_date"
) -> DataFrame:
    """One row per user of `users` with the day mask of every source (`<source>_mask`, days 0 to 62 after signup).

    Rows collapse, with map-side combining, to one long per user, source and 63 calendar days before they meet the signup
    day; a user with a third of all events brings as many rows to the join as any other.  One pass serves all sources.
    """
    tagged = union_all(
        *[f.select(F.col(user_col).alias("user_id"), F.unix_date(F.col(date_col).cast("date")).alias("_d"), F.lit(n).alias("_source"))
          for n, f in frames.items()]
    ).where("user_id is not null and _d is not null")
    block = F.floor(F.col("_d") / DAYS).cast("int")
    blocks = tagged.groupBy("user_id", "_source", block.alias("_block")).agg(day_mask(F.pmod("_d", F.lit(DAYS))).alias("_bits"))
    base = users.select("user_id", F.unix_date("signup_date").alias("_signup"))
    # the calendar block starts `_by` days after signup: shift its bits into place, what falls outside is gone
    placed = base.join(blocks, "user_id", "left").withColumn("_by", F.col("_block") * DAYS - F.col("_signup"))
    moved = F.expr(
        f"case when _by between 0 and {DAYS - 1} then shiftleft(_bits, _by) & {(1 << DAYS) - 1}L "
        f"when _by between {1 - DAYS} and -1 then shiftrightunsigned(_bits, -_by) else 0L end"
    )
    return placed.groupBy("user_id").agg(
        *[F.coalesce(F.bit_or(F.when(F.col("_source") == n, moved)), F.lit(0).cast("long")).alias(f"{n}_mask") for n in frames]
    )


def leave_each_out(
    frames: Mapping[str, DataFrame], users: DataFrame, W: Windows, user_col: str = "user_id", date_col: str = "activity_date"
) -> DataFrame:
    """Active days with all sources, without each source in turn, and the gaps; first and last active day and longest
    streak within days 0 to 62.  One call and one pass for every source.
    """
    masks = source_masks(frames, users, user_col, date_col)
    every = union_mask(*[f"{n}_mask" for n in frames])
    cells = {}
    for w, (a, b) in W.items():
        cells[f"active_days_{w}"] = days_in(every, a, b)
        for n in frames:
            rest = union_mask(*[f"{o}_mask" for o in frames if o != n])
            cells[f"active_days_excl_{n}_{w}"] = days_in(rest, a, b)
            cells[f"{n}_gap_{w}"] = days_in(every, a, b) - days_in(rest, a, b)
    return masks.select(
        "user_id",
        *[c.alias(n) for n, c in cells.items()],
        first_day(every).alias("first_active_day"),
        last_day(every).alias("last_active_day"),
        longest_run(every).alias("longest_active_run"),
    )


def session_behaviour(
    events: DataFrame,
    ids: DataFrame,
    users: DataFrame,
    families: Mapping[str, Sequence[str]],
    W: Windows,
    session_col: str = "session_id",
    key_col: str = "event_key",
    date_col: str = "day",
    prefix: str = "question",
    clip: bool = True,
) -> DataFrame:
    """Start / complete / skip counts, active days and completion and skip rates of keyed session events.

    Events are counted per session and day before sessions are matched to users.  `families` has the keys
    start, complete and skip; rates are clipped to 0-1 unless `clip` is false.
    """
    wanted = sorted({k for keys in families.values() for k in keys})
    per_day = (
        events.where(F.col(key_col).isin(*wanted) & F.col(date_col).isNotNull() & F.col(session_col).isNotNull())
        .groupBy(session_col, date_col)
        .agg(*[F.count_if(F.col(key_col).isin(*keys)).alias(name) for name, keys in families.items()])
    )
    out = window_metrics(
        resolve_identity(per_day, ids, session_col),
        users,
        W,
        [
            *[MetricSpec(f"{prefix}_{name}_count", "sum", name) for name in families],
            MetricSpec(f"{prefix}_active_days", "days"),
        ],
        date_col=date_col,
    )
    bounds = (0, 1) if clip else None
    rates = {}
    for w in W:
        start = f"{prefix}_start_count_{w}"
        rates[f"{prefix}_completion_rate_{w}"] = safe_div(f"{prefix}_complete_count_{w}", start, clip=bounds)
        rates[f"{prefix}_skip_rate_{w}"] = safe_div(f"{prefix}_skip_count_{w}", start, clip=bounds)
    return out.withColumns(rates)


def exposure_metrics(
    exposure: DataFrame,
    users: DataFrame,
    lookup: DataFrame | None,
    W: Windows,
    received: DataFrame | None = None,
    item_col: str = "item_id",
    lookup_value: str = "question_id",
    date_col: str = "day",
    prefix: str = "exposure",
    received_col: str = "received_count",
    rate: str = "recv_rate",
) -> DataFrame:
    """Exposures, distinct questions, days and the received / exposure rate per window.

    Rows outside every window are dropped first, and repeats of (user, item, day) are counted before items are looked up.
    """
    placed = exposure.select("user_id", item_col, date_col).join(users.select("user_id", "signup_date"), "user_id")
    near = placed.where(_span(F.datediff(date_col, "signup_date"), W))
    counted = near.groupBy("user_id", item_col, date_col).agg(F.count(F.lit(1)).alias("_n"))
    if lookup is None:
        resolved = counted.withColumn("_question", F.col(item_col))
    else:
        resolved = lookup_or_self(counted, lookup, item_col, lookup_value, "_question")
    out = window_metrics(
        resolved,
        users,
        W,
        [
            MetricSpec(f"{prefix}_count", "sum", "_n"),
            MetricSpec(f"{prefix}_unique_questions", "distinct", "_question"),
            MetricSpec(f"{prefix}_days", "days"),
        ],
        date_col=date_col,
    )
    if received is not None:
        out = out.join(received.select("user_id", *[f"{received_col}_{w}" for w in W]), "user_id", "left")
        out = out.withColumns(
            {f"{rate}_{w}": safe_div(f"{received_col}_{w}", f"{prefix}_count_{w}", clip=(0, 1)) for w in W}
        ).drop(*[f"{received_col}_{w}" for w in W])
    return out


def responses_after(
    anchors: DataFrame,
    users: DataFrame,
    sources: Mapping[str, tuple[DataFrame, str, bool]],
    window: str = "d0_28",
    W: Windows = WINDOWS,
    anchor_col: str = "first_date",
) -> DataFrame:
    """Reactions on or after the anchor day.  `sources` maps a name to (frame, day column, count days?)."""
    frames = [
        after_anchor(df, anchors, users, window, name, days, W, date_col=day, anchor_col=anchor_col)
        for name, (df, day, days) in sources.items()
    ]
    return assemble(*frames)


def user_mart(users: DataFrame, *frames: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """One row per user with every metric; gaps become 0 / false and absent features get their default."""
    out = fill_defaults(assemble(users, *frames))
    missing = {c: F.lit(v) for c, v in (defaults or {}).items() if c not in out.columns}
    return out.withColumns(missing) if missing else out


def behaviour_ratios(
    df: DataFrame,
    windows: Sequence[str],
    prefix: str = "sent",
    partner: str = "distinct_receivers",
    item: str = "distinct_items",
    early: tuple[str, str] | None = None,
    session_start: str | None = None,
    session_window: str = "d0_7",
) -> DataFrame:
    """Derived ratios: per active day, partner share, item share, early share, records per session start.

    Definitions follow the column names of a published data dictionary; no code for them was available.
    """
    new = {}
    for w in windows:
        n = f"{prefix}_count_{w}"
        new[f"{prefix}_per_active_day_{w}"] = safe_div(n, f"{prefix}_active_days_{w}")
        new[f"{prefix}_unique_{partner.removeprefix('distinct_')}_ratio_{w}"] = safe_div(f"{prefix}_{partner}_{w}", n)
        new[f"{prefix}_{item.removeprefix('distinct_')}_diversity_ratio_{w}"] = safe_div(f"{prefix}_{item}_{w}", n)
    if early:
        new[f"{prefix}_{early[0]}_share_of_{early[1]}"] = safe_div(f"{prefix}_count_{early[0]}", f"{prefix}_count_{early[1]}")
    if session_start:
        new[f"{prefix}_to_start_ratio_{session_window}"] = safe_div(f"{prefix}_count_{session_window}", session_start)
    return df.withColumns(new)


def d3_mart(
    users: DataFrame,
    facts: DataFrame,
    roles: Mapping[str, str],
    groups: Mapping[str, str],
    done: str,
    amount: str,
    W: Windows = WINDOWS,
) -> DataFrame:
    """Features of days 0-3 and targets of days 4-28, one row per user.

    `facts` has user_id, day, partner_id and item_id; `roles` gives the SQL condition of a row that is a record of kind
    sent, received, friend, point_use, attendance, payment or activity, so that one pass serves them all.  Facts kept in
    several tables are unioned by the caller with a column that tells them apart.  `groups` maps class and grade to
    columns of `users`; `done` and `amount` are SQL too.  Column set inferred from a published schema; its builder was
    not available.
    """
    early, late = pick("d0_3", W=W), pick("d4_28", W=W)
    sent, received = roles["sent"], roles["received"]
    M = [
        MetricSpec("sent_vote_count", "rows", where=sent),
        MetricSpec("sent_vote_complete_count", "rows", where=f"({sent}) and ({done})"),
        MetricSpec("sent_vote_active_days", "days", where=sent),
        MetricSpec("received_vote_count", "rows", where=received),
        MetricSpec("received_vote_days", "days", where=received),
        MetricSpec("first_received_date", "min", "day", where=received),
        MetricSpec("returned", "flag", where=roles["attendance"]),
        MetricSpec("payment_count", "rows", where=roles["payment"]),
        MetricSpec("bought_hearts", "sum", "_amount", where=roles["payment"]),
        MetricSpec("active_days", "days", where=roles["activity"]),
    ]
    counted = settle(window_metrics(facts.withColumn("_amount", F.expr(amount)), users, {**early, **late}, M))

    def of(role: str, column: str) -> Column:
        return F.when(F.expr(roles[role]), F.col(column))

    items = {
        "sent_vote_distinct_chosen_users": of("sent", "partner_id"),
        "sent_vote_distinct_questions": of("sent", "item_id"),
        "friends": of("friend", "item_id"),
    }
    different = distinct_in_windows(facts.withColumns(items), users, {n: n for n in items}, early, "user_id", "day")
    anchors = counted.select("user_id", F.col("first_received_date_d0_3").alias("first_date"))
    uses = after_anchor(facts.where(roles["point_use"]), anchors, users, "d0_3", "point_use_after_received_vote_count", W=W)
    uses = uses.withColumnsRenamed(
        {"point_use_after_received_vote_count_yn_d0_3": "point_use_after_received_vote_yn_d0_3"}
    )
    first = F.datediff("first_received_date_d0_3", "signup_date")
    around = counted.join(users, "user_id").select(
        *users.columns, (F.col("sent_vote_count_d0_3") > 0).alias("is_active"), first.alias("first_received_vote_day_d0_3")
    )
    totals = {key: f"{name}_users_d0_3" for name, key in groups.items()}
    around = active_peers(group_sizes(around, totals), {key: (name, totals[key]) for name, key in groups.items()}, suffix="d0_3")
    peers = around.select(
        "user_id",
        "first_received_vote_day_d0_3",
        *totals.values(),
        *[F.col(f"{name}_active_d0_3").alias(f"{name}_active_users_d0_3") for name in groups],
    )
    own = counted.select(
        "user_id",
        (F.col("received_vote_count_d0_3") > 0).alias("received_vote_yn_d0_3"),
        "received_vote_count_d0_3",
        "received_vote_days_d0_3",
        (F.col("sent_vote_count_d0_3") > 0).alias("sent_vote_experience_d0_3"),
        "sent_vote_count_d0_3",
        "sent_vote_complete_count_d0_3",
        "sent_vote_active_days_d0_3",
        safe_div("sent_vote_complete_count_d0_3", "sent_vote_count_d0_3").alias("sent_vote_complete_rate_d0_3"),
        "returned_d4_28",
        (F.col("payment_count_d4_28") > 0).alias("paid_d4_28"),
        "payment_count_d4_28",
        "bought_hearts_d4_28",
        "active_days_d4_28",
    )
    different = different.withColumnRenamed("friends_d0_3", "friends_d3")
    mart = user_mart(users.select("user_id"), peers, own, uses, different)
    flags = ["returned_d4_28", "paid_d4_28", "received_vote_yn_d0_3", "point_use_after_received_vote_yn_d0_3"]
    return mart.withColumns({c: F.col(c).cast("int") for c in flags})

"""Signup-relative day windows and the joins around them.

A window set W maps a name to inclusive (first, last) day offsets.  Facts are reduced to one row per user and
day before they meet the user table: that grain is bounded by the calendar, so a user who holds a third of
all events still brings only a handful of rows to the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions import MetricSpec, col_of
from daymark.functions.daymask import day_mask, days_in, fits

Windows = Mapping[str, tuple[int, int]]

# fixed values: day windows after signup
WINDOWS: dict[str, tuple[int, int]] = {
    "d0": (0, 0),
    "d0_1": (0, 1),
    "d0_3": (0, 3),
    "d0_7": (0, 7),
    "d0_14": (0, 14),
    "d0_28": (0, 28),
    "d1_28": (1, 28),
    "d8_28": (8, 28),
    "d4_28": (4, 28),
}


def pick(*names: str, W: Windows = WINDOWS) -> dict[str, tuple[int, int]]:
    return {n: W[n] for n in names}


def in_window(c, name: str, W: Windows = WINDOWS) -> Column:
    """Whether the offset lies in the window, both ends included; a missing offset is outside."""
    first, last = W[name]
    return F.coalesce(col_of(c).between(first, last), F.lit(False))


def signup_offset(df: DataFrame, users: DataFrame, user_col: str = "user_id", date_col: str = "day") -> DataFrame:
    """Add `day_offset` = days since signup (NULL for an unknown user); the id column becomes `user_id`.

    `users` has one row per user_id with signup_date.
    """
    keyed = df if user_col == "user_id" else df.drop("user_id").withColumnRenamed(user_col, "user_id")
    return keyed.join(users.select("user_id", "signup_date"), "user_id", "left").withColumn(
        "day_offset", F.datediff(date_col, "signup_date")
    )


def _span(c, W: Windows) -> Column:
    return col_of(c).between(min(a for a, _ in W.values()), max(b for _, b in W.values()))


def _partials(m: MetricSpec) -> dict[str, Column]:
    gate = m.gate()
    if m.kind in ("rows", "days", "flag"):
        return {m.name: F.count(F.lit(1)) if gate is None else F.count_if(gate)}
    if m.kind == "count":
        return {m.name: F.count(m.value())}
    if m.kind == "sum":
        return {m.name: F.sum(m.value())}
    if m.kind == "mean":
        return {m.name: F.sum(m.value()), f"{m.name}__n": F.count(m.value())}
    if m.kind == "min":
        return {m.name: F.min(m.value())}
    if m.kind == "max":
        return {m.name: F.max(m.value())}
    raise ValueError(f"metric kind {m.kind} has no daily form")


def _finals(m: MetricSpec, w: str, W: Windows, value: str | None = None, number: str | None = None) -> Column:
    """The metric in one window from daily partials, which `value` (and `number`, the rows of a mean) may name.

    Written as SQL text: with many metrics and windows, one expression string per column keeps plan building short.
    """
    inside = "day_offset between {} and {}".format(*W[w])
    value, number = value or f"`{m.name}`", number or f"`{m.name}__n`"
    part = f"case when {inside} then {value} end"
    text = {
        "rows": f"coalesce(sum({part}), 0)",
        "days": f"count_if({inside} and {value} > 0)",
        "flag": f"coalesce(max({part}), 0) > 0",
        "mean": f"try_divide(cast(sum({part}) as double), sum(case when {inside} then {number} end))",
        "min": f"min({part})",
        "max": f"max({part})",
    }
    text["count"] = text["sum"] = text["rows"]
    return F.expr(text[m.kind]).alias(f"{m.name}_{w}")


def distinct_in_windows(
    df: DataFrame, users: DataFrame, items: Mapping[str, str], W: Windows, user_col: str, date_col: str
) -> DataFrame:
    """Different values of each item column per user and window: `<name>_<window>`.

    Rows meet the signup day while still narrow and lose what lies outside every window; then each
    (user, name, item) collapses to a bit mask of the windows it was seen in, and the bits are added up per
    user.  The number of shuffles does not depend on how many columns or windows are counted, and the items of
    one user are spread over all tasks: a hot user's side of the join is split by Spark (see
    `daymark.session`), and both groupings combine on the map side.
    """
    kinds = dict(df.dtypes)
    same = len({kinds[c] for c in items.values()}) == 1
    keyed = df.select(
        F.col(user_col).alias("user_id"),
        F.col(date_col).alias("day"),
        *[(F.col(c) if same else F.col(c).cast("string")).alias(name) for name, c in items.items()],
    ).where("user_id is not null and day is not null")
    # hashing the signup days of a partition is little beside sorting its rows, and the split of a hot user's rows stays
    placed = keyed.join(users.select("user_id", "signup_date").hint("shuffle_hash"), "user_id").withColumn(
        "day_offset", F.datediff("day", "signup_date")
    )
    mask = F.expr(" | ".join(f"if(day_offset between {a} and {b}, {1 << i}L, 0L)" for i, (a, b) in enumerate(W.values())))
    inside = placed.where(_span("day_offset", W)).select("user_id", mask.alias("_mask"), *items)
    # the columns are numbered, so that a row of the grouping is as narrow as its item
    if len(items) > 1:
        pairs = [F.struct(F.lit(i).alias("name"), F.col(n).alias("item")) for i, n in enumerate(items)]
        long = inside.select("user_id", "_mask", F.inline(F.array(*pairs)))
    else:
        long = inside.select("user_id", "_mask", *[c for n in items for c in (F.lit(0).alias("name"), F.col(n).alias("item"))])
    seen = long.where("item is not null").groupBy("user_id", "name", "item").agg(F.bit_or("_mask").alias("_mask"))
    return seen.groupBy("user_id").agg(
        *[
            F.expr(f"count_if(name = {n} and (_mask & {1 << i}L) != 0)").alias(f"{name}_{w}")
            for n, name in enumerate(items)
            for i, w in enumerate(W)
        ]
    )


def window_metrics(
    df: DataFrame,
    users: DataFrame,
    W: Windows,
    M: Sequence[MetricSpec],
    user_col: str = "user_id",
    date_col: str = "day",
) -> DataFrame:
    """Every metric in every window, one row per user of `users`, absent activity as 0.

    One scan serves all windows.  Columns are named `<metric>_<window>`.
    """
    plain = [m for m in M if m.kind != "distinct"]
    base = users.select("user_id", "signup_date")
    out = None
    if plain:
        daily = (
            df.where(F.col(user_col).isNotNull() & F.col(date_col).isNotNull())
            .groupBy(F.col(user_col).alias("user_id"), F.col(date_col).alias("day"))
            .agg(*[c.alias(n) for m in plain for n, c in _partials(m).items()])
        )
        placed = base.join(daily, "user_id", "left").withColumn("day_offset", F.datediff("day", "signup_date"))
        out = placed.groupBy("user_id").agg(*[_finals(m, w, W) for w in W for m in plain])
    items = {m.name: m.col for m in M if m.kind == "distinct"}
    if items:
        counts = distinct_in_windows(df, users, items, W, user_col, date_col)
        out = (out if out is not None else base.select("user_id")).join(counts, "user_id", "left")
        out = out.fillna(0, subset=[c for c in counts.columns if c != "user_id"])
    return out.select("user_id", *[f"{m.name}_{w}" for w in W for m in M])


def _row_values(m: MetricSpec) -> dict[str, Column]:
    """What one row adds to the daily partials of `_partials`."""
    gate = m.gate()
    if m.kind in ("rows", "days", "flag"):
        return {m.name: (F.lit(1) if gate is None else F.when(gate, 1).otherwise(0)).cast("long")}
    if m.kind == "count":
        return {m.name: F.when(m.value().isNotNull(), 1).otherwise(0).cast("long")}
    if m.kind == "mean":
        return {m.name: m.value(), f"{m.name}__n": F.when(m.value().isNotNull(), 1).otherwise(0).cast("long")}
    if m.kind in ("sum", "min", "max"):
        return {m.name: m.value()}
    raise ValueError(f"metric kind {m.kind} has no daily form")


@dataclass(frozen=True, eq=False)
class Fact:
    """Rows of one user role with the metrics they add to, as (windows, metrics) pairs."""

    frame: DataFrame
    parts: Sequence[tuple[Windows, Sequence[MetricSpec]]]
    user_col: str = "user_id"
    date_col: str = "day"


def fact_metrics(facts: Sequence[Fact], users: DataFrame) -> DataFrame:
    """`window_metrics` of several facts in one pass: one row per user of `users`, `<metric>_<window>` columns.

    The rows of all facts are united in a narrow form (user, day, fact and a few value columns that the facts share by type),
    summed per user, day and fact with map-side combining, met with the signup day once and grouped once, however many facts
    there are.  Days are counted from one day mask per metric.  Facts that name the same metric add to it together (active
    days over several sources); its kind and windows must then agree.  Metrics of days need windows within days 0 to 62.
    Different items are counted by `distinct_in_windows` beside it.
    """
    specs: dict[str, tuple[MetricSpec, dict]] = {}
    found: dict[str, list[tuple[int, str]]] = {}  # partial -> (fact, slot)
    slots: dict[str, str] = {}  # slot -> how it is merged
    branches, distinct = [], []
    for i, f in enumerate(facts):
        values, merge = {}, {}
        for W, M in f.parts:
            items = {m.name: m.col for m in M if m.kind == "distinct"}
            if items:
                distinct.append((f, items, W))
            for m in M:
                if m.name in values:
                    raise ValueError(f"metric {m.name} is named twice in one fact")
                known = specs.setdefault(m.name, (m, dict(W)))
                if (known[0].kind, known[1]) != (m.kind, dict(W)):
                    raise ValueError(f"metric {m.name} has two kinds or window sets")
                if m.kind == "days" and not fits(W):
                    raise ValueError(f"windows of {m.name} reach beyond a day mask")
                if m.kind != "distinct":
                    values.update(_row_values(m))
                    merge.update({n: m.kind if m.kind in ("min", "max") else "sum" for n in _row_values(m)})
        if not values:
            continue
        rows = f.frame.select(
            F.col(f.user_col).alias("user_id"),
            F.col(f.date_col).cast("date").alias("day"),
            *[c.alias(n) for n, c in values.items()],
        ).where("user_id is not null and day is not null")
        kinds, used, named = dict(rows.dtypes), {}, []
        for n in values:
            group = f"{merge[n]}_{kinds[n]}"
            used[group] = used.get(group, -1) + 1
            slot = f"{group}_{used[group]}"
            slots[slot] = merge[n]
            found.setdefault(n, []).append((i, slot))
            named.append(F.col(f"`{n}`").alias(slot))
        branches.append(rows.select("user_id", "day", F.lit(i).alias("_fact"), *named))
    base = users.select("user_id", "signup_date")
    out = base.select("user_id")
    if branches:
        rows = branches[0]
        for b in branches[1:]:
            rows = rows.unionByName(b, allowMissingColumns=True)
        daily = rows.groupBy("user_id", "day", "_fact").agg(*[getattr(F, how)(f"`{s}`").alias(s) for s, how in slots.items()])
        placed = base.join(daily, "user_id", "left").withColumn("day_offset", F.datediff("day", "signup_date"))
        cells = []
        for m, W in specs.values():
            if m.kind == "distinct":
                continue
            value, number = (
                "case " + " ".join(f"when _fact = {i} then `{slot}`" for i, slot in found.get(n, [])) + " end" if n in found else None
                for n in (m.name, f"{m.name}__n")
            )
            if m.kind == "days":
                mask = day_mask("day_offset", f"({value}) > 0")
                cells += [days_in(mask, *W[w]).alias(f"{m.name}_{w}") for w in W]
            else:
                cells += [_finals(m, w, W, value, number) for w in W]
        out = placed.groupBy("user_id").agg(*cells)
    for f, items, W in distinct:
        counts = distinct_in_windows(f.frame, users, items, W, f.user_col, f.date_col)
        out = out.join(counts, "user_id", "left").fillna(0, subset=[c for c in counts.columns if c != "user_id"])
    return out


def first_in_window(
    df: DataFrame, users: DataFrame, window: str, W: Windows = WINDOWS, user_col: str = "user_id", date_col: str = "day"
) -> DataFrame:
    """Earliest offset and day inside the window, only for users who have one."""
    daily = df.select(F.col(user_col).alias("user_id"), F.col(date_col).alias("day")).dropna().distinct()
    placed = daily.join(users.select("user_id", "signup_date"), "user_id").withColumn(
        "day_offset", F.datediff("day", "signup_date")
    )
    return (
        placed.where(in_window("day_offset", window, W))
        .groupBy("user_id")
        .agg(F.min("day_offset").alias("first_offset"), F.min("day").alias("first_date"))
    )


def after_anchor(
    df: DataFrame,
    anchors: DataFrame,
    users: DataFrame,
    window: str,
    name: str,
    days: bool = False,
    W: Windows = WINDOWS,
    user_col: str = "user_id",
    date_col: str = "day",
    anchor_col: str = "first_date",
) -> DataFrame:
    """Rows (or different days) on or after the user's anchor day and inside the window, per anchored user."""
    parts = {name: (None, days)}
    return after_anchor_parts(df, anchors, users, window, parts, W, user_col, date_col, anchor_col)


def after_anchor_parts(
    df: DataFrame,
    anchors: DataFrame,
    users: DataFrame,
    window: str,
    parts: Mapping[str, tuple[str | None, bool]],
    W: Windows = WINDOWS,
    user_col: str = "user_id",
    date_col: str = "day",
    anchor_col: str = "first_date",
) -> DataFrame:
    """`after_anchor` for several kinds of rows of one table in one pass.

    `parts` maps an output name to (SQL condition or None, count days instead of rows).  The events are counted per user
    and day first, so the join on user compares days, not events.
    """
    counts = [
        (F.count(F.lit(1)) if rule is None else F.count_if(F.expr(rule))).alias(f"_n_{name}") for name, (rule, _) in parts.items()
    ]
    daily = (
        df.where(F.col(user_col).isNotNull() & F.col(date_col).isNotNull())
        .groupBy(F.col(user_col).alias("user_id"), F.col(date_col).alias("day"))
        .agg(*counts)
    )
    base = (
        anchors.where(F.col(anchor_col).isNotNull())
        .select("user_id", F.col(anchor_col).alias("_anchor"))
        .join(users.select("user_id", "signup_date"), "user_id", "left")
    )
    hit = F.coalesce(F.col("day") >= F.col("_anchor"), F.lit(False)) & in_window("day_offset", window, W)
    amounts = [
        (F.count_if(hit & (F.col(f"_n_{name}") > 0)) if days else F.coalesce(F.sum(F.when(hit, F.col(f"_n_{name}"))), F.lit(0))).alias(
            f"{name}_{window}"
        )
        for name, (_, days) in parts.items()
    ]
    return (
        base.join(daily, "user_id", "left")
        .withColumn("day_offset", F.datediff("day", "signup_date"))
        .groupBy("user_id")
        .agg(*amounts)
        .withColumns({f"{name}_yn_{window}": F.col(f"{name}_{window}") > 0 for name in parts})
    )


def enrich(df: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    """Left joins to one-row-per-key dimensions, each given with its key."""
    for dim, key in dims:
        df = df.join(dim, key, "left")
    return df


def assemble(users: DataFrame, *frames: DataFrame, key: str = "user_id") -> DataFrame:
    """Left joins of one-row-per-user frames.  All share the key, so one partitioning serves every join."""
    out = users
    for f in frames:
        out = out.join(f.drop(*[c for c in f.columns if c != key and c in out.columns]), key, "left")
    return out


def outer_merge(*frames: DataFrame, on: Sequence[str] = ("user_id",)) -> DataFrame:
    """Full outer joins on named keys; the key keeps whichever side has it."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on), "full_outer")
    return out


def resolve_identity(df: DataFrame, ids: DataFrame, session_col: str = "session_id", user_col: str = "user_id") -> DataFrame:
    """Rows of known sessions with their user; a session listed twice keeps its least user id."""
    known = (
        ids.where(F.col(session_col).isNotNull() & F.col(user_col).isNotNull())
        .groupBy(session_col)
        .agg(F.min(user_col).alias(user_col))
    )
    return df.where(F.col(session_col).isNotNull()).join(known, session_col)


def lookup_or_self(df: DataFrame, dim: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add the looked-up value, or the key itself where the dimension has none."""
    pairs = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_found"))
    return df.join(pairs, key, "left").withColumn(out, F.coalesce("_found", key)).drop("_found")


def as_role(df: DataFrame, role_col: str, to: str = "user_id") -> DataFrame:
    """The fact seen from one of its user columns: that column becomes `to`."""
    if role_col == to:
        return df.where(F.col(to).isNotNull())
    return df.drop(to).withColumnRenamed(role_col, to).where(F.col(to).isNotNull())


def compare(
    a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str], suffixes: tuple[str, str] = ("_base", "_excluded")
) -> DataFrame:
    """Both versions of each column side by side with `<col>_diff` = second minus first."""
    on, (s1, s2) = list(on), suffixes
    left = a.select(*on, *[F.col(c).alias(c + s1) for c in cols])
    right = b.select(*on, *[F.col(c).alias(c + s2) for c in cols])
    joined = left.join(right, on, "full_outer")
    return joined.select(
        *on,
        *[x for c in cols for x in (c + s1, c + s2)],
        *[(F.col(c + s2) - F.col(c + s1)).alias(c + "_diff") for c in cols],
    )

"""Scalar expressions: identifiers, days, lists in text, money, flags, ratios, buckets.

Everything returns a Column built from Spark's own functions, so plans stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_id(c) -> Column:
    """Identifier as digits in a string; text such as '12.0' is 12, a fraction or other text is NULL."""
    text = col_of(c).cast("string")
    wide = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(wide == F.floor(wide), wide.try_cast("bigint"))).cast("string")


def to_day(c) -> Column:
    """Calendar day of a timestamp or text; unreadable text is NULL."""
    return F.to_date(col_of(c).try_cast("timestamp"))


def _items(c) -> Column:
    # lists are written the way Python prints them: None, True and False, and a comma may follow the last item
    text = F.trim(col_of(c))
    for word, means in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"\b{word}\b", means)
    text = F.regexp_replace(text, r",\s*\]$", "]")
    return F.from_json(F.when(text.endswith("]"), text), "array<string>")


def list_len(c) -> Column:
    """Length of a list kept as text; NULL and unreadable text count 0."""
    return F.coalesce(F.size(_items(c)), F.lit(0))


def date_list(c) -> Column:
    """Sorted distinct days of a list kept as text; an empty array when there is none."""
    days = F.transform(_items(c), lambda x: F.to_date(x.try_cast("timestamp")))
    return F.coalesce(
        F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull()))),
        F.array().cast("array<date>"),
    )


def streak_of(days) -> Column:
    """Longest run of consecutive days in a sorted array of distinct days."""
    start = F.struct(
        F.lit(None).cast("date").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(acc, day):
        run = F.when(F.datediff(day, acc["prev"]) == 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(day.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(col_of(days), start, step, lambda acc: acc["best"])


WHOLE = ("tinyint", "smallint", "int", "bigint", "byte", "short", "integer", "long")


def num(c, default: float | None = 0.0, dtype: str = "string") -> Column:
    """Number from any type; unreadable, NaN and infinite values become `default`.

    `dtype` is the Spark type name of the column where it is known: numbers then need no round trip through text.
    """
    if dtype in WHOLE or dtype.startswith("decimal"):
        value = col_of(c).cast("double")
        return value if default is None else F.coalesce(value, F.lit(float(default)))
    value = col_of(c).cast("double") if dtype in ("float", "double") else col_of(c).cast("string").try_cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return finite if default is None else F.coalesce(finite, F.lit(float(default)))


TRUE_WORDS = ("1", "true", "t", "yes", "y", "paid")  # fixed values: spellings read as true


def to_binary(c, dtype: str) -> Column:
    """0/1 from a loosely typed flag; `dtype` is the Spark type name of the column."""
    c = col_of(c)
    if dtype == "boolean":
        hit = F.coalesce(c, F.lit(False))
    elif dtype in ("string", "varchar", "char"):
        hit = F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))
    else:
        hit = num(c, dtype=dtype) > 0
    return hit.cast("int")


def safe_div(n, d, clip: tuple[float, float] | None = None) -> Column:
    """n / d with 0 for a missing or zero denominator, optionally clipped."""
    n, d = col_of(n).cast("double"), col_of(d).cast("double")
    out = F.coalesce(F.try_divide(n, F.nullif(d, F.lit(0.0))), F.lit(0.0))
    return out if clip is None else F.least(F.greatest(out, F.lit(float(clip[0]))), F.lit(float(clip[1])))


def digits(c) -> Column:
    """First run of digits in a text as a number, NULL when there is none."""
    return F.regexp_extract(col_of(c).cast("string"), r"(\d+)", 1).try_cast("double")


def money(c, strip_all: bool = False) -> Column:
    """Amount from text: commas removed, or everything but digits, sign and dot removed."""
    text = col_of(c).cast("string")
    cleaned = F.regexp_replace(text, r"[^0-9.\-]", "") if strip_all else F.regexp_replace(text, ",", "")
    return cleaned.try_cast("double")


def group_key(*cols, sep: str = "|") -> Column:
    """Composite key; NULL as soon as one part is NULL."""
    parts = [col_of(c) for c in cols]
    present = parts[0].isNotNull()
    for p in parts[1:]:
        present = present & p.isNotNull()
    return F.when(present, F.concat_ws(sep, *[p.cast("string") for p in parts]))


def status_in(c, values: Iterable[str], fold: str | None = None) -> Column:
    """Whether a status is one of `values`; `fold` is None (exact), 'lower' or 'upper'."""
    text = F.coalesce(col_of(c).cast("string"), F.lit(""))
    text = {"lower": F.lower, "upper": F.upper, None: lambda t: t}[fold](text)
    return text.isin(*values)


def read_flag(*cols) -> Column:
    """True when any of the counters is above 0."""
    out = F.lit(False)
    for c in cols:
        out = out | (F.coalesce(col_of(c), F.lit(0)) > 0)
    return out


def first_non_null(*cols) -> Column:
    return F.coalesce(*[col_of(c) for c in cols])


def flag_label(c, yes: str, no: str) -> Column:
    return F.when(F.coalesce(col_of(c), F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def key_family(c, families: dict[str, Sequence[str]]) -> Column:
    """Name of the first family that lists the key, NULL when none does."""
    c = col_of(c)
    out = F.lit(None).cast("string")
    for name, keys in reversed(list(families.items())):
        out = F.when(c.isin(*keys), F.lit(name)).otherwise(out)
    return out


def bucket_label(c, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Label of the right-closed interval (edge[i], edge[i+1]] the value falls in, NULL outside all."""
    c = col_of(c)
    out = None
    for i, label in enumerate(labels):
        low = c >= edges[i] if include_lowest and i == 0 else c > edges[i]
        inside = low if edges[i + 1] == float("inf") else low & (c <= edges[i + 1])
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out

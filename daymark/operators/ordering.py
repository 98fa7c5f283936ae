"""Exact ranks, running totals and quantiles over groups of any size.

`row_number` or `percentile` over a group puts that whole group in one task.  Here a sketch picks range
boundaries first; each range is summed, the few range totals are accumulated, and only the rows inside one
range are ordered together.  No group, however large, meets in one task, and results stay exact because
the sketch only decides where the data is cut.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.session import shuffle_parts

HASH_SPAN = float(2**60)


def range_cuts(df: DataFrame, cols: Sequence[str], parts: int | None = None) -> list[float]:
    """Boundaries that split the values of `cols` into about `parts` equal ranges (one scan, a few numbers)."""
    parts = parts or shuffle_parts(df.sparkSession)
    grid = [i / parts for i in range(1, parts)]
    accuracy = max(1000, 10 * parts)
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), grid, accuracy).alias(f"c{i}") for i, c in enumerate(cols)]
    ).first()
    return sorted({v for cuts in row if cuts for v in cuts if v is not None and math.isfinite(v)})


def seeded_hash(c: Column | str, seed: int) -> Column:
    """A whole number in [0, 2^60): the first 15 hex digits of md5(seed, '|', text of c), which any engine can compute."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_cuts(df: DataFrame) -> list[float]:
    """Boundaries for `seeded_hash`, which is uniform; needs no look at the data."""
    parts = shuffle_parts(df.sparkSession)
    return [HASH_SPAN * i / parts for i in range(1, parts)]


def hash_ranked(df: DataFrame, by: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Add `n_before`: the row's place in a seeded random order within its group, and `n_total`.

    The order is `seeded_hash` of the id and then the id, so it does not depend on partitioning or on the id's type.
    """
    keyed = df.withColumns({"_h": seeded_hash(id_col, seed), "n": F.lit(1)})
    return running(keyed, "_h", ["n"], by=by, cuts=hash_cuts(df), then=[id_col]).drop("_h", "n")


def with_range(df: DataFrame, order: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Add the number of the range `order` falls in."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    keyed = df.withColumn("_order", F.col(order).cast("double"))
    return Bucketizer(splits=splits, inputCol="_order", outputCol=out, handleInvalid="keep").transform(keyed).drop("_order")


def running(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
    then: Sequence[str] = (),
) -> DataFrame:
    """Add `<s>_before` (sum over earlier rows) and `<s>_total` for each s, per `by`, ordered by `order`, `then`.

    Rows should be unique in (by, order, then) and `by` not NULL.  Equal `order` values land in one range, so
    collapse repeated values to counts before calling.
    """
    by = list(by)
    cuts = range_cuts(df, [order]) if cuts is None else cuts
    ranged = with_range(df, order, cuts, "_range")
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    # one row per range: the number of ranges is fixed by the cuts, not by the data
    across = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{s}").over(across), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    joined = local.join(offsets, [*by, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value, n): how often each value occurs in each column; NULL and NaN left out."""
    by = list(by)
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    for key in by:
        wide = wide.where(F.col(key).isNotNull())
    long = wide.unpivot(by, list(cols), "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    # adding 0.0 turns -0.0 into 0.0, so both zeros are one value
    return long.groupBy(*by, "column", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def quantile_columns(probs: Mapping[str, float]) -> list[Column]:
    """Aggregates picking linear-interpolation quantiles out of a frame made by `running` over value counts."""
    before, n, total, value = F.col("n_before"), F.col("n"), F.col("n_total"), F.col("value")
    out = []
    for name, q in probs.items():
        place = F.lit(float(q)) * (total - 1)
        lo, hi = F.floor(place), F.ceil(place)
        at_lo = F.max(F.when((before <= lo) & (lo < before + n), value))
        at_hi = F.max(F.when((before <= hi) & (hi < before + n), value))
        part = F.max(place - lo)
        out.append((at_lo + (at_hi - at_lo) * part).alias(name))
    return out


def ranked_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Value counts with the number of smaller values and the group size."""
    return running(
        value_counts(df, cols, by), "value", ["n"], by=[*by, "column"], cuts=range_cuts(df, cols)
    )


def quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, one row per (by, column)."""
    return ranked_values(df, cols, by).groupBy(*by, "column").agg(*quantile_columns(probs))


def quantile_values(df: DataFrame, cols: Sequence[str], q: float) -> dict[str, float | None]:
    """One quantile per column on the driver: as many numbers as there are columns."""
    rows = quantiles(df, cols, {"v": q}).collect()
    found = {r["column"]: r["v"] for r in rows}
    return {c: found.get(c) for c in cols}


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, rank): mean position of each value, ties sharing their average."""
    ranked = ranked_values(df, cols)
    return ranked.select("column", "value", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))

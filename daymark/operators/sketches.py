"""Mergeable quantile sketches: built per day and group in one scan, merged over any days later.

The exact quantiles of `ordering` read their input again for every question.  A KLL sketch is a few kilobytes whose size
does not grow with the rows; sketches of disjoint rows merge into the sketch of all of them.  Its answers are values of the data whose
rank is off by at most `rank_error(k)` of the rows (in 99 of 100 cases).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 800  # size parameter


def rank_error(k: int = K) -> float:
    """Share of the rows by which a quantile's rank may be off: 2.296 / k^0.9021, the published fit for KLL."""
    return 2.296 / k**0.9021


def sketch(df: DataFrame, cols: Sequence[str], by: Sequence[str], k: int = K) -> DataFrame:
    """(by, column, n, total, least, greatest, sketch): one row per group and column, from one scan.

    NULL and NaN are left out; a column without values in a group has n = 0 and no sketch.  Groups combine on the map side.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) + F.lit(0.0) for c in cols}
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(v).alias("n"),
            F.sum(v).alias("total"),
            F.min(v).alias("least"),
            F.max(v).alias("greatest"),
            F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, k)).alias("sketch"),
        )
        for c, v in value.items()
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("_cells")).select(*by, F.inline("_cells"))


def merge(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """The same table for coarser groups (days dropped, groups united), without reading the rows again."""
    return (
        sketches.where("n > 0")
        .groupBy(*by, "column")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("least").alias("least"),
            F.max("greatest").alias("greatest"),
            F.kll_merge_agg_double("sketch", k).alias("sketch"),
        )
    )


def read_quantiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Count, mean, extremes (exact) and the asked quantiles (within the rank error) instead of the sketch."""
    keys = [c for c in sketches.columns if c not in ("n", "total", "least", "greatest", "sketch")]
    return sketches.where("n > 0").select(
        *keys,
        "n",
        F.try_divide("total", "n").alias("mean"),
        F.col("least").alias("min"),
        F.col("greatest").alias("max"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in probs.items()],
    )

"""Row and column shaping: filters, fills, flags, reshaping, buckets, dedup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.functions import bucket_label, date_list, streak_of
from daymark.session import settle


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which every named column is present."""
    return df.dropna(subset=list(cols))


def fill_defaults(df: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """0 for missing numbers and false for missing flags, except in key columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in keys:
            pass
        elif isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def bucketize(
    df: DataFrame,
    col: str | Column,
    edges: Sequence[float],
    labels: Sequence[str],
    out: str,
    include_lowest: bool = False,
) -> DataFrame:
    """Add the right-closed bucket label as `out` and its position as `<out>_ord`."""
    return df.withColumns(
        {
            out: bucket_label(col, edges, labels, include_lowest),
            f"{out}_ord": bucket_label(col, edges, list(range(len(labels))), include_lowest),
        }
    )


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(ids.select(key), key, "left_anti")


def flag_member(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """Add whether the key is listed."""
    listed = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return df.join(listed, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot_fill(df: DataFrame, rows: Sequence[str], col: str, agg: Column, values: Sequence, fill=0) -> DataFrame:
    """Long to wide over a given list of values, so that no extra scan looks for them."""
    wide = df.groupBy(*rows).pivot(col, list(values)).agg(agg)
    return wide.fillna(fill, subset=[c for c in wide.columns if c not in rows])


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the least in `order_by`, then in the remaining columns.

    A minimum over rows combines on the map side, so a key with very many copies costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = [c for c in order_by if c in rest]
    ranked = F.struct(*first, *[c for c in rest if c not in first])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def dedup_rare(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """`dedup` of a table whose keys seldom repeat: the same rows, but only those whose key's hash repeats are moved.

    A first pass counts 64-bit hashes of the keys.  Rows whose hash occurs once pass as they are; the others, which hold every
    repeated key, go through `dedup`.  The table is read up to three times, so it should be stored.
    """
    key = F.xxhash64(*keys)
    counted = df.select(key.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    again = settle(counted.where("_n > 1").select("_key"))
    if again.isEmpty():
        return df
    keyed = df.withColumn("_key", key)
    single = keyed.join(again, "_key", "left_anti").select(*df.columns)
    return single.unionByName(dedup(keyed.join(again, "_key", "left_semi").select(*df.columns), keys, order_by))


def date_list_metrics(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """Days, number of days and longest streak of a list kept as text, one row per input row."""
    parsed = df.select(id_col, date_list(list_col).alias("days"))
    return parsed.select(id_col, "days", F.size("days").alias("day_count"), streak_of("days").alias("longest_streak"))


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))

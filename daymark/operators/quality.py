"""Distributions, audits, bounds, extremes, consistency and correlations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.functions import MetricSpec, aggregate_column, bucket_label, col_of, num, safe_div
from daymark.operators.ordering import average_ranks, quantile_columns, quantile_values, quantiles, ranked_values
from daymark.operators.segments import label_frame, summarize, with_share
from daymark.operators.tables import bucketize, pivot_fill, union_all
from daymark.operators.windows import Windows, compare, window_metrics
from daymark.session import settle

EMPTY_LABEL = "(none)"


def per_column(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """One row per column with the given statistics, all from a single scan."""
    cells = [F.struct(F.lit(c).alias("column"), *[make(c).alias(n) for n, make in stats.items()]) for c in cols]
    return df.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))


def _as_double(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*extra, *[F.col(c).cast("double").alias(c) for c in cols])


def distribution(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Count, mean, median, p75, p90 and max with missing values as 0, optionally per group."""
    keys = [by] if by else []
    filled = df.select(*keys, F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias(col))
    out = ranked_values(filled, [col], keys).groupBy(*keys, "column").agg(
        F.sum("n").alias("count"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mean"),
        *quantile_columns({"median": 0.5, "p75": 0.75, "p90": 0.9}),
        F.max("value").alias("max"),
    )
    return out.drop("column")


def bucket_histogram(
    df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True, count: str = "count"
) -> DataFrame:
    """Rows per bucket with their share in percent; empty buckets stay with 0."""
    value = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    counts = (
        df.groupBy(bucket_label(value, edges, labels, include_lowest).alias("bucket"))
        .agg(F.count(F.lit(1)).alias(count))
        .where("bucket is not null")
    )
    dense = label_frame(df.sparkSession, "bucket", labels).join(counts, "bucket", "left")
    return with_share(dense.withColumn(count, F.coalesce(count, F.lit(0))), count)


def bucket_matrix(
    df: DataFrame, x: str, y: str, x_buckets: tuple[Sequence, Sequence], y_buckets: tuple[Sequence, Sequence]
) -> DataFrame:
    """Row counts of x bucket (rows) by y bucket (columns), every cell present."""
    cut = bucketize(df, F.coalesce(F.col(x).cast("double"), F.lit(0.0)), *x_buckets, out="_x")
    cut = bucketize(cut, F.coalesce(F.col(y).cast("double"), F.lit(0.0)), *y_buckets, out="_y")
    counts = cut.where("_x is not null and _y is not null").groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    wide = pivot_fill(counts, ["_x"], "_y", F.sum("_n"), list(y_buckets[1])).withColumnRenamed("_x", x)
    dense = label_frame(df.sparkSession, x, x_buckets[1]).join(wide, x, "left")
    return dense.fillna(0, subset=list(y_buckets[1]))


def _is_missing(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def missing(df: DataFrame) -> DataFrame:
    """Missing and present values of every column."""
    return per_column(
        df,
        df.columns,
        {
            "missing_count": lambda c: F.count_if(_is_missing(df, c)),
            "missing_rate": lambda c: F.try_divide(F.count_if(_is_missing(df, c)), F.count(F.lit(1))),
            "non_missing_count": lambda c: F.count_if(~_is_missing(df, c)),
        },
    )


def dtypes(df: DataFrame, samples: int = 3) -> DataFrame:
    """Type, number of different values and the first few values (in text order) of every column."""
    types = dict(df.dtypes)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    distinct = text.unpivot([], df.columns, "column", "value").where("value is not null").distinct()
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    few = distinct.withColumn("_place", place).where(F.col("_place") <= samples).groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("sample_values")
    )
    names = df.sparkSession.createDataFrame([(c, types[c]) for c in df.columns], "column string, dtype string")
    return names.join(counts, "column", "left").join(few, "column", "left").fillna({"nunique": 0, "sample_values": ""})


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and p1 p5 p50 p95 p99 with missing and infinite values as 0."""
    kinds = dict(df.dtypes)
    clean = df.select(
        *[(F.coalesce(F.col(c), F.lit(False)).cast("double") if kinds[c] == "boolean" else num(c, dtype=kinds[c])).alias(c) for c in cols]
    )
    basic = per_column(
        clean,
        cols,
        {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )
    probs = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    return basic.join(quantiles(clean, cols, probs), "column", "left")


def zero_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of zeros, non-zero rows, mean and maximum of each column."""
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return per_column(
        clean,
        cols,
        {
            "row_count": lambda c: F.count(F.lit(1)),
            "zero_rate": lambda c: F.try_divide(F.count_if(F.col(c) == 0), F.count(F.lit(1))),
            "nonzero_count": lambda c: F.count_if(F.col(c) != 0),
            "mean": F.avg,
            "max": F.max,
        },
    )


def _canonical(c: Column, kind: T.DataType) -> Column:
    """The value in a form in which equal values have equal JSON: maps as sorted entries, one zero, times in microseconds."""
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(_canonical(e["key"], kind.keyType).alias("k"), _canonical(e["value"], kind.valueType).alias("v")),
        )
        # sorted by the text of the entry, as the entries may hold what Spark cannot order
        return F.array_sort(F.transform(entries, lambda e: F.to_json(e, {"ignoreNullFields": "false"})))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _canonical(e, kind.elementType))
    if isinstance(kind, T.StructType):
        cells = [_canonical(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(c.isNotNull(), F.struct(*cells)) if cells else c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c + F.lit(0.0).cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c


def row_text(df: DataFrame) -> Column:
    """A text that is equal for equal rows and for no others; NULL, empty text and the text 'null' stay apart."""
    cells = [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def duplicate_audit(
    df: DataFrame, keys: Sequence[str], table: str = "table", digest: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """How many rows key-based dedup would drop, and how many of those are not copies of a whole row.

    Rows travel as a 128-bit digest of `row_text`, so columns of any type, maps included, and wide rows cost one short text
    in the shuffle.  Only rows whose (key, digest) repeats are compared whole, so the figures are exact even where digests
    collide.  Every dropped whole-row copy is also a key copy, so the difference of the two sums is the third figure.
    """
    keys = list(keys)
    texts = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], row_text(df).alias("_text"))
    names = [f"_k{i}" for i in range(len(keys))]
    digests = texts.select(*names, digest(F.col("_text")).alias("_digest"))
    rows = digests.groupBy(*names, "_digest").agg(F.count(F.lit(1)).alias("_n"))
    # the digests that repeat, and how many different rows each of them stands for
    again = rows.where("_n > 1").select("_digest").distinct()
    whole = texts.withColumn("_digest", digest(F.col("_text"))).join(again, "_digest", "left_semi")
    kinds = whole.groupBy(*names, "_digest", "_text").count().groupBy(*names, "_digest").agg(F.count(F.lit(1)).alias("_kinds"))
    both = rows.select(*names, "_n", F.lit(1).cast("long").alias("_kinds")).unionByName(
        kinds.select(*names, F.lit(0).cast("long").alias("_n"), (F.col("_kinds") - 1).alias("_kinds"))
    )
    per_key = both.groupBy(*names).agg(F.sum("_n").alias("_n"), F.sum("_kinds").alias("_kinds"))
    out = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - F.col("_kinds")), F.lit(0)).alias("full_row_duplicates"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("key_duplicates"),
        F.coalesce(F.sum(F.col("_kinds") - 1), F.lit(0)).alias("key_not_row_duplicates"),
        F.count_if(F.col("_n") > 1).alias("duplicated_key_groups"),
    )
    return out.select(
        F.lit(table).alias("table_name"),
        F.lit(", ".join(keys)).alias("dedup_key"),
        "*",
        F.try_divide(F.col("full_row_duplicates") * 100.0, "key_duplicates").alias("full_share_pct"),
    )


def outlier_profile(
    df: DataFrame,
    cols: Sequence[str],
    id_col: str = "user_id",
    expected_max: Mapping[str, float] | None = None,
    group_col: str | None = None,
) -> DataFrame:
    """Quantiles, maximum over p99, rows above p99 and above an expected maximum, and who holds the maximum.

    With `group_col` also the group of that holder (`max_group`).  Two passes: one for the quantiles, one that compares with p99 as a constant.
    """
    expected_max = expected_max or {}
    clean = df.select(
        F.col(id_col).alias("_id"),
        (F.lit(None) if group_col is None else F.col(group_col)).cast("string").alias("_group"),
        *[F.col(c).cast("double").alias(c) for c in cols],
    )
    probs = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    spread = quantiles(clean, cols, probs).collect()  # one row per column
    p99 = {r["column"]: r["p99"] for r in spread}
    quant = df.sparkSession.createDataFrame(
        [tuple(r[c] for c in ["column", *probs]) for r in spread],
        "column string, " + ", ".join(f"{p} double" for p in probs),
    )

    def holder(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("v"), F.col("_id").alias("id"), "_group")))

    def above(c: str, bound: float | None) -> Column:
        return F.lit(0).cast("long") if bound is None else F.count_if(F.col(c) > F.lit(float(bound)))

    stats = per_column(
        clean,
        cols,
        {
            "non_null_count": F.count,
            "zero_count": lambda c: F.count_if(F.col(c) == 0),
            "mean": F.avg,
            "max": F.max,
            "above_p99_count": lambda c: above(c, p99.get(c)),
            "row_count": lambda c: F.count(F.lit(1)),
            "expected_max": lambda c: F.lit(expected_max.get(c)).cast("double"),
            "above_expected_max_count": lambda c: above(c, expected_max.get(c)),
            # the least id among the holders of the maximum
            "max_id": lambda c: holder(c)["id"],
            **({} if group_col is None else {"max_group": lambda c: holder(c)["_group"]}),
        },
    )
    joined = stats.join(F.broadcast(quant), "column", "left")  # at most one row per column
    return joined.withColumns(
        {
            "max_to_p99_ratio": F.try_divide("max", F.when(F.col("p99") > 0, F.col("p99"))),
            "above_p99_rate_pct": F.try_divide(F.col("above_p99_count") * 100.0, "row_count"),
        }
    ).drop("row_count")


def apply_bounds(
    df: DataFrame, rules: Sequence[Mapping], id_col: str = "user_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split rows by impossible values.  Rules have column, min and / or max, reason.

    Returns (kept rows, one audit row per rule, removed rows with their reasons).
    """
    used = [r for r in rules if r["column"] in df.columns]
    broken = []
    for r in used:
        c, bad = F.col(r["column"]).cast("double"), F.lit(False)
        if r.get("min") is not None:
            bad = bad | (c < r["min"])
        if r.get("max") is not None:
            bad = bad | (c > r["max"])
        broken.append(F.coalesce(bad, F.lit(False)))
    reason = [r.get("reason") or f"{r['column']} out of bounds" for r in used]
    flagged = df.withColumn(
        "invalid_reasons", F.array_compact(F.array(*[F.when(b, F.lit(t)) for b, t in zip(broken, reason)]))
    )
    kept = flagged.where(F.size("invalid_reasons") == 0).drop("invalid_reasons")
    shown = list(dict.fromkeys(r["column"] for r in used))
    removed = flagged.where(F.size("invalid_reasons") > 0).select(
        id_col, F.concat_ws("; ", "invalid_reasons").alias("invalid_reasons"), *[c for c in shown if c != id_col]
    )
    cells = [
        F.struct(
            F.lit(r["column"]).alias("column"),
            F.lit(r.get("min")).cast("double").alias("min_allowed"),
            F.lit(r.get("max")).cast("double").alias("max_allowed"),
            F.count_if(b).alias("invalid_count"),
            F.max(F.col(r["column"]).cast("double")).alias("max_observed"),
            F.min(F.col(r["column"]).cast("double")).alias("min_observed"),
            F.lit(t).alias("reason"),
        )
        for r, b, t in zip(used, broken, reason)
    ]
    audit = df.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))
    return kept, audit, removed


def isolated_extremes(
    df: DataFrame,
    cols: Sequence[str],
    id_col: str = "user_id",
    ratio: float = 10,
    at_most: int = 5,
    group_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Columns whose maximum is far above p99 because of a handful of rows, and those rows (with their group).

    A column is flagged only when 1 to `at_most` rows lie above p99, so candidates are few by definition.
    """
    audit = outlier_profile(df, cols, id_col, group_col=group_col).withColumn(
        "is_isolated",
        F.coalesce(
            (F.col("max_to_p99_ratio") >= ratio) & F.col("above_p99_count").between(1, at_most), F.lit(False)
        ),
    )
    flagged = audit.where("is_isolated").select("column", "p99", "max_to_p99_ratio").collect()
    parts = [
        df.where(F.col(r["column"]).cast("double") > r["p99"]).select(
            F.col(id_col),
            F.lit(r["column"]).alias("column"),
            F.col(r["column"]).cast("double").alias("value"),
            F.lit(r["p99"]).alias("p99"),
            F.lit(r["max_to_p99_ratio"]).alias("max_to_p99_ratio"),
            *([] if group_col is None else [F.col(group_col)]),
        )
        for r in flagged
    ]
    if parts:
        return audit, union_all(*parts)
    kind = dict(df.dtypes)[id_col]
    empty = f"{id_col} {kind}, column string, value double, p99 double, max_to_p99_ratio double"
    if group_col is not None:
        empty += f", {group_col} {dict(df.dtypes)[group_col]}"
    return audit, df.sparkSession.createDataFrame([], empty)


def sensitivity(base: DataFrame, reduced: DataFrame, by: Sequence[str], M: Sequence[MetricSpec]) -> DataFrame:
    """The same summary with and without the excluded rows, with differences."""
    return compare(summarize(base, by, M), summarize(reduced, by, M), by, [m.name for m in M])


def consistency(df: DataFrame, checks: Sequence[Mapping], unique_key: str | None = None) -> DataFrame:
    """Violations and rate of each check (name, severity, condition of a violation, action), in one pass."""
    cells = [
        F.struct(
            F.lit(c["check"]).alias("check"),
            F.lit(c.get("severity", "error")).alias("severity"),
            F.count_if(F.coalesce(F.expr(c["condition"]), F.lit(False))).alias("violations"),
            F.count(F.lit(1)).alias("_rows"),
            F.lit(c.get("action", "")).alias("action"),
        )
        for c in checks
    ]
    out = df.agg(F.array(*cells).alias("_all")).select(F.inline("_all"))
    if unique_key:
        per_key = df.groupBy(unique_key).agg(F.count(F.lit(1)).alias("_n"))
        repeats = per_key.agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        ).select(
            F.lit(f"{unique_key} repeated").alias("check"),
            F.lit("error").alias("severity"),
            "violations",
            "_rows",
            F.lit("rebuild or dedup").alias("action"),
        )
        out = out.unionByName(repeats)
    return out.select(
        "check", "severity", "violations", safe_div("violations", "_rows").alias("rate"), "action"
    )


def violations(report: DataFrame) -> DataFrame:
    """Only the checks that were violated."""
    return report.where("violations > 0")


def validate_result(
    df: DataFrame,
    key: str,
    required: Sequence[str],
    values: Sequence[str],
    min_rows: int = 1,
    allow_all_zero: bool = True,
    strict: bool = False,
) -> DataFrame:
    """One status row: error for missing columns or too few rows, warn (or error) when all values are 0."""
    absent = [c for c in [*required, *values] if c not in df.columns]
    present = [c for c in values if c in df.columns]
    total = F.lit(0.0)
    for c in present:
        total = total + F.coalesce(F.sum(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), F.lit(0.0))
    zero = F.lit(bool(values)) & (F.col("abs_sum") == 0)
    status = (
        F.when(F.lit(bool(absent)) | (F.col("row_count") < min_rows), "error")
        .when(zero, "warn" if allow_all_zero else "error")
        .otherwise("ok")
    )
    message = (
        F.when(F.lit(bool(absent)), F.lit("missing columns: " + ", ".join(absent)))
        .when(F.col("row_count") < min_rows, F.lit(f"fewer than {min_rows} rows"))
        .when(zero, "all values are 0")
        .otherwise("")
    )
    out = df.agg(F.count(F.lit(1)).alias("row_count"), total.alias("abs_sum")).select(
        F.lit(key).alias("result_key"), status.alias("status"), "row_count", "abs_sum", message.alias("message")
    )
    if strict:
        row = out.first()
        if row["status"] == "error":
            raise ValueError(f"{key}: {row['message']}")
    return out


def varying(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Which columns hold more than one value."""
    clean = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return per_column(clean, cols, {"varies": lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))})


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], names: tuple[str, str], out: str) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.corr(f"`{a}`", f"`{b}`").alias(out))
        for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))


def _matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, corr) for every pair of columns in one pass: each unordered pair is computed once and given both ways."""
    half = _pairs(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]], ("x", "y"), "corr")
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(
        F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    )
    return half.select(F.explode(sides).alias("_p"), "corr").select("_p.x", "_p.y", "corr")


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns that vary, missing values as 0, in one pass."""
    used = [r["column"] for r in varying(df, cols).collect() if r["varies"]]
    used = [c for c in cols if c in used]
    clean = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in used])
    return _matrix(clean, used)


def rank_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each row with its columns replaced by their average ranks; missing and infinite values count as 0.

    The cells are ranked while long, with one join on (column, value) and one grouping back to rows, so the number of
    shuffles does not depend on the number of columns.  A value that most rows share is one row of the rank table, and
    Spark splits the rows that meet it.
    """
    kinds = dict(df.dtypes)
    clean = df.select(*[(num(c, dtype=kinds[c]) + F.lit(0.0)).alias(c) for c in cols])
    # numbered and written once: the numbers must not change between the two reads
    clean = settle(clean.withColumn("_row", F.monotonically_increasing_id()))
    place = {c: i for i, c in enumerate(cols)}
    index = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))])
    table = average_ranks(clean, cols).select(F.element_at(index, F.col("column")).alias("_c"), F.col("value").alias("_v"), "rank")
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).alias("_v")) for c, i in place.items()])
    ranked = clean.select("_row", F.inline(cells)).join(table, ["_c", "_v"])
    return ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_c") == i, F.col("rank"))).alias(c) for c, i in place.items()]).drop("_row")


def spearman(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rank correlation of each feature with each target and its absolute value."""
    ranks = rank_columns(df, list(dict.fromkeys([*features, *targets])))
    out = _pairs(ranks, [(t, f) for t in targets for f in features], ("target", "feature"), "spearman_corr")
    return out.withColumn("abs_corr", F.abs("spearman_corr"))


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns that vary, (x, y, corr), from one rank pass."""
    used = {r["column"] for r in varying(df, cols).collect() if r["varies"]}
    used = [c for c in cols if c in used]
    return _matrix(rank_columns(df, used), used)


def winsorize(df: DataFrame, cols: Sequence[str], q: float = 0.99, on_zero_cap: str = "clip") -> DataFrame:
    """Cap columns at a quantile, missing values as 0.

    'clip' keeps values in [0, cap] even when the cap is 0; 'skip' caps from above only and leaves a column
    alone when its cap is 0 or less.
    """
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    caps = quantile_values(clean, cols, q)
    new = {}
    for c in cols:
        cap = caps[c]
        if cap is None or (on_zero_cap == "skip" and cap <= 0):
            continue
        top = F.least(F.col(c), F.lit(float(cap)))
        new[c] = top if on_zero_cap == "skip" else F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(cap)))
    return clean.withColumns(new) if new else clean


def value_sources(
    sources: Mapping[str, tuple[DataFrame, str | Column, str | Column | None]],
    users: DataFrame,
    W: Windows,
    snapshots: Mapping[str, tuple[DataFrame, str]] | None = None,
    date_col: str = "day",
) -> DataFrame:
    """Events, users and total value of several value candidates per window, side by side.

    `sources` maps a name to (fact, value, filter); `snapshots` maps a name to (user frame, balance column).
    """
    parts = []
    for name, (df, value, where) in sources.items():
        kept = df if where is None else df.where(F.expr(where) if isinstance(where, str) else where)
        per_user = window_metrics(
            kept.withColumn("_value", F.coalesce(col_of(value).cast("double"), F.lit(0.0))),
            users,
            W,
            [MetricSpec("n", "rows"), MetricSpec("v", "sum", "_value")],
            date_col=date_col,
        )
        cells = [
            F.struct(
                F.lit(name).alias("source"),
                F.lit(w).alias("window"),
                F.sum(f"n_{w}").alias("event_count"),
                F.count_if(F.col(f"n_{w}") > 0).alias("user_count"),
                F.sum(f"v_{w}").alias("total_value"),
            )
            for w in W
        ]
        parts.append(per_user.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows")))
    for name, (df, balance) in (snapshots or {}).items():
        held = F.col(balance).cast("double")
        parts.append(
            df.agg(
                F.count(held).alias("event_count"),
                F.count_distinct(F.when(held != 0, F.col("user_id"))).alias("user_count"),
                F.coalesce(F.sum(held), F.lit(0.0)).alias("total_value"),
            ).select(F.lit(name).alias("source"), F.lit("snapshot").alias("window"), "event_count", "user_count", "total_value")
        )
    return union_all(*parts)


def product_check(df: DataFrame, product_col: str, qty: str | Column, user_col: str = "user_id") -> DataFrame:
    """Payments, payers and quantity per product; a missing product stays as its own row."""
    q = col_of(qty).cast("double")
    return (
        df.groupBy(product_col)
        .agg(
            F.count(F.lit(1)).alias("payment_rows"),
            F.count_distinct(user_col).alias("paid_user_count"),
            F.min(q).alias("product_qty"),
            F.count_if(q.isNull()).alias("product_qty_missing"),
        )
        .withColumn("estimated_total_qty", F.col("payment_rows") * F.coalesce("product_qty", F.lit(0.0)))
    )


def metric_check(df: DataFrame, M: Sequence[MetricSpec]) -> DataFrame:
    """Metrics of the whole table as (metric, value) rows."""
    one = df.agg(*[aggregate_column(m).cast("double").alias(m.name) for m in M])
    return one.unpivot([], [m.name for m in M], "metric", "value")


# fixed values: columns that may hold each target, in order of preference
TARGET_CANDIDATES = {
    "returned": ["returned_d4_28", "retention_d4_28", "returned_d4_7", "retention_d4_7"],
    "paid": ["paid_d4_28", "paid_flag_d4_28", "payment_d4_28", "paid_d4_7", "paid_flag_d4_7", "payment_d4_7"],
    "payment_count": ["payment_count_d4_28", "payment_cnt_d4_28", "payment_count_d4_7", "payment_cnt_d4_7"],
    "active_days": ["active_days_d4_28", "active_days_d4_7"],
    "bought_hearts": [
        "bought_hearts_d4_28", "purchased_heart_cnt_d4_28", "payment_amount_d4_28",
        "bought_hearts_d4_7", "purchased_heart_cnt_d4_7", "payment_amount_d4_7",
    ],
}


def resolve_targets(
    df: DataFrame, candidates: Mapping[str, Sequence[str]] = TARGET_CANDIDATES
) -> tuple[dict[str, str], DataFrame, str]:
    """Chosen column per target, an audit table, and the window all chosen columns agree on.

    The audit also counts the values of the chosen column that are there and above 0 (the frame is read when it is used).
    """
    found = {t: [c for c in cs if c in df.columns] for t, cs in candidates.items()}
    chosen = {t: cs[0] for t, cs in found.items() if cs}
    audit = df.sparkSession.createDataFrame(
        [(t, chosen.get(t), ", ".join(cs), any(c.endswith("d4_28") for c in cs)) for t, cs in found.items()],
        "target_key string, selected_column string, available_candidates string, preferred_window_available boolean",
    )
    if chosen:
        counts = per_column(
            _as_double(df, list(chosen.values())),
            list(chosen.values()),
            {"value_count": F.count, "positive_count": lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0.0)) > 0)},
        )
        audit = audit.join(counts.withColumnRenamed("column", "selected_column"), "selected_column", "left")
    ends = {w for w in ("d4_28", "d4_7") if chosen and all(w in c for c in chosen.values())}
    return chosen, audit, ends.pop().upper().replace("_", "-D") if ends else "mixed"


def target_overview(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Counts, mean, extremes, median and positive share of each target column."""
    cols = list(targets.values())
    clean = _as_double(df, cols)
    positive = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0
    stats = per_column(
        clean,
        cols,
        {
            "row_count": F.count,
            "missing_count": lambda c: F.count_if(F.col(c).isNull()),
            "mean": F.avg,
            "min": F.min,
            "max": F.max,
            "positive_count": lambda c: F.count_if(positive(c)),
            "positive_rate": lambda c: F.try_divide(F.count_if(positive(c)), F.count(F.lit(1))),
        },
    )
    keys = df.sparkSession.createDataFrame([(k, c) for k, c in targets.items()], "target_key string, column string")
    return keys.join(stats, "column").join(quantiles(clean, cols, {"median": 0.5}), "column", "left")

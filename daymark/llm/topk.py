"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors are spread over candidate blocks and queries over query blocks of stated size; every (candidate block, query
block) pair is one task group.  Inside it the candidates become postings per term (component), each query scatters its
weighted postings into a dense array of scores, partition selection finds its k best, and the blocks' winners are merged.
A group holds one block of vectors, one of queries and one array of scores, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.session import settle, shuffle_parts

BLOCK, QUERY_BLOCK = 8192, 1024
HITS = "query_id long, vec_id long, score long"


def integer_vector(vec: Column, scale: int = 1024) -> Column:
    """floor(scale * x) per component as longs; NULL if the vector or a component is NULL or not finite."""
    x = F.transform(vec, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, row number and term number of every component."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return values, rows, terms


def search_block(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one block for each query (all, if fewer); ties to the smaller id."""
    ids = candidates["id"].to_numpy()
    values, rows, terms = _flat(candidates["vec"])
    order = np.argsort(terms, kind="stable")
    values, rows, terms = values[order], rows[order], terms[order]
    used = values != 0
    values, rows, terms = values[used], rows[used], terms[used]
    width = int(terms[-1]) + 1 if len(terms) else 0
    cuts = np.searchsorted(terms, np.arange(width + 1))
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query, vec in zip(queries["id"].to_pylist(), queries["vec"].to_pylist(), strict=True):
        scores = np.zeros(len(ids), np.int64)
        for term, weight in enumerate(vec[:width]):
            if weight:
                at = slice(cuts[term], cuts[term + 1])
                scores[rows[at]] += weight * values[at]  # a row has a term once, so nothing is added twice
        others = np.flatnonzero(ids != query)
        found = scores[others]
        if len(found) > k:
            least = np.partition(found, len(found) - k)[len(found) - k]
            others = others[found >= least]
        best = others[np.lexsort((ids[others], -scores[others]))][:k]
        hits.append((np.full(len(best), query, np.int64), ids[best], scores[best]))
    columns = [np.concatenate(c) for c in zip(*hits, strict=True)] if hits else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k highest scores among the other rows of `vectors`.

    Rows whose id is NULL, or whose vector is NULL or holds NULL or non-finite components, take no part.  Vectors of
    different lengths score over the components both have.  Rows that repeat a query's id are its own and not its
    candidates; of queries that repeat an id the least vector counts; other repeated rows are candidates one by one.
    Sums must fit in 64 bits.  Empty tables give an empty result; other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        ints = df.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vec_col), scale).alias("vec"))
        return ints.where("id IS NOT NULL AND vec IS NOT NULL")

    held = settle(usable(vectors))
    asked = settle(usable(queries).groupBy("id").agg(F.min("vec").alias("vec")))
    parts = max(shuffle_parts(vectors.sparkSession), -(-held.count() // block))
    query_parts = max(1, -(-asked.count() // query_block))
    left = held.select("*", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("cb"), _every(query_parts).alias("qb"))
    right = asked.select("*", F.pmod(F.xxhash64("id"), F.lit(query_parts)).alias("qb"), _every(parts).alias("cb"))
    hits = (
        left.groupBy("cb", "qb")
        .cogroup(right.groupBy("cb", "qb"))
        .applyInArrow(lambda c, q: search_block(c, q, k), HITS)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

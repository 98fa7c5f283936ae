"""Ranked lexical search with exact integer scores, by norm buckets as in LEMP.

A document is the vector of its impacts w(t) * tf'(t, d), a query a 0/1 vector over its terms, and a score is their inner
product.  Only terms that some query holds can score, so vectors are kept over those.

1. One pass over the texts counts all terms of each document and the occurrences of query terms.  The number of documents,
   of terms and of documents per term follow from these narrow rows.
2. Vectors are ordered by length (Euclidean norm) into ranges; each run of rows of one range is a bucket of vectors of
   nearly one length.
3. The longest vectors, about one bucket of them, give every query a first threshold: its k-th best score among them.
4. Every bucket is searched on its own.  By Cauchy-Schwarz a query skips a bucket whose greatest norm times its own
   is below the query's threshold.  Inside a bucket the query's rarest terms are its focus: a document stays only if each
   focus coordinate of its direction lies between the two bounds that the needed cosine leaves, and if the focus
   part plus the product of what is left of both norms reaches the threshold.  Survivors are scored in integers over
   all terms; better ones raise the threshold for the next bucket.
5. The buckets' best are merged per query.

Bounds are in doubles with a margin for rounding, and a document is left out only when it is strictly below a score that k
others reach, so results equal scoring everything.

Queries are taken in blocks of bounded text; what a block broadcasts (its terms, their weights, its queries' thresholds) is
bounded by `block_bytes` or by one query's text, whatever the number of documents and of queries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.llm.text import slices
from daymark.session import settle, shuffle_parts

ROWS = 256  # texts counted at once
BUCKET = 4096  # vectors of one bucket
FOCUS = 8  # terms of a query whose coordinates are bounded
BLOCK_BYTES = 8 << 20  # terms of one block of queries
MARGIN = 1e-9
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII; only A-Z lower-cased; NULL has none."""
    return (text or b"").translate(SPLIT).split()


def term_set(text: Column) -> Column:
    """The different terms of a text, in order."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [[t.decode() for t in sorted(set(terms(x)))] for x in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.array(found, pa.list_(pa.string()))

    return run(text)


def _counts(text: Column, vocabulary: Broadcast) -> Column:
    """Number of terms of a text, and number and occurrences of those in the vocabulary."""

    @F.arrow_udf("struct<n: long, terms: array<int>, tf: array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = vocabulary.value
        for texts in batches:
            n, found, times = [], [], []
            for some in slices(texts.cast(pa.large_binary()), ROWS):
                for text in some.to_pylist():
                    words = terms(text)
                    held = Counter(map(places.get, words))
                    held.pop(None, None)
                    n.append(len(words))
                    found.append(list(held))
                    times.append(list(held.values()))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                ["n", "terms", "tf"],
            )

    return run(text)


def weight(n_docs: int, n_holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_holding + 1)))


def _impacts(rows: DataFrame, weights: Broadcast, n_docs: int, n_terms: int) -> DataFrame:
    """(id, norm, terms, impacts) of the documents with an impact above 0; norms are rounded up.  No list is empty."""
    fields = [rows.schema["id"], T.StructField("norm", T.DoubleType())]
    fields += [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            at, where = _lists(batch["terms"])
            tf = batch["tf"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            # whole numbers of any size, as 90 * n * N may pass 64 bits before the division
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch["n"].to_pylist()], np.int64)
            impact = w[where] * (1000000000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at))))
            norm = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, at[:-1])) * (1 + MARGIN) if len(m) else np.zeros(0)
            parts = [
                batch["id"], pa.array(norm),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(where, pa.int32())),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(impact)),
            ]
            yield pa.RecordBatch.from_arrays(parts, ["id", "norm", "terms", "impacts"])

    return rows.mapInArrow(run, T.StructType(fields)).where("norm > 0")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins (and the last ends), and all values."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten().to_numpy(zero_copy_only=False)


class Bucket:
    """Vectors of one bucket by row and by term."""

    def __init__(self, ids: list, norms: np.ndarray, at: np.ndarray, where: np.ndarray, impacts: np.ndarray):
        self.ids, self.norms, self.at, self.where, self.impacts = ids, norms, at, where, impacts
        self.longest = float(norms.max(initial=0.0))
        rows = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.argsort(where, kind="stable")
        self.rows, self.by_term, self.sorted = rows[order], impacts[order], where[order]

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.sorted, [term, term + 1])
        return self.rows[low:high], self.by_term[low:high]

    def survivors(self, query: np.ndarray, least: float) -> np.ndarray:
        """Rows that may reach `least`; `query` holds its terms, rarest first."""
        if least <= 0:
            return np.arange(len(self.ids))
        length = math.sqrt(len(query))
        cosine = least / (length * self.longest) * (1 - MARGIN)
        if cosine > 1:
            return np.zeros(0, np.int64)
        part, left = np.zeros(len(self.ids)), self.norms**2
        stays = np.ones(len(self.ids), bool)
        side = 1 / length  # every coordinate of the query's direction
        spread = math.sqrt(max(0.0, 1 - side**2) * max(0.0, 1 - cosine**2))
        low, high = side * cosine - spread - MARGIN, 1.0 if cosine < side else side * cosine + spread + MARGIN
        for term in query[:FOCUS]:
            rows, impacts = self.postings(term)
            share = impacts / self.norms[rows]
            inside = (share >= low) & (share <= high)
            if low > 0:  # who lacks the term is out
                held = np.zeros(len(self.ids), bool)
                held[rows[inside]] = True
                stays &= held
            else:
                stays[rows[~inside]] = False
            part[rows] += impacts
            left[rows] -= impacts.astype(np.float64) ** 2
        rest = math.sqrt(max(0, len(query) - FOCUS))
        reach = part + rest * np.sqrt(np.maximum(left, 0) + MARGIN * self.norms**2)
        return np.flatnonzero(stays & (reach >= least * (1 - MARGIN)))

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of rows; `wanted` marks the query's terms."""
        lengths = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[rows] - ends + lengths, lengths)
        total = np.concatenate([[0], np.cumsum(self.impacts[places] * wanted[self.where[places]])])
        return total[ends] - total[ends - lengths]


def _key(hit: tuple):
    score, doc = hit
    return -score, doc is None, doc


def search_buckets(
    batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], least: list[int], k: int, n_terms: int
) -> list[list[tuple]]:
    """Per query the k best (score, id) of the batches that are not below the query's threshold."""
    best: list[list[tuple]] = [[] for _ in queries]
    least = list(least)
    wanted = np.zeros(n_terms, bool)
    for batch in batches:
        for some in slices(batch, BUCKET):
            at, where = _lists(some["terms"])
            bucket = Bucket(
                some["id"].to_pylist(), some["norm"].to_numpy(), at, where, some["impacts"].flatten().to_numpy(zero_copy_only=False)
            )
            for q, query in enumerate(queries):
                if math.sqrt(len(query)) * bucket.longest < least[q] * (1 - MARGIN):
                    continue
                rows = bucket.survivors(query, least[q])
                if not len(rows):
                    continue
                wanted[query] = True
                scores = bucket.scores(rows, wanted)
                wanted[query] = False
                cut = max(least[q], 1)
                if len(scores) > k:
                    cut = max(cut, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                good = np.flatnonzero(scores >= cut)
                if len(good):
                    hits = best[q] + [(int(scores[i]), bucket.ids[rows[i]]) for i in good]
                    best[q] = sorted(hits, key=_key)[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], best[q][-1][0])
    return best


def _hits(vectors: DataFrame, queries: Broadcast, least: Broadcast, k: int, n_terms: int) -> DataFrame:
    fields = [T.StructField("query", T.IntegerType()), vectors.schema["id"], T.StructField("score", T.LongType())]
    ids = vectors.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        found = search_buckets(batches, queries.value, least.value, k, n_terms)
        rows = [(q, doc, score) for q, hits in enumerate(found) for score, doc in hits]
        for at in range(0, len(rows), 10000):
            q, doc, score = zip(*rows[at : at + 10000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(doc, to_arrow_type(ids)), pa.array(score, pa.int64())],
                ["query", "id", "score"],
            )

    return vectors.mapInArrow(run, T.StructType(fields))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item, rank, id, score): for each item the k documents of highest score above 0 (all, if fewer).

    NULL and empty texts have no terms: such documents count nowhere and are never found, such items find nothing.  Equal
    scores go by ascending id, NULL ids last; rows that repeat an id are documents of their own.  Items that repeat an
    id and have the same terms are one query, other items that share an id are ranked each by themselves.  Empty tables
    give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), term_set(F.col(item_text)).alias("terms"))
    asked = settle(asked.where(F.size("terms") > 0).distinct())
    size = asked.agg(F.sum(F.length(F.array_join("terms", " ")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "terms"), F.lit(blocks))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"]
    found = [_search_block(spark, texts, asked.where(block == b), k).select(names) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _search_block(spark, texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.sort(F.col("item").asc_nulls_last(), "terms").collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    places = {t: i for i, t in enumerate(vocabulary)}
    numbers = [(q, r["item"]) for q, r in enumerate(rows)]
    named = spark.createDataFrame(numbers, T.StructType([T.StructField("query", T.IntegerType()), asked.schema["item"]]))

    sent = spark.sparkContext.broadcast({t.encode(): i for t, i in places.items()})
    held = settle(texts.select("id", _counts(F.col("text"), sent).alias("c")).select("id", "c.*").where("n > 0"))
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = dict(held.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    w = np.array([weight(n_docs, holding.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    used = held.where(F.size("terms") > 0)
    vectors = _impacts(used, spark.sparkContext.broadcast(w), n_docs, n_terms or 1)
    parts = max(shuffle_parts(spark), -(-(n_docs or 0) // (16 * BUCKET)))
    spread = F.xxhash64("id", "terms")  # vectors of one length may be many
    ordered = settle(vectors.repartitionByRange(parts, F.desc("norm"), spread).sortWithinPartitions(F.desc("norm")))

    queries = [np.array([places[t] for t in r["terms"]]) for r in rows]
    queries = spark.sparkContext.broadcast([q[np.argsort(-w[q], kind="stable")] for q in queries])
    nothing = spark.sparkContext.broadcast([0] * len(rows))
    share = 1 - min(1.0, BUCKET / max(n_docs or 0, 1))
    cut = ordered.agg(F.percentile_approx("norm", share, 10000)).first()[0] or 0.0
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    first = _hits(ordered.where(F.col("norm") >= cut), queries, nothing, k, len(vocabulary))
    reached = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    reached = reached.select("query", F.col("score").alias("least")).collect()
    least = {r["query"]: r["least"] for r in reached}
    least = spark.sparkContext.broadcast([least.get(q, 0) for q in range(len(rows))])
    hits = _hits(ordered, queries, least, k, len(vocabulary))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(named), "query")

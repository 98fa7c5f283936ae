"""Toxicity scores by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits, each counted once per text.  Every term is hashed into one of a fixed
number of features; no term is left out but those whose feature occurs in fewer than `LEAST_TEXTS` training texts.  The
machine has a weight per feature and a short vector per feature whose inner products weigh pairs of terms, such as an
insult with a group's name.  Which of them count is decided by the penalties inside the fit:

- a weight moves off zero only if its gradient exceeds `CLEAR` of its standard errors under chance;
- the vectors begin as the leading directions in which pairs of terms explain what the weights leave, and carry a ridge at
  `EDGE` times the strength that such directions reach by chance, which is measured by shuffling what is left between the
  texts.  Where no direction is stronger there are no vectors; a pair of terms that tell nothing alone is found;
- a last phase frees the surviving weights and vectors from most of both penalties, so that they are not too small.

The machine is fitted in one task on a bounded sample of labelled texts (`TRAIN_ROWS` per class; its memory is that of their
features).  What survives, at most one row per feature, is written as a table, and every text is scored as a whole.

Only labelled rows named as training rows are read for learning, and only a text's own words enter its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.session import settle

TRAIN_ROWS = 5000  # labelled texts per class that are learned from, at most; the lowest hashes of their ids
LEAST_TEXTS = 3  # training texts that a feature occurs in, at least
FEATURES = 1 << 18
FACTORS = 4
CLEAR, EDGE, FREED = 3.0, 1.2, 0.05  # penalties, and their share in the last phase
ROUNDS = (100, 100, 100)  # steps on the weights alone, on weights and vectors, and on what survived
SHUFFLES, TURNS = 3, 15  # to measure chance, and power iterations
FOLDS = 5


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is 0 modulo `folds`; never for NULL ids."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))


def terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), "")


def features(text: Column, n: int = FEATURES) -> Column:
    """The different features of a text's terms."""
    return F.array_distinct(F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(n)).cast("int")))


def training_ids(labels: DataFrame, id_col: str, label_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, label) of at most `rows` labelled ids per class that are not held out; ids with two labels are left out."""
    usable = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .where("label = high").select("id", "label")
    )
    order = [F.xxhash64("id"), F.col("id")]
    return usable.where("label = 1").orderBy(*order).limit(rows).unionByName(
        usable.where("label = 0").orderBy(*order).limit(rows)
    )


class Machine:
    """The fit: a constant, and a weight and a vector per feature, from rows that are arrays of present features."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, seed: int = 7):
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        names, column, held = np.unique(flat, return_inverse=True, return_counts=True)
        common = held >= LEAST_TEXTS
        present = common[column]
        self.names, held, self.n = names[common], held[common], len(rows)
        self.column = (np.cumsum(common) - 1)[column[present]]
        row = np.repeat(np.arange(self.n), [len(r) for r in rows])[present]
        self.filled, self.row_at = np.unique(row, return_index=True)
        by_column = np.argsort(self.column, kind="stable")
        self.row_of = row[by_column]
        self.column_at = np.searchsorted(self.column[by_column], np.arange(len(self.names)))
        self.labels = labels.astype(float)
        share = self.labels.mean()
        self.constant = float(np.log(share / (1 - share)))
        self.weights = np.zeros(len(self.names))
        self.vectors, self.draw = np.zeros((len(self.names), factors)), np.random.default_rng(seed)
        # standard error of a weight's gradient where the feature is independent of the label
        self.error = np.sqrt(held * share * (1 - share) * np.maximum(1 - held / self.n, 1e-9)) / self.n

    def by_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, *values.shape[1:]))
        out[self.filled] = np.add.reduceat(values[self.column], self.row_at, axis=0)
        return out

    def by_column(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.row_of], self.column_at, axis=0)

    def steps(self, n: int, clear: float, ridge: float, weighed: np.ndarray, paired: np.ndarray) -> None:
        """`n` proximal steps on the weights of `weighed` features and steps with momentum on the vectors of `paired` ones."""
        gone, gone_constant, speed, rate, last, pairs = np.full(len(self.names), 1e-12), 1e-12, 0.0, 0.5, np.inf, paired.any()
        for _ in range(n):
            value = self.constant + self.by_row(self.weights)
            if pairs:
                sums = self.by_row(self.vectors)
                value += 0.5 * ((sums**2).sum(1) - self.by_row((self.vectors**2).sum(1)))
            value = np.clip(value, -30, 30)
            slope = (1 / (1 + np.exp(-value)) - self.labels) / self.n
            slopes = self.by_column(slope)
            if pairs:
                loss = np.mean(np.logaddexp(0, value) - self.labels * value) + 0.5 * ridge * (self.vectors**2).sum()
                loss += clear * (self.error * np.abs(self.weights)).sum()
                rate, speed = (rate / 2, 0.0) if loss > last + 1e-6 else (min(rate * 1.05, 4.0), speed)
                last = loss
                bent = self.by_column(slope[:, None] * sums) + (ridge - slopes[:, None]) * self.vectors
                speed = 0.9 * speed - rate * bent
                self.vectors = np.where(paired[:, None], self.vectors + speed, 0.0)
            gone += slopes**2
            step = 0.5 / np.sqrt(gone)
            moved = self.weights - step * slopes
            self.weights = np.where(weighed, np.sign(moved) * np.maximum(np.abs(moved) - step * clear * self.error, 0), 0.0)
            gone_constant += slope.sum() ** 2
            self.constant -= 0.3 * slope.sum() / np.sqrt(gone_constant)

    def chance(self, left: np.ndarray) -> float:
        """The greatest strength of a direction when `left` is shuffled between the rows."""
        left = self.draw.permutation(left)
        own, x = self.by_column(left), self.draw.normal(size=len(self.names))
        for _ in range(TURNS):
            x = x / max(np.linalg.norm(x), 1e-300)
            x = self.by_column(left * self.by_row(x)) - own * x
        return float(np.linalg.norm(x))

    def directions(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strengths of the leading directions in which pairs explain `left`, one per factor, and the directions."""
        own = self.by_column(left)[:, None]

        def pull(x: np.ndarray) -> np.ndarray:
            return self.by_column(left[:, None] * self.by_row(x)) - own * x

        def lead(x: np.ndarray, shift: float) -> np.ndarray:
            for _ in range(TURNS):
                x = np.linalg.qr(pull(x) + shift * x)[0]
            return x

        start = self.draw.normal(size=self.vectors.shape)
        widest = np.abs(np.linalg.eigvalsh((x := lead(start, 0.0)).T @ pull(x))).max()
        x = lead(start, widest)  # the shift puts the greatest strengths before the least
        strength, turn = np.linalg.eigh(x.T @ pull(x))
        return strength, x @ turn

    def fit(self, clear: float = CLEAR, edge: float = EDGE, rounds: tuple[int, int, int] = ROUNDS) -> Machine:
        if len(self.names) < self.vectors.shape[1]:
            return self
        every, none = np.ones(len(self.names), bool), np.zeros(len(self.names), bool)
        self.steps(rounds[0], clear, 0.0, every, none)
        value = np.clip(self.constant + self.by_row(self.weights), -30, 30)
        left = (self.labels - 1 / (1 + np.exp(-value))) / self.n
        ridge = edge * max(self.chance(left) for _ in range(SHUFFLES))
        strength, found = self.directions(left)
        paired = none
        if (strength > ridge).any():
            self.vectors = np.where(strength > ridge, 0.5 * found, 0.0)
            self.steps(rounds[1], clear, ridge, every, every)
            length = np.sqrt((self.vectors**2).sum(1))
            paired = length > max(0.1 * length.max(), 1e-3)
        self.vectors[~paired] = 0.0
        self.steps(rounds[2], clear * FREED, ridge * FREED, (self.weights != 0) | paired, paired)
        return self


def machine_scores(found: pa.ListArray, constant: float, names: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Probabilities of label 1 for rows of present features; features that the machine does not know count nothing."""
    flat = found.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
    at = np.searchsorted(names, flat)
    known = at < len(names)
    known[known] = names[at[known]] == flat[known]
    at, row = at[known], row[known]
    value = constant + np.bincount(row, weights[at], len(found))
    for vector in vectors.T:
        value += 0.5 * (np.bincount(row, vector[at], len(found)) ** 2 - np.bincount(row, vector[at] ** 2, len(found)))
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


class ToxicityModel:
    """Fit on labelled texts, then score any texts.

    With labels of one class only (or none) there is nothing to learn, and every score is the share of label 1 (or 0).
    `model` is a table of (feature, weight, vector), one row per feature that counts, and the constant under feature -1.
    """

    def __init__(
        self, seed: int = 7, features: int = FEATURES, factors: int = FACTORS, clear: float = CLEAR, edge: float = EDGE,
        rounds: tuple[int, int, int] = ROUNDS,
    ):
        self.seed, self.features, self.factors, self.clear, self.edge, self.rounds = seed, features, factors, clear, edge, rounds
        self.constant: float | None = 0.0
        self.model: DataFrame | None = None

    def fit(
        self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = TRAIN_ROWS,
    ) -> ToxicityModel:
        # 2 * rows ids at most, so the broadcast is bounded and whole texts are not shuffled
        ids = settle(training_ids(labels, id_col, label_col, rows))
        own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        found = own.join(F.broadcast(ids), "id").select("label", F.array_sort(features(F.col("text"), self.features)).alias("found"))
        train = settle(found.distinct())  # copies of a text teach nothing more
        sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2:
            self.constant, self.model = float(1 in sizes), None
            return self
        self.constant = None
        seed, factors, clear, edge, rounds = self.seed, self.factors, self.clear, self.edge, self.rounds

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = []
            for batch in batches:
                found, labels = batch.column("found"), batch.column("label").to_numpy(zero_copy_only=False)
                cuts = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))[:-1]
                told += zip(labels.tolist(), np.split(found.flatten().to_numpy(zero_copy_only=False), cuts), strict=True)
            told.sort(key=lambda x: (x[0], x[1].tobytes()))  # the same fit in whatever order the rows come
            machine = Machine([x[1] for x in told], np.array([x[0] for x in told]), factors, seed).fit(clear, edge, rounds)
            counts = (machine.weights != 0) | (machine.vectors != 0).any(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *machine.names[counts].tolist()], pa.int32()),
                    pa.array([machine.constant, *machine.weights[counts].tolist()], pa.float64()),
                    pa.array([[0.0] * factors, *machine.vectors[counts].tolist()], pa.list_(pa.float64())),
                ],
                ["feature", "weight", "vector"],
            )

        # one task: 2 * rows arrays of features at most
        fitted = train.coalesce(1).mapInArrow(learn, "feature int, weight double, vector array<double>")
        self.model = settle(fitted)
        return self

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row of `docs`: id, held_out, score, predicted.  NULL and empty texts are scored on no terms."""
        if self.model is None:
            score = F.lit(self.constant)
        else:
            known = self.model.orderBy("feature").collect()  # one row per feature at most, the constant first
            constant, known = known[0]["weight"], known[1:]
            names, weights = np.array([r["feature"] for r in known], np.int64), np.array([r["weight"] for r in known], float)
            vectors = np.array([r["vector"] for r in known], float).reshape(len(known), self.factors)

            @F.arrow_udf("double")
            def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for found in batches:
                    yield pa.array(machine_scores(found, constant, names, weights, vectors), pa.float64())

            score = scored(features(F.col(text_col), self.features))
        return docs.select(F.col(id_col), score.alias("score")).select(
            id_col,
            held_out(F.col(id_col)).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit on `labels` and score every row of `docs`.

    NULL ids are scored but never learned from or held out; repeated ids are scored row by row; labels other than 0 and
    1 and ids labelled both ways are not used.  Other columns are not read.
    """
    return ToxicityModel().fit(docs, labels, id_col, text_col, label_col).score(docs, id_col, text_col)

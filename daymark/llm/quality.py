"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Base counts come from the whole text.  Rates made of them (whole numbers) go into a sketch: a histogram over values up
to 63 exactly and 32 buckets per power of two above, so a quantile is at most 1/32 too low.  Sketches add up: one
grouped count over (language, source) is combined before the shuffle, and a language's or the whole corpus's sketch is
the sum of those of its parts.  A group with fewer than `min_rows` documents takes its language's threshold, a language
with fewer the corpus's.

The threshold is median + reach * max(spread, least spread), where spread is the distance from the median to the 75 %
quantile; for the mean word length there is also a lower one.  It adapts to a group's habits, and as it hangs on the
middle of the distribution, junk below a quarter of a group does not move it.  The least spread keeps groups whose
clean texts are all alike from rejecting ordinary texts.  Verdicts join the small threshold table back to the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.text import key
from daymark.session import settle

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
NAMES = [c.split()[0] for c in COUNTS.split(", ")]
# fixed values of the data contract
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20

# rate, its expression, the least spread, lower threshold too
RATES = {
    "symbol_rate": ("10000 * n_symbols div nullif(n_words, 0)", 200, False),  # per 10,000 words
    "dup_rate": ("10000 * n_dup_lines div nullif(n_lines, 0)", 1500, False),  # per 10,000 lines with a word
    "repeat_rate": ("10000 * n_repeat_words div nullif(n_words, 0)", 350, False),  # per 10,000 words
    "upper_rate": ("10000 * n_upper div nullif(word_chars, 0)", 400, False),  # per 10,000 characters
    "word_length": ("100 * word_chars div nullif(n_words, 0)", 40, True),  # hundredths of a character
}
REACH = 6
MIN_ROWS = 200

_UPPER = bytes(range(65, 91))


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS for one whole text; all zero for NULL."""
    raw = (text or "").encode()
    words = raw.split()  # on bytes these are exactly the separators of the word rule
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    gaps = sum(raw.count(c) for c in b"\x20\t\n\v\f\r")
    return (
        len(words),
        len(text or "") - gaps,
        sum(raw.count(c) for c in SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
    )


def counts(text: Column) -> Column:
    """The base counts of a text column as a struct."""

    @F.arrow_udf("struct<" + re.sub(r"(\w+) (\w+)", r"\1: \2", COUNTS) + ">")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [count_text(t) for t in texts.to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return count.asNondeterministic()(text)


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words")


def bucket(value: str) -> str:
    """SQL of a whole number's sketch bucket."""
    shift = f"greatest(0, length(bin({value})) - 6)"
    return f"32 * {shift} + shiftright({value}, {shift})"


def bucket_low(code: str) -> str:
    """SQL of the least value in a bucket."""
    shift = f"greatest(0, cast({code} div 32 as int) - 1)"
    return f"shiftleft({code} - 32 * {shift}, {shift})"


def _rates(counted: DataFrame) -> DataFrame:
    return counted.selectExpr("lang_key", "source_key", *[f"{sql} AS {name}" for name, (sql, _, _) in RATES.items()])


def sketch(counted: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, code, n): one mergeable sketch per group, of documents that pass the base rules."""
    long = _rates(counted.where(~base_failed())).unpivot(["lang_key", "source_key"], list(RATES), "rate", "value")
    return long.groupBy("lang_key", "source_key", "rate", F.expr(bucket("value")).alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _limits(sketches: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Thresholds per `by` and rate from the merged sketches; a group holds at most one row per bucket."""
    merged = sketches.groupBy(*by, "rate", "code").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "rate")
    upto = whole.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))

    def at(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.expr(bucket_low("code"))))

    least = F.element_at(F.create_map(*[F.lit(x) for n, (_, s, _) in RATES.items() for x in (n, s)]), F.col("rate"))
    two_sided = F.col("rate").isin([n for n, (_, _, two) in RATES.items() if two])
    found = placed.groupBy(*by, "rate").agg(
        F.max("total").alias("rows"), at(50).alias("q50"), at(75).alias("q75"), at(25).alias("q25")
    )
    return found.select(
        *by,
        "rate",
        "rows",
        (F.col("q50") + reach * F.greatest(F.col("q75") - F.col("q50"), least)).alias("high"),
        F.when(two_sided, F.col("q50") - reach * F.greatest(F.col("q50") - F.col("q25"), least)).alias("low"),
    )


def thresholds(sketches: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """(lang_key, source_key, limits): per group a map from rate to its (high, low)."""
    own = _limits(sketches, ["lang_key", "source_key"], reach)
    lang = _limits(sketches, ["lang_key"], reach).selectExpr(
        "lang_key", "rate", "rows AS lang_rows", "high AS lang_high", "low AS lang_low"
    )
    corpus = _limits(sketches, [], reach).selectExpr("rate", "high AS all_high", "low AS all_low")
    picked = own.join(lang, ["lang_key", "rate"]).join(corpus, "rate").select(
        "lang_key",
        "source_key",
        "rate",
        *[
            F.when(F.col("rows") >= min_rows, F.col(c))
            .when(F.col("lang_rows") >= min_rows, F.col(f"lang_{c}"))
            .otherwise(F.col(f"all_{c}"))
            .alias(c)
            for c in ("high", "low")
        ],
    )
    columns = [
        F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{name}_{side}") for name in RATES for side in ("high", "low")
    ]
    return picked.groupBy("lang_key", "source_key").agg(*columns)


def _verdict() -> Column:
    inside = []
    for name, (sql, _, two) in RATES.items():
        inside.append(F.expr(sql) <= F.col(f"{name}_high"))
        if two:
            inside.append(F.expr(sql) >= F.col(f"{name}_low"))
    kept = inside[0]
    for test in inside[1:]:
        kept = kept & test
    return F.coalesce(~base_failed() & kept, F.lit(False))


def _counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return settle(
        docs.select(
            F.col(id_col).alias("id"),
            key(F.col(lang_col)).alias("lang_key"),
            key(F.col(source_col)).alias("source_key"),
            counts(F.col(text_col)).alias("c"),
        ).select("id", "lang_key", "source_key", "c.*")
    )


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_rows: int = MIN_ROWS,
    reach: int = REACH,
) -> DataFrame:
    """Per row of `docs`: id, the base counts, `base_failed` and `kept`; other columns are not read.

    NULL and empty texts have no words and fail the base rules.  NULL languages and sources are groups of their own.
    Repeated ids and rows are judged row by row.  An empty table gives an empty result.
    """
    counted = _counted(docs, id_col, text_col, lang_col, source_col)
    limits = settle(thresholds(settle(sketch(counted)), min_rows, reach))
    return counted.join(limits, ["lang_key", "source_key"], "left").select(
        F.col("id").alias(id_col), *NAMES, base_failed().alias("base_failed"), _verdict().alias("kept")
    )


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_rows: int = MIN_ROWS,
    reach: int = REACH,
) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their columns.

    The counts are computed again beside the row instead of joining by id, so that whole texts are not shuffled and
    repeated or NULL ids do no harm.
    """
    counted = _counted(docs, id_col, text_col, lang_col, source_col)
    limits = settle(thresholds(settle(sketch(counted)), min_rows, reach))
    fields = [F.col(f"`{c}`") for c in docs.columns]
    beside = docs.select(
        F.struct(*fields).alias("row"),
        key(F.col(lang_col)).alias("lang_key"),
        key(F.col(source_col)).alias("source_key"),
        counts(F.col(text_col)).alias("c"),
    ).select("row", "lang_key", "source_key", "c.*")
    return beside.join(limits, ["lang_key", "source_key"], "left").where(_verdict()).select("row.*")

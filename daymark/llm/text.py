"""What several corpus operators share: the word rule and keys that tell NULL from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the word rule and its separators are fixed by the data contract
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, GAP), "")), F.lit(0)).cast("long")


def key(c: Column) -> Column:
    """A text key that is never NULL: `=value`, or `-` for NULL, which sorts before every value's key."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def slices(rows, n: int):
    """An Arrow array or batch in pieces of at most `n` rows, so that few texts are unpacked at once."""
    for at in range(0, len(rows), n):
        yield rows.slice(at, n)

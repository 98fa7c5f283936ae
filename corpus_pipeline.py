"""From raw documents to mixed, clean token sequences: five stages, each an operator of `daymark.llm`.

Every stage reads what the one before it wrote, and all but the last return the columns of documents.  The result has one
row per copy of a document in the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.llm import bpe, mixing, pii, quality, simhash
from daymark.session import settle, tune

RANKS = "byte_bpe_multi_50k.tiktoken"
ORACLE_SQL = None  # learned spans and byte-pair merges have no SQL form; tests compare each stage with brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's learned thresholds.

    NULL, empty and blank texts have no words and go; NULL lang or source is a group of its own; repeated rows are judged
    one by one, alike; an empty table stays empty.
    """
    tune(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of fingerprints (three words) linked by at most two bits.

    Texts without words share fingerprint zero; NULL ids come after all others; of rows that repeat id and fingerprint
    one is kept; an empty table stays empty.
    """
    tune(spark)
    return simhash.keep_first(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced by its kind, and their new length.

    NULL texts stay NULL with NULL length; repeated rows are handled one by one; an empty table stays empty.
    """
    tune(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target shares.

    NULL sources are one source, last in order; documents without words weigh nothing; ties in size follow a seeded hash
    of the id; an empty table stays empty.
    """
    tune(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, one row per document of the mix.

    NULL and empty texts have no tokens and the digests of nothing; repeated rows stay; an empty table gives no rows.
    """
    tune(spark)
    return bpe.token_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", redact_pii),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

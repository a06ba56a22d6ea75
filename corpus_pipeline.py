"""The corpus pipeline: quality, line dedup, near-dedup, mixing and tokenisation of ``documents``.

Each stage is (spark, docs, sf_dir) -> DataFrame over all its predecessor kept; all but the last return the columns of
documents, with n_chars as the text's length where a stage changes texts.

Defined cases, in every stage: an empty table gives an empty result; other columns are carried whatever their names; texts
are never cut. Quality scores null and empty texts like any others. Line dedup keeps null texts null and all rows, also
those that share an id. Near-dedup keeps rows with null ids and texts without words, and of rows that share an id one.
Mixing keeps every row at least once; rows that share id and text are repeated alike. Tokens of null texts are none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, linededup, minhash, mixing, quality
from docloom.llm.common import materialize, plain

#: SQL can't express the trained stages; tests compare them with brute-force versions.
ORACLE_SQL = None

#: Target shares of languages, as the mixing stage's classifier sees them.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    ranker = quality.fit(docs.select("doc_id", "text"), labels, F.lit(True))
    rows, (key, text) = plain(docs, "doc_id", "text")
    scored = quality.score(rows, ranker, key, text, rows.columns).filter(F.col("score") >= quality.THRESHOLD)
    return scored.select(*rows.columns).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier one has."""
    out = linededup.without_repeated_chunks(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates. No rate is under 1, so no document is lost: short domains are repeated."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    mixed = mixing.mix(docs.select("doc_id", "text", "lang"), labels, TARGETS, lowest=1.0, upsample=True)
    return mixing.resampled(docs, mixed)


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokenise", tokenise_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

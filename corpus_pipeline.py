"""The corpus pipeline: language ID, line dedup, near-duplicates, source mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, materialize, read_table
from factloom.llm.langid import keep_identified
from factloom.llm.lines import keep_first_lines
from factloom.llm.mixing import mixed_documents
from factloom.llm.piece_bpe import piece_tokens
from factloom.llm.simhash import STAGE, drop_near_duplicates
from factloom.scratch import discard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those of which no language holds a fifth of the n-grams go."""
    bound_batches(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; documents of which nothing is left go."""
    return keep_first_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles to 0.8 or more the one with the smallest id stays; fingerprints propose, sets decide."""
    bound_batches(spark)
    return drop_near_duplicates(docs, **STAGE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, whole; perhaps never."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy, as count and digests, and what they decode to."""
    bound_batches(spark)
    return piece_tokens(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: Fingerprints, trained filters and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

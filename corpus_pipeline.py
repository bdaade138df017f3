"""The corpus pipeline: five stages, each written and read again as the next one's documents.

All stages but the last return the columns of documents; each decision takes effect in what the next stage gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, common, line_dedup, minhash, mixing, quality_classifier, queries

#: Documents score from 0 (junk) to 1; those below go.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = queries.quality_model(spark, docs, sf_dir)
    scored = quality_classifier.score(docs, model, meta=("n_chars",))
    return scored.filter(F.col("score") >= LEAST_SCORE).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; one that such runs leave without a word goes, as a copy."""
    out = line_dedup.line_dedup(docs)
    left = (F.col("n_removed_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines"))
    return out.filter(left).withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without an id and repeated rows belong to groups like others."""
    return minhash.one_of_each(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source take it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix, with the digests of its ids and of the bytes that they decode to."""
    return byte_bpe.encode(docs, *queries.byte_bpe())


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL can't express the classifier's scores or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

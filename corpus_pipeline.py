"""Cleaning of a document corpus in stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanspark.llm._shared import Scratch
from gleanspark.llm.crf_quality import keep_good
from gleanspark.llm.jaccard_join import one_of_each
from gleanspark.llm.packing import pack
from gleanspark.llm.secret_scan import redact_secrets
from gleanspark.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is under one half go; the labels of sf_dir train the classifier."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5, sample=4000)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return one_of_each(docs, t=0.7, n=2)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that came before are cut; documents of which nothing is left go."""
    return remove_repeats(docs, least=50)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark."""
    return redact_secrets(docs, threshold=0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: a row for each piece of a document."""
    return pack(docs, capacity=2048)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeats), ("secret_scan", secrets), ("best_fit_packing", packing)]

#: The classifier, the scan and the packing have no SQL form, so there is none for the whole; the stages' operators are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs

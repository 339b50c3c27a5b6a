"""A training corpus from documents: language, exact copies, near copies, source mix, packing.

Each stage works on all rows that the stage before kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import bounded, column, fresh, shared_dir
from tarn.llm.exact_dedup import drop_copies
from tarn.llm.jaccard import one_of_each_class
from tarn.llm.language_id import annotate, fit_language_model
from tarn.llm.mixing import mixed_documents
from tarn.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those in none (``und``: null, or without a letter) go. lang is what was found."""
    bounded(spark)
    found, score = fresh(docs, "_lang", "_score")
    rows = annotate(docs, fit_language_model(docs), lang_as=found, score_as=score).filter(F.col(found) != "und")
    return rows.withColumn("lang", F.col(found)).select(*[column(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal up to white space."""
    bounded(spark)
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingle sets with Jaccard similarity 0.8 or more."""
    bounded(spark)
    return one_of_each_class(docs, width=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it, once or twice whole, or not at all."""
    bounded(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's tokens in sequences of the permitted lengths."""
    bounded(spark)
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: Trained kernels and packing are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

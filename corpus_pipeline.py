"""Corpus pipeline: documents to a weighted training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  The stages
up to the last return the columns of ``documents``; the result of each is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loadcurve.llm import decontaminate, mixing, ngram_join, quality, secret_scan
from loadcurve.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more).

    The classifier is fitted on labelled rows of ``documents`` as it came.
    """
    model = quality.fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, "__score__").filter("__score__ >= 0.3").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard of 0.8 or more.

    The one with the group's smallest id stays.  Rows are judged by their texts:
    copies without an id go, different texts that repeat an id stay.  Rows
    without words stay.
    """
    return ngram_join.without_near_copies(docs, ngram=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (similarity of 0.8 or more); each row is judged by its own text."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"), by_id=False)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark; ``n_chars`` follows."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in a mix of the sources at tempered weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier and hashed search cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, through Parquet in the shared folder."""
    base = f"{checkpoint_dir(spark)}/loadcurve/pipeline-{uuid.uuid4().hex[:12]}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

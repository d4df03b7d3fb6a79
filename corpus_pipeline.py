"""A training corpus from raw documents: quality, near copies, contamination, personal data, packing.

Each stage works on what its predecessor kept and, but for the last, returns the columns of
``documents``; every result is written down and read again before the next stage starts, which then
deletes what its predecessor has left in the shared folder.

Defined cases, for every stage: null and empty texts, repeated rows, null ids, an empty table and other
columns, whatever their names, do no harm; but for the last stage all columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmoor.functions.staging import drop_folders, recorded, stage
from sparkmoor.llm import decontaminate, jaccard, packing, pii, quality
from sparkmoor.session import ship_package
from sparkmoor.sources.tables import table


NEAR = jaccard.Params(width=5, percent=80)
BATCH_ROWS = 1024   # documents that go to a Python worker at a time, and that both sides hold at once

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}   # by application, folders that the last stage's result is made of


def tidy(step: Stage) -> Stage:
    """Before a stage, delete what the one before left, unless its result has not been written yet."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(size, "10000")) <= BATCH_ROWS:
            spark.conf.set(size, str(BATCH_ROWS))
        app = spark.sparkContext.applicationId
        drop_folders(spark, _left.pop(app, []), docs)
        with recorded() as paths:
            out = step(spark, docs, sf_dir)
        _left[app] = paths
        return out

    run.__doc__, run.__name__ = step.__doc__, step.__name__
    return run


@tidy
def host_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host fails too often, go; one without words fails."""
    return quality.quality_filter(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays; documents
    without words stay, and so do rows without an id that have no copy with one."""
    return jaccard.one_of_each(docs, params=NEAR)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go, or with all of a shorter item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; ``n_chars`` follows.  A null text stays null."""
    masked = pii.mask_texts(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


@tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2,048 tokens; a null text is an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", host_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None  # SQL has no tokenizer; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs

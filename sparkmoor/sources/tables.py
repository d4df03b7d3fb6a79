"""Readers for the Parquet tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread_out(scan: DataFrame) -> DataFrame:
    """Use all cores on a scan of few splits, such as one small file.

    Splits without a row group of their own do no work, hence the plain comparison.  Tables
    with at least as many splits as cores are left alone: nothing is added to their plan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")

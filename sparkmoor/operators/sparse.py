"""Sparse matrix-vector products, scatter writes and result checks on (row, col, val) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import Staged, keyed_join, stage_counted


def _sums(matrix: DataFrame, x: Staged, rows: DataFrame) -> DataFrame:
    """sum val * x per row.  The product is linear, so copies of a cell need not be added up first:
    only the partial sums of rows are shuffled.

    A small selection filters the cells first.  A large one does not: filtering would shuffle
    the cells by row, where a hot row is one task, while the sums per row are already small.
    """
    wanted = stage_counted(rows.select("row").distinct())
    if wanted.broadcastable:
        matrix = matrix.join(F.broadcast(wanted.df), "row", "left_semi")
    hit = keyed_join(matrix.select("row", "col", "val"), x, ["col"])
    return hit.groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def wrapped(selected: DataFrame, n_rows: int) -> DataFrame:
    """Row indices beyond the matrix wrap around."""
    return selected.withColumn("row", F.pmod("row", F.lit(n_rows)))


def spmv_rows(matrix: DataFrame, x: Staged, selected: DataFrame, n_rows: int) -> DataFrame:
    """(row, y) of the selected rows; a row without cells gives 0."""
    rows = wrapped(selected.select("row"), n_rows).distinct()
    return rows.join(_sums(matrix, x, rows), "row", "left").select("row", F.coalesce("y", F.lit(0.0)).alias("y"))


def spmv_positions(matrix: DataFrame, x: Staged, selected: DataFrame, n_rows: int) -> DataFrame:
    """(place, y) with one result per position of the selection."""
    rows = wrapped(selected.select("place", "row"), n_rows)
    return rows.join(_sums(matrix, x, rows), "row", "left").select("place", F.coalesce("y", F.lit(0.0)).alias("y"))


def count_mismatches(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-5) -> DataFrame:
    """Rows compared and rows whose values differ by more than the tolerance."""
    other = right.select(key, F.col(value).alias("_expected"))
    return left.join(other, key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(F.col(value) - F.col("_expected")) > tolerance).alias("n_errors"))


def scatter(buffer: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """(idx, value) after the writes (dest, data); the last in ``order`` wins, others outside
    the buffer are ignored."""
    last = writes.groupBy(F.col("dest").alias("idx")).agg(
        F.max_by("data", F.struct(*order)).alias("_data"))
    return buffer.join(last, "idx", "left").select("idx", F.coalesce("_data", "value").alias("value"))

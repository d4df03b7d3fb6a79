"""Global positions and running sums over an order, without a single-task window.

The rows are range-partitioned on the order, sorted inside their partition and numbered there
as they are written down; only the per-partition totals (one row per partition) are
accumulated in one place and added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage

ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in these bits


def _ranged(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _with_offsets(placed: DataFrame, total: Column, name: str) -> DataFrame:
    """Add the totals of the earlier partitions to ``_inside``."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(total.alias("_t")).select(
        "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    # one offset row per range partition
    return placed.join(F.broadcast(offsets), "_part") \
        .withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


def global_index(df: DataFrame, order: list[str], name: str = "idx",
                 partitions: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in ``order``, which must be unique so that range
    partitioning can split any run of rows."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    placed = stage(_ranged(df, order, partitions)
                   .withColumn("_part", F.spark_partition_id()).withColumn("_inside", row))
    return _with_offsets(placed, F.count(F.lit(1)), name)


def running_total(df: DataFrame, order: list[str], value: Column, name: str,
                  partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``value`` over all rows before this one in (unique) ``order``."""
    ranged = _ranged(df.withColumn("_v", value.cast("long")), order, partitions) \
        .withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_inside", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            v = batch.column("_v").to_numpy()
            upto = np.cumsum(v) + carried
            carried = int(upto[-1]) if len(upto) else carried
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - v)],
                                             names=[*batch.schema.names, "_inside"])

    placed = stage(ranged.mapInArrow(add_up, schema))
    return _with_offsets(placed, F.sum("_v"), name).drop("_v")

"""Vector arithmetic on ``ARRAY<numeric>`` columns, and NumPy blocks for dense algebra."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import by_key

DIGITS = 6  # reported precision: independent of the order in which partial sums arrive


def rounded(c: Column | str) -> Column:
    return F.round(c, DIGITS)


def np_rounded(x: np.ndarray) -> np.ndarray:
    return np.round(x, DIGITS) + 0.0


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, left to right."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def int_dot(a: Column, b: Column) -> Column:
    """Exact inner product of integer vectors."""
    return F.aggregate(
        F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: x * y),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def matvec(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def rms_norm(v: Column, weight: Column, eps: float = 1e-5) -> Column:
    """x / sqrt(mean(x^2) + eps) * weight."""
    scale = F.lit(1.0) / F.sqrt(dot(v, v) / F.size(v) + F.lit(eps))
    return F.transform(F.zip_with(doubles(v), doubles(weight), lambda x, w: x * w),
                       lambda x: x * scale)


def signed_sqrt_gate(score: Column) -> Column:
    """sigmoid(sign(s) * sqrt(max(|s|, 1e-6))), the sign of zero being +1."""
    root = F.sqrt(F.greatest(F.abs(score), F.lit(1e-6)))
    return sigmoid(F.when(score >= 0, root).otherwise(-root))


def matrix_literal(matrix: Iterable[Iterable[float]]) -> Column:
    """A constant ``array<array<double>>``; folded into one literal by Catalyst."""
    text = json.dumps([[float(x) for x in row] for row in matrix])
    return F.from_json(F.lit(text), "array<array<double>>")


def vector_literal(vector: Iterable[float]) -> Column:
    return F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>")


_REDUCE = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def merge_vectors(df: DataFrame, keys: list[str], vecs: dict[str, tuple[str, str]],
                  sums: tuple[str, ...] = ()) -> DataFrame:
    """Element-wise aggregates per key: (keys..., vecs..., sums..., n).

    ``vecs`` names results as (column, "sum" | "min" | "max"), ``sums`` numbers to add up, and ``n``
    counts the rows.  Every batch of rows is reduced as a matrix before anything is shuffled, and
    the partial rows of a key are merged while they stream past in order, so neither the width
    of the vectors nor the size of a group matters to the plan or to a task's memory.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}
    schema = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], *[f"`{v}` array<double>" for v in vecs],
                        *[f"`{c}` double" for c in sums], "n bigint"])
    names = [*keys, *vecs, *sums, "n"]

    def reduce_batch(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        code = np.zeros(batch.num_rows, np.int64)
        for k in keys:
            column = batch.column(k)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            encoded = column.dictionary_encode("encode")
            code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        place = np.argsort(order[first], kind="stable")   # groups in the order of their first row
        rows = pa.array(order[first][place])
        out = [batch.column(k).take(rows) for k in keys]
        out = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out]
        for name, (_, how) in vecs.items():
            out.append(list_array(_REDUCE[how].reduceat(as_matrix(batch.column(name))[order], first)[place]))
        for name in (*sums, "n"):
            out.append(pa.array(np.add.reduceat(batch.column(name).to_numpy()[order], first)[place]))
        return pa.RecordBatch.from_arrays(out, names=names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield reduce_batch(batch)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                                       # the key that may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                done = reduce_batch(pa.Table.from_batches([last, batch] if last is not None else [batch]))
                yield done.slice(0, done.num_rows - 1)
                last = done.slice(done.num_rows - 1)
        if last is not None:
            yield last

    rows = df.select(*keys, *[doubles(c).alias(v) for v, (c, _) in vecs.items()],
                     *[F.col(c).cast("double").alias(c) for c in sums], F.lit(1).cast("bigint").alias("n"))
    return by_key(rows.mapInArrow(partial, schema), *keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def mean_vectors(df: DataFrame, keys: list[str], vec: str, name: str = "vec") -> DataFrame:
    """Element-wise mean per key."""
    return merge_vectors(df, keys, {name: (vec, "sum")}).select(
        *keys, F.transform(name, lambda x: x / F.col("n")).alias(name))


def sum_vectors(df: DataFrame, keys: list[str], vec: str, name: str = "vec", *more: str) -> DataFrame:
    """Element-wise sum per key, next to the sums of the columns ``more``."""
    return merge_vectors(df, keys, {name: (vec, "sum")}, more).drop("n")


def unpack(df: DataFrame, keys: list[str], vec: str, index: str = "dim",
           value: str = "value") -> DataFrame:
    """One row per array element, 0-based."""
    return df.select(*keys, F.posexplode(vec).alias(index, value))


# ---- NumPy blocks -------------------------------------------------------------------


def as_matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of an Arrow list column as a dense matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must be neither null nor of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), int(lengths[0]))


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: str) -> DataFrame:
    """Run ``fn`` on every Arrow batch of every partition; rows stay where they are.

    Where a batch becomes much larger than it was, ``fn`` gives its result in pieces.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                result = fn(batch)
                for out in [result] if isinstance(result, dict) else result:
                    cols = [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array)
                            else out[f.name].cast(f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, target)


def list_array(matrix: np.ndarray) -> pa.Array:
    """A dense matrix as an Arrow list column."""
    n, d = matrix.shape
    offsets = np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def collect_small(df: DataFrame, max_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else ``None``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None

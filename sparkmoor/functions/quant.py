"""Symmetric quantisation of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import keyed_join, stage_counted
from .vectors import as_matrix, list_array, map_blocks

INT16_MAX, INT8_MAX, FP8_MAX = 32767, 127, 448.0


def largest(v: Column) -> Column:
    return F.array_max(F.transform(v.cast("array<double>"), F.abs))


def tensor_scale(df: DataFrame, vec: str, bits: int) -> float:
    """Scale of a whole column: 16 bits max/32767 (1 if all zero), 8 bits max(.., 1e-8)/127."""
    peak = df.agg(F.max(largest(F.col(vec)))).first()[0] or 0.0
    if bits == 16:
        return peak / INT16_MAX if peak > 0 else 1.0
    return max(peak, 1e-8) / INT8_MAX


def quantise(v: Column, scale: Column | float, bits: int) -> Column:
    """round-half-even(x / scale), clamped."""
    top = INT16_MAX if bits == 16 else INT8_MAX
    inv = F.lit(1.0) / (F.lit(scale) if isinstance(scale, float) else scale)
    kind = "smallint" if bits == 16 else "tinyint"
    return F.transform(v.cast("array<double>"), lambda x: F.greatest(
        F.least(F.bround(x * inv), F.lit(float(top))), F.lit(float(-top - 1))).cast(kind))


def grouped_int8(df: DataFrame, group: str, vecs: list[str]) -> DataFrame:
    """8-bit values with one scale per group and column: ``v`` is replaced, ``v_scale`` added."""
    scales = stage_counted(df.groupBy(group).agg(*[
        (F.greatest(F.max(largest(F.col(v))), F.lit(1e-8)) / INT8_MAX).alias(f"{v}_scale") for v in vecs]))
    joined = keyed_join(df, scales, [group])
    for v in vecs:
        joined = joined.withColumn(v, quantise(F.col(v), F.col(f"{v}_scale"), 8))
    return joined


def dequantise(v: Column, scale: Column) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: x * scale)


def block_scaled(df: DataFrame, keys: list[str], vec: str, block: int) -> DataFrame:
    """Values over their block's scale max(|x|, 1e-12)/448, clamped, and the scales."""
    types = dict(df.dtypes)

    def run(b):
        x = as_matrix(b.column(vec))
        cut = x.reshape(len(x), -1, block)
        scale = np.maximum(np.abs(cut).max(axis=2), 1e-12) / FP8_MAX
        q = np.clip(cut / scale[:, :, None], -FP8_MAX, FP8_MAX).reshape(len(x), -1)
        return {**{k: b.column(k) for k in keys}, "scaled": list_array(q), "scales": list_array(scale)}

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return map_blocks(df.select(*keys, vec), run, f"{schema}, scaled array<double>, scales array<double>")


def hadamard(df: DataFrame, keys: list[str], vec: str, scale: float = 1.0) -> DataFrame:
    """Walsh-Hadamard transform of each vector; the length must be a power of two."""
    types = dict(df.dtypes)

    def run(b):
        x = as_matrix(b.column(vec))
        n = x.shape[1]
        if n & (n - 1):
            raise ValueError("length must be a power of two")
        i = np.arange(n)
        signs = 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]).astype(np.int64) % 2)
        return {**{k: b.column(k) for k in keys}, "vec": list_array(x @ signs * scale)}

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return map_blocks(df.select(*keys, vec), run, f"{schema}, vec array<double>")

"""Numbers of weights of models, as sums over the projections that they consist of."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column


class Projection(NamedTuple):
    """A matrix from vectors of ``inputs`` to vectors of ``outputs`` numbers, held ``copies`` times."""

    name: str
    inputs: Column
    outputs: Column
    copies: Column | int = 1


def expert_layer(dim: Column, inner: Column, routed: Column, shared: Column) -> list[Projection]:
    experts = routed + shared
    return [Projection("gate", dim, routed), Projection("linear", dim, inner, experts),
            Projection("gated", dim, inner, experts), Projection("back", inner, dim, experts)]


def latent_attention(hidden: Column, q_rank: Column, kv_rank: Column, heads: Column, plain: Column,
                     rotated: Column, value: Column) -> list[Projection]:
    return [Projection("query to rank", hidden, q_rank), Projection("rank to query", q_rank, heads * (plain + rotated)),
            Projection("key and value to rank", hidden, kv_rank), Projection("rotated key", hidden, rotated),
            Projection("rank to key", kv_rank, heads * plain), Projection("rank to value", kv_rank, heads * value),
            Projection("out", heads * value, hidden)]


def weights(projections: list[Projection]) -> Column:
    return reduce(add, [p.copies * p.inputs * p.outputs for p in projections])


def gigabytes(params: Column, bytes_each: int, binary: bool = True) -> Column:
    return params * bytes_each / float(1024**3 if binary else 10**9)

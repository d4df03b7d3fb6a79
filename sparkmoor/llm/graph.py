"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of at least one edge; ``root`` is the smallest node reachable.

    Each round first ties the larger neighbours of a node to its smallest neighbour and then the
    smaller ones.  Minima are taken before and after the shuffle, so a node of very many edges
    is no burden, and every round is written down, so lost executors cost one round at most.
    Null ends are left out; an empty table gives an empty result.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v)).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = stage(both.where(v > u).join(least, "u").select(v.alias("u"), m.alias("v")).where(u != v).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != m).select(v.alias("u"), m.alias("v"))
        now = stage(small.unionByName(least.select("u", m.alias("v"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(u.alias("node"), v.alias("root")).unionByName(
        now.select(v.alias("node"), v.alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return n, h or 0

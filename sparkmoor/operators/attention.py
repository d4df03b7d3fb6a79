"""Applying a selection: gathers, sparse attention, latent attention."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import Staged, hold, stage_counted
from ..functions.vectors import (as_matrix, dot, doubles, list_array, map_blocks, sum_vectors)
from .memory import page_of


# Selections up to this size also become scan filters, so that unselected row groups are skipped.
PUSHED_ROWS = 512


def _chosen(selected: Staged) -> DataFrame:
    return F.broadcast(selected.df) if selected.broadcastable else selected.df


def gather(rows: DataFrame, selected: Staged, id_col: str = "mem_id") -> DataFrame:
    """Rows of the selected ids; ids that do not exist are dropped, copies are kept."""
    if selected.rows <= PUSHED_ROWS:
        ids = [r[0] for r in selected.df.select(id_col).distinct().collect()]
        rows = rows.where(F.col(id_col).isin(ids))
    return rows.join(_chosen(selected), id_col)


def gather_pages(kv: DataFrame, selected: Staged, page_size: int) -> DataFrame:
    """Tokens of the selected pages, once per selection of their page."""
    if selected.rows <= PUSHED_ROWS:
        pages = [r[0] for r in selected.df.select("page_id").distinct().collect()]
        inside = [F.col("pos").between(p * page_size, (p + 1) * page_size - 1) for p in sorted(pages)]
        kv = kv.where(reduce(or_, inside, F.lit(False)))
    return kv.withColumn("page_id", page_of("pos", page_size)).join(_chosen(selected), "page_id")


def softmax_weights(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """exp(score - max) per group; the groups are selections, hence bounded."""
    peak = F.max(score).over(Window.partitionBy(*by))
    return scored.withColumn("w", F.exp(F.col(score) - peak))


def block_sparse_attention(kv: DataFrame, queries: DataFrame, selected: DataFrame,
                           page_size: int, dim: int, few: bool = False) -> DataFrame:
    """softmax(q.k / sqrt(d)) V over the tokens of the selected pages.

    ``kv`` (pos, k, v), ``queries`` (query_id, q), ``selected`` (query_id, page_id).
    A query without a selected token gives the zero vector.  ``few`` says that the selection
    is expected to be small (a few pages of a few queries); a wrong guess costs a second run
    of the selection, not the result.
    Result: (query_id, out).
    """
    picked = selected.select("query_id", "page_id")
    tokens = gather_pages(kv, hold(picked) if few else stage_counted(picked), page_size)
    scored = tokens.join(queries, "query_id").select(
        "query_id", "v", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double"))).alias("score"))
    weighted = softmax_weights(scored, ["query_id"])
    v = F.transform(doubles("v"), lambda x: x * F.col("w"))
    sums = sum_vectors(weighted.select("query_id", "w", v.alias("wv")), ["query_id"], "wv",
                       "wv", "w").withColumnRenamed("w", "z")
    out = F.transform("wv", lambda x: x / F.col("z"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return queries.select("query_id").join(sums.select("query_id", out.alias("out")), "query_id", "left") \
        .select("query_id", F.coalesce("out", zero).alias("out"))


def latent_attention(kv: DataFrame, heads: np.ndarray, pe: np.ndarray, w_k: np.ndarray,
                     w_v: np.ndarray, scale: float) -> DataFrame:
    """Latent sparse attention over gathered rows, several heads per query.

    ``kv``: (query_id, latent, k_pe), the rows already gathered for the query.
    ``heads`` (H, n) and ``pe`` (H, r) are the two parts of the query, ``w_k`` (H, n, c) and
    ``w_v`` (H, u, c) its key and value expansions.  The key expansion is folded into the
    query; each block contributes (max, sum, weighted latent) per head, which are merged by
    rescaling to the common maximum, so no group is ever held in one task.
    Result: (query_id, head, out).
    """
    folded = np.einsum("hn,hnc->hc", heads, w_k)
    n_heads = len(heads)

    def block(b: pa.RecordBatch) -> dict:
        qids = b.column("query_id").to_numpy()
        lat, kpe = as_matrix(b.column("latent")), as_matrix(b.column("k_pe"))
        sc = (lat @ folded.T + kpe @ pe.T) * scale
        out = {"query_id": [], "head": [], "peak": [], "z": [], "acc": []}
        for q in np.unique(qids):
            rows = qids == q
            peak = sc[rows].max(axis=0)
            e = np.exp(sc[rows] - peak)
            out["query_id"] += [q] * n_heads
            out["head"] += list(range(n_heads))
            out["peak"] += list(peak)
            out["z"] += list(e.sum(axis=0))
            out["acc"].append(e.T @ lat[rows])
        out["acc"] = list_array(np.concatenate(out["acc"]))
        return out

    parts = map_blocks(kv.select("query_id", doubles("latent").alias("latent"), doubles("k_pe").alias("k_pe")),
                       block, "query_id bigint, head int, peak double, z double, acc array<double>")
    key = ["query_id", "head"]
    peaks = parts.withColumn("_top", F.max("peak").over(Window.partitionBy(*key)))
    factor = F.exp(F.col("peak") - F.col("_top"))
    merged = sum_vectors(
        peaks.select(*key, (F.col("z") * factor).alias("z"),
                     F.transform("acc", lambda x: x * factor).alias("acc")),
        key, "acc", "acc", "z")

    def expand(b: pa.RecordBatch) -> dict:
        h = b.column("head").to_numpy()
        inter = as_matrix(b.column("acc")) / b.column("z").to_numpy()[:, None]
        return {"query_id": b.column("query_id"), "head": b.column("head"),
                "out": list_array(np.einsum("nc,nuc->nu", inter, w_v[h]))}

    return map_blocks(merged, expand, "query_id bigint, head int, out array<double>")


def gemv(rows: DataFrame, x: np.ndarray, id_col: str = "mem_id", vec: str = "vec") -> DataFrame:
    """y = K x on gathered rows."""

    def block(b: pa.RecordBatch) -> dict:
        return {id_col: b.column(id_col), "y": as_matrix(b.column(vec)) @ x}

    return map_blocks(rows.select(id_col, vec), block, f"{id_col} bigint, y double")

"""Scoring queries against a memory of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_index
from ..functions.staging import stage, stage_counted
from ..functions.vectors import as_matrix, collect_small, dot, doubles, map_blocks, np_rounded, rounded
from .retrieve import WORD_BITS, top_k

# A query batch up to this many rows travels with the tasks; a larger one visits tiles of the memory.
QUERY_ROWS = 4096
TILE_ROWS = 1 << 17
CELLS = 4_000_000
# Shares per query in which the best entries of all blocks are first reduced.
SHARES = 64


def _batch(queries: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    rows = collect_small(queries.select("query_id", doubles("q").alias("q")), limit)
    if rows is None:
        return None
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    mat = np.array([r["q"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    return ids, mat


def _spans(n: int, width: int) -> list[slice]:
    """Runs of rows whose score matrix stays near CELLS numbers."""
    step = max(1, CELLS // max(1, width))
    return [slice(i, i + step) for i in range(0, n, step)]


def _best(ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray, k: int) -> dict:
    """Up to ``k`` best rows per query of one block, by (score desc, id asc).

    Everything at or above the k-th score is a candidate, so ties are settled by id exactly.
    """
    n = len(ids)
    bar = np.partition(scores, n - k, axis=0)[n - k] if k < n else np.full(len(query_ids), -np.inf)
    picks, owners = [], []
    for j, q in enumerate(query_ids):
        rows = np.flatnonzero(scores[:, j] >= bar[j])
        rows = rows[np.lexsort((ids[rows], -scores[rows, j]))][:k]
        picks.append(np.stack([ids[rows], np.full(len(rows), j)]))
        owners.append(scores[rows, j])
    at = np.concatenate(picks, axis=1)
    return {"query_id": query_ids[at[1]], "mem_id": at[0], "score": np.concatenate(owners)}


def _joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


PAIR = "query_id bigint, mem_id bigint, score double"


def inner_products(memory: DataFrame, queries: DataFrame, limit: int = QUERY_ROWS) -> DataFrame:
    """score(query, entry) = sum_j q[j] * vec[j] for every entry: (query_id, mem_id, score).

    The sum runs over the length of the query.  Scores are rounded to ``DIGITS`` so that a
    ranking does not depend on the order of additions.
    """
    batch = _batch(queries, limit)
    memory = memory.select("mem_id", "vec")
    if batch is None:
        return over_visits(memory, queries, lambda ids, x, qids: _every(ids, np_rounded(x), qids), PAIR)
    qids, q = batch

    def block(b: pa.RecordBatch) -> dict:
        ids = b.column("mem_id").to_numpy()
        x = as_matrix(b.column("vec"))
        s = np_rounded(x[:, : q.shape[1]] @ q.T)
        return {"query_id": np.tile(qids, len(ids)), "mem_id": np.repeat(ids, len(qids)),
                "score": s.ravel()}

    if len(qids) == 0:
        return memory.sparkSession.createDataFrame([], PAIR)
    return map_blocks(memory, block, PAIR)


def top_inner_products(memory: DataFrame, queries: DataFrame, k: int,
                       limit: int = QUERY_ROWS) -> DataFrame:
    """Best ``k`` entries per query.

    Each Arrow block keeps only its own best ``k`` per query, so the exchange carries
    k rows per query and block rather than every (query, entry) pair.
    """
    batch = _batch(queries, limit)
    memory = memory.select("mem_id", "vec")
    if batch is None:
        best = over_visits(memory, queries, lambda ids, x, qids: _best(ids, np_rounded(x), qids, k), PAIR)
        return top_k(best, k, by=["query_id"], spread=SHARES)
    qids, q = batch
    if len(qids) == 0:
        return top_k(memory.sparkSession.createDataFrame([], PAIR), k, by=["query_id"])

    def block(b: pa.RecordBatch) -> dict:
        x, ids = as_matrix(b.column("vec")), b.column("mem_id").to_numpy()
        return _joined([_best(ids[s], np_rounded(x[s, : q.shape[1]] @ q.T), qids, k)
                        for s in _spans(len(ids), len(qids))])

    return top_k(map_blocks(memory, block, PAIR), k, by=["query_id"], spread=SHARES)


WORDS = "query_id bigint, word bigint, bits bigint"


def threshold_words(memory: DataFrame, queries: DataFrame, threshold: float, inclusive: bool = True,
                    limit: int = QUERY_ROWS) -> DataFrame:
    """Inner products against a threshold as bitmaps, without the scores in between.

    A block turns its scores into the words its ids fall into; words that several blocks
    share are merged by bit_or.  The exchange carries a word per 64 entries.
    """
    batch = _batch(queries, limit)
    if batch is None:
        found = over_visits(memory, queries, lambda ids, x, qids: _words(ids, np_rounded(x), qids, threshold, inclusive), WORDS)
        return found.groupBy("query_id", "word").agg(F.bit_or("bits").alias("bits"))
    qids, q = batch

    def block(b: pa.RecordBatch) -> dict:
        x, ids = as_matrix(b.column("vec")), b.column("mem_id").to_numpy()
        return _joined([_words(ids[s], np_rounded(x[s, : q.shape[1]] @ q.T), qids, threshold, inclusive)
                        for s in _spans(len(ids), len(qids))])

    if len(qids) == 0:
        return memory.sparkSession.createDataFrame([], WORDS)
    return map_blocks(memory.select("mem_id", "vec"), block, WORDS).groupBy("query_id", "word").agg(
        F.bit_or("bits").alias("bits"))


VISITS = "_tile int, _kind int, _id bigint, _vec array<double>"


def over_visits(memory: DataFrame, queries: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], dict],
                schema: str, tile_rows: int = 0, product=np.matmul) -> DataFrame:
    """``work(ids, scores, query_ids)`` on every tile of the memory and every block of queries.

    For query batches of any size: the memory is dealt into tiles of about ``tile_rows`` entries and moves
    once, and the queries visit each tile.  A task holds one tile, past which the queries stream in
    blocks; the bytes shuffled are those of the memory and of the queries once per tile.  ``product`` makes
    the scores from the tile's rows and the queries' columns.
    """
    tile_rows = tile_rows or TILE_ROWS
    tiles = max(1, -(-memory.count() // tile_rows))
    held = memory.select(F.pmod(F.xxhash64("mem_id"), F.lit(tiles)).cast("int").alias("_tile"), F.lit(0).alias("_kind"),
                         F.col("mem_id").alias("_id"), doubles("vec").alias("_vec"))
    guests = queries.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile"), F.lit(1).alias("_kind"),
                            F.col("query_id").alias("_id"), doubles("q").alias("_vec"))
    names = [f.split()[0] for f in schema.split(", ")]
    target = memory.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        at, parts, ids, mat = -1, [], np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            tile, kind = batch.column("_tile").to_numpy(), batch.column("_kind").to_numpy()
            edges = np.flatnonzero((np.diff(tile, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for a, z in zip(edges, np.append(edges[1:], len(tile))):
                some, x = batch.column("_id").slice(a, z - a).to_numpy(), as_matrix(batch.column("_vec").slice(a, z - a))
                if tile[a] != at:
                    at, parts, ids = int(tile[a]), [], np.zeros(0, np.int64)
                if kind[a] == 0:                    # the entries of a tile come first
                    parts.append((some, x))
                    continue
                if parts:
                    ids, mat, parts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), []
                for span in _spans(len(some), len(ids)) if len(ids) else ():
                    out = work(ids, product(mat[:, : x.shape[1]], x[span].T), some[span])
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], names=names)

    return held.unionByName(guests).repartition(tiles, "_tile").sortWithinPartitions("_tile", "_kind").mapInArrow(run, schema)


def _every(ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray) -> dict:
    return {"query_id": np.tile(query_ids, len(ids)), "mem_id": np.repeat(ids, len(query_ids)), "score": scores.ravel()}


def _words(ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray, threshold: float, inclusive: bool) -> dict:
    """The words that ``ids`` fall into, a bit per score that passes."""
    bit = np.left_shift(np.uint64(1), (ids % WORD_BITS).astype(np.uint64))
    found, where = np.unique(ids // WORD_BITS, return_inverse=True)
    out = np.zeros((len(found), len(query_ids)), np.uint64)
    np.bitwise_or.at(out, where, np.where(scores >= threshold if inclusive else scores > threshold, bit[:, None], np.uint64(0)))
    return {"query_id": np.tile(query_ids, len(found)), "word": np.repeat(found, len(query_ids)), "bits": out.view(np.int64).ravel()}


def integer_products(memory: DataFrame, queries: DataFrame, limit: int = QUERY_ROWS) -> DataFrame:
    """Exact integer products of 16-bit vectors: BIGINT scores.

    Sums of such products need about 40 bits, so the float matrix product (53 bits) is exact.
    """
    batch = _batch(queries, limit)
    memory = memory.select("mem_id", doubles("vec").alias("vec"))
    if batch is None:
        return over_visits(memory, queries, lambda ids, x, qids: _every(ids, x.astype(np.int64), qids),
                           "query_id bigint, mem_id bigint, score bigint")
    qids, q = batch

    def block(b: pa.RecordBatch) -> dict:
        ids = b.column("mem_id").to_numpy()
        s = as_matrix(b.column("vec")) @ q.T
        return {"query_id": np.tile(qids, len(ids)), "mem_id": np.repeat(ids, len(qids)),
                "score": s.ravel().astype(np.int64)}

    return map_blocks(memory, block, "query_id bigint, mem_id bigint, score bigint")


# ---- exact top-k by bounds --------------------------------------------------------------

OPENED = 4     # pages of a query that are opened first
ROOM = 1e-5    # more than rounding can move a score


class Opened(NamedTuple):
    """The best entries (query_id, mem_id, score, rank), and the pages (query_id, page_id) that were opened."""

    best: DataFrame
    pages: DataFrame


def top_by_bounds(entries: DataFrame, pages: DataFrame, queries: DataFrame, k: int) -> Opened:
    """The exact ``k`` best entries of each query, of the pages that can hold one.

    ``entries`` (mem_id, page_id, vec); ``pages`` (page_id, vmin, vmax), the extremes of their entries.  No
    entry scores above sum_j max(q_j vmin_j, q_j vmax_j), which is the inner product of the positive and
    the negative part of q with the page's maxima and minima.  The pages with the best bounds are opened
    first; the k-th best score in them is a bar, and of the others only those are opened whose bound
    reaches it.
    """
    part = lambda f: F.transform(doubles("q"), lambda x: f(x, F.lit(0.0)))
    asked = queries.select("query_id", F.concat(part(F.greatest), part(F.least)).alias("q"))
    corners = stage(pages.select(F.col("page_id").alias("mem_id"), F.concat(doubles("vmax"), doubles("vmin")).alias("vec")))
    first = stage(top_inner_products(corners, asked, OPENED).select("query_id", F.col("mem_id").alias("page_id"), "score", "rank"))
    seeds = stage(_score_pages(entries, queries, first.select("query_id", "page_id"), k))
    bars = stage(seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).select(
        "query_id", F.when(F.col("n") >= k, F.col("bar") - ROOM).otherwise(F.lit(float("-inf"))).alias("bar")))
    more = _reaching(corners, asked.join(bars, "query_id")).join(first.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    more = stage(more)
    best = top_k(seeds.unionByName(_score_pages(entries, queries, more, k)), k, by=["query_id"], spread=SHARES)
    return Opened(best, first.select("query_id", "page_id").unionByName(more))


def _reaching(corners: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, page_id) of the bounds that reach the query's bar; other bounds never leave their task."""
    held = collect_small(asked.select("query_id", "q", "bar"), QUERY_ROWS)
    if held is None:     # the bar is one more number of the query, and -1 one more of each page
        longer = asked.select("query_id", F.concat(F.array("bar"), "q").alias("q"))
        wide = corners.select("mem_id", F.concat(F.array(F.lit(-1.0)), "vec").alias("vec"))
        return over_visits(wide, longer, _not_below, "query_id bigint, page_id bigint")
    qids, bar = np.array([r["query_id"] for r in held], np.int64), np.array([r["bar"] for r in held], float)
    q = np.array([r["q"] for r in held], float)

    def block(b: pa.RecordBatch) -> dict:
        ids, x = b.column("mem_id").to_numpy(), as_matrix(b.column("vec"))
        at, of = np.nonzero(x[:, : q.shape[1]] @ q.T >= bar) if len(qids) else (np.zeros(0, int), np.zeros(0, int))
        return {"query_id": qids[of], "page_id": ids[at]}

    return map_blocks(corners, block, "query_id bigint, page_id bigint")


def _not_below(ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray) -> dict:
    at, of = np.nonzero(~(scores < 0))
    return {"query_id": query_ids[of], "page_id": ids[at]}


def _score_pages(entries: DataFrame, queries: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(query_id, mem_id, score): the best k entries of each query in its chosen pages."""
    wanted = stage_counted(chosen.join(queries.select("query_id", doubles("q").alias("q")), "query_id"))
    side = F.broadcast(wanted.df) if wanted.broadcastable else wanted.df
    scored = entries.join(side, "page_id").select("query_id", "mem_id", rounded(dot(F.col("q"), F.col("vec"))).alias("score"))
    return top_k(scored, k, by=["query_id"], spread=SHARES).drop("rank")


# ---- many heads ---------------------------------------------------------------------------


def _over_heads(memory: DataFrame, heads: DataFrame, contribution) -> DataFrame:
    """(mem_id, score): the sum of ``contribution`` over all heads, of which at most QUERY_ROWS travel
    with the tasks at a time.  ``contribution(rows)`` makes a function from a batch to scores."""
    numbered = stage_counted(global_index(heads, ["head"], "_no"))

    def part(low: int) -> DataFrame:
        rows = numbered.df.where((F.col("_no") >= low) & (F.col("_no") < low + QUERY_ROWS)).orderBy("_no").collect()
        scores = contribution(rows)
        return map_blocks(memory, lambda b: {"mem_id": b.column("mem_id"), "score": scores(b)}, "mem_id bigint, score double")

    parts = [part(low) for low in range(0, max(1, numbered.rows), QUERY_ROWS)]
    if len(parts) == 1:
        return parts[0].withColumn("score", rounded("score"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("mem_id").agg(rounded(F.sum("score")).alias("score"))


def multi_head(memory: DataFrame, heads: DataFrame, scale_block: int | None = None) -> DataFrame:
    """Score sum_h w_h * relu(q_h . k), summed over the heads: (mem_id, score).

    ``heads``: (head, q, w).  With ``scale_block`` the product is first multiplied by the key's mean
    block scale, the scale of a block being max(|x|, 1e-12) / 448, and the keys are taken as
    x / scale.
    """
    def contribution(rows: list):
        q, w = np.array([r["q"] for r in rows]), np.array([r["w"] for r in rows])

        def scores(b: pa.RecordBatch) -> np.ndarray:
            x = as_matrix(b.column("vec"))
            if not len(w):
                return np.zeros(len(x))
            if scale_block:
                cut = x.reshape(len(x), -1, scale_block)
                scale = np.maximum(np.abs(cut).max(axis=2), 1e-12) / 448.0
                x = np.clip(cut / scale[:, :, None], -448.0, 448.0).reshape(len(x), -1)
                return np.maximum((x @ q.T) * scale.mean(axis=1)[:, None], 0.0) @ w
            return np.maximum(x @ q.T, 0.0) @ w

        return scores

    wide = heads.select("head", doubles("q").alias("q"), F.col("w").cast("double").alias("w"))
    return _over_heads(memory.select("mem_id", "vec"), wide, contribution)


def table_lookup(keys: DataFrame, heads: DataFrame, lut: np.ndarray) -> DataFrame:
    """Product-quantised score: sum_h w_h * relu(sum_d lut[d][key code][query code]).

    ``keys``: (mem_id, codes); ``heads``: (head, codes, w); ``lut`` of shape
    (dims, key codes, query codes).  The query side of the table is fixed per head, so each
    head becomes a (dims, key codes) table and a key costs one gather per dimension.
    """
    dims = np.arange(lut.shape[0])

    def contribution(rows: list):
        tables = [lut[dims, :, np.array(r["codes"])] for r in rows]  # (D, K) each
        w = [r["w"] for r in rows]

        def scores(b: pa.RecordBatch) -> np.ndarray:
            codes = as_matrix(b.column("codes"), np.int64)
            s = np.zeros(len(codes))
            for table, weight in zip(tables, w):
                s += weight * np.maximum(table[dims, codes].sum(axis=1), 0)
            return s

        return scores

    return _over_heads(keys.select("mem_id", "codes"), heads.select("head", "codes", F.col("w").cast("double").alias("w")),
                       contribution)

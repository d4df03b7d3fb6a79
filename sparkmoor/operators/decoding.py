"""Sparse-attention selection while a sequence grows.

In round r a query q_r and a key k_r arrive after ``past`` older keys.  Eight rounds share a
slot behind the past keys and each overwrites the one before, so round r sees the past keys,
the last key of every finished group of eight, and its own key.

A sequence is cut into tiles, each a block of rounds against a block of slots, which meet by an
as-of rule: a key goes to the blocks of rounds that come after it.  A tile gives its own scores, bits
or best entries, and best entries are merged per round.  Nothing ever holds a sequence, and short
sequences share their tiles, so one of a million positions and a million of hundred are the
same work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import keyed_join, stage_counted
from ..functions.vectors import as_matrix
from .retrieve import WORD_BITS, top_k

GROUP = 8
BLOCK_BITS = 128
TILE = 1024         # rounds, and slots, of a tile
BY = ["seq_id", "round"]
SCORES = "seq_id bigint, round int, pos bigint, score bigint"


def visible(round_no: Column, key_round: Column) -> Column:
    """Whether the key of ``key_round`` is still in its slot at ``round_no``."""
    finished = (F.floor(key_round / GROUP) < F.floor(round_no / GROUP)) & (key_round % GROUP == GROUP - 1)
    return finished | (key_round == round_no)


def windows(rows: DataFrame, length: int, n: int) -> DataFrame:
    """(seq_id, at, ...) of ``rows`` (pos, ...) with positions 0..n-1, cut every ``length`` positions.

    Where the last window would be short it is moved back to end at the last position, so that every
    window has its full length, unless there are fewer positions than that.
    """
    pos, whole = F.col("pos"), n // length
    own = F.struct(F.floor(pos / length).cast("bigint").alias("seq_id"), F.pmod(pos, F.lit(length)).cast("int").alias("at"))
    last = F.struct(F.lit(whole).cast("bigint").alias("seq_id"), (pos - (n - length)).cast("int").alias("at"))
    if n < length or n % length == 0:
        placed = rows.withColumn("_w", own)
    else:
        both = F.array(F.when(pos < whole * length, own), F.when(pos >= n - length, last))
        placed = rows.withColumn("_w", F.explode(F.filter(both, lambda w: w.isNotNull())))
    return placed.select("_w.*", *[c for c in rows.columns if c != "pos"])


# ---- tiles --------------------------------------------------------------------------


class Tile:
    """Scores of some rounds of one sequence (rows) in consecutive slots (columns)."""

    def __init__(self, rounds: np.ndarray, first_slot: int, scores: np.ndarray, seen: np.ndarray):
        self.rounds, self.first_slot, self.scores, self.seen = rounds, first_slot, scores, seen


def _tile(q: np.ndarray, own: np.ndarray, rounds: np.ndarray, k: np.ndarray, slots: np.ndarray, past: int,
          first_slot: int, width: int) -> Tile:
    """Products of 16-bit vectors stay far below 2**53, so the float matrix product is exact."""
    now = past + rounds // GROUP                       # the slot of a round's own key
    scores = np.zeros((len(rounds), width), np.int64)
    seen = np.zeros(scores.shape, bool)
    if len(slots):
        scores[:, slots - first_slot] = (q @ k.T).astype(np.int64)
        seen[:, slots - first_slot] = slots[None, :] < now[:, None]
    here = np.flatnonzero((now >= first_slot) & (now < first_slot + width))
    scores[here, now[here] - first_slot] = (q[here] * own[here]).sum(axis=1).astype(np.int64)
    seen[here, now[here] - first_slot] = True
    return Tile(rounds, first_slot, scores, seen)


def over_tiles(rows: DataFrame, past: int, work: Callable[[Tile], dict], schema: str, page: int = BLOCK_BITS) -> DataFrame:
    """``work`` on every tile of ``rows`` (seq_id, at, q, k): vectors of 16-bit integers by position.

    ``work`` returns columns behind ``seq_id``; pages of ``page`` slots are never cut.
    """
    at, n_slots = F.col("at"), max(page, TILE // page * page)
    lengths = stage_counted(rows.groupBy("seq_id").agg((F.max("at") - past).cast("int").alias("last")).where("last >= 0"))
    short = F.col("last") < TILE // 4
    few = lengths.df.where(short).agg(F.sum(F.col("last") + past + 1)).first()[0] or 0
    shared = max(1, few // TILE)                       # short sequences share that many tiles
    sized = keyed_join(rows, lengths, ["seq_id"]).withColumn(
        "bundle", F.when(short, F.pmod(F.xxhash64("seq_id"), F.lit(shared)).cast("string")).otherwise(
            F.concat(F.lit("s"), F.col("seq_id").cast("string"))))
    rounds = lambda c: F.floor(c / TILE).cast("int")
    slots = lambda c: F.floor(c / n_slots).cast("int")
    reach = F.least(F.col("last"), (rounds(at - past) + 1) * TILE - 1)
    asks = sized.where(at >= past).select(
        "bundle", rounds(at - past).alias("qb"), F.explode(F.sequence(F.lit(0), slots(past + F.floor(reach / GROUP)))).alias("kb"),
        "seq_id", (at - past).alias("round"), "q", "k")
    slot = F.when(at < past, at).otherwise(past + F.floor((at - past) / GROUP)).cast("int")
    first = F.when(at < past, 0).otherwise(at - past + 1)   # the first round that finds the key finished
    held = sized.where((at < past) | ((at - past) % GROUP == GROUP - 1)).where(first <= F.col("last")).select(
        F.col("bundle").alias("of"), F.explode(F.sequence(rounds(first), rounds(F.col("last")))).alias("later"),
        slots(slot).alias("at_slots"), F.col("seq_id").alias("seq"), slot.alias("slot"), F.col("k").alias("key"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({n: [] for n in names})
        first_slot = key[2].as_py() * n_slots
        seq, round_no = (asked.column(c).to_numpy() for c in ("seq_id", "round"))
        q, own = (as_matrix(asked.column(c)) for c in ("q", "k"))
        seq_k, slot_no = (known.column(c).to_numpy() for c in ("seq", "slot"))
        k = as_matrix(known.column("key")) if known.num_rows else np.zeros((0, q.shape[1]))
        order, order_k = np.lexsort((round_no, seq)), np.lexsort((slot_no, seq_k))
        ids, starts = np.unique(seq[order], return_index=True)
        parts = []
        for s, mine in zip(ids, np.split(order, starts[1:])):
            a, z = np.searchsorted(seq_k[order_k], [s, s + 1])
            theirs = order_k[a:z]
            most = past + int(round_no[mine].max()) // GROUP + 1 - first_slot
            width = min(n_slots, -(-most // page) * page)
            out = work(_tile(q[mine], own[mine], round_no[mine].astype(np.int64), k[theirs],
                             slot_no[theirs].astype(np.int64), past, first_slot, width))
            parts.append(pa.table({"seq_id": np.full(len(out["round"]), s)} | out).select(names))
        return pa.concat_tables(parts).cast(_arrow(schema))

    return asks.groupBy("bundle", "qb", "kb").cogroup(held.groupBy("of", "later", "at_slots")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])


def growing_scores(rows: DataFrame, past: int) -> DataFrame:
    """Exact integer scores of each round against the keys it sees; ``pos`` is a key's slot."""
    def work(t: Tile) -> dict:
        r, c = np.nonzero(t.seen)
        return {"round": t.rounds[r], "pos": c + t.first_slot, "score": t.scores[r, c]}

    return over_tiles(rows, past, work, SCORES)


def threshold_bits(rows: DataFrame, past: int, threshold: int) -> DataFrame:
    """Bit set iff the score is above the threshold, in 128-bit blocks; later positions are 0."""
    def work(t: Tile) -> dict:
        bits = np.packbits(t.seen & (t.scores > threshold), axis=1, bitorder="little").view(np.int64)
        words = t.first_slot // WORD_BITS + np.arange(bits.shape[1])
        own = past + t.rounds // GROUP + 1
        r, c = np.nonzero(words[None, :] < (-(-own // BLOCK_BITS) * (BLOCK_BITS // WORD_BITS))[:, None])
        return {"round": t.rounds[r], "word": words[c], "bits": bits[r, c]}

    return over_tiles(rows, past, work, "seq_id bigint, round int, word bigint, bits bigint")


def _best(scores: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best seen entries of each row, ties to the lower column."""
    order = np.argsort(np.where(seen, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    r = np.repeat(np.arange(len(scores)), order.shape[1])
    c = order.ravel()
    keep = seen[r, c]
    return r[keep], c[keep]


def budget_keys(rows: DataFrame, past: int, k: int = 64) -> DataFrame:
    """The k best keys of each round."""
    def work(t: Tile) -> dict:
        r, c = _best(t.scores, t.seen, k)
        return {"round": t.rounds[r], "pos": c + t.first_slot, "score": t.scores[r, c]}

    return top_k(over_tiles(rows, past, work, SCORES), k, "pos", BY)


def best_pages(rows: DataFrame, past: int, page_size: int = 16, k: int = 64) -> DataFrame:
    """The k best pages of each round by their best key; the last page may be short."""
    def work(t: Tile) -> dict:
        shape = (len(t.rounds), -1, page_size)
        low = np.iinfo(np.int64).min
        best = np.where(t.seen, t.scores, low).reshape(shape).max(axis=2)
        r, c = _best(best, t.seen.reshape(shape).any(axis=2), k)
        return {"round": t.rounds[r], "page_id": c + t.first_slot // page_size, "score": best[r, c]}

    pages = over_tiles(rows, past, work, "seq_id bigint, round int, page_id bigint, score bigint", page_size)
    return top_k(pages, k, "page_id", BY)

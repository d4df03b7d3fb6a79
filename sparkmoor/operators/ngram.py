"""N-gram memory: hashed n-grams address embedding rows, which are projected, gated and mixed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import Staged, keyed_join, stage_counted
from ..functions.vectors import as_matrix, list_array, map_blocks, silu, sum_vectors

# Seed step per layer, vocabulary, and how far above it the table sizes start.
LAYER_STEP = 10007
VOCAB_SIZE = 129280
TABLE_FACTOR = 5
# Embedding tables up to this many numbers travel with the tasks; larger ones are joined.
TABLE_LIMIT = 4_000_000
# Positions that are hashed at a time: a position becomes a number per head, and a batch of long sequences has millions.
PIECE = 16_384
TOO_MANY = 1 << 62


def multipliers(layer: int, vocab_size: int = VOCAB_SIZE, size: int = 3, seed: int = 0) -> list[int]:
    """Odd factors so small that id * factor fits a signed 64-bit integer."""
    half = max(1, (2**63 - 1) // vocab_size // 2)
    drawn = np.random.default_rng(seed + LAYER_STEP * layer).integers(0, half, size=size, dtype=np.int64)
    return [2 * int(d) + 1 for d in drawn]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def table_sizes(layers: list[int], heads: int = 8, ngrams: int = 2,
                start: int = VOCAB_SIZE * TABLE_FACTOR) -> dict[int, list[list[int]]]:
    """Distinct primes from ``start`` upwards, dealt to layer, n-gram length and head in turn."""
    found: list[int] = []
    candidate = start
    while len(found) < len(layers) * ngrams * heads:
        if _is_prime(candidate):
            found.append(candidate)
        candidate += 1
    deal = iter(found)
    return {layer: [[next(deal) for _ in range(heads)] for _ in range(ngrams)] for layer in layers}


def ngram_hash(df: DataFrame, keys: list[str], factors: list[int], sizes: list[list[int]],
               pad_id: int, ids: str = "ids", bits: int | None = None) -> DataFrame:
    """Row per position with its hashes, one per (n-gram length, head): (keys..., pos, heads).

    mix_n = xor over k < n of id[t-k] * factor[k], ids before the start being ``pad_id``;
    hash = mix_n mod size.  ``bits`` cuts the products to that many bits.  A sequence is one
    row, so shifting needs no window and no shuffle; only a piece of a batch is as wide as its hashes.
    """
    types = dict(df.dtypes)
    flat_sizes = [np.array(s, np.int64) for s in sizes]

    def block(b: pa.RecordBatch) -> Iterator[dict]:
        col = b.column(ids)
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        ends = np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(), dtype=np.int64)
        for a in range(0, len(x), PIECE):
            at = np.arange(a, min(a + PIECE, len(x)))
            row = np.searchsorted(ends, at, side="right")
            pos = at - np.append(0, ends)[row]
            mix, heads = None, []
            for k, factor in enumerate(factors):
                part = np.where(pos >= k, x[at - k], pad_id) * np.int64(factor)
                mix = part if mix is None else mix ^ part
                if k:
                    cut = mix & np.int64((1 << bits) - 1) if bits else mix
                    heads.append(cut[:, None] % flat_sizes[k - 1])
            out = {c: b.column(c).take(pa.array(row)) for c in keys}
            yield {**out, "pos": pos, "heads": list_array(np.concatenate(heads, axis=1))}

    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    return map_blocks(df.select(*keys, F.col(ids).cast("array<bigint>").alias(ids)), block,
                      f"{schema}, pos bigint, heads array<bigint>")


def row_ids(hashed: DataFrame, sizes: list[list[int]], table_rows: int | None = None) -> DataFrame:
    """Heads share one table: each head's hashes are moved behind the tables before it.

    ``table_rows`` wraps the ids into a smaller table.
    """
    flat = [s for group in sizes for s in group]
    starts = F.array(*[F.lit(sum(flat[:i])).cast("bigint") for i in range(len(flat))])
    moved = F.zip_with("heads", starts, lambda h, s: h + s)
    if table_rows:
        moved = F.transform(moved, lambda i: i % table_rows)
    return hashed.withColumn("rows", moved).drop("heads")


def lookup(addressed: DataFrame, keys: list[str], table: DataFrame, dim: int, limit: int = TABLE_LIMIT,
           work: Callable[[np.ndarray], dict] | None = None, fields: str = "flat array<float>",
           each: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Embedding rows of every head, side by side: (keys..., flat).  A row that the table lacks is zero.

    ``work`` turns a matrix of such rows into the columns ``fields``, so that what is projected or
    summed up next never leaves its block as a whole.  Where that can begin with the table's rows one by one,
    ``each`` turns a matrix of them into rows of ``dim`` doubles, which are looked up in their place: the
    table is read once, and neither the tasks nor a join get more of it than those.

    A table within the limit is gathered inside the blocks.  A larger one is joined on the row
    id, rows of frequent n-grams apart, and regrouped per position (one row per head).
    """
    kind = "float" if each is None else "double"
    number = np.float32 if each is None else np.float64
    table = table.select("row_id", F.col("vec").cast("array<float>").alias("vec"))
    if each is not None:
        row_id = dict(table.dtypes)["row_id"]
        table = map_blocks(table, lambda b: {"row_id": b.column("row_id"), "vec": list_array(each(as_matrix(b.column("vec"), np.float32)))},
                           f"row_id {row_id}, vec array<double>")
    staged = stage_counted(table)
    if staged.rows * dim <= limit:
        held = staged.df.toArrow()
        ids = held.column("row_id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        matrix = np.concatenate([as_matrix(held.column("vec"), number).reshape(-1, dim)[order],
                                 np.zeros((1, dim), number)])   # the last row stands for all that are lacking
        types = dict(addressed.dtypes)

        def block(b: pa.RecordBatch) -> dict:
            at = as_matrix(b.column("rows"), np.int64)
            place = np.searchsorted(ids, at)
            known = np.append(ids, -1)[place] == at
            flat = matrix[np.where(known, place, len(ids))].reshape(len(at), -1)
            return {**{c: b.column(c) for c in keys}, **(work(flat) if work else {"flat": list_array(flat)})}

        schema = ", ".join(f"{c} {types[c]}" for c in keys)
        return map_blocks(addressed.select(*keys, "rows"), block, f"{schema}, {fields}")
    asked = addressed.select(*keys, F.posexplode("rows").alias("head", "row_id"))
    found = keyed_join(asked, Staged(staged.df, TOO_MANY), ["row_id"])
    parts = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("head", "vec"))).alias("parts"))
    zero = F.array_repeat(F.lit(0.0).cast(kind), dim)
    places = F.sequence(F.lit(0), F.col("n") - 1)
    flat = addressed.select(*keys, F.size("rows").alias("n")).join(parts, keys, "left").select(
        *keys, F.flatten(F.transform(places, lambda h: F.coalesce(F.try_element_at("parts", h), zero))).alias("flat"))
    if work is None:
        return flat
    schema = ", ".join(f"{c} {t}" for c, t in flat.dtypes if c in keys)
    return map_blocks(flat, lambda b: {**{c: b.column(c) for c in keys}, **work(as_matrix(b.column("flat"), number))},
                      f"{schema}, {fields}")


def gated_value(df: DataFrame, keys: list[str], groups: int, dim: int, key_norm: np.ndarray,
                hidden_norm: np.ndarray) -> DataFrame:
    """Gate each group's hidden state against its key and scale the shared value.

    ``df``: (keys..., kv, hidden) with kv = the group keys followed by the value.  Both sides
    are RMS-normalised; gate = sigmoid(sign(s) sqrt(max(|s|, 1e-6))) of s = key.hidden/sqrt(d).
    Result: (keys..., hidden, gates, gated).
    """
    types = dict(df.dtypes)

    def norm(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).mean(axis=2, keepdims=True) + 1e-5) * w

    def block(b: pa.RecordBatch) -> dict:
        kv, hidden = as_matrix(b.column("kv")), as_matrix(b.column("hidden"))
        n = len(kv)
        k = norm(kv[:, : groups * dim].reshape(n, groups, dim), key_norm)
        q = norm(hidden.reshape(n, groups, dim), hidden_norm)
        s = (k * q).sum(axis=2) / np.sqrt(dim)
        root = np.sqrt(np.maximum(np.abs(s), 1e-6)) * np.where(s >= 0, 1.0, -1.0)
        gates = 1.0 / (1.0 + np.exp(-root))
        gated = gates[:, :, None] * kv[:, None, groups * dim:]
        return {**{c: b.column(c) for c in keys}, "hidden": list_array(hidden), "gates": list_array(gates),
                "gated": list_array(gated.reshape(n, -1))}

    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    return map_blocks(df.select(*keys, "kv", "hidden"), block,
                      f"{schema}, hidden array<double>, gates array<double>, gated array<double>")


def short_conv(df: DataFrame, groups: int, dim: int, taps: np.ndarray, norm: np.ndarray,
               dilation: int = 3, residual: bool = False) -> DataFrame:
    """Depth-wise causal convolution over positions: (seq_id, t, out).

    ``df``: (seq_id, t, gated[, hidden]); each group is RMS-normalised, tap k reads position
    t - k * dilation (tap 0 is the current one), the sum goes through SiLU, and with
    ``residual`` gated + hidden is added.  Every position sends its share to the positions it
    influences and the shares are summed per position, so a long sequence is never gathered
    in one task.
    """
    width = groups * dim
    n_taps = taps.shape[1]
    cols = ["seq_id", "t", "gated"] + (["hidden"] if residual else [])

    def block(b: pa.RecordBatch) -> dict:
        x = as_matrix(b.column("gated"))
        n = len(x)
        g = x.reshape(n, groups, dim)
        normed = (g / np.sqrt((g * g).mean(axis=2, keepdims=True) + 1e-5) * norm).reshape(n, width)
        base = x + as_matrix(b.column("hidden")) if residual else np.zeros_like(x)
        t, seq = b.column("t").to_numpy(), b.column("seq_id").to_numpy()
        shares = np.concatenate([np.concatenate([normed * taps[:, k] for k in range(n_taps)]),
                                 np.concatenate([base, np.zeros(((n_taps - 1) * n, width))])], axis=1)
        at = np.concatenate([t + k * dilation for k in range(n_taps)])
        own = np.repeat([1.0] + [0.0] * (n_taps - 1), n)
        # what falls on one position is added up here already, where it comes from the same batch
        order = np.lexsort((at, np.tile(seq, n_taps)))
        s, a = np.tile(seq, n_taps)[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (a[1:] != a[:-1])]))
        return {"seq_id": s[first], "t": a[first], "share": list_array(np.add.reduceat(shares[order], first)),
                "own": np.add.reduceat(own[order], first)}

    shares = map_blocks(df.select(*cols), block, "seq_id bigint, t bigint, share array<double>, own double")
    summed = sum_vectors(shares, ["seq_id", "t"], "share", "acc", "own")
    acc, base = F.slice("acc", 1, width), F.slice("acc", width + 1, width)
    # a share may point behind the end of its sequence: no row of its own is there
    return summed.where("own > 0").select("seq_id", "t", F.zip_with(acc, base, lambda a, r: silu(a) + r).alias("out"))

"""Routing tokens to experts and evaluating the experts' feed-forward layers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import keyed_join, stage_counted
from ..functions.vectors import as_matrix, collect_small, list_array, map_blocks, rounded, sum_vectors
from .score import over_visits

ROUTE_SCALE = 2.5
# Expert weights up to this many numbers travel with the tasks; larger ones are joined.
WEIGHT_LIMIT = 4_000_000
TILE_NUMBERS = 8_000_000   # of the tokens that a task holds
BLOCK_ROWS = 256           # rows that are multiplied at a time

WIDE = "token_id bigint, x array<double>, experts array<int>, weights array<double>"


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def _silu(z: np.ndarray) -> np.ndarray:
    return z * _sigmoid(z)


def _largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row, ties to the lower column."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def grouped_choice(z: np.ndarray, bias: np.ndarray, groups: int, top_groups: int, k: int,
                   mode: str = "sigmoid", scale: float = ROUTE_SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Group-limited choice: the best groups by their two best biased scores, then the best
    k experts in them.  Weights are the unbiased scores, made to sum to one in sigmoid mode."""
    if mode == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        plain = e / e.sum(axis=1, keepdims=True)
    else:
        plain = _sigmoid(z)
    biased = plain + bias
    if groups > 1:
        by_group = biased.reshape(len(z), groups, -1)
        two = np.sort(by_group, axis=2)[:, :, -2:].sum(axis=2)
        keep = np.zeros_like(two, dtype=bool)
        np.put_along_axis(keep, _largest(two, top_groups), True, axis=1)
        biased = np.where(keep[:, :, None], by_group, -np.inf).reshape(len(z), -1)
    chosen = _largest(biased, k)
    w = np.take_along_axis(plain, chosen, axis=1)
    if mode == "sigmoid":
        w = w / w.sum(axis=1, keepdims=True)
    return chosen, w * scale


def split_choice(z: np.ndarray, bias: np.ndarray, k: int,
                 scale: float = ROUTE_SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The best k experts of each half; weights are the biased scores over their total."""
    biased = _sigmoid(z) + bias
    half = biased.shape[1] // 2
    chosen = np.concatenate([_largest(biased[:, :half], k), _largest(biased[:, half:], k) + half], axis=1)
    w = np.take_along_axis(biased, chosen, axis=1)
    total = w.sum(axis=1, keepdims=True)
    return chosen, np.where(total > 1e-12, w * scale / np.where(total > 1e-12, total, 1.0), 0.0)


GATE_ROWS = 4096    # experts whose gate travels with the tasks; of more, tokens visit tiles
GATE_TILE = 2048


def gate_matrix(gate: DataFrame, limit: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(expert, vec, bias) rows as a matrix and a bias vector, by expert; None above the limit."""
    rows = collect_small(gate, limit or GATE_ROWS)
    if rows is None:
        return None
    rows = sorted(rows, key=lambda r: r["expert"])
    return np.array([r["vec"] for r in rows], np.float64), np.array([r["bias"] for r in rows], np.float64)


def _biased(bias_and_rows: np.ndarray, shift_and_x: np.ndarray) -> np.ndarray:
    """Two score matrices, one above the other: z less the token's shift, and the bias of each expert."""
    z = bias_and_rows[:, 1:] @ shift_and_x[1:] - shift_and_x[0]
    return np.concatenate([z, np.repeat(bias_and_rows[:, :1], z.shape[1], axis=1)])


def _over_gate(tokens: DataFrame, gate: DataFrame, work, schema: str) -> DataFrame:
    """``work(experts, z - shift, bias, tokens)`` on tiles of the gate; tokens (token_id, shift, x)."""
    held = gate.select(F.col("expert").cast("bigint").alias("mem_id"),
                       F.concat(F.array(F.col("bias").cast("double")), F.col("vec").cast("array<double>")).alias("vec"))
    asked = tokens.select(F.col("token_id").alias("query_id"), F.concat(F.array("shift"), F.col("x").cast("array<double>")).alias("q"))

    def split(ids: np.ndarray, both: np.ndarray, token_ids: np.ndarray) -> dict:
        order = np.argsort(ids)          # experts in order, so that ties go to the lower one
        return work(ids[order], both[: len(ids)][order], both[len(ids):][order], token_ids)

    return over_visits(held, asked, split, schema, GATE_TILE, _biased)


def gate_scores(tokens: DataFrame, gate: DataFrame) -> DataFrame:
    """sigmoid(x.w) + bias of every expert: (token_id, scores)."""
    whole = gate_matrix(gate)
    if whole is None:
        def pieces(ids: np.ndarray, z: np.ndarray, bias: np.ndarray, token_ids: np.ndarray) -> dict:
            lists = pa.array([ids] * len(token_ids), pa.list_(pa.int64()))
            return {"token_id": token_ids, "experts": lists, "scores": list_array((_sigmoid(z) + bias).T)}

        found = _over_gate(tokens.withColumn("shift", F.lit(0.0)), gate, pieces, "token_id bigint, experts array<bigint>, scores array<double>")
        pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("experts", "scores"))))   # one per expert
        return found.groupBy("token_id").agg(F.transform(pairs, lambda p: p["scores"]).alias("scores"))
    w, bias = whole

    def block(b: pa.RecordBatch) -> dict:
        return {"token_id": b.column("token_id"), "scores": list_array(_sigmoid(as_matrix(b.column("x")) @ w.T) + bias)}

    return map_blocks(tokens.select("token_id", "x"), block, "token_id bigint, scores array<double>")


def route(tokens: DataFrame, gate: tuple[np.ndarray, np.ndarray], choose) -> DataFrame:
    """One row per token with its experts and weights; ``choose(z, bias)`` picks them.

    Routing is a row-wise map: nothing is shuffled.
    """
    w, bias = gate

    def block(b: pa.RecordBatch) -> dict:
        x = as_matrix(b.column("x"))
        chosen, weights = choose(x @ w.T, bias)
        return {"token_id": b.column("token_id"), "x": list_array(x),
                "experts": list_array(chosen.astype(np.int32)), "weights": list_array(weights)}

    return map_blocks(tokens.select("token_id", "x"), block, WIDE)


def _normalised(tokens: DataFrame, gate: DataFrame) -> DataFrame:
    """Tokens with ``shift`` = log sum exp of their scores, from one partial sum per tile."""
    def part(ids: np.ndarray, z: np.ndarray, bias: np.ndarray, token_ids: np.ndarray) -> dict:
        top = z.max(axis=0)
        return {"token_id": token_ids, "top": top, "total": np.exp(z - top).sum(axis=0)}

    parts = _over_gate(tokens.withColumn("shift", F.lit(0.0)), gate, part, "token_id bigint, top double, total double")
    tops = parts.groupBy("token_id").agg(F.max("top").alias("peak"), F.collect_list(F.struct("top", "total")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["total"] * F.exp(p["top"] - F.col("peak")))
    return tokens.join(tops.select("token_id", (F.col("peak") + F.log(total)).alias("shift")), "token_id")


def _route_tiles(tokens: DataFrame, gate: DataFrame, groups: int, top_groups: int | None, k: int, mode: str,
                 scale: float) -> DataFrame:
    """Routing by a gate that is too large to travel: the best of each group in a tile, merged per token.

    With ``top_groups`` the k best experts of the best groups, else the k best of every group.  Token ids
    are unique.
    """
    tokens = tokens.select("token_id", F.col("x").cast("array<double>").alias("x"))
    n = gate.count()
    most = max(2, k)

    def best(ids: np.ndarray, z: np.ndarray, bias: np.ndarray, token_ids: np.ndarray) -> dict:
        plain = np.exp(z) if mode == "softmax" else _sigmoid(z)
        biased, of = plain + bias, ids * groups // n
        out = []
        for g in np.unique(of):
            rows = np.flatnonzero(of == g)
            at = rows[_largest(biased[rows].T, most)]                       # (tokens, up to most)
            t = np.arange(len(token_ids))[:, None]
            out.append([np.repeat(token_ids, at.shape[1]), np.full(at.size, g), ids[at].ravel(), plain[at, t].ravel(), biased[at, t].ravel()])
        return dict(zip(("token_id", "part", "expert", "plain", "biased"), map(np.concatenate, zip(*out))))

    asked = _normalised(tokens, gate) if mode == "softmax" else tokens.withColumn("shift", F.lit(0.0))
    found = _over_gate(asked, gate, best, "token_id bigint, part int, expert int, plain double, biased double")
    in_part = Window.partitionBy("token_id", "part").orderBy(F.desc("biased"), "expert")
    placed = found.withColumn("place", F.row_number().over(in_part)).where(F.col("place") <= most)
    if top_groups is None:
        chosen = placed.where(F.col("place") <= k).withColumn("slot", F.col("part") * k + F.col("place"))
        weight = F.col("biased")
    else:
        if groups > 1:
            two = F.sum(F.when(F.col("place") <= 2, F.col("biased"))).over(Window.partitionBy("token_id", "part"))
            order = Window.partitionBy("token_id").orderBy(F.desc("two"), "part")
            placed = placed.withColumn("two", two).withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= top_groups)
        everywhere = Window.partitionBy("token_id").orderBy(F.desc("biased"), "expert")
        chosen = placed.withColumn("slot", F.row_number().over(everywhere)).where(F.col("slot") <= k)
        weight = F.col("plain")
    wide = chosen.groupBy("token_id").agg(F.array_sort(F.collect_list(F.struct("slot", "expert", weight.alias("w")))).alias("r"),
                                          F.sum(weight).alias("total"))
    if top_groups is None:
        share = lambda w: F.when(F.col("total") > 1e-12, w * scale / F.col("total")).otherwise(0.0)
    elif mode == "sigmoid":
        share = lambda w: w / F.col("total") * scale
    else:
        share = lambda w: w * scale
    return tokens.join(wide, "token_id").select("token_id", "x", F.transform("r", lambda r: r["expert"]).alias("experts"),
                                                F.transform("r", lambda r: share(r["w"])).alias("weights"))


def route_grouped(tokens: DataFrame, gate: DataFrame, groups: int, top_groups: int, k: int,
                  mode: str = "sigmoid") -> DataFrame:
    whole = gate_matrix(gate)
    if whole is None:
        return _route_tiles(tokens, gate, groups, top_groups, k, mode, ROUTE_SCALE)
    return route(tokens, whole, lambda z, bias: grouped_choice(z, bias, groups, top_groups, k, mode))


def route_split(tokens: DataFrame, gate: DataFrame, k: int) -> DataFrame:
    whole = gate_matrix(gate)
    if whole is None:
        return _route_tiles(tokens, gate, 2, None, k, "sigmoid", ROUTE_SCALE)
    return route(tokens, whole, lambda z, bias: split_choice(z, bias, k))


def routes(wide: DataFrame) -> DataFrame:
    """(token_id, slot, expert_id, weight)."""
    return wide.select("token_id", F.posexplode(F.arrays_zip("experts", "weights")).alias("slot", "r")).select(
        "token_id", "slot", F.col("r.experts").alias("expert_id"), F.col("r.weights").alias("weight"))


def expert_counts(wide: DataFrame, n_experts: int) -> DataFrame:
    """Tokens per expert, zero for an idle one."""
    counts = wide.select(F.explode("experts").alias("expert_id")).groupBy("expert_id").agg(
        F.count(F.lit(1)).alias("n_tokens"))
    ids = wide.sparkSession.range(n_experts).select(F.col("id").cast("int").alias("expert_id"))
    return ids.join(counts, "expert_id", "left").select("expert_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def group_descriptors(counts: DataFrame, block: int) -> DataFrame:
    """Start of each expert's tokens, plain and padded to blocks (one row per expert).

    The window runs over one row per expert.
    """
    earlier = Window.orderBy("expert_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.ceil((F.col("n_tokens") + 1) / block) * block
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("bigint")
    return counts.select(F.col("expert_id").cast("int").alias("expert_id"), F.col("n_tokens").cast("bigint").alias("n_tokens"),
                         before("n_tokens").alias("start"), before(room).alias("padded_start"))


def block_experts(counts: DataFrame, block: int) -> DataFrame:
    """Expert of each padded block: the last one starting at or before it."""
    placed = group_descriptors(counts, block)
    total = counts.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    n = math.ceil((total[0] or 0) / block) + total[1]
    following = F.lead(F.col("padded_start") / block, 1, n).over(Window.orderBy("expert_id")).cast("bigint")
    first = (F.col("padded_start") / block).cast("bigint")
    ranges = placed.select("expert_id", first.alias("a"), F.least(following, F.lit(n)).alias("z")).where("a < z")
    return ranges.select(F.explode(F.sequence("a", F.col("z") - 1)).alias("block"), "expert_id")


# ---- feed-forward layers ------------------------------------------------------------


def weight_arrays(weights: DataFrame, limit: int = WEIGHT_LIMIT) -> dict[int, tuple[np.ndarray, ...]] | None:
    """Per expert its layers (w1, w3, w2), each (I, D), or None above the limit.

    ``weights``: (expert, row, w1, w3, w2), where ``w2`` is the column of the second layer that belongs
    to the inner row.  Experts may differ in their number of rows; one without rows is absent.
    """
    first = weights.select("w1").first()
    rows = collect_small(weights, max(1, limit // (3 * len(first["w1"])))) if first else []
    if rows is None:
        return None
    of: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["expert"], r["row"])):
        of.setdefault(r["expert"], []).append(r)
    return {e: tuple(np.array([r[c] for r in rs], np.float64) for c in ("w1", "w3", "w2")) for e, rs in of.items()}


class Layer(NamedTuple):
    """A feed-forward layer in two steps, so that its inner rows can be taken in blocks.

    ``gate(W1 x, W3 x)`` gives the inner numbers, each by itself; ``finish(inner)`` gives what W2 is
    applied to and a function of the outcome, from all inner numbers of a token.
    """

    gate: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]]

    def __call__(self, x: np.ndarray, w1: np.ndarray, w3: np.ndarray, w2: np.ndarray) -> np.ndarray:
        inner, after = self.finish(self.gate(x @ w1.T, x @ w3.T))
        return after(inner @ w2)


PLAIN = Layer(lambda a, b: _silu(a) * b, lambda inner: (inner, lambda y: y))


def feed_forward(wide: DataFrame, weights: DataFrame, dim: int, limit: int = WEIGHT_LIMIT, layer: Layer = PLAIN) -> DataFrame:
    """sum over a token's experts of weight * W2 (silu(W1 x) * W3 x): (token_id, y).

    While the weights fit the limit every block of tokens evaluates its experts where it is.
    Beyond it, tiles of tokens of one expert meet the rows of that expert's layer, and the parts
    are summed per token.  An expert without weights adds nothing.
    """
    layers = weight_arrays(weights, limit)
    if layers is None:
        nothing = wide.select("token_id", F.array_repeat(F.lit(0.0), dim).alias("y"))
        parts = expert_parts(wide, weights, dim, layer).select("token_id", "y")
        return accumulate(parts.unionByName(nothing))

    def block(b: pa.RecordBatch) -> dict:
        x = as_matrix(b.column("x"))
        chosen, w = as_matrix(b.column("experts"), np.int64), as_matrix(b.column("weights"))
        y = np.zeros_like(x)
        for e in np.unique(chosen):
            if e in layers:
                row, slot = np.nonzero(chosen == e)
                np.add.at(y, row, layer(x[row], *layers[e]) * w[row, slot][:, None])
        return {"token_id": b.column("token_id"), "y": list_array(y)}

    return map_blocks(wide, block, "token_id bigint, y array<double>")


PARTS = "token_id bigint, expert_id int, y array<double>"


class _Tile:
    """Tokens of one expert, past which the rows of its layer stream: first those of W1 and W3, which
    fill the inner numbers, then those of W2."""

    def __init__(self, expert: int, dim: int, layer: Layer):
        self.expert, self.dim, self.layer = expert, dim, layer
        self.ids, self.weight, self.x, self.inner = [], [], [], []
        self.y: np.ndarray | None = None
        self.at = 0

    def add(self, kind: int, ids: np.ndarray, weight: np.ndarray, a: pa.Array, b: pa.Array) -> None:
        if kind == 0:
            self.ids.append(ids)
            self.weight.append(weight)
            self.x.append(as_matrix(a))
        elif kind == 1 and self.x:
            self.x = [np.concatenate(self.x)] if len(self.x) > 1 else self.x
            self.inner.append(self.layer.gate(self.x[0] @ as_matrix(a).T, self.x[0] @ as_matrix(b).T))
        elif kind == 2 and self.x:
            if self.y is None:
                self.inner, self.after = self.layer.finish(np.concatenate(self.inner, axis=1))
                self.y = np.zeros((len(self.inner), self.dim))
            w2 = as_matrix(a)
            self.y += self.inner[:, self.at:self.at + len(w2)] @ w2
            self.at += len(w2)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.y is not None:
            y = self.after(self.y) * np.concatenate(self.weight)[:, None]
            ids = np.concatenate(self.ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), self.expert, np.int32)), list_array(y)],
                                             names=[f.split()[0] for f in PARTS.split(", ")])


def expert_parts(wide: DataFrame, weights: DataFrame, dim: int, layer: Layer = PLAIN) -> DataFrame:
    """Weighted output of each (token, expert): (token_id, expert_id, y).

    The tokens of an expert are dealt into tiles of about ``TILE_NUMBERS`` numbers, as many as it has
    use for, and the rows of its layer go to each tile.  No row is larger than two vectors, and no task
    holds more than a tile of tokens and a block of rows.
    """
    rows = max(1, TILE_NUMBERS // dim)
    pairs = wide.select("token_id", "x", F.explode(F.arrays_zip("experts", "weights")).alias("r")).select(
        F.col("r.experts").alias("expert"), "token_id", F.col("r.weights").alias("w"), F.col("x").cast("array<double>").alias("x"))
    own = weights.select(F.col("expert").cast("int").alias("expert"), "row", "w1", "w3", "w2")
    loads = pairs.groupBy("expert").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("tiles"))
    # one row per expert that has both tokens and weights
    loads = stage_counted(loads.join(own.select("expert").distinct(), "expert"))
    tile = F.pmod(F.xxhash64("token_id"), F.col("tiles")).cast("int")
    none = F.lit(None).cast("array<double>")
    asked = keyed_join(pairs, loads, ["expert"]).select(
        "expert", tile.alias("tile"), F.lit(0).alias("kind"), F.col("token_id").alias("id"), "w", F.col("x").alias("a"), none.alias("b"))
    held = _layer_rows(keyed_join(own, loads, ["expert"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            expert, tile, kind = (batch.column(c).to_numpy() for c in ("expert", "tile", "kind"))
            ids, w = batch.column("id").to_numpy(), batch.column("w").to_numpy()
            new = np.diff(expert, prepend=-1) != 0
            edges = np.flatnonzero(new | (np.diff(tile, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for i, j in zip(edges, np.append(edges[1:], batch.num_rows)):
                if at != (expert[i], tile[i]):
                    if now is not None:
                        yield from now.result()
                    at, now = (expert[i], tile[i]), _Tile(int(expert[i]), dim, layer)
                for a in range(i, j, BLOCK_ROWS):
                    z = min(j, a + BLOCK_ROWS)
                    now.add(int(kind[i]), ids[a:z], w[a:z], batch.column("a").slice(a, z - a), batch.column("b").slice(a, z - a))
        if now is not None:
            yield from now.result()

    together = asked.unionByName(held).repartition("expert", "tile").sortWithinPartitions("expert", "tile", "kind", "id")
    return together.mapInArrow(run, PARTS)


def _layer_rows(weights: DataFrame) -> DataFrame:
    """The rows of W1 and W3 (kind 1) and of W2 (kind 2) of each expert, once per tile of its tokens."""
    double = lambda c: F.col(c).cast("array<double>")
    kinds = F.array(F.struct(F.lit(1).alias("kind"), double("w1").alias("a"), double("w3").alias("b")),
                    F.struct(F.lit(2).alias("kind"), double("w2").alias("a"), F.lit(None).cast("array<double>").alias("b")))
    tiles = weights.select("expert", "row", kinds.alias("m"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    return tiles.select("expert", "row", "tile", F.explode("m").alias("m")).select(
        "expert", "tile", "m.kind", F.col("row").cast("bigint").alias("id"), F.lit(0.0).alias("w"), "m.a", "m.b")


def accumulate(parts: DataFrame) -> DataFrame:
    """Sum of the partial outputs per token."""
    return sum_vectors(parts, ["token_id"], "y", "y")


def shared_expert(tokens: DataFrame, weights: DataFrame, dim: int, limit: int = WEIGHT_LIMIT) -> DataFrame:
    """The same feed-forward layer for every token, unweighted."""
    wide = tokens.select("token_id", F.col("x").cast("array<double>").alias("x"),
                         F.array(F.lit(0)).alias("experts"), F.array(F.lit(1.0)).alias("weights"))
    return feed_forward(wide, weights, dim, limit)


def quantised_feed_forward(wide: DataFrame, weights: DataFrame, dim: int, x_scale: float,
                           w_scales: tuple[float, float, float],
                           w_shifts: tuple[float, float, float] = (0.0, 0.0, 0.0),
                           limit: int = WEIGHT_LIMIT) -> DataFrame:
    """The layer on 16-bit integers: integer products, the inner vector requantised per token.

    ``wide.x`` and the weights hold integers; sums stay below 2**53 and are exact.
    """
    (s1, s3, s2), (h1, h3, h2) = w_scales, w_shifts

    def gate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _silu(a * s1 * x_scale + h1) * (b * s3 * x_scale + h3)

    def finish(inner: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        peak = np.abs(inner).max(axis=1, keepdims=True)
        scale = np.where(peak > 0, peak / 32767.0, 1.0)
        return np.clip(np.rint(inner * (1.0 / scale)), -32768, 32767), lambda y: y * s2 * scale + h2

    found = feed_forward(wide, weights, dim, limit, Layer(gate, finish))
    return found.select("token_id", F.transform("y", rounded).alias("y"))

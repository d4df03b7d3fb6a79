"""Building and editing vector memories."""

from __future__ import annotations

import warnings
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_index
from ..functions.vectors import (as_matrix, list_array, map_blocks, matrix_literal, matvec, mean_vectors,
                                 merge_vectors)

# Above this many weights a projection runs as NumPy blocks instead of a SQL literal.
LITERAL_WEIGHTS = 4096


def lcg_weights(in_dim: int, out_dim: int, seed: int = 42) -> np.ndarray:
    """Reproducible (out_dim, in_dim) projection weights.

    Fixed values of the generator: multiplier 1103515245, increment 12345, 32-bit state,
    15-bit output taken from bit 16 upwards, scaled by sqrt(2 / (in + out)).
    """
    states = np.empty(in_dim * out_dim, dtype=np.uint64)
    state = seed
    for i in range(states.size):
        state = (1103515245 * state + 12345) % 2**32
        states[i] = state
    draws = ((states >> np.uint64(16)) & np.uint64(0x7FFF)).astype(np.float64) / 32767.0 - 0.5
    return (draws * np.sqrt(2.0 / (in_dim + out_dim))).reshape(out_dim, in_dim)


def page_of(pos: str | Column, page_size: int) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(page_size)).cast("bigint")


def project(df: DataFrame, vec: str, weights: np.ndarray, name: str = "vec") -> DataFrame:
    """Replace the array column ``vec`` by ``weights @ vec``."""
    keep = [c for c in df.columns if c not in (vec, name)]
    if weights.size <= LITERAL_WEIGHTS:
        return df.select(*keep, matvec(matrix_literal(weights), F.col(vec)).alias(name))
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def block(batch):
        out = {c: batch.column(c) for c in keep}
        out[name] = list_array(as_matrix(batch.column(vec)) @ weights.T)
        return out

    return map_blocks(df.select(*keep, vec), block, f"{schema}, {name} array<double>")


def paged_index(kv: DataFrame, page_size: int, dim: int, weights: np.ndarray | None = None,
                context: list[str] | None = None) -> DataFrame:
    """Mean of the keys of each page of consecutive tokens, then projected.

    ``kv``: (context..., pos, k).  Result: (context..., mem_id, vec); the last page is
    divided by its real length.  An empty cache gives an empty index, as do, with a warning, weights
    of another width.  Tokens of a page lie together in the input, so the partial sums already
    shrink the shuffle by about the page size.
    """
    keys = context or []
    if weights is not None and weights.shape[1] != dim:
        warnings.warn(f"weights for {weights.shape[1]} dimensions do not fit keys of {dim}: the index is empty", stacklevel=2)
        kv, weights = kv.where(F.lit(False)), None
    pooled = mean_vectors(
        kv.select(*keys, page_of("pos", page_size).alias("mem_id"), "k"),
        [*keys, "mem_id"], "k")
    return pooled if weights is None else project(pooled, "vec", weights)


def fold_query(query: DataFrame, weights: np.ndarray) -> DataFrame:
    """Move the projection from the memory to the query: q.(W k) = (W^T q).k."""
    return project(query, "q", np.ascontiguousarray(weights.T), "q")


def minmax_index(kv: DataFrame, block: int, dim: int, page_entries: int = 1) -> DataFrame:
    """Element-wise minimum and maximum per block; ``page_entries`` entries form a page."""
    entries = kv.select(page_of("pos", block).alias("entry_id"), "k")
    return merge_vectors(entries, ["entry_id"], {"vmin": ("k", "min"), "vmax": ("k", "max")}).select(
        "entry_id", page_of("entry_id", page_entries).alias("page_id"), "vmin", "vmax")


def minmax_page(index: DataFrame, page_id: int) -> DataFrame:
    return index.where(F.col("page_id") == page_id)


def segment_memory(kv: DataFrame, segment: int, entries: int, dim: int) -> DataFrame:
    """``entries`` mean vectors per segment of ``segment`` tokens: (segment_id, slot, vec)."""
    if segment % entries:
        raise ValueError("entries must divide the segment length")
    width = segment // entries
    return mean_vectors(
        kv.select(page_of("pos", segment).alias("segment_id"),
                  F.floor(F.pmod("pos", F.lit(segment)) / width).cast("int").alias("slot"), "k"),
        ["segment_id", "slot"], "k")


def read_segment(memory: DataFrame) -> DataFrame:
    """Vectors of each segment concatenated in slot order (bounded by entries per segment)."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "vec")))
    return memory.groupBy("segment_id").agg(
        F.flatten(F.transform(slots, lambda s: s["vec"])).alias("vec"))


def context_length(memory: DataFrame, segment: int, entries: int) -> DataFrame:
    """Number of tokens the stored vectors stand for."""
    return memory.agg((F.count(F.lit(1)) * segment / entries).alias("tokens"))


# ---- edits: ids stay dense ----------------------------------------------------------


class Edits(NamedTuple):
    """Edits of a memory with the ids 0..n-1, noted and carried out together.

    What is stored keeps its place: entries of the memory by their id, inserted ones behind them.  A
    deletion adds one number to a sorted list; the dense id of a stored entry is its place less the
    deletions before it, and the entry with a dense id is found by halving.  Any number of edits takes
    one count, one numbering of what was inserted, and one pass over the memory.  The driver holds one
    number per deletion.
    """

    memory: DataFrame
    log: tuple[tuple[str, object], ...] = ()
    id_col: str = "mem_id"

    def insert(self, vectors: DataFrame) -> Edits:
        """Append ``vectors`` (ordered by their own ids) behind the last entry."""
        return self._replace(log=(*self.log, ("insert", vectors)))

    def delete(self, idx: int) -> Edits:
        """Remove one entry; later ids move down by one."""
        return self._replace(log=(*self.log, ("delete", idx)))

    def pop_last(self) -> Edits:
        return self._replace(log=(*self.log, ("pop", None)))

    def apply(self) -> DataFrame:
        """The edited memory.  An id that does not exist at its turn raises an IndexError."""
        inserts = [v for what, v in self.log if what == "insert"]
        counted = [d.select(F.lit(i).alias("i"), F.col(self.id_col).cast("long").alias("id"))
                   for i, d in enumerate([self.memory, *inserts])]
        last = F.when(F.col("i") == 0, F.max("id") + 1).otherwise(F.count(F.lit(1)))   # an id may have many rows
        sizes = dict(reduce(DataFrame.unionByName, counted).groupBy("i").agg(last.alias("n")).collect())
        stored, deleted, at = sizes.get(0, 0), [], 0
        for what, value in self.log:
            if what == "insert":
                at += 1
                stored += sizes.get(at, 0)
                continue
            alive = stored - len(deleted)
            idx = alive - 1 if what == "pop" else value
            if not 0 <= idx < alive:
                raise IndexError("memory is empty" if what == "pop" else f"no entry {idx}")
            before = bisect_right(range(len(deleted)), idx, key=lambda j: deleted[j] - j)
            insort(deleted, idx + before)
        rows = self.memory
        if inserts:
            n = sizes.get(0, 0)
            batches = [v.select(F.lit(i).alias("_batch"), *self.memory.columns) for i, v in enumerate(inserts)]
            numbered = global_index(reduce(DataFrame.unionByName, batches), ["_batch", self.id_col], "_at")
            rows = rows.unionByName(numbered.withColumn(self.id_col, (F.col("_at") + n).cast(dict(rows.dtypes)[self.id_col]))
                                    .select(*self.memory.columns))
        return _without(rows, self.id_col, np.array(deleted, np.int64)) if deleted else rows


def _without(rows: DataFrame, id_col: str, deleted: np.ndarray) -> DataFrame:
    """Rows but the deleted ones, whose ids close the gaps: a pass without a shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(deleted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = held.value
        for batch in batches:
            ids = batch.column(id_col).to_numpy()
            before = np.searchsorted(gone, ids)
            keep = gone[np.minimum(before, len(gone) - 1)] != ids
            dense = pa.array((ids - before)[keep], batch.schema.field(id_col).type)
            left = batch.filter(pa.array(keep))
            yield left.set_column(left.schema.get_field_index(id_col), id_col, dense)

    return rows.mapInArrow(run, rows.schema)


def edit(memory: DataFrame, id_col: str = "mem_id") -> Edits:
    return Edits(memory, (), id_col)


def insert(memory: DataFrame, vectors: DataFrame, id_col: str = "mem_id") -> DataFrame:
    return edit(memory, id_col).insert(vectors).apply()


def pop_last(memory: DataFrame, id_col: str = "mem_id") -> DataFrame:
    return edit(memory, id_col).pop_last().apply()


def delete(memory: DataFrame, idx: int, id_col: str = "mem_id") -> DataFrame:
    return edit(memory, id_col).delete(idx).apply()


def get(memory: DataFrame, idx: int, id_col: str = "mem_id") -> DataFrame:
    if idx < 0 or not memory.where(F.col(id_col) == idx).limit(1).count():
        raise IndexError(f"no entry {idx}")
    return memory.where(F.col(id_col) == idx)


def insert_segment(memory: DataFrame, segment: DataFrame) -> DataFrame:
    last = memory.agg(F.max("segment_id")).first()[0]
    return memory.unionByName(
        segment.withColumn("segment_id", F.lit(0 if last is None else last + 1).cast("bigint"))
        .select(*memory.columns))


def delete_segment(memory: DataFrame, segment_id: int) -> DataFrame:
    return delete(memory, segment_id, "segment_id")


def pop_segment(memory: DataFrame) -> DataFrame:
    return pop_last(memory, "segment_id")

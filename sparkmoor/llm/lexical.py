"""Ranked lexical search on K2-treaps over the grid of terms and documents.

*Index.*  Documents are put together into blocks of a bounded number of cells, a cell being a term in
a document.  A block is a grid, its rows the block's terms and its columns its documents, and is kept
as a K2-treap: a quadtree of which only the non-empty quarters exist, every node with the largest
impact below it.  It is written level by level as two byte strings: four bits per inner node say
which quarters exist, and variable-length numbers say how far a node's maximum lies below its
parent's.  Blocks are built where the documents are, and written as a Parquet table, which can be
searched again.  The impact of a cell depends on its document and the corpus' means alone; what a
term weighs is found when it is asked for.

*Search.*  The row paths of an item's terms descend together over ranges of documents.  A range's
bound is the sum, over the terms whose path still has a node there, of weight times the node's
maximum; ranges are split from the best bound on, until none can reach the k-th best score.  At
single documents the bound is the score itself.  Items descend side by side through a block, a few of
the best ranges of each at a time, and a task keeps the k best documents per item over all its
blocks, so that later blocks are mostly skipped.  Only those are shuffled.

Items are searched in chunks of about ``CHUNK`` weighted terms, which is what a task holds of them.

Defined cases: null and empty texts have no terms; documents without terms count nowhere and are
never found; items without terms, or with none that a document has, return nothing; rows that repeat
are documents or items of their own; a null document key comes after all others among equals; an
empty corpus or set of items gives no rows.  Texts of any length are counted in windows.  Other
columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import running_total
from ..functions.staging import new_folder
from ..operators.retrieve import top_k
from .common import join_checked, per_row, stage
from .decontaminate import FOLD, pack, unpack
from .resampling import windows

CELLS, DOCS = 1 << 20, 1 << 14   # of a block, unless one document has more
CHUNK = 200_000                  # weighted terms of the items searched at a time
TOGETHER = 2_000                 # weighted terms of the items that descend side by side
FIRST, MOST = 16, 2_048          # ranges of an item that are split at a time
NO_KEY = np.iinfo(np.int64).max
BLOCK = ("block string, keys array<long>, terms array<string>, found_in array<int>, height int, top long, "
         "quarters binary, drops binary, n_docs long, n_words long")
# how many of a node's quarters come before each quarter
BEFORE = np.array([[bin(m & ((1 << c) - 1)).count("1") for c in range(4)] for m in range(16)], np.int64)
ROW_GROUP = 32 << 20


def terms_of(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a window at a time."""
    if text:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        folded = b" " + raw.translate(FOLD) + b" "
        for a, z in windows(folded):
            yield folded[a:z].split()


# ---- the treap --------------------------------------------------------------------------


class Treap(NamedTuple):
    """Nodes level by level, the children of a node side by side."""

    quarters: np.ndarray   # of inner nodes: a bit per quarter, 2 * lower rows + right columns
    first: np.ndarray      # of inner nodes: the number of the first child
    maxima: np.ndarray
    height: int


def _spread(x: np.ndarray) -> np.ndarray:
    """Put a zero between the bits of numbers below 2^32."""
    x = x.astype(np.uint64)
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                     (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(by))) & np.uint64(mask)
    return x


def write_treap(row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(height, largest impact, quarters, drops) of distinct cells, at least one."""
    height = max(1, int(max(row.max(), col.max())).bit_length())
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, value = code[order], impact[order].astype(np.int64)
    quarters, drops = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        best = np.maximum.reduceat(value, start)
        quarters.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), start))
        drops.append(np.repeat(best, np.diff(np.append(start, len(code)))) - value)
        code, value = parent[start], best
    q = np.concatenate(quarters[::-1])
    q = np.append(q, np.uint8(0)) if len(q) % 2 else q
    data, _ = pack(np.concatenate(drops[::-1]))
    return height, int(value[0]), (q[0::2] | (q[1::2] << 4)).astype(np.uint8).tobytes(), data.tobytes()


def read_treap(height: int, top: int, quarters: bytes, drops: bytes) -> Treap:
    both = np.frombuffer(quarters, np.uint8)
    q = np.stack([both & 15, both >> 4], 1).ravel()
    drop = unpack(drops)
    children = BEFORE[q, 3] + (q >> 3)
    first = 1 + np.cumsum(children) - children
    maxima = np.empty(len(drop) + 1, np.int64)
    maxima[0], at, n = top, 0, 1
    for _ in range(height):
        count = children[at:at + n]
        below = int(count.sum())
        a = at + n
        maxima[a:a + below] = np.repeat(maxima[at:a], count) - drop[a - 1:a - 1 + below]
        at, n = a, below
    return Treap(q, first, maxima, height)


# ---- the index --------------------------------------------------------------------------


class Index(NamedTuple):
    """Written blocks, documents that have a term, and terms with repeats."""

    blocks: DataFrame
    n_docs: int
    n_words: int


def count_words(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                some = sum(len(part) for part in terms_of(t.as_py()))
                n, words = n + (some > 0), words + some
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], names=["n", "words"])

    row = docs.select(text).mapInArrow(run, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def impact(tf: np.ndarray, n: int, n_docs: int, n_words: int) -> np.ndarray:
    """What a term's ``tf`` occurrences in a document of ``n`` terms are worth."""
    length = 100 - 25 + (25 * n * n_docs) // n_words
    return (1_000_000_000 * tf) // (1000 * tf + 12 * length)


class _Grid:
    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.keys: list[int | None] = []
        self.rows: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.cells = 0

    def add(self, key: int | None, text: bytes | None, n_docs: int, n_words: int) -> None:
        ids = [np.fromiter(map(self.number.__getitem__, some), np.int64, len(some)) for some in terms_of(text)]
        n = sum(map(len, ids))
        if n:
            row, tf = _merged([np.unique(some, return_counts=True) for some in ids])
            self.keys.append(key)
            self.rows.append(row)
            self.values.append(impact(tf, n, n_docs, n_words))
            self.cells += len(row)

    def record(self, name: str, n_docs: int, n_words: int) -> pa.RecordBatch:
        row = np.concatenate(self.rows)
        col = np.repeat(np.arange(len(self.rows)), [len(r) for r in self.rows])
        height, top, quarters, drops = write_treap(row, col, np.concatenate(self.values))
        found_in = np.bincount(row, minlength=len(self.number)).astype(np.int32)
        values = [name, self.keys, [t.decode("utf-8", "replace") for t in self.number], found_in, height, top, quarters,
                  drops, n_docs, n_words]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.int64(),
                 pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                          names=[f.split()[0] for f in BLOCK.split(", ")])


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(counts) == 1:
        return counts[0]
    row, at = np.unique(np.concatenate([r for r, _ in counts]), return_inverse=True)
    tf = np.zeros(len(row), np.int64)
    np.add.at(tf, at, np.concatenate([c for _, c in counts]))
    return row, tf


def build_index(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text",
                cells: int = CELLS) -> Index:
    """Write the index of ``docs``, whose keys are whole numbers, to ``path`` (default: the shared folder)."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "treaps")
    n_docs, n_words = count_words(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, grid = TaskContext.get().partitionId(), 0, _Grid()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                grid.add(k, t.as_py(), n_docs, n_words)
                if grid.cells >= cells or len(grid.keys) >= DOCS:
                    yield grid.record(f"{part}-{n}", n_docs, n_words)
                    n, grid = n + 1, _Grid()
        if grid.keys:
            yield grid.record(f"{part}-{n}", n_docs, n_words)

    docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, BLOCK) \
        .write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return Index(spark.read.schema(BLOCK).parquet(path), n_docs, n_words)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index written before; its counts stand in each block."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    row = blocks.agg(F.max("n_docs"), F.max("n_words")).first()
    return Index(blocks, row[0] or 0, row[1] or 0)


# ---- search -----------------------------------------------------------------------------


class Best:
    """The k best (item, key, score) so far, and per item the score that a newcomer must reach."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.bar = np.ones(n_items, np.int64)        # scores are above 0
        self.item, self.key, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        item, key, score = (np.concatenate(x) for x in ((self.item, item), (self.key, key), (self.score, score)))
        order = np.lexsort((key, -score, item))
        item, key, score = item[order], key[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.bar[item[last]] = score[last]
        keep = place < self.k
        self.item, self.key, self.score = item[keep], key[keep], score[keep]


class _Ranges(NamedTuple):
    """Ranges of documents, and for each the nodes that its item's row paths have reached."""

    item: np.ndarray
    bound: np.ndarray
    level: np.ndarray
    begin: np.ndarray    # which range of the level: its first document's leading bits
    of: np.ndarray       # by path: the range, a row of ``rows`` and the node
    path: np.ndarray
    node: np.ndarray

    def where(self, keep: np.ndarray) -> "_Ranges":
        at = np.cumsum(keep) - 1
        some = keep[self.of]
        return _Ranges(self.item[keep], self.bound[keep], self.level[keep], self.begin[keep],
                       at[self.of[some]], self.path[some], self.node[some])

    def plus(self, other: "_Ranges") -> "_Ranges":
        joined = [np.concatenate(x) for x in zip(self, other)]
        joined[4][len(self.of):] += len(self.item)
        return _Ranges(*joined)


def search_block(treap: Treap, keys: np.ndarray, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Descend all (item, row, weight) together; returns the number of ranges that were split."""
    items, of = np.unique(item, return_inverse=True)
    bound = np.zeros(len(items), np.int64)
    np.add.at(bound, of, weight * treap.maxima[0])
    zero = np.zeros(len(items), np.int64)
    pool = _Ranges(items, bound, zero, zero, of, np.arange(len(row)), np.zeros(len(row), np.int64))
    split, rounds = 0, 0
    while True:
        pool = pool.where(pool.bound >= best.bar[pool.item])
        if not len(pool.item):
            return split
        order = np.lexsort((-pool.bound, pool.item))
        place = np.empty(len(order), np.int64)
        ordered = pool.item[order]
        place[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        # few until the best paths are down, so that there is a bar before many are split
        at_once = min(MOST, FIRST << min(20, max(0, rounds - treap.height)))
        now = pool.where(place < at_once)
        pool = pool.where(place >= at_once)
        split, rounds = split + len(now.item), rounds + 1
        below = _split(treap, now, row, weight)
        leaf = below.level == treap.height
        leaf &= below.bound >= best.bar[below.item]
        if leaf.any():
            best.add(below.item[leaf], keys[below.begin[leaf]], below.bound[leaf])
        pool = pool.plus(below.where(below.level < treap.height))


def _split(treap: Treap, now: _Ranges, row: np.ndarray, weight: np.ndarray) -> _Ranges:
    lower = (row[now.path] >> (treap.height - 1 - now.level[now.of])) & 1
    quarters, first = treap.quarters[now.node], treap.first[now.node]
    of, path, node = [], [], []
    for right in (0, 1):
        quarter = 2 * lower + right
        here = np.flatnonzero((quarters >> quarter.astype(np.uint8)) & 1)
        of.append(2 * now.of[here] + right)
        path.append(now.path[here])
        node.append(first[here] + BEFORE[quarters[here], quarter[here]])
    of, path, node = map(np.concatenate, (of, path, node))
    bound = np.zeros(2 * len(now.item), np.int64)
    np.add.at(bound, of, weight[path] * treap.maxima[node])
    twice = lambda x: np.repeat(x, 2)
    side = np.tile([0, 1], len(now.item))
    both = _Ranges(twice(now.item), bound, twice(now.level) + 1, 2 * twice(now.begin) + side, of, path, node)
    return both.where(bound > 0)


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(no, item_id, term, n): the terms of every row of ``items``, with repeats counted."""
    def count(t: str | None) -> list[dict]:
        total: defaultdict[bytes, int] = defaultdict(int)
        for some in terms_of(t):
            for w in some:
                total[w] += 1
        return [{"term": w.decode("utf-8", "replace"), "n": n} for w, n in total.items()]

    rows = items.select(F.monotonically_increasing_id().alias("no"), F.col(item).alias("item_id"), F.col(text).alias("text"))
    return per_row(rows, lambda: lambda texts: [(count(t),) for t in texts], ["text"], "terms array<struct<term:string,n:long>>") \
        .select("no", "item_id", F.explode("terms").alias("t")).select("no", "item_id", "t.*")


def search(index: Index, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the ``k`` documents with the highest scores above 0."""
    asked = stage(_item_terms(items, item, text))
    held = index.blocks.select(F.explode(F.arrays_zip("terms", "found_in")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.found_in").cast("long").alias("df"))
    words = stage(asked.select("term").distinct())
    df = join_checked(held, words, ["term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    heavy = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = stage(df.select("term", heavy.alias("w")).where("w > 0"))
    weighted = stage(join_checked(asked, weights, ["term"], "inner").select("no", "term", (F.col("n") * F.col("w")).alias("weight")))
    sizes = weighted.groupBy("no").agg(F.count(F.lit(1)).alias("size"))
    chunked = stage(running_total(sizes, ["no"], F.col("size"), "before").select("no", F.floor(F.col("before") / CHUNK).alias("chunk")))
    found = [stage(_search_chunk(index, join_checked(weighted, chunked.where(F.col("chunk") == c[0]), ["no"], "inner"), k))
             for c in chunked.select("chunk").distinct().orderBy("chunk").collect()]
    spark = index.blocks.sparkSession
    every = found[0] if found else spark.createDataFrame([], "no long, doc_id long, score long")
    for f in found[1:]:
        every = every.unionByName(f)
    names = asked.select("no", "item_id").distinct()
    return join_checked(every, stage(names), ["no"], "inner").select(
        "item_id", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "doc_id")).alias("rank"),
        F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")).alias("doc_id"), "score")


def _search_chunk(index: Index, weighted: DataFrame, k: int) -> DataFrame:
    """(no, doc_id, score) of the best documents of a chunk's items."""
    rows = weighted.select("no", "term", "weight").toArrow()     # about CHUNK, or one item
    numbers, item = np.unique(rows.column("no").to_numpy(), return_inverse=True)
    order = np.argsort(item, kind="stable")
    item, weight = item[order], rows.column("weight").to_numpy()[order]
    words = rows.column("term").combine_chunks().take(pa.array(order)).dictionary_encode()
    term, words = words.indices.to_numpy(), words.dictionary
    # items side by side: runs of items with about TOGETHER terms
    starts = np.flatnonzero(np.diff(item, prepend=-1))
    group = np.repeat(starts // TOGETHER, np.diff(np.append(starts, len(item))))
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(item))
    spark = index.blocks.sparkSession
    plan = spark.sparkContext.broadcast((numbers, item, weight, term, words, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, item, weight, term, words, edges = plan.value
        best = Best(len(numbers), k)
        for batch in batches:
            for b in (batch.slice(i, 1) for i in range(batch.num_rows)):
                row = pc.index_in(words, b.column("terms").flatten())
                row = row.fill_null(-1).to_numpy()[term].astype(np.int64)
                there = np.flatnonzero(row >= 0)
                if not len(there):
                    continue
                treap = read_treap(*[b.column(c)[0].as_py() for c in ("height", "top", "quarters", "drops")])
                keys = b.column("keys").flatten().fill_null(NO_KEY).to_numpy()
                for a, z in zip(np.searchsorted(there, edges[:-1]), np.searchsorted(there, edges[1:])):
                    some = there[a:z]
                    if len(some):
                        search_block(treap, keys, item[some], row[some], weight[some], best)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.item]), pa.array(best.key), pa.array(best.score)],
                                         names=["no", "doc_id", "score"])

    used = index.blocks.select("keys", "terms", "height", "top", "quarters", "drops")
    return top_k(used.mapInArrow(run, "no long, doc_id long, score long"), k, "doc_id", ["no"]).drop("rank")


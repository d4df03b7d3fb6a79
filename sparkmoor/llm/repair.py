"""Token ids in grammar-compressed shards (Re-Pair) with random access.

Documents come in the order of their ids; each task turns its range into shards of about
``SHARD_IDS`` ids.  In a shard, the pairs of neighbouring ids that occur most often are replaced by
new symbols, again and again, until no pair is frequent or the symbols of the format run out.
The rules and the length of what each symbol expands to are stored with the remaining symbols,
so any range of ids can be decoded without the rest.

A shard is one binary value: a header of numbers, then the document ids and lengths, the rules'
left and right sides, their expansion lengths, the first rule of each round, and the symbols.

Defined cases: null and empty texts are the end id alone; null ids come first and stay null; rows
that share an id are ordered by a hash of their text, and rows that repeat stand side by side; a
long document is one shard at most twice over the usual size or as long as itself; an empty table
gives no shards and an empty result.  Other columns are never looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_dir
from .common import pieces
from .tokens import encoder

SHARD_IDS = 1 << 19
SYMBOLS = 1 << 16      # so that a symbol takes two bytes
MIN_COUNT = 6          # a pair that occurs less often is not worth a rule
BUCKET_BITS = 17       # of the counters that single out rare pairs
MAGIC = b"RPSH0001"
_HEAD = struct.Struct("<8sIIIIQI")
SHARD = "part int, shard int, first long, n_ids long, data binary"


def replace_round(seq: np.ndarray, stop: int, next_symbol: int, most: int,
                  min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: (sequence, left sides, right sides) after replacing frequent pairs.

    Pairs are first counted by a hash, which shows for most of them that they are rare, or too rare to
    be among the ``most`` that get a symbol, and then exactly.  Where two frequent pairs overlap the more frequent one is replaced, and of equal
    ones the first, third and so on.  Pairs with the end id are left alone, so that a symbol never
    reaches over the end of a document.
    """
    left, right = seq[:-1], seq[1:]
    open_ = (left != stop) & (right != stop)
    mixed = (left.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (right.astype(np.uint32) * np.uint32(0x85EBCA77))
    bucket = mixed >> np.uint32(32 - BUCKET_BITS)
    counts = np.bincount(bucket[open_], minlength=1 << BUCKET_BITS)
    at_least = np.cumsum(np.bincount(np.minimum(counts, 1 << 16))[::-1])[::-1]   # buckets by their count
    enough = max(min_count, int(np.searchsorted(-at_least, -most, "right") - 1) // 2)
    where = np.flatnonzero(open_ & (counts >= enough)[bucket])
    # the shorter numbers are put in order in less time
    kind_of, half = (np.uint32, 16) if next_symbol + most <= 1 << 16 else (np.int64, 32)
    pair = (left[where].astype(kind_of) << kind_of(half)) | right[where].astype(kind_of)
    kinds, of, n = np.unique(pair, return_inverse=True, return_counts=True)
    weight = np.zeros(len(seq) + 1, np.int32)          # weight[i + 1] is the count of the pair at i
    weight[where + 1] = np.where(n >= enough, n, 0)[of]
    here = weight[where + 1]
    peak = (here > 0) & (here >= weight[where]) & (here >= weight[where + 2])
    at = where[peak]
    fresh = np.diff(at, prepend=-9) != 1
    step = np.arange(len(at))
    take = (step - np.maximum.accumulate(np.where(fresh, step, 0))) % 2 == 0 if len(at) else np.zeros(0, bool)
    at, kind = at[take], of[peak][take]
    times = np.bincount(kind, minlength=len(kinds))
    order = np.argsort(-times, kind="stable")[:most]
    order = order[times[order] >= max(2, min_count // 2)]
    symbol = np.full(len(kinds), -1, np.int64)
    symbol[order] = next_symbol + np.arange(len(order))
    new = symbol[kind]
    at, new = at[new >= 0], new[new >= 0]
    out = seq.copy()
    out[at] = new
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep], (kinds[order] >> half).astype(np.int32), (kinds[order] & ((1 << half) - 1)).astype(np.int32)


class Grammar(NamedTuple):
    base: int              # symbols from here on are rules
    rounds: np.ndarray     # first rule of each round
    left: np.ndarray
    right: np.ndarray
    expands: np.ndarray    # length of each rule's expansion
    symbols: np.ndarray


def build(ids: np.ndarray, stop: int, base: int, symbols: int = SYMBOLS, min_count: int = MIN_COUNT) -> Grammar:
    seq, lefts, rights, rounds, used = ids.astype(np.int32), [], [], [], 0
    while len(seq) > 2 and base + used < symbols:
        before = len(seq)
        # at most half of the symbols that are left, so that later rounds can build on these rules
        most = max(256, (symbols - base - used) // 2)
        seq, a, b = replace_round(seq, stop, base + used, min(most, symbols - base - used), min_count)
        if not len(a):
            break
        lefts.append(a)
        rights.append(b)
        rounds.append(used)
        used += len(a)
        if len(seq) > 0.99 * before:
            break
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int32)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int32)
    size = np.ones(base + used, np.int64)
    for k, begin in enumerate(rounds):
        end = rounds[k + 1] if k + 1 < len(rounds) else used
        size[base + begin:base + end] = size[left[begin:end]] + size[right[begin:end]]
    return Grammar(base, np.array(rounds, np.int64), left, right, size[base:], seq)


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for: the rules of the last round are undone first."""
    seq, end = symbols.astype(np.int32), len(g.left)
    for begin in g.rounds[::-1]:
        is_rule = (seq >= g.base + begin) & (seq < g.base + end)
        if is_rule.any():
            reps = 1 + is_rule
            at = (np.cumsum(reps) - reps)[is_rule]
            rule = seq[is_rule] - g.base
            seq = np.repeat(seq, reps)
            seq[at], seq[at + 1] = g.left[rule], g.right[rule]
        end = begin
    return seq


def write_shard(keys: list[int | None], lengths: list[int], g: Grammar) -> bytes:
    wide = "<u2" if g.base + len(g.left) <= 1 << 16 else "<u4"
    head = _HEAD.pack(MAGIC, len(keys), g.base, len(g.left), len(g.rounds), len(g.symbols), int(wide[-1]))
    return b"".join([
        head, np.array([k is None for k in keys], "u1").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(),
        g.left.astype(wide).tobytes(), g.right.astype(wide).tobytes(), g.expands.astype("<u4").tobytes(),
        g.rounds.astype("<u4").tobytes(), g.symbols.astype(wide).tobytes()])


class Shard(NamedTuple):
    keys: list[int | None]
    lengths: np.ndarray
    grammar: Grammar

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end; only the symbols that cover them are expanded."""
        g = self.grammar
        size = np.ones(g.base + len(g.left), np.int64)
        size[g.base:] = g.expands
        ends = np.cumsum(size[g.symbols])
        total = int(ends[-1]) if len(ends) else 0
        end = total if end is None else min(end, total)
        if begin >= end:
            return np.zeros(0, np.int32)
        a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end)
        skip = begin - (int(ends[a - 1]) if a else 0)
        return expand(g, g.symbols[a:b + 1])[skip:skip + end - begin]


def read_shard(data: bytes) -> Shard:
    magic, n_docs, base, n_rules, n_rounds, n_symbols, wide = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at, parts = _HEAD.size, []
    symbol = f"<u{wide}"
    for kind, n in (("u1", n_docs), ("<i8", n_docs), ("<u4", n_docs), (symbol, n_rules), (symbol, n_rules),
                    ("<u4", n_rules), ("<u4", n_rounds), (symbol, n_symbols)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    null, keys, lengths, left, right, expands, rounds, symbols = parts
    return Shard([None if x else k for x, k in zip(null.tolist(), keys.tolist())], lengths.astype(np.int64),
                 Grammar(base, rounds.astype(np.int64), left.astype(np.int32), right.astype(np.int32),
                         expands.astype(np.int64), symbols.astype(np.int32)))


def write_shards(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1,
                 doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts in the order of their ids and write the shards as a table at ``path``."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, "doc_id", "tie") \
        .sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys, lengths, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = write_shard(keys, lengths, build(np.concatenate(held), end_id, len(enc.mark)))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "shard", "first", "n_ids", "data"])

        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                ids, counts = enc.encode(batch.column(1).to_pylist())
                at = 0
                for key, k in zip(batch.column(0).to_pylist(), counts.tolist()):
                    if n and n + k + 1 > shard_ids:
                        yield flush()
                        shard, first = shard + 1, first + n
                        keys, lengths, held, n = [], [], [], 0
                    keys.append(key)
                    lengths.append(k + 1)
                    held.append(np.append(ids[at:at + k], np.int32(end_id)))
                    at, n = at + k, n + k + 1
        if keys:
            yield flush()

    ordered.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards at ``path``."""
    shards = spark.read.schema(SHARD).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = read_shard(data.as_py())
                raw = memoryview(shard.ids().astype("<u4")).cast("B")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crc), pa.int32()), pa.array(shard.keys, pa.int64()),
                     pa.array(first + starts), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "first", "data").mapInArrow(
        run, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()   # one row per range of ids
    offset, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in totals):
        offsets.append((part, offset))
        offset += n
    before = spark.createDataFrame(offsets, "part int, before long")
    return docs.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write shards into the shared folder of the cluster and read the documents back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, **options)
    return read_documents(spark, path)

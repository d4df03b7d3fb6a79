"""Benchmark decontamination over a positional inverted index of the training texts.

*Index.*  Documents are put together into blocks of a bounded number of words.  A block is a small
inverted index: one row per term with the positions of all its occurrences in the block (gaps as
variable-length numbers), and one row with the keys, starts and lengths of its documents.  One
empty position parts neighbouring documents, so no phrase can run over a border.  Building it
shuffles nothing; it is a Parquet table and can be searched for any later benchmark.

*Search.*  Only the postings of the test's own terms are read and brought together by block.  For
each phrase the lists are taken from the rarest term on: its positions, less their offset in the
phrase, are the candidates, and each further list can only thin them out.  A phrase matches
exactly where all offset-adjusted lists meet, and nearly where all its words occur within
``near`` consecutive words around an occurrence of the rarest.

Phrases are searched in chunks of at most ``CHUNK``; that is what a task holds of the test, however
large it is.

Defined cases: null and empty texts have no words; items without words have no phrases; items of
fewer words than a phrase are one phrase; null document keys stay null; rows that repeat are
documents of their own; empty tables give no matches or no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import global_index
from ..functions.staging import new_folder
from .common import give_back, join_checked, let_go, stage

BLOCK_WORDS, BLOCK_DOCS = 1 << 20, 1 << 16
CHUNK = 100_000   # phrases searched at a time
ROWS = 20_000     # index rows in one Arrow batch
INDEX = ("block string, term string, n long, postings binary, doc_keys array<string>, doc_starts array<int>, "
         "doc_words array<int>")
SPANS = "array<struct<phrase:bigint,exact:boolean,start:int,stop:int>>"

# A-Z become a-z; digits, a-z and everything beyond ASCII stay; the rest parts words
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def phrase_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers, and where each number ends."""
    d = numbers.astype(np.uint64)
    size = np.ones(len(d), np.int64)
    for bits in (7, 14, 21, 28):
        size += d >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = size > k
        if not has.any():
            break
        byte = (d[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - size)[has] + k] = byte.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    at = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * at), first)


class _Block:
    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[np.ndarray] = []
        self.keys: list[str | None] = []
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.next = self.words = 0

    def add(self, key: str | None, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.keys.append(key)
        self.starts.append(self.next)
        self.lengths.append(len(words))
        self.next += len(words) + 1
        self.words += len(words)

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.ids)
        where = np.concatenate([np.arange(s, s + n, dtype=np.int64) for s, n in zip(self.starts, self.lengths)])
        order = np.argsort(ids, kind="stable")
        where, counts = where[order], np.bincount(ids, minlength=len(self.number))
        gaps = np.diff(where, prepend=0)
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])[:len(counts)]
        gaps[firsts] = where[firsts]
        data, ends = pack(gaps)
        stops = ends[np.cumsum(counts) - 1] if len(counts) else ends
        terms = list(self.number)
        for at in range(0, len(terms), ROWS):
            some = terms[at:at + ROWS]
            low = int(stops[at - 1]) if at else 0
            edges = np.concatenate([[low], stops[at:at + ROWS]]) - low
            lists = pa.Array.from_buffers(pa.binary(), len(some), [
                None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[low:int(edges[-1]) + low].copy())])
            empty = [pa.nulls(len(some), t) for t in (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some)), pa.array([t.decode("utf-8", "replace") for t in some], pa.string()),
                 pa.array(counts[at:at + ROWS].astype(np.int64)), lists, *empty], names=_names())
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.nulls(1, pa.string()), pa.array([self.words], pa.int64()), pa.nulls(1, pa.binary()),
             pa.array([self.keys], pa.list_(pa.string())), pa.array([self.starts], pa.list_(pa.int32())),
             pa.array([self.lengths], pa.list_(pa.int32()))], names=_names())


def _names() -> list[str]:
    return [f.split()[0] for f in INDEX.split(", ")]


def build_index(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text",
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """Write the index of ``docs`` to ``path`` (default: the shared folder) and return it."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, n, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = phrase_words(t.as_py())
                if block.keys and (block.words + len(words) > block_words or len(block.keys) >= BLOCK_DOCS):
                    yield from block.rows(f"{part}-{n}")
                    n, block = n + 1, _Block()
                block.add(k, words)
        if block.keys:
            yield from block.rows(f"{part}-{n}")
        del block
        give_back()

    docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(run, INDEX) \
        .write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Phrases(NamedTuple):
    """``texts`` (phrase long, words string) and ``items`` (phrase long, item_id long), both written."""

    texts: DataFrame
    items: DataFrame


def phrases_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = 10) -> Phrases:
    """Every run of ``width`` words of the test's items, equal ones numbered once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = [x.decode("utf-8", "replace") for x in phrase_words(t.as_py())]
                runs = {" ".join(w[a:a + width]) for a in range(max(1, len(w) - width + 1))} if w else set()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(runs), pa.int64()), pa.array(list(runs), pa.string())], names=["item_id", "words"])

    windows = stage(benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
                    .mapInArrow(run, "item_id long, words string"))
    texts = stage(global_index(windows.select("words").distinct(), ["words"], "phrase"))
    items = stage(windows.join(texts, "words").select("phrase", "item_id").distinct())
    return Phrases(texts, items)


class _Plan(NamedTuple):
    """A phrase with its distinct words from the rarest on: (term, offsets), and its length."""

    phrase: int
    terms: list[tuple[str, list[int]]]
    length: int


def _plans(rows: list[tuple[int, str]], freq: dict[str, int]) -> list[_Plan]:
    plans = []
    for phrase, words in rows:
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words.split(" ")):
            at.setdefault(w, []).append(i)
        if all(w in freq for w in at):
            plans.append(_Plan(phrase, sorted(at.items(), key=lambda x: (freq[x[0]], x[0])), len(words.split(" "))))
    return plans


def _found(in_list: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(in_list, wanted)
    return in_list[np.minimum(at, len(in_list) - 1)] == wanted


def _close(in_list: np.ndarray, to: np.ndarray, reach: int) -> np.ndarray:
    at = np.searchsorted(in_list, to - reach)
    return in_list[np.minimum(at, len(in_list) - 1)] - to <= reach


def match_phrase(plan: _Plan, lists: dict[str, np.ndarray], doc_at, near: int) -> list[tuple[int, int, bool]]:
    """(start, stop, exact) of the matches of one phrase in a block; ``doc_at`` gives the first
    position and the end of the document around a position."""
    if any(t not in lists for t, _ in plan.terms):
        return []
    reach = max(near, plan.length) - 1
    rare = lists[plan.terms[0][0]]
    for term, _ in plan.terms[1:]:       # both kinds of match have all words close to the rarest
        rare = rare[_close(lists[term], rare, reach)]
        if not len(rare):
            return []
    starts = rare - plan.terms[0][1][0]
    for term, offsets in plan.terms:
        for o in offsets:
            if len(starts):
                starts = starts[_found(lists[term], starts + o)]
    out = [(int(s), int(s) + plan.length, True) for s in starts]
    if near:
        seen = -1                        # words up to here belong to a match already
        exact = set(starts.tolist())
        for p in rare.tolist():
            if p < seen or p - plan.terms[0][1][0] in exact:
                continue
            low, high = doc_at(p)
            for s in range(max(low, p - near + 1), p + 1):
                stop = min(s + near, high)
                ends = []
                for term, _ in plan.terms:
                    x = lists[term]
                    i = int(np.searchsorted(x, s))
                    if i == len(x) or x[i] >= stop:
                        break
                    ends.append(int(x[i]))
                else:
                    seen = max(ends) + 1
                    out.append((min(ends), seen, False))
                    break
    return out


def search(index: DataFrame, phrases: Phrases, near: int = 0) -> DataFrame:
    """(block, ord, doc_key, n_words, spans) of every indexed document, ``spans`` with the matches of
    all phrases as word positions within it."""
    spark = index.sparkSession
    n = phrases.texts.count()
    parts = [_search_chunk(spark, index, phrases.texts.where(F.floor(F.col("phrase") / CHUNK) == c), near)
             for c in range(max(1, -(-n // CHUNK)))]
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("block", "ord").agg(F.first("doc_key").alias("doc_key"), F.first("n_words").alias("n_words"),
                                             F.flatten(F.collect_list("spans")).alias("spans"))


def _search_chunk(spark: SparkSession, index: DataFrame, texts: DataFrame, near: int) -> DataFrame:
    rows = [(r[0], r[1]) for r in texts.select("phrase", "words").collect()]   # at most CHUNK
    terms = spark.createDataFrame([(t,) for t in sorted({w for _, p in rows for w in p.split(" ")})], "term string")
    wanted = F.broadcast(terms)
    freq = {r[0]: r[1] for r in index.select("term", "n").join(wanted, "term", "left_semi")
            .groupBy("term").agg(F.sum("n")).collect()}                        # at most CHUNK times a phrase's words
    plans = spark.sparkContext.broadcast(_plans(rows, freq))
    of_docs = index.where("term IS NULL")
    of_terms = index.where("term IS NOT NULL").join(wanted, "term", "left_semi").select(*index.columns)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        lists, keys, starts, lengths = {}, [], None, None
        for term, data, k, s, w in zip(table.column("term").to_pylist(), table.column("postings"),
                                       *[table.column(c) for c in ("doc_keys", "doc_starts", "doc_words")]):
            if term is None:
                keys, starts, lengths = k.as_py(), np.array(s.as_py(), np.int64), np.array(w.as_py(), np.int64)
            else:
                lists[term] = np.cumsum(unpack(data.as_py()))

        def doc_at(p: int) -> tuple[int, int]:
            i = int(np.searchsorted(starts, p, "right")) - 1
            return int(starts[i]), int(starts[i] + lengths[i])

        found = [(s, e, x, plan.phrase) for plan in plans.value for s, e, x in match_phrase(plan, lists, doc_at, near)]
        a = np.array([f[0] for f in found], np.int64)
        of = np.searchsorted(starts, a, "right") - 1
        order = np.argsort(of, kind="stable")
        begin = a[order] - starts[of[order]]
        stop = begin + np.array([f[1] - f[0] for f in found], np.int64)[order]
        spans = pa.StructArray.from_arrays(
            [pa.array(np.array([f[3] for f in found], np.int64)[order]),
             pa.array(np.array([f[2] for f in found], bool)[order]),
             pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32))],
            names=["phrase", "exact", "start", "stop"])
        edges = np.searchsorted(of[order], np.arange(len(keys) + 1)).astype(np.int32)
        lists.clear()
        give_back()
        return pa.table({"block": pa.array([block] * len(keys)), "ord": pa.array(np.arange(len(keys), dtype=np.int64)),
                         "doc_key": pa.array(keys, pa.string()), "n_words": pa.array(lengths),
                         "spans": pa.ListArray.from_arrays(pa.array(edges), spans)})

    return of_docs.unionByName(of_terms).groupBy("block").applyInArrow(
        run, f"block string, ord long, doc_key string, n_words long, spans {SPANS}")


def report(index: DataFrame, phrases: Phrases, near: int = 12) -> DataFrame:
    """(doc_key, n_words, n_hit, n_items, items, contaminated, n_near) of every indexed document.

    ``items`` are the ids of the items with an exact phrase in the document, sorted as text, and
    ``n_near`` counts those with a phrase whose words lie within ``near`` consecutive words.
    """
    found = stage(search(index, phrases, near))
    hit = found.where(F.size("spans") > 0).select(
        "block", "ord", F.explode(F.array_distinct(F.transform(
            "spans", lambda s: F.struct(s["phrase"].alias("phrase"), s["exact"].alias("exact"))))).alias("m"))
    items = join_checked(hit.select("block", "ord", "m.phrase", "m.exact"), phrases.items, ["phrase"], "inner") \
        .groupBy("block", "ord").agg(
            F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"),
            F.count_distinct("item_id").alias("n_near"))
    exact = F.filter("spans", lambda s: s["exact"])
    places = F.flatten(F.transform(exact, lambda s: F.sequence(s["start"], s["stop"] - 1)))
    n_hit = F.size(F.array_distinct(places)).cast("long")
    return found.join(items, ["block", "ord"], "left").select(
        "doc_key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without an exact phrase of the test, with the columns they came with.

    The verdict depends on the text alone, so texts are known by their digest here, and rows
    with null or repeated ids need no care."""
    from .common import fresh

    key = fresh(docs, "_digest")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit(""))))
    found = search(build_index(keyed, key=key, text=text), phrases_of(benchmark))
    bad = stage(found.where(F.size("spans") > 0).select(F.col("doc_key").alias(key)).distinct())
    return join_checked(keyed, bad, [key], "left_anti", row_bytes=96).drop(key)

"""Near-duplicate join on word n-grams with rare-first prefix filtering.

1.  *Counts.*  Every task counts the n-grams of its documents in ``BUCKETS`` hashed counters; their
    sum, reduced to a byte each, is the only thing sent to all tasks, and its size is fixed.
    Ordered by count, rarest first, and then by hash, all n-grams have one global order.
2.  *Prefixes.*  Two sets of the demanded similarity share one of the first
    ``n - ceil(t n) + 1`` n-grams in that order.  Documents with equal sets become one class.
3.  *Join on prefix n-grams.*  The classes that share a prefix n-gram are its group, and groups with the
    same members count once.  A class belongs to many groups, but lives in one home only: a block of
    its largest group.
4.  *Verification.*  Pairs go through the length, positional and suffix filters, and what is left is
    verified on whole sets.  First the residents of each home are compared, and what they link is
    contracted.  Two classes of different components that share a group and not a home then meet at
    the home of the one in the larger component, and so once per pair.  Only components are asked for:
    pairs that are connected already need no verification, and no class goes where all are of its own.

So a text is sent once to its home, and beyond that only to homes that hold others it may be linked to,
however many n-grams near copies have in common.

Texts are fetched for the members of groups only; sets are never written.

Defined cases: null, empty and blank texts have no n-grams and are linked with nothing; a text of
fewer words than an n-gram is one n-gram; rows that repeat, or share an id, are members of the
classes of their texts; a null id is passed over when a component is named, and a component of
null ids only has no name; an empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashOf, fresh, give_back, join_checked, let_go, pieces, small_enough, stage
from .graph import connected

BUCKET_BITS, SLICE_BITS = 24, 16
BLOCK_MEMBERS, BLOCK_GRAMS = 1000, 1_000_000
WORDS_HELD = 250_000    # words whose hashes a task remembers
SIGNATURE = "doc_id long, text_hash long, n long, digest binary, node long, prefix array<bigint>"
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = re.compile(rb"[\x09-\x0d ]")
_SLICE = 1 << 22


class Params(NamedTuple):
    width: int = 3
    percent: int = 90  # least similarity in percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def overlap(self, x: int, y: int) -> int:
        """Least intersection of sets of x and y members that are similar enough."""
        return -(-self.percent * (x + y) // (100 + self.percent))


def gram_set(text: str | None, width: int, hash_of: HashOf) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text; long texts are cut at blanks."""
    raw = text.encode("utf-8", "surrogatepass").translate(_UPPER) if text else b""
    if len(raw) <= _SLICE:
        words = raw.split()
        w = hash_of.array(words, len(words))
    else:
        parts, at = [], 0
        while at < len(raw):
            cut = _BLANK.search(raw, at + _SLICE)
            stop = cut.start() if cut else len(raw)
            words = raw[at:stop].split()
            parts.append(hash_of.array(words, len(words)))
            at = stop
        w = np.concatenate(parts)
    if not len(w):
        return w
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k:len(w) - width + 1 + k])
    return np.unique(h)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_levels(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """For each hashed bucket a byte that rises with the number of n-grams counted there."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts, hash_of = np.zeros(1 << BUCKET_BITS, np.uint32), HashOf(WORDS_HELD)
        for batch in batches:
            for t in batch.column(0):
                at = gram_set(t.as_py(), width, hash_of) >> np.uint64(64 - BUCKET_BITS)
                np.add.at(counts, at.astype(np.int64), 1)
        for k, part in enumerate(counts.reshape(-1, 1 << SLICE_BITS)):
            if part.any():
                packed = zlib.compress(np.minimum(part, 65535).astype(np.uint16).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed])], names=["slice", "counts"])
        del counts, hash_of
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(c.as_py()), np.uint16).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            level = np.minimum(8 * np.log2(part + 1.0), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()])],
                                             names=["slice", "counts"])

    fields = "slice int, counts binary"
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(text).mapInArrow(count, fields).repartition(tasks, "slice").mapInArrow(add, fields).collect()
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)  # at most this many bytes come back
    for k, c in rows:
        levels[k << SLICE_BITS:(k + 1) << SLICE_BITS] = np.frombuffer(c, np.uint8)
    return levels


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(doc_id, text_hash, n, digest, node, prefix): size and digest of each set and its rarest n-grams."""
    levels = docs.sparkSession.sparkContext.broadcast(gram_levels(docs.select(text), text, params.width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        hash_of, level = HashOf(WORDS_HELD), levels.value
        for whole in batches:
            for batch in pieces(whole):
                sizes, digests, nodes, prefixes = [], [], [], []
                for t in batch.column(1):
                    s = gram_set(t.as_py(), params.width, hash_of)
                    key = (level[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) \
                        | (s >> np.uint64(8))
                    p = params.prefix(len(s))
                    key = np.sort(np.partition(key, p - 1)[:p]) if p and p < len(key) else key
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    sizes.append(len(s))
                    digests.append(digest)
                    nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                    prefixes.append(key.view(np.int64))
                edges = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))],
                    names=[f.split()[0] for f in SIGNATURE.split(", ")])
        del hash_of
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("text_hash")).mapInArrow(run, SIGNATURE)


class Member(NamedTuple):
    name: bytes
    grams: np.ndarray          # the whole set
    visitor: bool = False
    rank: tuple[int, bytes] = (0, b"")   # size and root of its component


def find_links(docs: list[Member], params: Params) -> list[tuple[bytes, bytes]]:
    """Links that connect what the similar pairs of ``docs`` connect.

    Members of one component are connected already.  Where there are visitors, only pairs of a visitor
    and a resident of a component of higher rank are compared.  N-grams are ordered by their count among
    these documents, rarest first; sets come in order of size.
    """
    docs = sorted(docs, key=lambda d: (len(d.grams), d.name))
    visited = any(d.visitor for d in docs)
    sizes = [len(d.grams) for d in docs]
    grams, where, counts = np.unique(np.concatenate([d.grams for d in docs]), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, counts))] = np.arange(len(grams))
    cuts = np.cumsum(sizes)[:-1]
    ranks = [np.sort(r) for r in np.split(rank[where], cuts)]
    common = np.sort(rank[counts > 1])
    first: dict[bytes, int] = {}
    parent = [first.setdefault(d.rank[1], i) if d.rank[1] else i for i, d in enumerate(docs)]

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    index: dict[int, list[tuple[int, int]]] = {}
    out = []
    least = int(common[0]) if len(common) else len(grams)
    for x, rx in enumerate(ranks):
        nx, p = sizes[x], params.prefix(sizes[x])
        prefix = rx[:p].tolist()
        shared: dict[int, int] = {}
        for i, g in enumerate(prefix):
            if g < least:
                continue                                                # in no other document
            for y, j in index.get(g, ()):
                ny = sizes[y]
                if 100 * ny < params.percent * nx:
                    continue                                            # length
                so_far = shared.get(y, 0)
                if so_far >= 0:                                         # position
                    fits = so_far + 1 + min(nx - i, ny - j) - 1 >= params.overlap(nx, ny)
                    shared[y] = so_far + 1 if fits else -1
        for y, n in shared.items():
            if n <= 0 or find(x) == find(y):
                continue
            if visited:
                guest, host = (docs[x], docs[y]) if docs[x].visitor else (docs[y], docs[x])
                if not guest.visitor or host.visitor or host.rank <= guest.rank:
                    continue
            ry, ny = ranks[y], sizes[y]
            need = params.overlap(nx, ny)
            # suffix: cut both sets at the same n-grams; the parts' sizes bound what they can share
            at = np.linspace(0, nx, 9).astype(np.int64)
            mine, theirs = np.diff(at), np.diff(np.concatenate([[0], np.searchsorted(ry, rx[at[1:-1]]), [ny]]))
            if np.minimum(mine, theirs).sum() < need:
                continue
            both = int((ry[np.minimum(np.searchsorted(ry, rx), ny - 1)] == rx).sum())
            if 100 * both >= params.percent * (nx + ny - both):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
                out.append((docs[x].name, docs[y].name))
        for i, g in enumerate(prefix):
            if g >= least:
                index.setdefault(g, []).append((x, i))
    return out


MAP_BITS = 27           # of a bitmap that thins rows before they are shuffled


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bits set at the lowest ``MAP_BITS`` bits of the numbers of a column: a fixed size, whatever the column."""
    piece = 1 << 16     # bytes

    def emit(places: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, bits in places.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)])],
                                             names=["slice", "bits"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
            for k, some in zip(*_runs(at >> 19, at)):
                bits = held.setdefault(int(k), np.zeros(piece, np.uint8))
                np.bitwise_or.at(bits, (some & (8 * piece - 1)) >> 3, np.left_shift(1, some & 7).astype(np.uint8))
        yield from emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                bits = np.frombuffer(zlib.decompress(b.as_py()), np.uint8)
                held[k] = held[k] | bits if k in held else bits
        yield from emit(held)

    fields, tasks = "slice int, bits binary", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for k, b in df.select(column).mapInArrow(collect, fields).repartition(tasks, "slice").mapInArrow(merge, fields).collect():
        out[k * piece:(k + 1) * piece] = np.frombuffer(zlib.decompress(b), np.uint8)
    return out


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, starts = np.unique(keys, return_index=True)
    return ids, np.split(values, starts[1:])


def _set(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = (numbers.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def thinned(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, n, gram) of ``rows`` (node, n, prefix) whose n-grams may be in ``kept``: what cannot is left
    out where it is, so that only the n-grams of groups, and few others, are shuffled to meet them."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(kept, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy()
            of = np.repeat(np.arange(len(prefix)), np.diff(prefix.offsets.to_numpy()))
            some = np.flatnonzero(_set(held, flat))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(of[some])), batch.column("n").take(pa.array(of[some])),
                                              pa.array(flat[some])], names=["node", "n", "gram"])

    return rows.select("node", "n", "prefix").mapInArrow(run, "node long, n long, gram long")


def one_per_class(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, prefix) of every class: a row of ``signed`` that has no copy stays where it is, and of the
    copies the class' own one is taken."""
    several = stage(classes.where("copies > 1").select("digest", "node", "rep"))
    rows = signed.where("n > 0").select("doc_id", "text_hash", "digest", "node", "n", "prefix")
    own = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    if small_enough(several, 96):
        met = rows.join(F.broadcast(several.drop("node")), "digest", "left")
        alone, copied = met.where("rep IS NULL"), met.where(own)
    else:
        bits = rows.sparkSession.sparkContext.broadcast(bitmap(several, "node"))

        @F.arrow_udf("boolean")
        def may_have_copies(nodes: pa.Array) -> pa.Array:
            return pa.array(_set(bits.value, nodes.to_numpy()))

        marked = rows.withColumn("copied", may_have_copies("node"))
        met = marked.where("copied").join(several.drop("node"), "digest", "left")
        alone = marked.where("NOT copied").unionByName(met.where("rep IS NULL").drop("rep"))
        copied = met.where(own)
    # rows may repeat id and text
    return alone.select("node", "n", "prefix").unionByName(copied.dropDuplicates(["digest"]).select("node", "n", "prefix"))


def groups_of(signed: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """(gram, node): groups of two or more classes that share a prefix n-gram.

    Left out are members whose size none of the others comes near, and groups with the members of
    another one.
    """
    prefixes = one_per_class(signed, classes)
    rows = prefixes.select("node", "n", F.explode("prefix").alias("gram"))
    # nodes are digests, so their lowest, their highest and their parity tell the members of a group
    shared = rows.groupBy("gram").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor("node").alias("mark")).where("size > 1")
    kept = stage(shared.groupBy("size", "low", "high", "mark").agg(F.min("gram").alias("gram")).select("gram"))
    rows = rows if small_enough(kept, 8) else thinned(prefixes, kept)
    members = stage(join_checked(rows, kept, ["gram"], "inner", row_bytes=8))
    # sizes that are near enough fall into the same or neighbouring steps of this scale
    step = F.floor(F.log("n") / float(np.log(100 / params.percent)) + 1e-6) if params.percent < 100 else F.col("n")
    members = members.select("node", "gram", step.cast("long").alias("step"))
    steps = members.groupBy("gram", "step").agg(F.count(F.lit(1)).alias("m"))
    near = stage(steps.select("gram", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)).alias("step"), "m")
                 .groupBy("gram", "step").agg(F.sum("m").alias("m")).where("m > 1").drop("m"))
    return join_checked(members, near, ["gram", "step"], "left_semi").drop("step")


def homes_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, node, rep, gram, block): the home of every member of a group, which is a block of the
    largest group that it belongs to."""
    sizes = stage(members.groupBy("gram").agg(F.count(F.lit(1)).alias("size")))
    largest = join_checked(members, sizes, ["gram"], "inner").groupBy("node").agg(
        F.max(F.struct("size", "gram")).alias("of")).select("node", "of.gram")
    homes = stage(classes.select("digest", "node", "rep", "n").join(stage(largest), "node"))
    blocks = stage(homes.groupBy("gram").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    return join_checked(homes, blocks, ["gram"], "inner").select(
        "digest", "node", "rep", "gram", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"))


def _compared(texts: DataFrame, placed: DataFrame, by: list[str], params: Params) -> DataFrame:
    """(a, b): links found in each of the tasks ``by`` of ``placed`` (digest, visitor, size, root, ...)."""
    def run(table: pa.Table) -> pa.Table:
        hash_of = HashOf(WORDS_HELD)
        here = [Member(d, gram_set(t.as_py(), params.width, hash_of), v, (s, r))
                for d, v, s, r, t in zip(*[table.column(c).to_pylist() for c in ("digest", "visitor", "size", "root")],
                                         table.column("t"))]
        found = find_links(here, params)
        if len(here) >= BLOCK_MEMBERS // 4:
            del here, hash_of
            give_back()
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()),
                         "b": pa.array([x[1] for x in found], pa.binary())})

    # the texts stay in place until they go to their tasks, if what tells the tasks is small enough
    rows = join_checked(texts, stage(placed), ["digest"], "inner", row_bytes=96)
    return rows.groupBy(*by).applyInArrow(run, "a binary, b binary")


def _visits(members: DataFrame, homes: DataFrame, found: DataFrame, heads: bool) -> DataFrame:
    """(gram, block, part, digest, visitor, size, root) of all visits that may still find a link.

    A member visits the homes of the members that it shares a group with, where these are of
    components of higher rank; with ``heads`` only one member of each component of several does.
    """
    roots = stage(connected(found).withColumnRenamed("node", "digest"))
    ranked = stage(join_checked(homes, roots, ["digest"], "left", row_bytes=96)
                   .withColumn("root", F.coalesce("root", "digest")))
    sizes = stage(ranked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("digest").alias("head")))
    ranked = stage(join_checked(ranked, sizes, ["root"], "inner", row_bytes=96).select(
        "node", "digest", F.struct(F.col("gram").alias("gram"), "block").alias("home"), "size", "root",
        ((F.col("digest") == F.col("head")) & (F.col("size") > 1)).alias("head")))
    in_groups = stage(members.join(ranked, "node"))
    there = in_groups.groupBy("gram", "home").agg(F.max(F.struct("size", "root")).alias("highest"))
    open_ = stage(there.groupBy("gram").agg(F.max("highest").alias("highest"), F.count(F.lit(1)).alias("homes"))
                  .where("homes > 1").select("gram", F.col("highest").alias("top")))
    guests = join_checked(in_groups, open_, ["gram"], "inner").where(F.struct("size", "root") < F.col("top"))
    guests = guests.where("head") if heads else guests
    visits = guests.select("gram", "digest", "size", "root", F.col("home").alias("own")) \
        .join(there, "gram").where((F.col("home") != F.col("own")) & (F.col("highest") > F.struct("size", "root"))) \
        .select("home", "digest", "size", "root").distinct()
    visits = stage(visits)
    parts = stage(visits.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("parts")))
    guests = join_checked(visits, parts, ["home"], "inner") \
        .withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")).withColumn("visitor", F.lit(True))
    hosts = join_checked(ranked, parts, ["home"], "inner") \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("visitor", F.lit(False))
    names = ["home.gram", "home.block", "part", "digest", "visitor", "size", "root"]
    return guests.select(*names).unionByName(hosts.select(*names))


def links(signed: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, params: Params) -> DataFrame:
    """(a, b) verified links between classes, enough to connect all that similar pairs connect.

    First the residents of each home are compared, so that most near copies are of one component.  Then
    all members that may still have a link to another component visit its homes; where these are
    many, one head of each component goes before them.
    """
    members = stage(groups_of(signed, classes, params))
    homes = stage(homes_of(members, classes))
    fetched = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    texts = stage(join_checked(fetched, homes.select("digest", "rep"), (F.col("h") == F.col("rep.text_hash"))
                               & F.col("d").eqNullSafe(F.col("rep.doc_id")), "inner", row_bytes=96).select("digest", "t"))
    if texts.count() > homes.count():   # only where rows repeat
        texts = stage(texts.groupBy("digest").agg(F.first("t").alias("t")))
    several = stage(homes.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    residents = join_checked(homes, several, ["gram", "block"], "left_semi").select(
        "digest", "gram", "block", F.lit(False).alias("visitor"), F.lit(0).cast("long").alias("size"),
        F.lit(b"").alias("root"))
    found = stage(_compared(texts, residents, ["gram", "block"], params))
    visits = stage(_visits(members, homes, found, False))
    if visits.where("visitor").count() > homes.count() // 4:   # many: let the heads merge what they can first
        found = _after(found, texts, _visits(members, homes, found, True), params)
        visits = stage(_visits(members, homes, found, False))
    return _after(found, texts, visits, params)


def _after(found: DataFrame, texts: DataFrame, visits: DataFrame, params: Params) -> DataFrame:
    return stage(found.unionByName(_compared(texts, visits, ["gram", "block", "part"], params)))


def similar_classes(signed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    params: Params = Params()) -> DataFrame:
    """(digest, component_id) of the classes that have copies or links; ``signed`` is written."""
    classes = stage(signed.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("node").alias("node")))
    joined = stage(connected(links(signed, classes, docs, doc_id, text, params)).withColumnRenamed("node", "digest"))
    named = join_checked(classes.select("digest", "class_id", "copies"), joined, ["digest"], "left") \
        .where("copies > 1 OR root IS NOT NULL")
    named = stage(named.withColumn("root", F.coalesce("root", "digest")))
    names = stage(named.groupBy("root").agg(F.min("class_id").alias("component_id")))
    return join_checked(named, names, ["root"], "inner").select("digest", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row; ``component_id`` is the smallest id that
    links reach."""
    signed = stage(signatures(docs, doc_id, text, params))
    classes = stage(similar_classes(signed, docs, doc_id, text, params))
    every = join_checked(signed.select("doc_id", "text_hash", "n", "digest"), classes, ["digest"], "left", row_bytes=96)
    return every.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                        F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """The rows whose id names their component; of rows that repeat id and text one stays.  Rows with
    a null id stay unless a copy or near copy has an id."""
    found = stage(near_duplicates(docs, doc_id, text, params))
    d, h = fresh(docs, "_d"), fresh(docs, "_h")
    keys = [F.col("doc_id").alias(d), F.col("text_hash").alias(h)]
    gone = stage(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*keys).distinct())
    again = stage(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    keyed = docs.withColumn(h, F.xxhash64(text))

    def meets(rows: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
        return join_checked(keyed, rows, keyed[doc_id].cast("long").eqNullSafe(rows[d]) & (keyed[h] == rows[h]), how)

    stay = meets(gone, keyed, "left_anti")
    if again.count():   # only the rows in question are brought together
        stay = meets(again, stay, "left_anti").unionByName(meets(again, stay, "left_semi").dropDuplicates([doc_id, h]))
    return stay.select(*[f"`{c}`" for c in docs.columns])

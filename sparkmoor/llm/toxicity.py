"""Toxicity from two class-conditional Kneser-Ney models.

A text's score rests on the difference of its log-likelihoods under a model of toxic and one of
ordinary texts, divided by its length.  Both models interpolate word pairs with words, by absolute
discounting, and words with counts that the classes share; a word counts once for each word it
has followed, so that copies of a text add nothing.

Smoothing goes by evidence: as long as an expression's counts in the two classes may be a matter
of chance (``EVIDENCE``, a likelihood-ratio statistic), both models take the shared backoff for it,
and the expression speaks for neither.  Most rare expressions are of that sort; without this the
sum of their chance differences drowns the few words that do tell the classes apart.

All counts come from all labelled rows outside the held-out fold, but for one row in five, on
which the mean ratio is turned into a probability by a monotone step curve (all these rows count,
added up by their ratio to ``RATIO_DIGITS`` digits).

The models are what has evidence.  If that is small enough (``MODEL_ROWS``) it is sent to all tasks
and texts are scored where they lie; else their words meet it in shuffled joins, with equal results.

Defined cases: null and empty texts have no words and score as the curve says of 0; null
labels are not learned from, and of several labels of an id the highest counts; a null id counts
as an empty one for the split; without examples of both classes every score is 0; rows that repeat
are rows of their own; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashOf, give_back, join_checked, per_row, pieces, small_enough, stage
from .decontaminate import phrase_words
from .language import in_fold

DISCOUNT = 0.75
BACKOFF = 0.002      # share of the backoff in an expression with evidence
EVIDENCE = 14.0      # about one in five thousand by chance
MODEL_ROWS = 1_000_000
MASK_BITS, MASK_SLICE = 26, 1 << 16   # bits of the mask of pairs, bytes of its slices
RATIO_DIGITS = 4
START = 0  # stands before the first word
PIECE, WORDS_HELD = 4 << 20, 250_000   # bytes of text that are taken apart at a time, words whose hashes a task holds


def _pairs(texts, hash_of: HashOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word before, word) as hashes, for all words of a list of texts."""
    words = [phrase_words(t.as_py()) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    w = hash_of.array((x for ws in words for x in ws), int(sizes.sum()))
    v = np.concatenate([[np.uint64(START)], w[:-1]]) if len(w) else w
    ends = np.cumsum(sizes)
    firsts = (ends - sizes)[sizes > 0]
    v[firsts] = START
    return np.repeat(np.arange(len(words)), sizes), v.view(np.int64), w.view(np.int64)


def pair_counts(labelled: DataFrame) -> DataFrame:
    """(v, w, toxic, ordinary) of the word pairs of ``labelled`` (text, label), added up in each batch
    before they are shuffled, and written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = HashOf(WORDS_HELD)
        for whole in batches:
            for batch in pieces(whole, PIECE):
                of, v, w = _pairs(batch.column(0), hash_of)
                if not len(of):
                    continue
                one = 1 << (32 * np.array(batch.column(1).to_pylist(), np.int64)[of])   # toxic in the upper half
                order = np.lexsort((w, v))
                v, w, one = v[order], w[order], one[order]
                first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[first]), pa.array(w[first]), pa.array(np.add.reduceat(one, first))], names=["v", "w", "n"])
        give_back()

    # the halves are parted before they are added up, as the sums may take more than 32 bits
    return stage(labelled.select("text", "label").mapInArrow(run, "v long, w long, n long").groupBy("v", "w").agg(
        F.sum(F.shiftrightunsigned("n", 32)).alias("toxic"),
        F.sum(F.col("n").bitwiseAND(F.lit((1 << 32) - 1))).alias("ordinary")))


def _places(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The bit of each pair in a mask of 2^MASK_BITS bits."""
    h = (v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ w.view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(27))) >> np.uint64(64 - MASK_BITS)).astype(np.int64)


def _mask(pairs: DataFrame) -> np.ndarray:
    """Bits at the places of ``pairs``; its size is fixed."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << (MASK_BITS - 3), np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            np.bitwise_or.at(mask, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k, part in enumerate(mask.reshape(-1, MASK_SLICE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])],
                                                 names=["slice", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(c.as_py()), np.uint8)
                parts[k] = parts[k] | part if k in parts else part
        for k, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["slice", "bits"])

    fields = "slice int, bits binary"
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("v", "w").mapInArrow(mark, fields).repartition(tasks, "slice").mapInArrow(join, fields).collect()
    mask = np.zeros(1 << (MASK_BITS - 3), np.uint8)   # at most this many bytes come back
    for k, bits in rows:
        mask[k * MASK_SLICE:(k + 1) * MASK_SLICE] = np.frombuffer(bits, np.uint8)
    return mask


def with_contexts(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Append to the written ``pairs`` (v, w, ...) of ``labelled`` ``fresh_toxic`` and ``fresh_ordinary``: how many
    different words have stood before the pair in texts of the class, counted in full.  A passage that
    is copied many times raises a pair's count, but not this.

    The mask keeps other pairs, but for a few, out of the shuffle; the join drops the rest.
    """
    mask = labelled.sparkSession.sparkContext.broadcast(_mask(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, bits = HashOf(WORDS_HELD), mask.value
        for whole in batches:
            for batch in pieces(whole, PIECE):
                of, v, w = _pairs(batch.column(0), hash_of)
                at = _places(v, w)
                hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                u = np.where(v == START, START, np.roll(v, 1))[hit]
                v, w, label = v[hit], w[hit], np.array(batch.column(1).to_pylist(), np.int64)[of[hit]]
                order = np.lexsort((label, u, w, v))
                u, v, w, label = u[order], v[order], w[order], label[order]
                new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (label[1:] != label[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (v, w, u, 1 << label)], names=["v", "w", "u", "of"])
        give_back()

    seen = labelled.select("text", "label").mapInArrow(run, "v long, w long, u long, of long") \
        .groupBy("v", "w", "u").agg(F.bit_or("of").alias("of"))
    fresh = seen.groupBy("v", "w").agg(F.sum(F.shiftright("of", 1)).alias("fresh_toxic"),
                                       F.sum(F.col("of").bitwiseAND(F.lit(1))).alias("fresh_ordinary"))
    return join_checked(fresh, pairs, ["v", "w"], "inner").select(*pairs.columns, "fresh_toxic", "fresh_ordinary")


def count_pairs(labelled: DataFrame) -> DataFrame:
    """(v, w, toxic, ordinary, fresh_toxic, fresh_ordinary) of all word pairs of ``labelled`` (text, label)."""
    return with_contexts(labelled, pair_counts(labelled))


class Model(NamedTuple):
    """Log-likelihood ratios: ``words`` (w, word_ratio) and ``pairs`` (v, w, pair_ratio), which take
    precedence; anything else has none."""

    words: DataFrame
    pairs: DataFrame
    rows: int


def _evidence(toxic: Column, ordinary: Column, share: float) -> Column:
    """Twice the log-likelihood ratio of the counts against the classes' shares in all texts."""
    n = toxic + ordinary
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return 2 * (part(toxic, share) + part(ordinary, 1 - share))


def _evidence_in_places(share: float) -> Column:
    """Evidence of a pair of which each occurrence counts only as far as it stood in a place of its own.

    Both counts are drawn down by the same factor, the places for each occurrence in the class that the
    pair speaks for.  The numbers of places are not held against each other: of a frequent pair both
    classes come to know all places there are, whatever their counts.
    """
    toxic, ordinary = F.col("toxic"), F.col("ordinary")
    own = F.when(toxic > share * (toxic + ordinary), F.col("fresh_toxic") / toxic).otherwise(F.col("fresh_ordinary") / ordinary)
    return own * _evidence(toxic, ordinary, share)


def fit(labelled: DataFrame, discount: float = DISCOUNT, backoff: float = BACKOFF,
        evidence: float = EVIDENCE) -> Model | None:
    """Models of all rows of ``labelled`` (text, label); None without words of both classes."""
    counts = pair_counts(labelled)
    toxic, ordinary = F.col("toxic"), F.col("ordinary")
    words = stage(counts.groupBy("w").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")]))
    m_toxic, m_ordinary = words.agg(F.sum("toxic"), F.sum("ordinary")).first()
    n_toxic, n_ordinary = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not m_toxic or not m_ordinary:
        return None
    cut = lambda c: F.greatest(c - discount, F.lit(0.0))
    shared = (toxic + ordinary) / (m_toxic + m_ordinary)
    telling = _evidence(toxic, ordinary, m_toxic / (m_toxic + m_ordinary)) >= evidence
    own = words.select("w", *[
        F.when(telling, (1 - backoff) * cut(c) / total + backoff * shared).otherwise(shared).alias(f"p_{name}")
        for name, c, total in (("toxic", toxic, m_toxic), ("ordinary", ordinary, m_ordinary))], telling.alias("telling"))
    ratios = stage(own.where("telling").select("w", F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("word_ratio")))
    share = n_toxic / (n_toxic + n_ordinary)
    told = stage(counts.where(_evidence(toxic, ordinary, share) >= evidence))
    pairs = stage(with_contexts(labelled, told).where(_evidence_in_places(share) >= evidence)
                  .drop("fresh_toxic", "fresh_ordinary"))
    heads = join_checked(counts.select("v", "toxic", "ordinary"), stage(pairs.select("v").distinct()), ["v"], "left_semi") \
        .groupBy("v").agg(F.sum("toxic").alias("v_toxic"), F.sum("ordinary").alias("v_ordinary"))

    def conditional(name: str) -> Column:
        n = F.col(f"v_{name}")
        return F.when(n > 0, (1 - backoff) * cut(F.col(name)) / n + backoff * F.col(f"p_{name}")).otherwise(F.col(f"p_{name}"))

    tails = stage(join_checked(own, stage(pairs.select("w").distinct()), ["w"], "left_semi"))
    told = stage(pairs.join(stage(heads), "v").join(tails, "w").select(
        "v", "w", F.log(conditional("toxic") / conditional("ordinary")).alias("pair_ratio")))
    return Model(ratios, told, ratios.count() + told.count())


class _Lookup:
    """The ratios as sorted arrays."""

    def __init__(self, words: pa.Table, pairs: pa.Table):
        w, order = self._sorted(words.column("w").to_numpy())
        self.w, self.of_word = w, words.column("word_ratio").to_numpy()[order]
        self.heads = np.unique(pairs.column("v").to_numpy())
        self.tails = np.unique(pairs.column("w").to_numpy())
        self.pair, order = self._sorted(self._key(pairs.column("v").to_numpy(), pairs.column("w").to_numpy())[0])
        self.of_pair = pairs.column("pair_ratio").to_numpy()[order]

    @staticmethod
    def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x)
        return x[order], order

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _key(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a known head and tail as one number; whether they are such pairs."""
        (a, has_a), (b, has_b) = self._find(self.heads, v), self._find(self.tails, w)
        return (a << 32) | b, has_a & has_b

    def ratios(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.w, w)
        out = np.where(hit, self.of_word[at] if len(self.of_word) else 0.0, 0.0)
        key, known = self._key(v, w)
        at, hit = self._find(self.pair, key[known])
        of = np.flatnonzero(known)[hit]
        out[of] = self.of_pair[at[hit]]
        return out


def with_ratio(docs: DataFrame, model: Model, name: str, text: str = "text", most_rows: int = MODEL_ROWS) -> DataFrame:
    """Append ``name``: the mean log-likelihood ratio of the words of each text, 0 without words; the
    text itself is left out."""
    rest = [c for c in docs.columns if c != text]
    if model.rows > most_rows:
        return _ratio_by_joins(docs, model, name, text, rest)
    shared = docs.sparkSession.sparkContext.broadcast((model.words.toArrow(), model.pairs.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, lookup = HashOf(), _Lookup(*shared.value)
        for whole in batches:
            for batch in pieces(whole):
                of, v, w = _pairs(batch.column(0), hash_of)
                n = np.bincount(of, minlength=batch.num_rows)
                mean = np.bincount(of, lookup.ratios(v, w), batch.num_rows) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.round(mean, 9))], names=[*rest, name])

    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(name, T.DoubleType())])
    return docs.select(text, *rest).mapInArrow(run, schema)


def _ratio_by_joins(docs: DataFrame, model: Model, name: str, text: str, rest: list[str]) -> DataFrame:
    """The same by shuffling words: rows are numbered, since nothing else need tell them apart."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = HashOf(WORDS_HELD)
        for whole in batches:
            for batch in pieces(whole):
                of, v, w = _pairs(batch.column(1), hash_of)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[of]), pa.array(v), pa.array(w)],
                                                 names=["_row", "v", "w"])

    # equal pairs of a text are added up before anything is shuffled by word
    words = rows.select("_row", text).mapInArrow(run, "_row long, v long, w long").groupBy("_row", "v", "w").agg(
        F.count(F.lit(1)).alias("n"))
    joined = words.join(model.words, "w", "left").join(model.pairs, ["v", "w"], "left")
    ratio = F.coalesce("pair_ratio", "word_ratio", F.lit(0.0))
    means = joined.groupBy("_row").agg(F.round(F.sum(ratio * F.col("n")) / F.sum("n"), 9).alias(name))
    return rows.join(means, "_row", "left").select(*rest, F.coalesce(name, F.lit(0.0)).alias(name))


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve that fits labels ``y`` best (pool adjacent violators), each step drawn
    towards the rate of all by one example.  With ``n``, ``y`` are sums of the labels of so many rows."""
    if not len(x):
        return np.zeros(1), np.zeros(1)
    kinds, of = np.unique(x, return_inverse=True)
    n, hits = np.bincount(of, n), np.bincount(of, y)
    mean = hits.sum() / n.sum()
    blocks: list[list[float]] = []   # from, to, rate, weight
    for a, k, h in zip(kinds, n, hits):
        blocks.append([a, a, h / k, k])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            last = blocks.pop()
            into = blocks[-1]
            into[2] = (into[2] * into[3] + last[2] * last[3]) / (into[3] + last[3])
            into[1], into[3] = last[1], into[3] + last[3]
    at = [e for b in blocks for e in ([b[0], b[1]] if b[1] > b[0] else [b[0]])]
    rate = [(b[2] * b[3] + mean) / (b[3] + 1) for b in blocks for _ in range(2 if b[1] > b[0] else 1)]
    return np.array(at), np.maximum.accumulate(rate)


def calibrate(rated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The curve of all rows of ``rated`` (ratio, label); a row for each rounded ratio reaches the driver."""
    sums = rated.groupBy(F.round("ratio", RATIO_DIGITS).alias("ratio")).agg(
        F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")).toArrow()
    return curve(*[sums.column(c).to_numpy().astype(float) for c in ("ratio", "hits", "n")])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          threshold: float = 0.7, most_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, ratio) of every document."""
    held, rest = in_fold(doc_id, 1), in_fold(doc_id, 4, 5)
    known = stage(labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held)
                  .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("long").alias("label")))
    rows = docs.where(~held).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), rest.alias("_rest"))
    labelled = join_checked(rows, known, ["_id"], "inner")
    if not small_enough(known):   # the texts move, but once
        labelled = stage(labelled)
    model = fit(labelled.where("NOT _rest").select("text", "label"))
    every = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("_text"))
    if model is None:
        return every.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                            F.lit(0.0).alias("ratio"))
    at, rate = calibrate(with_ratio(labelled.where("_rest").select("text", "label"), model, "ratio", "text", most_rows))
    rated = per_row(with_ratio(every, model, "ratio", "_text", most_rows),
                    lambda: lambda ratios: [(float(p),) for p in np.round(np.interp(ratios, at, rate), 9)], ["ratio"],
                    "score double")
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ratio")

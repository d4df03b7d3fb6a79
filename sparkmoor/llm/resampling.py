"""Importance resampling toward a target distribution, on hashed word features.

*Features* of a text are its words and its pairs of neighbouring words; a feature falls into the
bucket that the CRC of its bytes names.  Buckets are counted over the whole corpus and the whole
target, their log-ratio is what a feature gains, a document weighs the mean of its gains, and
noise drawn from its key turns the highest weights into a sample without replacement.

*Dictionary.*  A worker keeps an Aho-Corasick automaton of the distinct words it has met, each
between two blanks, whose payload is the word's CRC and length.  A scan of the text emits one
payload per known word; a word it does not know is hashed on the spot and enters the next
automaton.  The CRC of a pair is composed of two neighbouring payloads: the first is shifted by the
second's length, a table look-up per byte of the CRC, so no pair is ever spelled out.  The automaton
is bounded by letters (``MOST_LETTERS``) and longer words than ``LONGEST`` never enter it: what it
lacks is hashed at every place, which costs time on strange texts and changes no result.

*Scale.*  Two scans and no shuffle of texts: a task sends one number per bucket, gains are as many
numbers as there are buckets, and the draw orders three numbers per document by ranges.

Defined cases: null and empty texts have no words, no features and weight 0; rows that repeat are
documents of their own, and the draw's ties beyond equal keys are settled in no stated order; a null
key draws noise as the empty text would and comes after all others among equals; an empty target or
corpus counts as zeros; an empty table gives no rows.  Texts of any length are scanned in windows.
Other columns stay or go as ``keep`` says, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_index
from .common import fresh, per_row, pieces, stage
from .decontaminate import FOLD

WINDOW = 4 << 20        # bytes scanned at a time
MOST_LETTERS = 2 << 20  # of all words of an automaton
LONGEST = 64            # bytes of a word in it
HIT = np.dtype([("end", np.int64), ("payload", np.int64)])


class Params(NamedTuple):
    buckets: int = 10_000
    percent: int = 25
    min_words: int = 20
    seed: int = 7


def _crc_tables() -> np.ndarray:
    """[n, k, v]: what byte ``k`` of a CRC, holding ``v``, becomes when ``n`` bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    tables = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONGEST):
        t = tables[-1]
        tables.append((t >> np.uint32(8)) ^ one[t & np.uint32(255)])
    return np.stack(tables)


SHIFT = _crc_tables()
BLANK = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The CRC's part in that of a text that goes on for ``n`` bytes, ``n`` up to ``LONGEST``."""
    out = SHIFT[n, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ SHIFT[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Dictionary:
    """CRCs and lengths of the words of folded texts, by automaton."""

    def __init__(self) -> None:
        self.machine: ahocorasick.Automaton | None = None
        self.known: dict[bytes, int] = {}   # payloads by word
        self.letters = self.built = 0       # letters of ``known``, and words of ``machine``

    def _learn(self, word: bytes) -> int:
        payload = len(word) << 32 | zlib.crc32(word)
        if len(word) <= LONGEST and self.letters < MOST_LETTERS:
            self.known[word] = payload
            self.letters += len(word)
        return payload

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for word, payload in self.known.items():
            self.machine.add_word(f" {word.decode('latin-1')} ", payload)
        self.machine.make_automaton()
        self.built = len(self.known)

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, crc) of every word; blanks part words and stand at both ends."""
        letter = np.frombuffer(text, np.uint8) != 32
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, end = edges[0::2], edges[1::2]
        payload = np.full(len(start), -1, np.int64)
        if len(self.known) > 2 * self.built:
            self._build()
        if self.machine is not None:
            hits = np.fromiter(self.machine.iter(text.decode("latin-1")), HIT)
            payload[np.searchsorted(end, hits["end"])] = hits["payload"]
        for i in np.flatnonzero(payload < 0).tolist():
            word = text[start[i]:end[i]]
            payload[i] = self.known.get(word) or self._learn(word)
        return start, payload >> 32, (payload & 0xFFFFFFFF).astype(np.uint32)


_dictionary: Dictionary | None = None


def dictionary() -> Dictionary:
    """The one of this worker, which tasks hand on."""
    global _dictionary
    if _dictionary is None:
        _dictionary = Dictionary()
    return _dictionary


def windows(text: bytes, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Cut at blanks: each part begins and ends with one, which it shares with its neighbours.

    The first parts are short, so that the dictionary learns from little."""
    at, step = 0, min(size, 1 << 16)
    while at < len(text) - 1:
        end = text.rfind(b" ", at + 1, at + step)
        if end < 0:
            end = text.find(b" ", at + 1)
        yield at, end + 1
        at, step = end, min(size, 2 * step)


def features(texts: list[bytes | None], words: Dictionary, buckets: int,
             size: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each feature, bucket of each feature), a window at a time."""
    folded = [t.translate(FOLD) if t else b"" for t in texts]
    first = np.cumsum([0] + [len(t) + 1 for t in folded])[:-1] + 1   # where each text begins
    whole = b" " + b" ".join(folded) + b" "
    del folded
    last_of, last_crc, last_start = -1, np.uint32(0), 0              # the word before this window
    for a, z in windows(whole, size):
        start, length, crc = words.scan(whole[a:z])
        if not len(start):
            continue
        of = np.searchsorted(first, start + a, "right") - 1
        before_of = np.concatenate([[last_of], of[:-1]])
        before_crc = np.concatenate([[last_crc], crc[:-1]]).astype(np.uint32)
        pair = np.flatnonzero(before_of == of)
        opened = shifted(before_crc[pair], 1) ^ BLANK                # the first word and the blank
        n = length[pair]
        joined = shifted(opened, np.minimum(n, LONGEST)) ^ crc[pair]
        for i in np.flatnonzero(n > LONGEST).tolist():
            s = int(start[pair[i]]) + a
            joined[i] = zlib.crc32(whole[s:s + int(n[i])], int(opened[i]))
        both = np.concatenate([of, of[pair]])
        yield of, both, np.concatenate([crc, joined]) % np.uint32(buckets)
        last_of, last_crc = int(of[-1]), crc[-1]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = Params().buckets) -> DataFrame:
    """(bucket, n) over all texts: a task sends at most a row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(buckets, np.int64), dictionary()
        for batch in batches:
            for part in pieces(batch):
                for _, _, bucket in features(part.column(0).cast(pa.binary()).to_pylist(), words, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = Params().buckets) -> np.ndarray:
    """What a feature of each bucket gains, in thousandths, from two tables of bucket counts."""
    def held(counts: DataFrame) -> np.ndarray:      # as many rows as buckets at most
        out = np.zeros(buckets)
        for bucket, n in counts.collect():
            out[bucket] = n
        return out

    s, t = held(corpus), held(target)
    up, down = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * up / ((a + 1) * down))) for a, b in zip(s.tolist(), t.tolist())],
                    np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """Append ``n_words``, ``n_features`` and ``weight``, the floored mean gain, of every row's text;
    columns must not be called so."""
    def make():
        words = dictionary()

        def work(texts: list[str | None]) -> list[tuple[int, int, int]]:
            raw = [t.encode("utf-8", "surrogatepass") if t else None for t in texts]
            n, m, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for of, both, bucket in features(raw, words, len(gain)):
                n += np.bincount(of, minlength=len(n))
                m += np.bincount(both, minlength=len(n))
                # sums of whole numbers below 2^53 are exact in doubles
                total += np.bincount(both, gain[bucket], minlength=len(n)).astype(np.int64)
            return list(zip(n.tolist(), m.tolist(), (total // np.maximum(m, 1)).tolist()))

        return work

    return per_row(docs, make, [text], "n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a digest of the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``docs`` but the text) and a struct ``draw`` (n_words,
    n_features, weight, score, rank) of every document; who is not drawn has no rank.

    ``draw`` is named otherwise where a kept column has that name.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    gain = gains(bucket_counts(docs, text, params.buckets), bucket_counts(target, text, params.buckets), params.buckets)
    inside = docs.select(F.struct(*keep).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    weighed = weigh(inside, gain).drop("text")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), params.seed)))
    able = F.col("n_words") >= params.min_words
    drawn = scored.where(able).count() * params.percent // 100
    ordered = global_index(scored.where(able).select("*", (-F.col("score")).alias("last"), F.col("key").isNull().alias("no_key")),
                           ["last", "no_key", "key"], "place")
    ranked = ordered.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("last", "no_key", "place")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    draw = F.struct("n_words", "n_features", "weight", "score", "rank")
    name = fresh(docs.select(*keep), "draw")
    return ranked.unionByName(rest).select("row", draw.alias("_draw")).select("row.*", F.col("_draw").alias(name))

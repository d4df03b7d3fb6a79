"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is the product of its letters'
vectors, each rotated by its distance from the end; a text, and a language, is the sum over its
n-grams.  A text gets the language whose sum has the largest cosine with its own.

Letters are folded to lower case; whatever is not a letter parts words, and one such parting
takes part in n-grams at their ends.  The sum for a language is linear in its texts, so tasks add
up their own texts and only one vector per task and language is shuffled.  Languages are few, so
their vectors are sent to all tasks.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every text if no
language can be learned; null languages are not learned from; of equal cosines the first language
by name wins; a null id counts as an empty one for the split; rows that repeat are rows of their
own.  Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, pieces

DIMENSIONS, WIDTH, SEED = 1024, 3, 20_240_501
MOST_GRAMS = 60_000   # n-gram vectors that a task keeps


def in_fold(doc_id: str, fold: int, folds: int = 3) -> Column:
    """Whether the checksum of an id, as text, falls into a fold."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


class Grams:
    """n-gram vectors, made when first seen."""

    def __init__(self, dimensions: int = DIMENSIONS, width: int = WIDTH):
        self.dimensions, self.width = dimensions, width
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((1024, dimensions), np.int8)

    def _letter(self, cp: int) -> np.ndarray:
        if cp not in self.letter:
            if len(self.letter) > 20_000:
                self.letter.clear()
            rng = np.random.default_rng((SEED, cp))
            self.letter[cp] = rng.integers(0, 2, self.dimensions, np.int8) * np.int8(2) - np.int8(1)
        return self.letter[cp]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the vectors of ``keys``, which are distinct."""
        if len(self.place) + len(keys) > MOST_GRAMS:
            self.place.clear()
        while len(self.rows) < len(self.place) + len(keys):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            at = self.place.get(key)
            if at is None:
                at = self.place[key] = len(self.place)
                bound = np.ones(self.dimensions, np.int8)
                for k in range(self.width):
                    bound = bound * np.roll(self._letter(key >> (21 * k) & 0x1FFFFF), k)
                self.rows[at] = bound
            out[i] = at
        return out

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, vector row, count) of the n-grams of each text."""
        table = letters()
        folded, owner = [], []
        for i, t in enumerate(texts):
            a = table[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
            a = np.concatenate([[0], a, [0]]).astype(np.int64)
            a = a[(a != 0) | np.concatenate([[True], a[:-1] != 0])]
            folded.append(a)
            owner.append(np.full(len(a), i))
        a, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (folded, owner))
        n = len(a) - self.width + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3
        key = np.zeros(n, np.int64)
        whole = of[:n] == of[self.width - 1:]
        for k in range(self.width):
            part = a[self.width - 1 - k:len(a) - k]
            key |= part << (21 * k)
            if 0 < k < self.width - 1:
                whole &= part != 0                       # partings only at the ends
        key, of = key[whole], of[:n][whole]
        kinds, which = np.unique(key, return_inverse=True)
        both, counts = np.unique(of * len(kinds) + which, return_counts=True)
        rows = self.places(kinds)
        return both // max(1, len(kinds)), rows[both % max(1, len(kinds))], counts


def profiles(labelled: DataFrame, lang: str, text: str, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Names of the languages and their unit vectors, learned from all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(dimensions), {}
        for whole in batches:
            for batch in pieces(whole):
                names = batch.column(0).to_pylist()
                of, row, n = grams.count(batch.column(1).to_pylist())
                kinds = sorted(set(names))
                code = np.array([kinds.index(x) for x in names], np.int64)[of]
                for c, name in enumerate(kinds):
                    mine = code == c
                    counts = np.bincount(row[mine], n[mine], len(grams.place))
                    used = np.flatnonzero(counts)
                    total = sums.setdefault(name, np.zeros(dimensions))
                    for at in range(0, len(used), 4096):
                        some = used[at:at + 4096]
                        total += counts[some] @ grams.rows[some].astype(np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()])], names=["name", "total"])

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("name"), F.col(text).alias("t")) \
        .mapInArrow(run, "name string, total array<double>") \
        .select("name", F.posexplode("total").alias("d", "x")).groupBy("name", "d").agg(F.sum("x").alias("x")) \
        .groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total")) \
        .orderBy("name").collect()          # one row per language
    vectors = np.array([r["total"] for r in rows]).reshape(-1, dimensions)
    norms = np.linalg.norm(vectors, axis=1)
    keep = norms > 0
    return [r["name"] for r, k in zip(rows, keep) if k], vectors[keep] / norms[keep, None]


def with_language(docs: DataFrame, names: list[str], vectors: np.ndarray, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``, the cosine with that language (0 if negative)."""
    shared = docs.sparkSession.sparkContext.broadcast((names, vectors))
    dimensions = vectors.shape[1]

    def make():
        grams = Grams(dimensions)
        own, unit = shared.value

        def work(texts: list) -> list[tuple]:
            of, row, n = grams.count(texts)
            edges = np.searchsorted(of, np.arange(len(texts) + 1))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                best = ("und", 0.0)
                if b > a and own:
                    total = np.zeros(dimensions, np.float32)
                    for at in range(a, b, 4096):
                        stop = min(b, at + 4096)
                        total += n[at:stop].astype(np.float32) @ grams.rows[row[at:stop]].astype(np.float32)
                    norm = float(np.linalg.norm(total.astype(np.float64)))
                    cosine = unit @ total / norm if norm else np.zeros(len(own))
                    k = int(np.argmax(cosine))
                    best = (own[k], min(1.0, max(0.0, float(cosine[k]))))
                out.append(best)
            return out

        return work

    return per_row(docs, make, [text], "lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows outside the held-out fold."""
    held = in_fold(doc_id, 1)
    names, vectors = profiles(docs.where(~held), lang, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("_text"))
    return with_language(rows, names, vectors, "_text").drop("_text")

"""A text index that is kept: append-only segments under versions.

    <path>/segments/<name>/{postings,texts,frequencies}   Parquet, never changed
    <path>/versions/<number>                               one JSON row, written last

A segment has the postings and texts of some documents, the document frequency of each of its
tokens, and its own counts.  A version names segments and the tokenizer they were cut with.  What
is not named by a version does not exist: a writer that dies leaves files that nobody reads, and
readers keep the last whole version.  Adding documents writes a segment of them and a version;
when enough segments are of like size, they are written together once more, so that a document is
rewritten as often as sizes grow tenfold.  Two writers of one version: the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bm25 import Index, doc_freq, postings_of

MANIFEST = "version long, tokenizer string, segments array<struct<name:string,docs:long,words:long,tier:int>>"
FAN = 4            # so many segments of a tier become one of the next
TIER_DOCS = 10     # a tier holds segments of up to that many times the documents of the tier below
FIRST_TIER = 1000

Tokenizer = Callable[[list[str]], list[list[str]]]
_tokenizers: dict[str, Tokenizer | None] = {"words": None}


def register_tokenizer(name: str, tokenizer: Tokenizer) -> None:
    """Make a tokenizer known by the name that bundles keep."""
    if name in _tokenizers and _tokenizers[name] is not tokenizer:
        raise ValueError(f"{name} names another tokenizer")
    _tokenizers[name] = tokenizer


class Segment(NamedTuple):
    name: str
    docs: int
    words: int
    tier: int


class Bundle(NamedTuple):
    spark: SparkSession
    path: str
    version: int
    tokenizer_name: str
    segments: tuple[Segment, ...]

    @property
    def tokenizer(self) -> Tokenizer | None:
        if self.tokenizer_name not in _tokenizers:
            raise LookupError(f"register the tokenizer {self.tokenizer_name} first")
        return _tokenizers[self.tokenizer_name]

    def _table(self, what: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/{s.name}/{what}" for s in self.segments])

    @property
    def index(self) -> Index:
        """Postings and frequencies of all segments; their counts are in the version, so nothing is scanned."""
        docs, words = sum(s.docs for s in self.segments), sum(s.words for s in self.segments)
        return Index(self._table("postings"), docs, words / docs if docs else 0.0, self.tokenizer, self.doc_freq())

    @property
    def texts(self) -> DataFrame:
        """(doc_id, text)."""
        return self._table("texts")

    def doc_freq(self) -> DataFrame:
        """(token, df), from the segments' frequencies: as much work as there are tokens, not postings."""
        return self._table("frequencies").groupBy("token").agg(F.sum("df").alias("df"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All whole versions; none where there is no bundle."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/versions/*").where("version IS NOT NULL")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def open_bundle(spark: SparkSession, path: str, version: int | None = None) -> Bundle | None:
    """The last whole version, or a given one; None where there is none."""
    every = versions(spark, path)
    row = (every if version is None else every.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        return None
    return Bundle(spark, path, row["version"], row["tokenizer"], tuple(Segment(*s) for s in row["segments"]))


def _tier(docs: int) -> int:
    tier, size = 0, FIRST_TIER
    while docs > size:
        tier, size = tier + 1, size * TIER_DOCS
    return tier


def _write_segment(spark: SparkSession, path: str, docs: DataFrame, tokenizer: Tokenizer | None) -> Segment:
    """Write (doc_id, text) and what is derived from them; texts first, so that they are read once."""
    name = uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    docs.select("doc_id", "text").write.parquet(f"{folder}/texts")
    postings_of(spark.read.parquet(f"{folder}/texts"), tokenizer=tokenizer).write.parquet(f"{folder}/postings")
    return _with_frequencies(spark, folder, name)


def _with_frequencies(spark: SparkSession, folder: str, name: str) -> Segment:
    postings = spark.read.parquet(f"{folder}/postings")
    doc_freq(postings).write.parquet(f"{folder}/frequencies")
    row = postings.agg(F.count_if("head").alias("n"), F.sum("tf").alias("w")).first()
    return Segment(name, row["n"], row["w"] or 0, _tier(row["n"]))


def _write_version(spark: SparkSession, path: str, version: int, tokenizer: str, segments: list[Segment]) -> Bundle:
    row = {"version": version, "tokenizer": tokenizer, "segments": [s._asdict() for s in segments]}
    # the row appears as a whole when its job is committed, and a folder that exists is an error
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("errorifexists") \
        .text(f"{path}/versions/{version:012d}")
    return Bundle(spark, path, version, tokenizer, tuple(segments))


def create(docs: DataFrame, path: str, tokenizer: str = "words") -> Bundle:
    """A bundle of ``docs`` (doc_id, text), as the first version at ``path``."""
    spark = docs.sparkSession
    if open_bundle(spark, path) is not None:
        raise FileExistsError(path)
    held = Bundle(spark, path, 0, tokenizer, ())
    return _write_version(spark, path, 1, tokenizer, [_write_segment(spark, path, docs, held.tokenizer)])


def append(bundle: Bundle, docs: DataFrame) -> Bundle:
    """The next version, with more documents, cut by the bundle's own tokenizer."""
    added = _write_segment(bundle.spark, bundle.path, docs, bundle.tokenizer)
    segments = merged(bundle._replace(segments=(*bundle.segments, added)))
    return _write_version(bundle.spark, bundle.path, bundle.version + 1, bundle.tokenizer_name, segments)


def merged(bundle: Bundle) -> list[Segment]:
    """The segments after all merges that are due; merged ones stay on disk for earlier versions."""
    segments = list(bundle.segments)
    while True:
        tiers = [t for t in sorted({s.tier for s in segments}) if sum(s.tier == t for s in segments) >= FAN]
        if not tiers:
            return segments
        old = [s for s in segments if s.tier == tiers[0]]
        part, name = bundle._replace(segments=tuple(old)), uuid.uuid4().hex
        folder = f"{bundle.path}/segments/{name}"
        part.texts.write.parquet(f"{folder}/texts")
        part.index.postings.write.parquet(f"{folder}/postings")
        new = _with_frequencies(bundle.spark, folder, name)
        segments = [s for s in segments if s not in old] + [new._replace(tier=max(new.tier, tiers[0] + 1))]


def open_or_create(docs: DataFrame, path: str, tokenizer: str = "words") -> Bundle:
    return open_bundle(docs.sparkSession, path) or create(docs, path, tokenizer)

"""Inverted-index construction and BM25 ranking."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import global_index, running_total
from ..functions.staging import Staged, by_key, keyed_join, salted_join, stage, stage_counted
from ..functions.text import tokenize
from ..functions.vectors import rounded
from .retrieve import top_k

PAGE = 65536  # ids per page of the padded frequency table
TF_LIMIT = 255
UNKNOWN_ID = 4294967295


class Index(NamedTuple):
    """Postings (doc_id, dl, token, tf, head), document count and mean length.

    ``head`` marks one row per document, so that documents without any token are kept (their
    only row has no token) and counted without another pass.  ``frequencies`` (token, df), where they
    are kept, spare the counting of postings.
    """

    postings: DataFrame
    n_docs: int
    mean_len: float
    tokenizer: Callable[[list[str]], list[list[str]]] | None = None   # what its tokens were cut with
    frequencies: DataFrame | None = None

    @property
    def terms(self) -> DataFrame:
        return self.postings.where(F.col("token").isNotNull())


def postings_of(docs: DataFrame, text: str = "text", tokenizer=None) -> DataFrame:
    """(doc_id, dl, token, tf, head).

    A document is one row, so its tokens are counted inside the row, as the runs of its sorted
    tokens: building the index shuffles nothing, and a document's postings stay together.
    """
    words = tokenize(docs.select("doc_id", text), text, "tokens", tokenizer).select(
        "doc_id", F.size("tokens").alias("dl"), F.sort_array("tokens").alias("tokens"))
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.col("dl") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    marked = words.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, j: F.struct(
        F.get("tokens", s).alias("token"), (F.coalesce(F.get("starts", j + 1), F.col("dl")) - s).alias("tf")))
    return marked.select("doc_id", "dl", F.posexplode_outer(runs).alias("at", "run")).select(
        "doc_id", "dl", "run.token", F.coalesce("run.tf", F.lit(0)).alias("tf"),
        (F.coalesce("at", F.lit(0)) == 0).alias("head"))


def describe(postings: DataFrame, tokenizer=None) -> Index:
    row = postings.agg(F.count_if("head").alias("n"), F.sum("tf").alias("len")).first()
    return Index(postings, row["n"], (row["len"] or 0) / row["n"] if row["n"] else 0.0, tokenizer)


def build_index(docs: DataFrame, text: str = "text", tokenizer=None) -> Index:
    """Tokenise once and keep the postings as a table in the shared folder; ``sources.bundle`` keeps
    an index beyond the session."""
    return describe(stage(postings_of(docs, text, tokenizer)), tokenizer)


def add_documents(index: Index, docs: DataFrame, text: str = "text") -> Index:
    """Index with more documents, cut by its own tokenizer; earlier ones are neither read nor removed."""
    more = build_index(docs, text, index.tokenizer)
    n = index.n_docs + more.n_docs
    words = index.mean_len * index.n_docs + more.mean_len * more.n_docs
    return Index(index.postings.unionByName(more.postings), n, words / n if n else 0.0, index.tokenizer)


# ---- exports ------------------------------------------------------------------------


def doc_freq(postings: DataFrame) -> DataFrame:
    """Documents per token."""
    return postings.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(postings: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """Dense token ids in token order: (token, df, vocab_idx).  ``frequencies`` (token, df) spare the counting
    of postings where they are known."""
    return global_index(doc_freq(postings) if frequencies is None else frequencies, ["token"], "vocab_idx")


def numeric_token(token: Column) -> Column:
    """The number a token spells, or UNKNOWN_ID."""
    return F.coalesce(F.when(token.rlike("^-*[0-9]+$"), token.try_cast("bigint")),
                      F.lit(UNKNOWN_ID).cast("bigint"))


def vocab_mapping(vocab: DataFrame) -> DataFrame:
    return vocab.select("vocab_idx", numeric_token(F.col("token")).alias("token_id"))


# Tokens that are looked up by broadcast when the whole vocabulary is too large for it.
HOT_TOKENS = 100_000


def with_vocab(postings: DataFrame, vocab: Staged) -> DataFrame:
    """Postings with token ids.

    A vocabulary too large to broadcast is split.  At most HOT_TOKENS tokens can hold more
    than 1/HOT_TOKENS of all entries each: they are broadcast, whatever their frequency.  The
    others are too rare to skew a shuffle and are joined by token.
    """
    terms = postings.where(F.col("token").isNotNull())
    ids = vocab.df.select("token", "vocab_idx")
    if vocab.broadcastable:
        return terms.join(F.broadcast(ids), "token")
    entries = vocab.df.agg(F.sum("df")).first()[0]
    is_hot = F.col("df") > entries / HOT_TOKENS
    hot = vocab.df.where(is_hot).select("token", F.col("vocab_idx").alias("_hot"))
    marked = terms.join(F.broadcast(hot), "token", "left")
    common = marked.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "vocab_idx")
    rare = marked.where(F.col("_hot").isNull()).drop("_hot").join(
        vocab.df.where(~is_hot).select("token", "vocab_idx"), "token")
    return common.unionByName(rare)


def term_freq_layout(numbered: DataFrame) -> DataFrame:
    """Entries per document and the byte offset of its record (4 + 8 per entry)."""
    sizes = numbered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return running_total(sizes, ["doc_id"], F.col("n_terms") * 8 + 4, "byte_offset")


def inverted_blocks(postings: DataFrame, docs_per_block: int = 1024) -> DataFrame:
    """Posting lists cut into blocks of documents, each list sorted by document.

    A token in a third of all documents becomes many bounded lists instead of one.
    """
    entry = F.struct("doc_id", F.coalesce("tf", F.lit(1)).alias("tf"))
    return (
        postings.where(F.col("token").isNotNull())
        .groupBy("token", F.floor(F.col("doc_id") / docs_per_block).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )


def first_ids(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Document frequencies of the ids 0..limit-1, zero where an id is unused.

    By default all ids are kept and the table is filled up to whole pages; a ``limit`` cuts it.
    """
    if limit is None:
        limit = math.ceil(((df.agg(F.max("vocab_idx")).first()[0] or 0) + 1) / PAGE) * PAGE
    ids = df.sparkSession.range(limit).withColumnRenamed("id", "vocab_idx")
    return ids.join(df.where(F.col("vocab_idx") < limit).select("vocab_idx", "df"), "vocab_idx", "left") \
        .select("vocab_idx", F.coalesce("df", F.lit(0)).alias("df"))


def packed_token(token_id: Column, tf: Column) -> Column:
    """One 64-bit word: the frequency above, the token id in the lower 32 bits."""
    return F.least(tf, F.lit(TF_LIMIT)).cast("bigint") * (1 << 32) + token_id


def pack_documents(numbered: DataFrame) -> DataFrame:
    """Lane layout of the packed format: batches of 64 documents, 4 channels, 16 lanes.

    A lane keeps the tokens with ``id % 16 == doc % 16``; rows count them by id.  The window
    runs inside one document.
    """
    kept = lane_postings(numbered)
    inside = Window.partitionBy("doc_id").orderBy("vocab_idx")
    return kept.select(
        F.floor(F.col("doc_id") / 64).cast("bigint").alias("batch"),
        F.floor(F.pmod("doc_id", F.lit(64)) / 16).cast("int").alias("channel"),
        F.pmod("doc_id", F.lit(16)).cast("int").alias("lane"),
        (F.row_number().over(inside) - 1).alias("row"),
        packed_token(F.col("vocab_idx"), F.col("tf")).alias("packed"))


def packed_rows(packed: DataFrame, n_docs: int) -> DataFrame:
    """Rows per batch: its longest lane, at least one, also for a batch without tokens."""
    spark = packed.sparkSession
    batches = spark.range(math.ceil(n_docs / 64)).withColumnRenamed("id", "batch")
    longest = packed.groupBy("batch").agg((F.max("row") + 1).alias("n"))
    return batches.join(longest, "batch", "left").select(
        "batch", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n_rows"))


def index_statistics(index: Index, packed: DataFrame) -> DataFrame:
    """One row of counts over frequencies, documents and the packed layout."""
    freq = doc_freq(index.postings).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.max("df").alias("max_df"), F.min("df").alias("min_df"),
        rounded(F.avg("df")).alias("avg_df"), F.sum("df").alias("n_entries"))
    rows = packed_rows(packed, index.n_docs).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_rows"),
        rounded(F.avg("n_rows")).alias("avg_rows"))
    layout = rows.select(F.struct("*")).scalar()
    return freq.withColumn("_r", layout).select("*", "_r.*").drop("_r").select(
        F.lit(index.n_docs).cast("bigint").alias("n_docs"), "*",
        (F.col("n_rows") * 4 * 16 * 8 + F.col("n_batches") * 4).alias("packed_bytes"))


# ---- scoring ------------------------------------------------------------------------


class Formula(NamedTuple):
    """One of the three BM25 forms, as expressions of the usual quantities."""

    k1: float
    b: float
    idf_plus_one: bool      # ln(1 + (N-df+.5)/(df+.5)) or ln((N-df+.5)/(df+.5))
    numerator: bool         # tf * (k1 + 1) or tf
    tf_limit: int | None = None
    pad_docs: int = 1       # N is rounded up to a multiple of this

    def idf(self, df: Column, n: int) -> Column:
        n = math.ceil(n / self.pad_docs) * self.pad_docs
        odds = (F.lit(float(n)) - df + 0.5) / (df + 0.5)
        return F.log(odds + 1.0) if self.idf_plus_one else F.log(odds)

    def weight(self, tf: Column, dl: Column, mean_len: float) -> Column:
        tf = (F.least(tf, F.lit(self.tf_limit)) if self.tf_limit else tf).cast("double")
        norm = F.lit(1.0 - self.b) + F.lit(self.b) * dl / F.lit(mean_len) if self.b else F.lit(1.0)
        return tf * F.lit(self.k1 + 1.0 if self.numerator else 1.0) / (tf + F.lit(self.k1) * norm)

    def weights(self, tf: np.ndarray, dl: np.ndarray, mean_len: float) -> np.ndarray:
        """``weight`` of arrays."""
        tf = (np.minimum(tf, self.tf_limit) if self.tf_limit else tf).astype(np.float64)
        norm = (1.0 - self.b) + self.b * dl / mean_len if self.b else 1.0
        return tf * (self.k1 + 1.0 if self.numerator else 1.0) / (tf + self.k1 * norm)


# Fixed parameters of the three forms.
CPU = Formula(k1=1.2, b=0.75, idf_plus_one=True, numerator=True)
PACKED = Formula(k1=1.2, b=0.0, idf_plus_one=False, numerator=True, tf_limit=TF_LIMIT, pad_docs=64)
LUCENE = Formula(k1=1.5, b=0.75, idf_plus_one=True, numerator=False)


def query_terms(queries: DataFrame, text: str = "text", by: list[str] | None = None, tokenizer=None) -> DataFrame:
    """Distinct tokens per query; a blank query has none.  Multiplicity does not count.

    ``tokenizer`` must be the one the index was built with.
    """
    by = by or ["query_id"]
    words = tokenize(queries.select(*by, text), text, "_tokens", tokenizer)
    return words.select(*by, F.explode(F.array_distinct("_tokens")).alias("token"))


def weighted_terms(index: Index, terms: DataFrame, formula: Formula) -> Staged:
    """Query terms with their idf, staged: terms no document has are dropped.

    Frequencies combine before they are shuffled, so postings never move to meet the terms.
    """
    held = stage(terms)
    wanted = stage_counted(held.select("token").distinct())
    if index.frequencies is not None:
        df = index.frequencies.join(F.broadcast(wanted.df) if wanted.broadcastable else wanted.df, "token", "left_semi")
    elif wanted.broadcastable:
        df = doc_freq(index.terms.join(F.broadcast(wanted.df), "token", "left_semi"))
    else:
        df = doc_freq(index.terms).join(wanted.df, "token", "left_semi")
    idf = df.select("token", formula.idf(F.col("df").cast("double"), index.n_docs).alias("idf"))
    return stage_counted(keyed_join(held, stage_counted(idf), ["token"]))


def score_weighted(index: Index, postings: DataFrame, weighted: Staged, formula: Formula,
                   by: list[str]) -> DataFrame:
    """Sum of idf * weight per (query, document).

    When the terms can be broadcast, only the postings of query tokens are shuffled, by
    document; a document's scores for all queries are then summed in one place.  Otherwise
    postings and terms meet by token, salted by document.
    """
    scored = postings.select("doc_id", "dl", "token", "tf")
    if weighted.broadcastable:
        wanted = weighted.df.select("token").distinct()
        scored = by_key(scored.join(F.broadcast(wanted), "token", "left_semi"), "doc_id")
    hits = salted_join(scored, weighted, ["token"], "doc_id")
    part = F.col("idf") * formula.weight(F.col("tf"), F.col("dl"), index.mean_len)
    return hits.groupBy(*by, "doc_id").agg(rounded(F.sum(part)).alias("score"))


def score_documents(index: Index, terms: DataFrame, formula: Formula, by: list[str] | None = None,
                    postings: DataFrame | None = None) -> DataFrame:
    """BM25 of every matching document: (by..., doc_id, score).

    ``postings`` replaces the scored postings (not the statistics), e.g. to leave out tokens
    outside a lane.  To rank documents for many queries use ``ranking.top_documents``, which
    does not make a row per pair.
    """
    scored = index.terms if postings is None else postings
    return score_weighted(index, scored, weighted_terms(index, terms, formula), formula, by or ["query_id"])


def lane_postings(numbered: DataFrame) -> DataFrame:
    """Postings whose token id falls into the lane of their document."""
    return numbered.where(F.col("vocab_idx") % 16 == F.pmod("doc_id", F.lit(16)))


def score_all_documents(index: Index, terms: DataFrame, formula: Formula,
                        postings: DataFrame | None = None) -> DataFrame:
    """BM25 of every document for a single query; a document without a match scores 0."""
    scored = score_documents(index, terms.withColumn("query_id", F.lit(0)), formula,
                             postings=postings).drop("query_id")
    docs = index.postings.where("head").select("doc_id")
    return docs.join(scored, "doc_id", "left").select(
        "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def rank_documents(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    return top_k(scores, k, "doc_id", by)


def sample_query(numbered: DataFrame, size: int = 64, seed: int = 42) -> DataFrame:
    """``size`` tokens drawn evenly over the 16 lanes, at random but repeatably.

    A lane offers the tokens of its documents with a matching id.
    """
    offered = lane_postings(numbered).select("vocab_idx").distinct()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vocab_idx").cast("string")).cast("binary"))
    lane = offered.withColumn("lane", (F.col("vocab_idx") % 16).cast("int")).withColumn("_draw", draw)
    turn = F.row_number().over(Window.partitionBy("lane").orderBy("_draw", "vocab_idx"))
    per_lane = lane.withColumn("turn", turn).where(F.col("turn") <= math.ceil(size / 16))
    return per_lane.orderBy("turn", "lane").limit(size).select("lane", "turn", "vocab_idx")

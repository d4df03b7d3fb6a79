"""Retrieval on streams: incremental document frequencies and sentence-wise lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators import bm25, rag, ranking


def running_doc_freq(docs: DataFrame) -> DataFrame:
    """Document frequencies of all documents so far (update or complete mode).

    Frequencies only grow: documents are never removed.  Counts are combined in each task
    before the exchange, so a token of every document is no hot spot.
    """
    words = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def sentence_retrieval(texts: DataFrame, keys: list[str], index: bm25.Index, path: str, checkpoint: str,
                       k: int = 3, formula: bm25.Formula = bm25.CPU, **trigger) -> StreamingQuery:
    """Retrieve ``k`` documents for every sentence of every text that arrives.

    Each micro-batch overwrites its own folder, so a batch that is run again leaves one copy.
    """
    by = [*keys, "sentence_no"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        said = rag.split_sentences(batch, keys)
        terms = bm25.query_terms(said, "sentence", by)
        ranking.top_documents(index, terms, formula, k, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (texts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

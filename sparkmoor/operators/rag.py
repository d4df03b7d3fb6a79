"""Applying retrieved documents to text: token lists, contexts and prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import Staged
from ..functions.text import continuation_prompt, numbered_context, question_prompt, sentences


def fetch(docs: DataFrame, ranked: Staged, columns: list[str]) -> DataFrame:
    """Columns of the ranked documents; ids without a document are skipped.

    A small ranking is broadcast, so that the texts of other documents never move.
    """
    wanted = F.broadcast(ranked.df) if ranked.broadcastable else ranked.df
    return docs.select("doc_id", *columns).join(wanted, "doc_id")


def in_rank_order(fetched: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Values of each query's documents by rank: at most k per query."""
    entries = F.array_sort(F.collect_list(F.struct("rank", value)))
    return fetched.groupBy(*by).agg(F.transform(entries, lambda e: e[value]).alias(name))


def contexts(queries: DataFrame, docs: DataFrame, ranked: Staged, by: list[str]) -> DataFrame:
    """Queries with the array ``docs`` of their documents; empty when none was found."""
    found = in_rank_order(fetch(docs, ranked, ["text"]), by, "text", "docs")
    return queries.join(found, by, "left").withColumn(
        "docs", F.coalesce("docs", F.array().cast("array<string>")))


def with_context(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.withColumn("context", F.concat(F.lit(prefix), numbered_context(F.col("docs"))))


def with_prompt(df: DataFrame, question: str = "text",
                template: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    return df.withColumn("prompt", question_prompt(numbered_context(F.col("docs")), F.col(question), template))


def with_continuation(df: DataFrame, prompt: str, written: str) -> DataFrame:
    return df.withColumn("continued", continuation_prompt(F.col(prompt), F.col(written), F.col("docs")))


def append_tokens(queries: DataFrame, docs: DataFrame, ranked: Staged, by: list[str]) -> DataFrame:
    """The query's tokens followed by those of its documents in rank order."""
    found = in_rank_order(fetch(docs, ranked, ["tokens"]), by, "tokens", "_more")
    more = F.coalesce(F.flatten("_more"), F.array().cast("array<string>"))
    return queries.join(found, by, "left").withColumn("tokens", F.concat("tokens", more)).drop("_more")


def split_sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per sentence, numbered from 1."""
    return df.select(*keys, F.posexplode(sentences(text)).alias("_at", "sentence")).select(
        *keys, (F.col("_at") + 1).alias("sentence_no"), "sentence")


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Add ``answer``.  ``model`` maps a batch of prompts to texts; without one the answer is
    the first sentence of the first document, taken from ``docs``."""
    if model is None:
        return df.withColumn("answer", F.coalesce(
            F.try_element_at(sentences(F.try_element_at("docs", F.lit(1))), F.lit(1)), F.lit("")))

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(prompts.tolist()))

    return df.withColumn("answer", run(F.col(prompt)))

"""Composing the four stages: build a memory, score it, choose entries, apply them.

A step is any function of DataFrames.  Steps may write intermediate tables and count them, so calling
a flow can start jobs; what it returns is a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage, stage_counted
from ..functions.text import continuation_prompt, sentences
from ..operators import attention, bm25, memory, rag, ranking, score

Step = Callable[..., DataFrame]
KINDS = ("build", "score", "retrieve", "apply", "fused")
_named: dict[tuple[str, str], Step] = {}


def register(kind: str, name: str) -> Callable[[Step], Step]:
    """Make a function available as a step under a name."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of step: {kind}")

    def add(fn: Step) -> Step:
        _named[kind, name] = fn
        return fn

    return add


def resolve(kind: str, step: Step | str | None) -> Step | None:
    if isinstance(step, str):
        if (kind, step) not in _named:
            raise KeyError(f"no {kind} step named {step}")
        return _named[kind, step]
    return step


@dataclass(frozen=True)
class MemoryFlow:
    """build(data) -> memory; score(memory, query) -> scores; retrieve(scores) -> index;
    apply(data, query, index) -> result.  ``fused`` stands for score and retrieve together."""

    build: Step | str
    apply: Step | str
    score: Step | str | None = None
    retrieve: Step | str | None = None
    fused: Step | str | None = None

    def __post_init__(self):
        for kind in KINDS:
            object.__setattr__(self, kind, resolve(kind, getattr(self, kind)))
        if self.fused is None and (self.score is None or self.retrieve is None):
            raise ValueError("give score and retrieve, or a fused step")

    def with_steps(self, **steps: Step | str) -> MemoryFlow:
        """The same flow with some steps replaced."""
        return replace(self, **steps)

    def build_memory(self, data: DataFrame):
        return self.build(data)

    def retrieve_index(self, held, query: DataFrame) -> DataFrame:
        if self.fused is not None:
            return self.fused(held, query)
        return self.retrieve(self.score(held, query))

    def manage_and_apply(self, held, data: DataFrame, query: DataFrame) -> DataFrame:
        """Score, choose and apply with a memory built earlier."""
        return self.apply(data, query, self.retrieve_index(held, query))

    def build_and_apply(self, data: DataFrame, query: DataFrame) -> DataFrame:
        return self.manage_and_apply(self.build_memory(data), data, query)


def paged_attention(page_size: int, dim: int, k: int, weights: np.ndarray | None = None) -> MemoryFlow:
    """Attention over the best pages; data (pos, k, v), query (query_id, q)."""

    def build(kv: DataFrame) -> DataFrame:
        return memory.paged_index(kv.select("pos", "k"), page_size, dim, weights)

    def choose(held: DataFrame, query: DataFrame) -> DataFrame:
        return score.top_inner_products(held, query if weights is None else memory.project(query, "q", weights, "q"), k)

    def attend(kv: DataFrame, query: DataFrame, index: DataFrame) -> DataFrame:
        pages = index.select("query_id", F.col("mem_id").alias("page_id"))
        return attention.block_sparse_attention(kv, query, pages, page_size, dim)

    return MemoryFlow(build=build, fused=choose, apply=attend)


def document_prompts(k: int, formula: bm25.Formula = bm25.CPU, tokenizer=None) -> MemoryFlow:
    """Prompts around the best documents; data (doc_id, text), query (query_id, text).

    A blank query finds nothing and gets an empty context.
    """

    def choose(index: bm25.Index, query: DataFrame) -> DataFrame:
        return ranking.top_documents(index, bm25.query_terms(query, tokenizer=tokenizer), formula, k)

    def build(docs: DataFrame) -> bm25.Index:
        return bm25.build_index(docs, tokenizer=tokenizer)

    def prompts(docs: DataFrame, query: DataFrame, index: DataFrame) -> DataFrame:
        ranked = stage_counted(index.select("query_id", "doc_id", "rank"))
        return rag.with_prompt(rag.contexts(query, docs, ranked, ["query_id"]))

    return MemoryFlow(build=build, fused=choose, apply=prompts)


def follow_up(index: bm25.Index, docs: DataFrame, answered: DataFrame, k: int = 3,
              formula: bm25.Formula = bm25.CPU, model=None, tokenizer=None) -> DataFrame:
    """After an answer, look again: the first sentence of each answer retrieves ``k`` documents, which
    continue the prompt.  ``answered`` (query_id, prompt, answer) gains sentence, continued and the new
    answer (of ``model``, or an extract).  An answer without a sentence retrieves nothing."""
    said = answered.select("query_id", "prompt", F.coalesce(
        F.try_element_at(sentences("answer"), F.lit(1)), F.lit("")).alias("sentence"))
    terms = bm25.query_terms(said, "sentence", tokenizer=tokenizer)
    ranked = stage_counted(ranking.top_documents(index, terms, formula, k).select("query_id", "doc_id", "rank"))
    found = rag.contexts(said, docs, ranked, ["query_id"])
    return rag.generate(rag.with_continuation(found, "prompt", "sentence"), "continued", model)


def _next_sentence(model) -> Column:
    """The first sentence of what the model writes behind the prompt; without a model, of the
    documents at hand, one after the other, the first sentence that is not written yet."""
    if model is not None:
        return F.coalesce(F.try_element_at(sentences("answer"), F.lit(1)), F.lit(""))
    offered = F.flatten(F.transform("docs", sentences))
    return F.coalesce(F.get(F.filter(offered, lambda s: ~F.array_contains("written", s)), 0), F.lit(""))


def sentence_loop(index: bm25.Index | ranking.Blocks, docs: DataFrame, queries: DataFrame, rounds: int, k: int = 3,
                  formula: bm25.Formula = bm25.CPU, model=None, tokenizer=None) -> DataFrame:
    """Write answers a sentence at a time, and look documents up anew after each.

    ``queries`` (query_id, text), ids being unique.  In a round every query that is not done gets its next
    sentence, which retrieves ``k`` documents that are put behind the prompt; a sentence that finds
    none is put there alone.  A query is done when nothing more is written.  The result has a row
    per query and round: (query_id, round, sentence, doc_ids, prompt).  Each round is written down, and works
    on the queries that are left.
    """
    tables = index if isinstance(index, ranking.Blocks) else ranking.block_postings(index, formula)

    def lookup(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
        """``df`` with the texts ``docs``, and (query_id, doc_ids)."""
        terms = bm25.query_terms(df, text, tokenizer=tokenizer)
        ranked = stage_counted(ranking.top_documents(tables, terms, formula, k).select("query_id", "doc_id", "rank"))
        ids = ranked.df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))),
                                                            lambda r: r["doc_id"]).alias("doc_ids"))   # k a query
        return rag.contexts(df, docs, ranked, ["query_id"]), ids

    found, _ = lookup(queries.select("query_id", "text"), "text")
    state = stage(rag.with_prompt(found).select("query_id", "prompt", "docs", F.array().cast("array<string>").alias("written")))
    done = []
    for r in range(1, rounds + 1):
        asked = rag.generate(state, "prompt", model) if model is not None else state
        said = stage_counted(asked.withColumn("sentence", _next_sentence(model)).where("sentence <> ''")
                             .select("query_id", "prompt", "written", "sentence"))
        if not said.rows:
            break
        found, ids = lookup(said.df, "sentence")
        longer = F.when(F.size("docs") > 0, continuation_prompt(F.col("prompt"), F.col("sentence"), F.col("docs"))) \
            .otherwise(F.concat("prompt", "sentence"))
        state = stage(found.join(ids, "query_id", "left").select(
            "query_id", longer.alias("prompt"), "docs", F.array_append("written", F.col("sentence")).alias("written"), "sentence",
            F.coalesce("doc_ids", F.array().cast("array<bigint>")).alias("doc_ids")))
        done.append(state.select("query_id", F.lit(r).alias("round"), "sentence", "doc_ids", "prompt"))
    if not done:
        return queries.sparkSession.createDataFrame([], "query_id long, round int, sentence string, doc_ids array<bigint>, prompt string")
    return reduce(DataFrame.unionByName, done)

"""Queries on the documents: index exports, BM25 and retrieval-augmented prompts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.staging import Staged, new_folder, shared_dir, stage_counted
from ..operators import bm25, rag, retrieve
from ..operators.bm25 import CPU, LUCENE, PACKED, Index
from ..operators.ranking import Blocks, block_postings, top_documents
from ..sources import bundle
from ..sources.corpus import parse_ids, titled_corpus
from ..sources.tables import spread_out, table
from . import steps
from .registry import query, r6
from .vector_queries import ranked_sql

_held: dict[tuple, object] = {}


def _once(spark: SparkSession, root: str, what: str, make):
    """One build per application and state of the documents, as an index is built once and then
    queried.  The state is told by the files' number, length and time, so changed tables are noticed."""
    key = (spark.sparkContext.applicationId, root, what, _state(spark, root))
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _state(spark: SparkSession, root: str) -> tuple:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/documents.parquet")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string")).first())


def text_bundle(spark: SparkSession, root: str) -> bundle.Bundle:
    def make():
        tag = hashlib.md5(f"{spark.sparkContext.applicationId}:{root}:{_state(spark, root)}".encode()).hexdigest()
        docs = spread_out(table(spark, root, "documents").select("doc_id", "text"))
        return bundle.open_or_create(docs, f"{shared_dir(spark)}/index-{tag}")

    return _once(spark, root, "bundle", make)


def text_index(spark: SparkSession, root: str) -> Index:
    return _once(spark, root, "index", lambda: text_bundle(spark, root).index)


def text_blocks(spark: SparkSession, root: str, formula: bm25.Formula) -> Blocks:
    """Documents as rows, which belong to the index as its vocabulary does and fit every formula."""
    return _once(spark, root, "blocks", lambda: block_postings(text_index(spark, root), formula))._replace(formula=formula)


def vocabulary(spark: SparkSession, root: str) -> Staged:
    """Numbered from the frequencies that the bundle keeps, so the postings are not counted again."""
    held = text_bundle(spark, root)
    return _once(spark, root, "vocab", lambda: stage_counted(bm25.vocabulary(held.index.postings, held.doc_freq())))


def numbered(spark: SparkSession, root: str) -> DataFrame:
    return bm25.with_vocab(text_index(spark, root).postings, vocabulary(spark, root))


def item_queries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), "text")


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
POSTINGS = f"""dt AS (SELECT doc_id, text, {WORDS} AS t FROM documents),
  st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
  p AS (SELECT doc_id, dl, token, count(*)::INTEGER AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM dt) GROUP BY ALL),
  f AS (SELECT token, count(*) AS df FROM p GROUP BY token)"""
NUMBERED = f"""{POSTINGS}, vo AS (SELECT token, df, row_number() OVER (ORDER BY token) - 1 AS vocab_idx FROM f),
  nu AS (SELECT p.*, vocab_idx FROM p JOIN vo USING (token))"""
LANE = "nu.vocab_idx % 16 = nu.doc_id % 16"


@query("corpus_texts", "SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, trim(concat_ws(' ', nullif(source, ''), nullif(text, ''))) AS text FROM documents) WHERE text <> ''")
def corpus_texts(spark, root):
    docs = titled_corpus(table(spark, root, "documents"), title="source", key="doc_id")
    return docs.select("doc_id", F.md5(F.trim("text").cast("binary")).alias("digest"))


@query("doc_freq", f"WITH {POSTINGS} SELECT token, df FROM f")
def doc_freq(spark, root):
    return bm25.doc_freq(text_index(spark, root).postings)


@query("vocab_map", f"""WITH {NUMBERED} SELECT token, vocab_idx, coalesce(CASE WHEN regexp_matches(token, '^-*[0-9]+$')
  THEN try_cast(token AS BIGINT) END, 4294967295)::BIGINT AS token_id FROM vo""")
def vocab_map(spark, root):
    vocab = vocabulary(spark, root).df
    return vocab.select("token", "vocab_idx", bm25.numeric_token(F.col("token")).alias("token_id"))


@query("term_freq", f"WITH {NUMBERED} SELECT doc_id, vocab_idx, tf FROM nu")
def term_freq(spark, root):
    return numbered(spark, root).select("doc_id", "vocab_idx", "tf")


@query("term_freq_layout", f"""WITH {POSTINGS}, s AS (SELECT doc_id, count(*) AS n_terms FROM p GROUP BY doc_id)
  SELECT doc_id, n_terms, coalesce(sum(n_terms * 8 + 4) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM s""")
def term_freq_layout(spark, root):
    return bm25.term_freq_layout(text_index(spark, root).terms)


@query("inverted_index", f"""WITH {POSTINGS} SELECT token, doc_id // 1024 AS block, count(*)::INTEGER AS n_entries,
  string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS entries FROM p GROUP BY 1, 2""")
def inverted_index(spark, root):
    blocks = bm25.inverted_blocks(text_index(spark, root).postings)
    shown = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["doc_id"], e["tf"])), ",")
    return blocks.select("token", "block", F.size("entries").alias("n_entries"), shown.alias("entries"))


PACK = f"""{NUMBERED}, k AS (SELECT doc_id, vocab_idx, tf, row_number() OVER (PARTITION BY doc_id ORDER BY vocab_idx) - 1 AS row
  FROM nu WHERE {LANE}),
  nr AS (SELECT b.range AS batch, greatest(coalesce(max(row) + 1, 0), 1) AS n_rows FROM range((SELECT ceil(n / 64.0)::BIGINT FROM st)) b
    LEFT JOIN k ON doc_id // 64 = b.range GROUP BY 1)"""


@query("packed_documents", f"""WITH {PACK} SELECT doc_id // 64 AS batch, (doc_id % 64 // 16)::INTEGER AS channel, (doc_id % 16)::INTEGER AS lane,
  row::INTEGER AS row, least(tf, 255)::BIGINT * 4294967296 + vocab_idx AS packed FROM k""")
def packed_documents(spark, root):
    return bm25.pack_documents(numbered(spark, root))


@query("packed_rows", f"WITH {PACK} SELECT batch, n_rows::INTEGER AS n_rows FROM nr")
def packed_rows(spark, root):
    return bm25.packed_rows(packed_documents(spark, root), text_index(spark, root).n_docs)


@query("index_statistics", f"""WITH {PACK}, a AS (SELECT count(*) AS n_tokens, max(df) AS max_df, min(df) AS min_df, {r6('avg(df)')} AS avg_df, sum(df)::BIGINT AS n_entries FROM f),
  b AS (SELECT count(*) AS n_batches, sum(n_rows)::BIGINT AS n_rows, {r6('avg(n_rows)')} AS avg_rows FROM nr)
  SELECT n AS n_docs, a.*, b.*, (n_rows * 512 + n_batches * 4)::BIGINT AS packed_bytes FROM a, b, st""")
def index_statistics(spark, root):
    return bm25.index_statistics(text_index(spark, root), packed_documents(spark, root))


@query("doc_freq_padded", f"WITH {NUMBERED} SELECT i.range AS vocab_idx, coalesce(df, 0)::BIGINT AS df FROM range((SELECT ((max(vocab_idx) + 65536) // 65536 * 65536)::BIGINT FROM vo)) i LEFT JOIN vo ON vocab_idx = i.range")
def doc_freq_padded(spark, root):
    return bm25.first_ids(vocabulary(spark, root).df)


@query("grown_doc_freq", f"""SELECT token, count(*) AS df FROM (SELECT DISTINCT d, token FROM (
  SELECT 'd' || doc_id AS d, unnest({WORDS}) AS token FROM documents UNION ALL
  SELECT 'b' || item_id AS d, unnest({WORDS}) AS token FROM benchmark)) GROUP BY token""")
def grown_doc_freq(spark, root):
    """Document frequencies after the benchmark texts were added to the index."""
    index = text_index(spark, root)
    extra = item_queries(spark, root).select((F.col("query_id") + index.n_docs).alias("doc_id"), "text")
    return bm25.doc_freq(bm25.add_documents(index, extra).postings)


@query("index_bundle", f"""WITH u AS (SELECT doc_id, text FROM documents UNION ALL SELECT n + item_id, text FROM benchmark, (SELECT count(*) AS n FROM documents)),
  dt AS (SELECT doc_id, {WORDS} AS t FROM u), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM dt)
  SELECT v AS version, count(DISTINCT d)::BIGINT AS n_docs, count(DISTINCT token)::BIGINT AS n_tokens, count(token)::BIGINT AS n_words,
    {r6('count(token) / count(DISTINCT d)')} AS mean_len
  FROM (SELECT 1 AS v, dt.doc_id AS d, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS token FROM dt, (SELECT count(*) AS n FROM documents) WHERE dt.doc_id < n
    UNION ALL SELECT 2, doc_id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) FROM dt) GROUP BY v""")
def index_bundle(spark, root):
    """A bundle is written, reopened, appended to and reopened at either version."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    path = new_folder(spark, "bundle")
    n = bundle.create(docs, path).index.n_docs
    bundle.append(bundle.open_bundle(spark, path), item_queries(spark, root).select((F.col("query_id") + n).alias("doc_id"), "text"))
    rows = []
    for v in (1, 2):
        held = bundle.open_bundle(spark, path, v)
        rows.append(held.doc_freq().agg(F.lit(v).alias("version"), F.lit(held.index.n_docs).cast("bigint").alias("n_docs"),
                                        F.count(F.lit(1)).alias("n_tokens"),
                                        F.lit(sum(s.words for s in held.segments)).cast("bigint").alias("n_words"),
                                        F.round(F.lit(held.index.mean_len), 6).alias("mean_len")))
    return rows[0].unionByName(rows[1])


@query("segment_frequencies", f"""SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS token FROM documents) GROUP BY token""")
def segment_frequencies(spark, root):
    """Document frequencies of an index to which the documents came in six parts, four of which were merged."""
    docs = spread_out(table(spark, root, "documents").select("doc_id", "text"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(6))
    held = bundle.create(docs.where(part == 0), new_folder(spark, "bundle"))
    for i in range(1, 6):
        held = bundle.append(held, docs.where(part == i))
    return bundle.open_bundle(spark, held.path).doc_freq()


ALL_TERMS = f"qt AS (SELECT DISTINCT unnest({WORDS}) AS token FROM benchmark)"
ITEM_TERMS = f"qt AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS token FROM benchmark)"
N64 = "ceil(n / 64.0) * 64"
IDF_CPU = "ln((n - df + 0.5) / (df + 0.5) + 1)"
IDF_HW = f"ln(({N64} - df + 0.5) / (df + 0.5))"
TF_CPU = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))"
TF_HW = "least(tf, 255) * 2.2 / (least(tf, 255) + 1.2)"
TF_LUCENE = "tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean))"


def bm25_sql(idf: str, tf: str, source: str = "p", where: str = "true", by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""m AS (SELECT {key}doc_id, {r6(f'sum({idf}::DOUBLE * ({tf})::DOUBLE)')} AS score
      FROM {source} JOIN qt USING (token) JOIN f USING (token), st WHERE {where} GROUP BY ALL)"""


ALL_DOCS = "s AS (SELECT d.doc_id, coalesce(score, 0.0)::DOUBLE AS score FROM documents d LEFT JOIN m USING (doc_id))"
TOP_ALL = f"SELECT doc_id, score, rank FROM {ranked_sql('s', 64, '', 'doc_id')}"


def _ranked_for_all(spark, root, formula):
    """The 64 best documents for one query made of all benchmark tokens."""
    terms = item_queries(spark, root).select(F.explode(tx.tokens("text")).alias("token")).distinct()
    return bm25.rank_documents(bm25.score_all_documents(text_index(spark, root), terms, formula), 64)


@query("bm25_cpu", f"WITH {POSTINGS}, {ALL_TERMS}, {bm25_sql(IDF_CPU, TF_CPU)}, {ALL_DOCS} {TOP_ALL}")
def bm25_cpu(spark, root):
    return _ranked_for_all(spark, root, CPU)


@query("bm25_packed", f"WITH {POSTINGS}, {ALL_TERMS}, {bm25_sql(IDF_HW, TF_HW)}, {ALL_DOCS} {TOP_ALL}")
def bm25_packed(spark, root):
    return _ranked_for_all(spark, root, PACKED)


@query("bm25_lucene", f"WITH {POSTINGS}, {ALL_TERMS}, {bm25_sql(IDF_CPU, TF_LUCENE)}, {ALL_DOCS} {TOP_ALL}")
def bm25_lucene(spark, root):
    return _ranked_for_all(spark, root, LUCENE)


@query("bm25_packed_lanes", f"WITH {NUMBERED}, {ALL_TERMS}, {bm25_sql(IDF_HW, TF_HW, 'nu', LANE)}, {ALL_DOCS} {TOP_ALL}")
def bm25_packed_lanes(spark, root):
    """As bm25_packed, but a document sees only tokens of its own lane."""
    index = text_index(spark, root)
    terms = item_queries(spark, root).select(F.explode(tx.tokens("text")).alias("token")).distinct()
    lanes = bm25.lane_postings(numbered(spark, root))
    return bm25.rank_documents(bm25.score_all_documents(index, terms, PACKED, lanes), 64)


def _item_ranking(spark, root, formula, k):
    return top_documents(text_blocks(spark, root, formula), bm25.query_terms(item_queries(spark, root)), formula, k)


def item_top(k: int, idf: str = IDF_CPU, tf: str = TF_CPU) -> str:
    m = bm25_sql(idf, tf, by="query_id")
    return f"{POSTINGS}, {ITEM_TERMS}, {m}, top AS {ranked_sql('m', k, 'query_id', 'doc_id')}"


@query("bm25_multi_query", f"WITH {item_top(10)} SELECT query_id, doc_id, score, rank FROM top")
def bm25_multi_query(spark, root):
    return _item_ranking(spark, root, CPU, 10)


@query("query_bitmap", f"""WITH {NUMBERED}, {ALL_TERMS} SELECT vocab_idx // 64 AS word, bit_or(CASE WHEN vocab_idx % 64 = 63
  THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (vocab_idx % 64)::INTEGER END) AS bits FROM vo JOIN qt USING (token) GROUP BY 1""")
def query_bitmap(spark, root):
    """The ids of the query tokens as a membership bitmap; unknown tokens have no bit."""
    terms = item_queries(spark, root).select(F.explode(tx.tokens("text")).alias("token")).distinct()
    ids = vocabulary(spark, root).df.join(terms, "token", "left_semi")
    return retrieve.threshold_bitmap(ids.withColumn("score", F.lit(1.0)), 1.0, "vocab_idx")


@query("matching_postings", f"WITH {POSTINGS}, {ALL_TERMS} SELECT doc_id, token, tf FROM p SEMI JOIN qt USING (token)")
def matching_postings(spark, root):
    terms = item_queries(spark, root).select(F.explode(tx.tokens("text")).alias("token")).distinct()
    return retrieve.matching_postings(text_index(spark, root).terms, stage_counted(terms)).select("doc_id", "token", "tf")


@query("topk_overlap", f"""WITH {POSTINGS}, {ITEM_TERMS}, {bm25_sql(IDF_CPU, TF_CPU, by='query_id')}, a AS {ranked_sql('m', 64, 'query_id', 'doc_id')},
  m2 AS (SELECT query_id, doc_id, {r6(f'sum({IDF_CPU} * {TF_LUCENE})')} AS score FROM p JOIN qt USING (token) JOIN f USING (token), st GROUP BY ALL),
  b AS {ranked_sql('m2', 64, 'query_id', 'doc_id')},
  j AS (SELECT a.query_id, count(*) AS n_returned, count(DISTINCT a.doc_id) AS n_unique, count(b.doc_id) AS n_overlap, count_if(d.doc_id IS NULL)::BIGINT AS n_invalid
    FROM a LEFT JOIN b USING (query_id, doc_id) LEFT JOIN documents d ON d.doc_id = a.doc_id GROUP BY 1),
  w AS (SELECT query_id, count(*) AS n_expected FROM b GROUP BY 1)
  SELECT *, CASE WHEN n_overlap / n_expected >= 0.9 AND n_invalid = 0 AND n_unique = n_returned THEN 'pass'
    WHEN n_overlap / n_expected >= 0.5 AND n_invalid = 0 THEN 'partial' ELSE 'fail' END AS verdict FROM j JOIN w USING (query_id)""")
def topk_overlap(spark, root):
    return retrieve.overlap(_item_ranking(spark, root, CPU, 64), _item_ranking(spark, root, LUCENE, 64),
                            table(spark, root, "documents"), "doc_id", ["query_id"])


@query("sampled_query", f"""WITH {NUMBERED}, o AS (SELECT DISTINCT vocab_idx FROM nu WHERE {LANE}),
  t AS (SELECT (vocab_idx % 16)::INTEGER AS lane, row_number() OVER (PARTITION BY vocab_idx % 16 ORDER BY md5('42:' || vocab_idx), vocab_idx)::INTEGER AS turn, vocab_idx FROM o)
  SELECT * FROM t WHERE turn <= 4 ORDER BY turn, lane LIMIT 64""")
def sampled_query(spark, root):
    return bm25.sample_query(numbered(spark, root))


CONTEXT = f"""{item_top(3)}, c AS (SELECT query_id, string_agg('[Document ' || (rank + 1) || '] ' || substring(text, 1, 1000), chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg('[Doc ' || (rank + 1) || '] ' || substring(text, 1, 500), chr(10) ORDER BY rank) AS more FROM top JOIN documents USING (doc_id) GROUP BY 1),
  a AS (SELECT item_id AS query_id, text, coalesce(context, '') AS context, coalesce(more, '') AS more FROM benchmark LEFT JOIN c ON query_id = item_id)"""


def _item_contexts(spark, root):
    ranked = stage_counted(_item_ranking(spark, root, CPU, 3).select("query_id", "doc_id", "rank"))
    return rag.contexts(item_queries(spark, root), table(spark, root, "documents"), ranked, ["query_id"])


@query("rag_context", f"WITH {CONTEXT} SELECT query_id, context FROM a")
def rag_context(spark, root):
    return rag.with_context(_item_contexts(spark, root)).select("query_id", "context")


NL = "chr(10)"
PROMPT = (f"'Based on the following context, answer the question.' || {NL} || {NL} || 'Context:' || {NL} || context || {NL} || {NL} "
          f"|| 'Question: ' || text || {NL} || {NL} || 'Answer:'")


@query("rag_prompt", f"WITH {CONTEXT} SELECT query_id, {PROMPT} AS prompt FROM a")
def rag_prompt(spark, root):
    return rag.with_prompt(_item_contexts(spark, root)).select("query_id", "prompt")


@query("rag_continuation", f"""WITH {CONTEXT} SELECT query_id, {PROMPT} || text || {NL} || {NL} || '[Additional Context from Retrieval]' || {NL} || more
  || {NL} || {NL} || '[Continue Answer]' || {NL} AS continued FROM a""")
def rag_continuation(spark, root):
    """The prompt continued after a text; here the question itself stands for the text."""
    df = rag.with_prompt(_item_contexts(spark, root))
    return rag.with_continuation(df, "prompt", "text").select("query_id", "continued")


PIECES = r"regexp_extract_all({}, '[^.!?\n]*[.!?\n]|[^.!?\n]+')"
TRIMMED = "list_filter(list_transform({}, lambda s: regexp_replace(s, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda s: s <> '')"
SENTENCES = TRIMMED.format(PIECES.format("text"))


@query("rag_answer", f"""WITH {item_top(3)} SELECT item_id AS query_id, coalesce({SENTENCES.replace('text', 'documents.text')}[1], '') AS answer
  FROM benchmark LEFT JOIN (SELECT * FROM top WHERE rank = 0) t ON t.query_id = item_id LEFT JOIN documents USING (doc_id)""")
def rag_answer(spark, root):
    return rag.generate(_item_contexts(spark, root), "prompt").select("query_id", "answer")


def _first_sentence(col: str) -> str:
    return f"coalesce({TRIMMED.format(PIECES.format(col))}[1], '')"


@query("answer_follow_up", f"""WITH {POSTINGS}, an AS (WITH {ITEM_TERMS}, {bm25_sql(IDF_CPU, TF_CPU, by='query_id')}, top AS {ranked_sql('m', 3, 'query_id', 'doc_id')}
    SELECT item_id AS query_id, benchmark.text AS prompt, {_first_sentence('documents.text')} AS sentence
    FROM benchmark LEFT JOIN (SELECT * FROM top WHERE rank = 0) t ON t.query_id = item_id LEFT JOIN documents USING (doc_id)),
  qt AS (SELECT DISTINCT query_id, unnest({WORDS.replace('text', 'sentence')}) AS token FROM an), {bm25_sql(IDF_CPU, TF_CPU, by='query_id')},
  top AS {ranked_sql('m', 3, 'query_id', 'doc_id')},
  c AS (SELECT query_id, string_agg('[Doc ' || (rank + 1) || '] ' || substring(text, 1, 500), {NL} ORDER BY rank) AS more,
    max(CASE WHEN rank = 0 THEN {_first_sentence('text')} END) AS answer FROM top JOIN documents USING (doc_id) GROUP BY 1)
  SELECT query_id, sentence, prompt || sentence || {NL} || {NL} || '[Additional Context from Retrieval]' || {NL} || coalesce(more, '')
    || {NL} || {NL} || '[Continue Answer]' || {NL} AS continued, coalesce(answer, '') AS answer FROM an LEFT JOIN c USING (query_id)""")
def answer_follow_up(spark, root):
    """The answer's first sentence retrieves again and the prompt, here the question, is continued."""
    answered = rag.generate(_item_contexts(spark, root), "text").select("query_id", F.col("text").alias("prompt"), "answer")
    again = steps.follow_up(text_blocks(spark, root, CPU), table(spark, root, "documents"), answered)
    return again.select("query_id", "sentence", "continued", "answer")


def _round_sql(r: int) -> str:
    """One round of the loop over the queries that are left: s = sentence, t = its documents, fs = the state."""
    return f"""sd{r} AS (SELECT * FROM (SELECT query_id, prompt, written, coalesce(list_filter(offered, lambda x: NOT list_contains(written, x))[1], '') AS sentence
      FROM fs{r - 1}) WHERE sentence <> ''),
    tp{r} AS (WITH qt AS (SELECT DISTINCT query_id, unnest({WORDS.replace('text', 'sentence')}) AS token FROM sd{r}), {bm25_sql(IDF_CPU, TF_CPU, by='query_id')}
      SELECT * FROM {ranked_sql('m', 3, 'query_id', 'doc_id')}),
    fs{r} AS (SELECT query_id, {r}::INTEGER AS round, sentence, coalesce(ids, '') AS doc_ids, prompt || sentence || coalesce({NL} || {NL}
        || '[Additional Context from Retrieval]' || {NL} || more || {NL} || {NL} || '[Continue Answer]' || {NL}, '') AS prompt,
        coalesce(offered, []) AS offered, list_append(written, sentence) AS written
      FROM sd{r} LEFT JOIN (SELECT query_id, string_agg('[Doc ' || (rank + 1) || '] ' || substring(text, 1, 500), {NL} ORDER BY rank) AS more,
        flatten(list(se ORDER BY rank)) AS offered, string_agg(doc_id, ',' ORDER BY rank) AS ids FROM tp{r} JOIN ds USING (doc_id) GROUP BY 1) USING (query_id))"""


@query("sentence_loop", f"""WITH {CONTEXT}, ds AS (SELECT doc_id, text, {SENTENCES} AS se FROM documents),
  fs0 AS (SELECT query_id, {PROMPT} AS prompt, coalesce(offered, []) AS offered, []::VARCHAR[] AS written FROM a LEFT JOIN (
    SELECT query_id, flatten(list(se ORDER BY rank)) AS offered FROM top JOIN ds USING (doc_id) GROUP BY 1) USING (query_id)),
  {", ".join(map(_round_sql, (1, 2, 3)))}
  {" UNION ALL ".join(f"SELECT query_id, round, sentence, doc_ids, md5(prompt) AS digest FROM fs{r}" for r in (1, 2, 3))}""")
def sentence_loop(spark, root):
    """Answers written a sentence at a time from the documents, which are looked up anew after each."""
    said = steps.sentence_loop(text_blocks(spark, root, CPU), table(spark, root, "documents"), item_queries(spark, root), 3)
    return said.select("query_id", "round", "sentence", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"),
                       F.md5(F.col("prompt").cast("binary")).alias("digest"))


@query("rag_token_concat", f"""WITH {item_top(3)}, c AS (SELECT query_id, flatten(list(t ORDER BY rank)) AS more FROM top JOIN dt USING (doc_id) GROUP BY 1),
  j AS (SELECT item_id AS query_id, list_concat({WORDS}, coalesce(more, [])) AS t FROM benchmark LEFT JOIN c ON query_id = item_id)
  SELECT query_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM j""")
def rag_token_concat(spark, root):
    ranked = stage_counted(_item_ranking(spark, root, CPU, 3).select("query_id", "doc_id", "rank"))
    queries = tx.tokenize(item_queries(spark, root)).select("query_id", "tokens")
    docs = tx.tokenize(table(spark, root, "documents").select("doc_id", "text"))
    joined = rag.append_tokens(queries, docs, ranked, ["query_id"])
    return joined.select("query_id", F.size("tokens").alias("n_tokens"),
                         F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


SAID = f"""se AS (SELECT conv_id, turn, unnest(s) AS sentence, generate_subscripts(s, 1)::INTEGER AS sentence_no FROM (
  SELECT conv_id, turn, {SENTENCES} AS s FROM conversations))"""


@query("sentences", f"WITH {SAID} SELECT conv_id, turn, sentence_no, sentence FROM se")
def sentences(spark, root):
    return rag.split_sentences(table(spark, root, "conversations"), ["conv_id", "turn"])


@query("sentence_retrieval", f"""WITH {POSTINGS}, {SAID}, qt AS (SELECT DISTINCT conv_id, turn, sentence_no, unnest({WORDS.replace('text', 'sentence')}) AS token FROM se),
  {bm25_sql(IDF_CPU, TF_CPU, by='conv_id, turn, sentence_no')} SELECT conv_id, turn, sentence_no, doc_id, score, rank
  FROM {ranked_sql('m', 3, 'conv_id, turn, sentence_no', 'doc_id')}""")
def sentence_retrieval(spark, root):
    """After each sentence of a conversation, the three documents closest to it."""
    by = ["conv_id", "turn", "sentence_no"]
    terms = bm25.query_terms(sentences(spark, root), "sentence", by)
    return top_documents(text_blocks(spark, root, CPU), terms, CPU, 3, by)


@query("parsed_ids", """SELECT event_id, unnest(list_sort(list_distinct(list_filter(list_transform(string_split(l, ','),
  lambda s: CASE WHEN regexp_matches(trim(s), '^-?[0-9]+$') THEN try_cast(trim(s) AS INTEGER) END), lambda n: n IS NOT NULL AND n >= 0 AND n < 65536)))) AS id
  FROM (SELECT event_id, concat_ws(', ', event_id::VARCHAR, user_id::VARCHAR, event_type, '-7', user_id::VARCHAR, '70000') AS l FROM events)""")
def parsed_ids(spark, root):
    line = F.concat_ws(", ", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type",
                       F.lit("-7"), F.col("user_id").cast("string"), F.lit("70000"))
    return table(spark, root, "events").select("event_id", F.explode(parse_ids(line)).alias("id"))


@query("snake_case_names", r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(n, '([a-z])([0-9])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'),
  '([A-Z])([A-Z][a-z])', '\1_\2', 'g')) AS snake FROM (SELECT p_partkey, upper(p_name[1]) || replace(p_name[2:], ' ', '') || p_type || replace(p_brand, '#', '') AS n FROM part)""")
def snake_case_names(spark, root):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.regexp_replace(F.expr("substring(p_name, 2)"), " ", ""),
                    F.col("p_type"), F.regexp_replace("p_brand", "#", ""))
    return table(spark, root, "part").select("p_partkey", tx.snake_case(name).alias("snake"))


_LEXEMES_SQL = "regexp_extract_all(code, '" + tx.LEXEME.replace("'", "''") + "')"
_OPS_SQL = ", ".join(
    f"sum(len(list_filter(lex, lambda x, i: x = '{op}=' OR (x = '{op}' AND i > 1 AND i < len(lex) AND "
    f"regexp_matches(lex[i - 1], '{tx.BEFORE}') AND regexp_matches(lex[i + 1], '{tx.AFTER}')))))::BIGINT AS n_{n}"
    for n, op in tx.ARITHMETIC.items())
_CALLS_SQL = ", ".join(
    rf"sum(len(regexp_extract_all(code, '\b({'|'.join(c)})\s*\(')))::BIGINT AS n_{n}_calls" for n, c in tx.MATH_CALLS.items())


@query("operator_counts", r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages),
  c AS (SELECT page_id, CASE WHEN regexp_matches(line, '^\s*//') THEN '' ELSE line END AS code FROM l),
  x AS (SELECT page_id, code, @LEXEMES AS lex FROM c)
  SELECT page_id, @OPS, @CALLS FROM x GROUP BY page_id""".replace("@OPS", _OPS_SQL).replace("@LEXEMES", _LEXEMES_SQL).replace("@CALLS", _CALLS_SQL))
def operator_counts(spark, root):
    """Arithmetic operators and math calls per page, counted line by line."""
    lines = table(spark, root, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    line = F.col("line")
    sums = [F.sum(c).alias(f"n_{n}") for n, c in tx.arithmetic_counts(line).items()]
    calls = [F.sum(c).alias(f"n_{n}_calls") for n, c in tx.math_call_counts(line).items()]
    return lines.groupBy("page_id").agg(*sums, *calls)


@query("token_compression", f"""WITH {NUMBERED}, k AS (SELECT vocab_idx AS token_id, token, lower(strip_accents(token)) AS form FROM vo),
  g AS (SELECT form, row_number() OVER (ORDER BY min(token_id)) - 1 AS new_id FROM k GROUP BY form)
  SELECT token_id, new_id FROM k JOIN g USING (form)""")
def token_compression(spark, root):
    vocab = vocabulary(spark, root).df.select(F.col("vocab_idx").alias("token_id"), "token")
    return tx.compress_vocabulary(vocab).select("token_id", "new_id")


"""Queries on vector memories.  Keys are the embeddings, values the reversed embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import hold
from ..functions.vectors import (as_matrix, collect_small, doubles, map_blocks, mean_vectors, np_rounded, rounded, total,
                                 unpack)
from ..operators import attention, memory, retrieve, score
from ..sources.tables import table
from . import steps
from .registry import query, r6, sql_matrix

DIM = 64
PAGE = 8
PROJ = memory.lcg_weights(DIM, 16)


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("mem_id"),
                                                   F.col("embedding").alias("vec"))


def cache_rows(spark: SparkSession, root: str) -> DataFrame:
    """The embeddings as a key/value cache."""
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("pos"), F.col("embedding").alias("k"),
        F.reverse("embedding").alias("v"))


def label_queries(spark: SparkSession, root: str) -> DataFrame:
    """One query per label: the mean of its embeddings."""
    e = table(spark, root, "embeddings")
    return mean_vectors(e.select(F.col("label").cast("bigint").alias("query_id"), "embedding"),
                        ["query_id"], "embedding", "q")


def mean_query(spark: SparkSession, root: str) -> DataFrame:
    """A single query: the mean of all embeddings."""
    e = table(spark, root, "embeddings")
    return mean_vectors(e.select(F.lit(0).cast("bigint").alias("query_id"), "embedding"),
                        ["query_id"], "embedding", "q")


def cohort_heads(spark: SparkSession, root: str, heads: int) -> DataFrame:
    """``heads`` query heads: means of the rows dealt out by id, with weights 1/4, 2/4, ..."""
    e = table(spark, root, "embeddings")
    q = mean_vectors(e.select(F.pmod("vec_id", F.lit(heads)).cast("int").alias("head"), "embedding"),
                     ["head"], "embedding", "q")
    return q.withColumn("w", (F.col("head") + 1) / 4)


ELEMENTS = """el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
  generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)"""
LABEL_Q = f"""{ELEMENTS}, q AS (SELECT query_id, list(m ORDER BY d) AS q FROM (
  SELECT label::BIGINT AS query_id, d, avg(v) AS m FROM el GROUP BY ALL) GROUP BY query_id)"""
MEAN_Q = f"""{ELEMENTS}, q AS (SELECT 0::BIGINT AS query_id, list(m ORDER BY d) AS q FROM (
  SELECT d, avg(v) AS m FROM el GROUP BY d))"""
KV = """kv AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS k,
  list_reverse(embedding::DOUBLE[]) AS v FROM embeddings)"""
SCORES = f"""s AS (SELECT query_id, vec_id AS mem_id,
  {r6('list_inner_product(q, embedding::DOUBLE[])')} AS score FROM embeddings, q)"""


def ranked_sql(source: str, k: int, by: str = "query_id", id_col: str = "mem_id") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT *, (row_number() OVER ({part}ORDER BY score DESC, {id_col}) - 1)::INTEGER AS rank
      FROM {source} QUALIFY row_number() OVER ({part}ORDER BY score DESC, {id_col}) <= {k})"""


@query("inner_product_scores", f"WITH {LABEL_Q}, {SCORES} SELECT query_id, mem_id, score FROM s")
def inner_product_scores(spark, root):
    return score.inner_products(vectors(spark, root), label_queries(spark, root))


@query("topk_single", f"WITH {MEAN_Q}, {SCORES} SELECT mem_id, score, rank FROM {ranked_sql('s', 64)}")
def topk_single(spark, root):
    s = score.inner_products(vectors(spark, root), mean_query(spark, root))
    return retrieve.top_k(s.select("mem_id", "score"), 64)


@query("topk_per_label", f"WITH {LABEL_Q}, {SCORES} SELECT query_id, mem_id, score, rank FROM {ranked_sql('s', 10)}")
def topk_per_label(spark, root):
    return score.top_inner_products(vectors(spark, root), label_queries(spark, root), 10)


@query("topk_without_tail", f"WITH {LABEL_Q}, {SCORES} SELECT query_id, mem_id, rank FROM {ranked_sql('s', 64)} WHERE rank < 61")
def topk_without_tail(spark, root):
    best = score.top_inner_products(vectors(spark, root), label_queries(spark, root), 64)
    return retrieve.drop_tail(best, 64).select("query_id", "mem_id", "rank")


BITMAP_SQL = """b AS (SELECT query_id, mem_id // 64 AS word, bit_or(CASE WHEN score >= (SELECT max(score) / 2 FROM s) THEN
   CASE WHEN mem_id % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << (mem_id % 64)::INTEGER) END
   ELSE 0::BIGINT END) AS bits FROM s GROUP BY 1, 2)"""


@query("threshold_bitmap", f"WITH {LABEL_Q}, {SCORES}, {BITMAP_SQL} SELECT query_id, word, bits FROM b")
def threshold_bitmap(spark, root):
    """Which scores reach half of the highest."""
    memories, asked = vectors(spark, root), label_queries(spark, root)
    highest = score.top_inner_products(memories, asked, 1).agg(F.max("score")).first()[0]
    return score.threshold_words(memories, asked, highest / 2)


@query("threshold_decode", f"WITH {LABEL_Q}, {SCORES} SELECT query_id, mem_id FROM s WHERE score >= (SELECT max(score) / 2 FROM s)")
def threshold_decode(spark, root):
    return retrieve.decode_bitmap(threshold_bitmap(spark, root), by=["query_id"])


POOLED = """pooled AS (SELECT vec_id // 8 AS mem_id, d, avg(v) AS m FROM el GROUP BY ALL),
  pv AS (SELECT mem_id, list(m ORDER BY d) AS vec FROM pooled GROUP BY mem_id)"""
PROJECTED = f"""w AS (SELECT unnest({sql_matrix(PROJ)}::DOUBLE[][]) AS row, generate_subscripts({sql_matrix(PROJ)}::DOUBLE[][], 1) - 1 AS o),
  pw AS (SELECT mem_id, o, list_inner_product(row, vec) AS x FROM pv, w)"""


@query("paged_index", f"WITH {ELEMENTS}, {POOLED}, {PROJECTED} SELECT mem_id, o::INTEGER AS dim, {r6('x')} AS value FROM pw")
def paged_index(spark, root):
    index = memory.paged_index(cache_rows(spark, root).select("pos", "k"), PAGE, DIM, PROJ)
    return unpack(index, ["mem_id"], "vec").withColumn("value", rounded("value"))


@query("minmax_index", f"WITH {ELEMENTS} SELECT vec_id // 16 AS entry_id, vec_id // 64 AS page_id, d::INTEGER AS dim, "
       f"{r6('min(v)')} AS vmin, {r6('max(v)')} AS vmax FROM el GROUP BY 1, 2, 3")
def minmax_index(spark, root):
    index = memory.minmax_index(cache_rows(spark, root).select("pos", "k"), 16, DIM, 4)
    return index.select("entry_id", "page_id", F.posexplode(F.arrays_zip("vmin", "vmax")).alias("dim", "x")) \
        .select("entry_id", "page_id", "dim", rounded(F.col("x.vmin").cast("double")).alias("vmin"),
                rounded(F.col("x.vmax").cast("double")).alias("vmax"))


@steps.register("score", "city_block")
def city_block(held: DataFrame, query: DataFrame) -> DataFrame:
    """Less the sum of absolute differences: a step that the library does not have by itself."""
    rows = collect_small(query.select("query_id", doubles("q").alias("q")), score.QUERY_ROWS)   # a query for each label
    ids, q = np.array([r["query_id"] for r in rows]), np.array([r["q"] for r in rows])

    def block(b: pa.RecordBatch) -> dict:
        x = as_matrix(b.column("vec"))
        far = np.stack([np.abs(x - one).sum(axis=1) for one in q], axis=1)
        return {"query_id": np.tile(ids, len(x)), "mem_id": np.repeat(b.column("mem_id").to_numpy(), len(ids)), "score": np_rounded(-far.ravel())}

    return map_blocks(held, block, score.PAIR)


@query("custom_steps", f"""WITH {LABEL_Q}, qd AS (SELECT query_id, unnest(q) AS w, generate_subscripts(q, 1) - 1 AS d FROM q),
  s AS (SELECT query_id, vec_id AS mem_id, {r6('-sum(abs(v - w))')} AS score FROM el JOIN qd USING (d) GROUP BY ALL)
  SELECT query_id, mem_id, rank, label FROM {ranked_sql('s', 5)} JOIN (SELECT vec_id AS mem_id, label FROM embeddings) USING (mem_id)""")
def custom_steps(spark, root):
    """A flow with a scoring step of one's own, known by its name, and the other steps replaced one by one."""
    data = table(spark, root, "embeddings").select(F.col("vec_id").alias("mem_id"), F.col("embedding").alias("vec"), "label")
    flow = steps.MemoryFlow(build=lambda d: d.select("mem_id", "vec"), score="city_block",
                            retrieve=lambda s: retrieve.top_k(s, 1, by=["query_id"]), apply=lambda d, q, i: i)
    flow = flow.with_steps(retrieve=lambda s: retrieve.top_k(s, 5, by=["query_id"]),
                           apply=lambda d, q, i: i.join(d.select("mem_id", "label"), "mem_id"))
    return flow.build_and_apply(data, label_queries(spark, root)).select("query_id", "mem_id", "rank", "label")


@query("topk_by_bounds", f"WITH {LABEL_Q}, {SCORES} SELECT query_id, mem_id, score, rank FROM {ranked_sql('s', 10)}")
def topk_by_bounds(spark, root):
    """The ten best entries per label, of the pages of eight whose extremes leave room for one."""
    return _opened(spark, root).best


@query("pages_opened", f"""WITH {LABEL_Q}, {SCORES}, x AS (SELECT vec_id // 8 AS page_id, d, min(v) AS lo, max(v) AS hi FROM el GROUP BY ALL),
  qd AS (SELECT query_id, unnest(q) AS w, generate_subscripts(q, 1) - 1 AS d FROM q),
  b AS (SELECT query_id, page_id, {r6('sum(greatest(w * lo, w * hi))')} AS bound FROM x JOIN qd USING (d) GROUP BY ALL),
  o AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, page_id) AS place, bound FROM b),
  k AS (SELECT query_id, CASE WHEN count(*) >= 10 THEN min(score) - 0.00001 ELSE -1e300 END AS bar FROM (
    SELECT s.query_id, score, mem_id FROM s JOIN o ON o.query_id = s.query_id AND page_id = mem_id // 8 WHERE place <= 4
    QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, mem_id) <= 10) GROUP BY query_id)
  SELECT query_id, count(*) AS n_pages FROM o JOIN k USING (query_id) WHERE place <= 4 OR bound >= bar GROUP BY query_id""")
def pages_opened(spark, root):
    """How many pages that took."""
    return _opened(spark, root).pages.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pages"))


def _opened(spark, root):
    cache = cache_rows(spark, root).select("pos", "k")
    pages = memory.minmax_index(cache, PAGE, DIM).select(F.col("entry_id").alias("page_id"), "vmin", "vmax")
    entries = cache.select(F.col("pos").alias("mem_id"), memory.page_of("pos", PAGE).alias("page_id"), F.col("k").alias("vec"))
    return score.top_by_bounds(entries, pages, hold(label_queries(spark, root)).df, 10)


@query("segment_memory", f"WITH {ELEMENTS} SELECT vec_id // 32 AS segment_id, ((vec_id % 32) // 16 * 64 + d)::INTEGER AS dim, "
       f"{r6('avg(v)')} AS value FROM el GROUP BY 1, 2")
def segment_memory(spark, root):
    held = memory.segment_memory(cache_rows(spark, root).select("pos", "k"), 32, 2, DIM)
    return unpack(memory.read_segment(held), ["segment_id"], "vec").withColumn("value", rounded("value"))


@query("memory_edits", f"""WITH {LABEL_Q}, n AS (SELECT max(vec_id) AS last FROM embeddings),
  kept AS (SELECT vec_id - CASE WHEN vec_id > 3 THEN 1 ELSE 0 END AS mem_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id <> 3),
  added AS (SELECT last + row_number() OVER (ORDER BY query_id) - 1 AS mem_id, q AS vec FROM q, n),
  both_ AS (SELECT * FROM kept UNION ALL SELECT * FROM added)
  SELECT mem_id, {r6('list_sum(vec)')} AS content FROM both_ WHERE mem_id < (SELECT max(mem_id) FROM both_)""")
def memory_edits(spark, root):
    """Delete entry 3, append the label means, drop the last entry."""
    held = vectors(spark, root).select("mem_id", F.col("vec").cast("array<double>").alias("vec"))
    more = label_queries(spark, root).select(F.col("query_id").alias("mem_id"), F.col("q").alias("vec"))
    edited = memory.edit(held).delete(3).insert(more).pop_last().apply()
    return edited.select("mem_id", rounded(total(F.col("vec"))).alias("content"))


PAGE_TOP = f"""qp AS (SELECT query_id, list(list_inner_product(row, q) ORDER BY o) AS q FROM q, w GROUP BY query_id),
  pvec AS (SELECT mem_id, list(x ORDER BY o) AS vec FROM pw GROUP BY mem_id),
  s AS (SELECT query_id, mem_id, {r6('list_inner_product(q, vec)')} AS score FROM qp, pvec),
  top AS {ranked_sql('s', 4)}"""


def _page_choice(spark, root, weights, k=4):
    """Best pages per label query; query and pages are projected alike."""
    kv = cache_rows(spark, root)
    q = hold(label_queries(spark, root)).df  # read by the scoring and by the attention
    index = memory.paged_index(kv.select("pos", "k"), PAGE, DIM, weights)
    scored = memory.project(q, "q", weights, "q") if weights is not None else q
    return kv, q, score.top_inner_products(index, scored, k)


@query("paged_topk", f"WITH {LABEL_Q}, {POOLED}, {PROJECTED}, {PAGE_TOP} SELECT query_id, mem_id, score, rank FROM top")
def paged_topk(spark, root):
    return _page_choice(spark, root, PROJ)[2]


ATTEND = f"""tok AS (SELECT top.query_id, k, v, list_inner_product(q, k) / {math.sqrt(DIM)!r} AS sc
    FROM top JOIN kv ON pos // 8 = mem_id JOIN q ON q.query_id = top.query_id),
  e AS (SELECT query_id, v, exp(sc - max(sc) OVER (PARTITION BY query_id)) AS w FROM tok),
  x AS (SELECT query_id, w, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS dim FROM e)
  SELECT query_id, dim::INTEGER AS dim, {r6('sum(w * y) / sum(w)')} AS value FROM x GROUP BY 1, 2"""


def _attend(kv, q, chosen):
    out = attention.block_sparse_attention(
        kv, q, chosen.select("query_id", F.col("mem_id").alias("page_id")), PAGE, DIM, few=True)
    return unpack(out, ["query_id"], "out").withColumn("value", rounded("value"))


@query("block_sparse_attention", f"WITH {LABEL_Q}, {POOLED}, {KV}, s AS (SELECT query_id, mem_id, "
       f"{r6('list_inner_product(q, vec)')} AS score FROM q, pv), top AS {ranked_sql('s', 4)}, {ATTEND}")
def block_sparse_attention(spark, root):
    return _attend(*_page_choice(spark, root, None))


@query("paged_attention", f"WITH {LABEL_Q}, {POOLED}, {PROJECTED}, {PAGE_TOP}, {KV}, {ATTEND}")
def paged_attention(spark, root):
    """Build the page index, score it, choose pages, attend to their tokens."""
    return _attend(*_page_choice(spark, root, PROJ))


@query("gather_gemv", f"""WITH {MEAN_Q}, {SCORES}, top AS {ranked_sql('s', 64)}
  SELECT mem_id, {r6('list_inner_product(embedding::DOUBLE[], list_reverse(q))')} AS y
  FROM top JOIN embeddings ON vec_id = mem_id, q""")
def gather_gemv(spark, root):
    x = np.array(mean_query(spark, root).first()["q"])[::-1]
    rows = attention.gather(vectors(spark, root), hold(topk_single(spark, root).select("mem_id")))
    return attention.gemv(rows, x).withColumn("y", rounded("y"))


INT_VEC = "list_transform(embedding::DOUBLE[], lambda x: round_even(x * 1000, 0)::BIGINT)"


@query("integer_scores", f"""WITH {LABEL_Q} SELECT query_id, vec_id AS mem_id,
  list_sum(list_transform(list_zip({INT_VEC}, list_transform(q, lambda x: round_even(x * 1000, 0)::BIGINT)), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM embeddings, q""")
def integer_scores(spark, root):
    def fixed(c):
        return F.transform(F.col(c).cast("array<double>"), lambda x: F.bround(x * 1000).cast("smallint"))

    m = vectors(spark, root).select("mem_id", fixed("vec").alias("vec"))
    return score.integer_products(m, label_queries(spark, root).select("query_id", fixed("q").alias("q")))


HEADS = f"""{ELEMENTS}, h AS (SELECT head, list(m ORDER BY d) AS q, (head + 1) / 4 AS w FROM (
  SELECT (vec_id % 16)::INTEGER AS head, d, avg(v) AS m FROM el GROUP BY ALL) GROUP BY head)"""


@query("multi_head_topk", f"""WITH {HEADS}, s AS (SELECT vec_id AS mem_id,
  {r6('sum(w * greatest(list_inner_product(q, embedding::DOUBLE[]), 0))')} AS score FROM embeddings, h GROUP BY vec_id)
  SELECT mem_id, score, rank FROM {ranked_sql('s', 64, '')}""")
def multi_head_topk(spark, root):
    s = score.multi_head(vectors(spark, root), cohort_heads(spark, root, 16))
    return retrieve.top_k(s, 64)


@query("multi_head_top2048", f"""WITH {HEADS}, s AS (SELECT vec_id AS mem_id,
  {r6('sum(w * greatest(list_inner_product(q, embedding::DOUBLE[]), 0))')} AS score FROM embeddings, h GROUP BY vec_id)
  SELECT mem_id, score, rank FROM {ranked_sql('s', 2048, '')}""")
def multi_head_top2048(spark, root):
    """The selection at the length an indexer of long contexts asks for."""
    return retrieve.top_k(score.multi_head(vectors(spark, root), cohort_heads(spark, root, 16)), 2048)


@query("multi_head_scaled", f"""WITH {HEADS}, b AS (SELECT vec_id, d // 16 AS blk, greatest(max(abs(v)), 1e-12) / 448.0 AS sc FROM el GROUP BY 1, 2),
  m AS (SELECT vec_id, avg(sc) AS sc FROM b GROUP BY 1),
  k AS (SELECT vec_id, list(least(greatest(v / sc, -448.0), 448.0) ORDER BY d) AS k FROM el JOIN b USING (vec_id) WHERE blk = d // 16 GROUP BY 1)
  SELECT vec_id AS mem_id, {r6('sum(w * greatest(list_inner_product(q, k) * sc, 0))')} AS score FROM k JOIN m USING (vec_id), h GROUP BY 1""")
def multi_head_scaled(spark, root):
    return score.multi_head(vectors(spark, root), cohort_heads(spark, root, 16), scale_block=16)


LEVELS = 16


def sample_table() -> np.ndarray:
    """lut[d][key code][query code] as 8-bit integers."""
    d, k, q = np.ogrid[0:DIM, 0:LEVELS, 0:LEVELS]
    return (k - 8) * (q - 8) + d % 3


def codes(c, gain: float):
    return F.transform(F.col(c).cast("array<double>"), lambda x: F.least(F.greatest(
        F.floor((x * gain + 0.5) * LEVELS), F.lit(0)), F.lit(LEVELS - 1)).cast("int"))


def _code_sql(x, gain):
    return f"least(greatest(floor(({x} * {gain} + 0.5) * 16), 0), 15)"


@query("table_lookup_topk", f"""WITH {ELEMENTS}, hd AS (SELECT (vec_id % 16)::INTEGER AS head, d, avg(v) AS m FROM el GROUP BY ALL),
  kc AS (SELECT vec_id, d, {_code_sql('v', 1.0)} AS kc FROM el), qc AS (SELECT head, d, {_code_sql('m', 4.0)} AS qc FROM hd),
  qk AS (SELECT vec_id, head, sum((kc - 8) * (qc - 8) + d % 3) AS qk FROM kc JOIN qc USING (d) GROUP BY 1, 2),
  s AS (SELECT vec_id AS mem_id, {r6('sum((head + 1) / 4 * greatest(qk, 0))')} AS score FROM qk GROUP BY 1)
  SELECT mem_id, score, rank FROM {ranked_sql('s', 64, '')}""")
def table_lookup_topk(spark, root):
    keys = vectors(spark, root).select("mem_id", codes("vec", 1.0).alias("codes"))
    heads = cohort_heads(spark, root, 16).select("head", codes("q", 4.0).alias("codes"), "w")
    return retrieve.top_k(score.table_lookup(keys, heads, sample_table()), 64)


HEADS_N, NOPE, LATENT, ROPE, VDIM = 4, 8, 48, 16, 8
MLA_Q = memory.lcg_weights(NOPE, HEADS_N, 7)
MLA_PE = memory.lcg_weights(ROPE, HEADS_N, 8)
MLA_K = memory.lcg_weights(LATENT, HEADS_N * NOPE, 9).reshape(HEADS_N, NOPE, LATENT)
MLA_V = memory.lcg_weights(LATENT, HEADS_N * VDIM, 10).reshape(HEADS_N, VDIM, LATENT)
MLA_SCALE = 1.0 / math.sqrt(NOPE + ROPE)
_FOLDED = np.einsum("hn,hnc->hc", MLA_Q, MLA_K)


@query("latent_attention", f"""WITH {LABEL_Q}, {SCORES}, top AS {ranked_sql('s', 32)},
  kv AS (SELECT query_id, embedding[1:48]::DOUBLE[] AS lat, embedding[49:64]::DOUBLE[] AS pe FROM top JOIN embeddings ON vec_id = mem_id),
  hw AS (SELECT unnest({sql_matrix(_FOLDED)}::DOUBLE[][]) AS f, unnest({sql_matrix(MLA_PE)}::DOUBLE[][]) AS p, unnest(range(4)) AS head),
  sc AS (SELECT query_id, head, lat, (list_inner_product(f, lat) + list_inner_product(p, pe)) * {MLA_SCALE!r} AS sc FROM kv, hw),
  e AS (SELECT query_id, head, lat, exp(sc - max(sc) OVER (PARTITION BY query_id, head)) AS w FROM sc),
  x AS (SELECT query_id, head, w, unnest(lat) AS y, generate_subscripts(lat, 1) AS d FROM e),
  m AS (SELECT query_id, head, d, sum(w * y) / sum(w) AS y FROM x GROUP BY ALL),
  i AS (SELECT query_id, head, list(y ORDER BY d) AS y FROM m GROUP BY ALL),
  wv AS (SELECT unnest({sql_matrix(MLA_V.reshape(-1, LATENT))}::DOUBLE[][]) AS r, unnest(range(32)) AS n)
  SELECT query_id, head::INTEGER AS head, (n % 8)::INTEGER AS dim, {r6('list_inner_product(r, y)')} AS value FROM i JOIN wv ON n // 8 = head""")
def latent_attention(spark, root):
    best = score.top_inner_products(vectors(spark, root), label_queries(spark, root), 32)
    rows = attention.gather(vectors(spark, root), hold(best.select("query_id", "mem_id")))
    kv = rows.select("query_id", F.slice("vec", 1, LATENT).alias("latent"),
                     F.slice("vec", LATENT + 1, ROPE).alias("k_pe"))
    out = attention.latent_attention(kv, MLA_Q, MLA_PE, MLA_K, MLA_V, MLA_SCALE)
    return unpack(out, ["query_id", "head"], "out").withColumn("value", rounded("value"))

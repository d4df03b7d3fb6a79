"""Queries on n-gram memories.  Sequences are the turns of the conversations; the embedding
rows are the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.text import token_id, tokens
from ..functions.vectors import (dot, np_rounded, rms_norm, rounded, signed_sqrt_gate, unpack,
                                 vector_literal)
from ..operators import memory, ngram
from ..sources.tables import spread_out, table
from .registry import query, r6, sql_matrix, sql_vector
from .vector_queries import DIM, ELEMENTS

LAYER, PAD = 1, 2
FACTORS = ngram.multipliers(LAYER)
SIZES = ngram.table_sizes([LAYER])[LAYER]
KEYS = ["conv_id", "turn"]


def token_sequences(spark, root):
    said = spread_out(table(spark, root, "conversations").select(*KEYS, "text"))
    return said.select(*KEYS, F.transform(tokens("text"), lambda t: token_id(t, ngram.VOCAB_SIZE)).alias("ids"))


TOKEN_IDS = f"""tk AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (
    SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM conversations)),
  id AS (SELECT conv_id, turn, pos, ('0x' || substr(md5(token), 1, 8))::BIGINT % {ngram.VOCAB_SIZE} AS id FROM tk),
  lg AS (SELECT *, coalesce(lag(id, 1) OVER w, {PAD}) AS id1, coalesce(lag(id, 2) OVER w, {PAD}) AS id2 FROM id WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
  mx AS (SELECT conv_id, turn, pos, xor(id * {FACTORS[0]}, id1 * {FACTORS[1]}) AS m2, xor(xor(id * {FACTORS[0]}, id1 * {FACTORS[1]}), id2 * {FACTORS[2]}) AS m3 FROM lg)"""
_FLAT = [(n, s) for n, group in zip((2, 3), SIZES) for s in group]
HASHES = ", ".join(f"m{n} % {s} AS h{i}" for i, (n, s) in enumerate(_FLAT))


@query("ngram_hash", f"WITH {TOKEN_IDS} SELECT conv_id, turn, pos, {HASHES} FROM mx")
def ngram_hash(spark, root):
    hashed = ngram.ngram_hash(token_sequences(spark, root), KEYS, FACTORS, SIZES, PAD)
    return hashed.select(*KEYS, "pos", *[F.col("heads")[i].alias(f"h{i}") for i in range(len(_FLAT))])


HASHES_40 = ", ".join(f"(m{n} & {2**40 - 1}) % {s} AS h{i}" for i, (n, s) in enumerate(_FLAT))


@query("ngram_hash_40bit", f"WITH {TOKEN_IDS} SELECT conv_id, turn, pos, {HASHES_40} FROM mx")
def ngram_hash_40bit(spark, root):
    """The hashes with products cut to 40 bits."""
    hashed = ngram.ngram_hash(token_sequences(spark, root), KEYS, FACTORS, SIZES, PAD, bits=40)
    return hashed.select(*KEYS, "pos", *[F.col("heads")[i].alias(f"h{i}") for i in range(len(_FLAT))])


_ROWS = ", ".join(f"(m{n} % {s} + {sum(x for _, x in _FLAT[:i])}) % r" for i, (n, s) in enumerate(_FLAT))


@query("ngram_lookup", f"""WITH {TOKEN_IDS}, sz AS (SELECT count(*) AS r FROM embeddings),
  rw AS (SELECT conv_id, turn, pos, unnest([{_ROWS}]) AS row FROM mx, sz)
  SELECT conv_id, turn, pos, (16 * 64)::INTEGER AS width, {r6('sum(list_sum(embedding::DOUBLE[]))')} AS content
  FROM rw JOIN embeddings ON vec_id = row GROUP BY 1, 2, 3""")
def ngram_lookup(spark, root):
    held = table(spark, root, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    hashed = ngram.ngram_hash(token_sequences(spark, root), KEYS, FACTORS, SIZES, PAD)
    keys = [*KEYS, "pos"]

    def row_sums(rows):
        return rows.sum(axis=1, dtype=np.float64, keepdims=True)

    def content(sums):
        return {"width": np.full(len(sums), sums.shape[1] * DIM, np.int32), "content": np_rounded(sums.sum(axis=1))}

    return ngram.lookup(ngram.row_ids(hashed, SIZES, held.count()), keys, held, 1, work=content, fields="width int, content double", each=row_sums)


G, D, SEQ = 4, 8, 128
KV_W = memory.lcg_weights(DIM, (G + 1) * D, 11) * 4
NORM1, NORM2, NORM3 = (1.0 + 0.1 * ((np.arange(G * D) + s) % 3).reshape(G, D) for s in range(3))
TAPS = memory.lcg_weights(4, G * D, 12)


def projected(spark, root):
    e = table(spark, root, "embeddings").select(
        F.floor(F.col("vec_id") / SEQ).cast("bigint").alias("seq_id"), (F.col("vec_id") % SEQ).alias("t"),
        F.slice(F.reverse("embedding"), 1, G * D).cast("array<double>").alias("hidden"), F.col("embedding").alias("flat"))
    return memory.project(e, "flat", KV_W, "kv")


def gated(spark, root):
    return ngram.gated_value(projected(spark, root), ["seq_id", "t"], G, D, NORM1, NORM2)


KV = f"""{ELEMENTS}, kw AS (SELECT unnest({sql_matrix(KV_W)}::DOUBLE[][]) AS w, unnest(range({(G + 1) * D})) AS o),
  kv AS (SELECT vec_id, o, list_inner_product(w, embedding::DOUBLE[]) AS y FROM embeddings, kw),
  hd AS (SELECT vec_id, unnest(range({G * D})) AS c, unnest(list_reverse(embedding::DOUBLE[])[1:{G * D}]) AS h FROM embeddings)"""
N1, N2, N3 = (sql_vector(n.ravel()) for n in (NORM1, NORM2, NORM3))
GATED = f"""{KV}, pr AS (SELECT hd.vec_id, c, c // 8 AS g, h, y AS k, {N1}[c + 1] AS n1, {N2}[c + 1] AS n2 FROM hd JOIN kv ON kv.vec_id = hd.vec_id AND o = c),
  sc AS (SELECT vec_id, g, sum(k * n1 * h * n2) / sqrt(avg(k * k) + 1e-5) / sqrt(avg(h * h) + 1e-5) / sqrt(8) AS s FROM pr GROUP BY 1, 2),
  gt AS (SELECT vec_id, g, 1 / (1 + exp(-(CASE WHEN s >= 0 THEN 1 ELSE -1 END) * sqrt(greatest(abs(s), 1e-6)))) AS gate FROM sc),
  gv AS (SELECT gt.vec_id, gt.vec_id // 128 AS seq_id, gt.vec_id % 128 AS t, g, g * 8 + o - 32 AS c, gate * y AS v FROM gt JOIN kv ON kv.vec_id = gt.vec_id AND o >= 32)"""


@query("kv_projection", f"WITH {KV} SELECT vec_id // 128 AS seq_id, vec_id % 128 AS t, o::INTEGER AS dim, {r6('y')} AS value FROM kv")
def kv_projection(spark, root):
    return unpack(projected(spark, root), ["seq_id", "t"], "kv").withColumn("value", rounded("value"))


@query("rms_norm", f"""WITH {KV}, n AS (SELECT vec_id, avg(h * h) AS m FROM hd GROUP BY 1)
  SELECT vec_id, c::INTEGER AS dim, {r6(f'h / sqrt(m + 1e-5) * {N1}[c + 1]')} AS value FROM hd JOIN n USING (vec_id)""")
def rms_norm_rows(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.slice(F.reverse("embedding"), 1, G * D).alias("h"))
    normed = e.select("vec_id", rms_norm(F.col("h"), vector_literal(NORM1.ravel())).alias("n"))
    return unpack(normed, ["vec_id"], "n").withColumn("value", rounded("value"))


@query("memory_gate", f"WITH {GATED} SELECT vec_id // 128 AS seq_id, vec_id % 128 AS t, g::INTEGER AS dim, {r6('gate')} AS gate FROM gt")
def memory_gate(spark, root):
    return unpack(gated(spark, root), ["seq_id", "t"], "gates", "dim", "gate").withColumn("gate", rounded("gate"))


@query("self_gate", f"""SELECT vec_id, {r6("1 / (1 + exp(-(CASE WHEN s >= 0 THEN 1 ELSE -1 END) * sqrt(greatest(abs(s), 1e-6))))")} AS gate
  FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])) AS s FROM embeddings)""")
def self_gate(spark, root):
    """The gate of each embedding against its reverse."""
    e = table(spark, root, "embeddings")
    s = dot(F.col("embedding"), F.reverse("embedding"))
    return e.select("vec_id", rounded(signed_sqrt_gate(s)).alias("gate"))


CONV = f"""{GATED}, ri AS (SELECT seq_id, t, g, 1 / sqrt(avg(v * v) + 1e-5) AS r FROM gv GROUP BY ALL),
  nm AS (SELECT gv.*, v * r * {N3}[c + 1] AS x FROM gv JOIN ri USING (seq_id, t, g)),
  tp AS (SELECT unnest({sql_matrix(TAPS)}::DOUBLE[][]) AS w, unnest(range(32)) AS c),
  ac AS (SELECT a.vec_id, a.seq_id, a.t, a.c, a.v, sum(b.x * w[(a.t - b.t) // 3 + 1]) AS s
    FROM nm a JOIN nm b ON b.seq_id = a.seq_id AND b.c = a.c AND a.t - b.t IN (0, 3, 6, 9) JOIN tp ON tp.c = a.c GROUP BY ALL)"""


@query("short_conv", f"WITH {CONV} SELECT seq_id, t, c::INTEGER AS dim, {r6('s / (1 + exp(-s))')} AS value FROM ac")
def short_conv(spark, root):
    out = ngram.short_conv(gated(spark, root), G, D, TAPS, NORM3)
    return unpack(out, ["seq_id", "t"], "out").withColumn("value", rounded("value"))


@query("memory_residual", f"WITH {CONV} SELECT seq_id, t, c::INTEGER AS dim, {r6('s / (1 + exp(-s)) + v + h')} AS value FROM ac JOIN hd USING (vec_id, c)")
def memory_residual(spark, root):
    """Projection, gate, convolution and residual in one plan."""
    out = ngram.short_conv(gated(spark, root), G, D, TAPS, NORM3, residual=True)
    return unpack(out, ["seq_id", "t"], "out").withColumn("value", rounded("value"))

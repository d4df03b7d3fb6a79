"""Queries on growing sequences: runs of 96 embeddings, the last 16 of which are decoded.

Where the table does not end with a run, one more run ends at its last row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding
from ..sources.tables import table
from .registry import query
from .vector_queries import ranked_sql

LENGTH, PAST = 96, 80


def sequences(spark, root):
    """(seq_id, at, q, k)."""
    def fixed(c):
        return F.transform(c.cast("array<double>"), lambda x: F.bround(x * 100).cast("smallint"))

    vectors = table(spark, root, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("pos"), fixed(F.reverse("embedding")).alias("q"), fixed(F.col("embedding")).alias("k"))
    return decoding.windows(rows, LENGTH, vectors.count())


GROWN = """c AS (SELECT count(*) AS n FROM embeddings),
  n AS (SELECT seq_id, l::INTEGER AS l, list_transform(embedding::DOUBLE[], lambda x: round_even(x * 100, 0)) AS k FROM (
    SELECT vec_id // 96 AS seq_id, vec_id % 96 AS l, embedding FROM embeddings, c WHERE n < 96 OR vec_id // 96 < n // 96
    UNION ALL SELECT n // 96, vec_id - (n - 96), embedding FROM embeddings, c WHERE n >= 96 AND n % 96 > 0 AND vec_id >= n - 96)),
  g AS (SELECT a.seq_id, a.l - 80 AS round, CASE WHEN b.l < 80 THEN b.l ELSE 80 + (b.l - 80) // 8 END::BIGINT AS pos,
    list_inner_product(list_reverse(a.k), b.k)::BIGINT AS score FROM n a JOIN n b USING (seq_id)
    WHERE a.l >= 80 AND (b.l < 80 OR b.l = a.l OR ((b.l - 80) % 8 = 7 AND (b.l - 80) // 8 < (a.l - 80) // 8)))"""


@query("growing_scores", f"WITH {GROWN} SELECT seq_id, round::INTEGER AS round, pos, score FROM g")
def growing_scores(spark, root):
    return decoding.growing_scores(sequences(spark, root), PAST)


@query("decode_threshold_bits", f"""WITH {GROWN} SELECT seq_id, round::INTEGER AS round, w AS word, bit_or(CASE WHEN pos // 64 = w AND score > 800 THEN
  CASE WHEN pos % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (pos % 64)::INTEGER END ELSE 0::BIGINT END) AS bits
  FROM g, (SELECT unnest([0, 1])::BIGINT AS w) GROUP BY 1, 2, 3""")
def decode_threshold_bits(spark, root):
    return decoding.threshold_bits(sequences(spark, root), PAST, 800)


@query("decode_budget", f"WITH {GROWN} SELECT seq_id, round::INTEGER AS round, pos, score, rank FROM {ranked_sql('g', 16, 'seq_id, round', 'pos')}")
def decode_budget(spark, root):
    return decoding.budget_keys(sequences(spark, root), PAST, 16)


@query("decode_pages", f"""WITH {GROWN}, m AS (SELECT seq_id, round, pos // 16 AS page_id, max(score) AS score FROM g GROUP BY ALL)
  SELECT seq_id, round::INTEGER AS round, page_id, score, rank FROM {ranked_sql('m', 4, 'seq_id, round', 'page_id')}""")
def decode_pages(spark, root):
    return decoding.best_pages(sequences(spark, root), PAST, 16, 4)

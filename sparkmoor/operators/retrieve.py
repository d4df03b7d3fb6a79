"""Selecting entries: top-k, thresholds as bitmaps, page reduction, query membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import Staged, keyed_join, stage, stage_counted

WORD_BITS = 64


def top_k(scores: DataFrame, k: int, id_col: str = "mem_id", by: list[str] | None = None,
          score: str = "score", spread: int | None = None) -> DataFrame:
    """Best ``k`` entries per query by (score desc, id asc), ranked from 0.

    Without ``by`` this is a bounded heap per partition (TakeOrderedAndProject); with it a
    WindowGroupLimit keeps at most ``k`` rows per query and partition before the shuffle.
    ``spread`` first takes the best k in that many shares of a query, for plans with so many
    input partitions that k rows of each would be too much for the one task of a query.
    """
    order = [F.desc(score), F.asc(id_col)]
    if not by:
        best = scores.orderBy(*order).limit(k)
        return best.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    if spread:
        share = F.pmod(F.xxhash64(id_col), F.lit(spread))
        shares = scores.withColumn("_share", share).withColumn(
            "_n", F.row_number().over(Window.partitionBy(*by, "_share").orderBy(*order)))
        scores = shares.where(F.col("_n") <= k).drop("_share", "_n")
    ranked = scores.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("int"))


def drop_tail(ranked: DataFrame, k: int, tail: int = 3) -> DataFrame:
    """Leave out the last ``tail`` of ``k`` ranks."""
    return ranked.where(F.col("rank") < k - tail)


def passes(score: Column, threshold: float, inclusive: bool = True) -> Column:
    return score >= F.lit(threshold) if inclusive else score > F.lit(threshold)


def threshold_bitmap(scores: DataFrame, threshold: float, id_col: str = "mem_id",
                     by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Bit ``id % 64`` of word ``id / 64`` is set iff the score passes.

    Every word that has an id is emitted, also when no bit is set.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"),
                          F.pmod(F.col(id_col), F.lit(WORD_BITS)).cast("int"))
    word = F.floor(F.col(id_col) / WORD_BITS).cast("bigint").alias("word")
    return scores.groupBy(*(by or []), word).agg(
        F.bit_or(F.when(passes(F.col("score"), threshold, inclusive), bit)
                 .otherwise(F.lit(0).cast("bigint"))).alias("bits"))


def decode_bitmap(bitmap: DataFrame, by: list[str] | None = None,
                  id_col: str = "mem_id") -> DataFrame:
    """Ids whose bit is set."""
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)),
                        lambda i: F.getbit(F.col("bits"), i) == 1)
    return bitmap.select(*(by or []), "word", F.explode(set_bits).alias("_bit")).select(
        *(by or []), (F.col("word") * WORD_BITS + F.col("_bit")).alias(id_col))


def page_scores(scores: DataFrame, page_size: int, id_col: str = "pos",
                by: list[str] | None = None) -> DataFrame:
    """Maximum score over each run of ``page_size`` consecutive entries."""
    page = F.floor(F.col(id_col) / page_size).cast("bigint").alias("page_id")
    return scores.groupBy(*(by or []), page).agg(F.max("score").alias("score"))


def matching_postings(postings: DataFrame, query_tokens: Staged) -> DataFrame:
    """Postings of the query's tokens."""
    return keyed_join(postings, Staged(query_tokens.df.select("token").distinct(), query_tokens.rows),
                      ["token"])


def overlap(left: DataFrame, right: DataFrame, universe: DataFrame, id_col: str,
            by: list[str]) -> DataFrame:
    """Agreement of two selections per query: sizes, overlap, invalid ids, verdict.

    Passes at 90 % overlap with only valid, unique ids; 50 % with valid ids is partial.
    """
    lefts = stage(left.groupBy(*by, id_col).agg(F.count(F.lit(1)).alias("_copies")))
    named = stage_counted(lefts.select(id_col).distinct())
    known = keyed_join(universe.select(id_col), named, [id_col]).distinct().withColumn("_known", F.lit(1))
    rights = stage(right.select(*by, id_col).distinct().withColumn("_hit", F.lit(1)))
    joined = lefts.join(rights, [*by, id_col], "left").join(known, id_col, "left")
    stats = joined.groupBy(*by).agg(
        F.sum("_copies").alias("n_returned"),
        F.count(F.lit(1)).alias("n_unique"),
        F.sum(F.coalesce("_hit", F.lit(0))).cast("bigint").alias("n_overlap"),
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).cast("bigint").alias("n_invalid"))
    wanted = rights.groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"))
    ratio = F.col("n_overlap") / F.col("n_expected")
    verdict = (
        F.when((ratio >= 0.9) & (F.col("n_invalid") == 0)
               & (F.col("n_unique") == F.col("n_returned")), "pass")
        .when((ratio >= 0.5) & (F.col("n_invalid") == 0), "partial").otherwise("fail"))
    return stats.join(wanted, by).withColumn("verdict", verdict)

"""Index and value patterns, checksums, and summaries of measured latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import running_total
from ..functions.staging import Staged, keyed_join, stage, stage_counted
from ..functions.vectors import rounded

WORD = 2**32


def generated_index(i: Column, mode: str = "sequential", stride: int = 1, start: int = 0) -> Column:
    """Index of item i: start + i, start + i * stride, or start + 0, 1, 2, 4, 8, ... (up to 2^31),
    in unsigned 32-bit arithmetic."""
    if mode == "strided":
        step = i * stride
    elif mode == "pattern":
        power = F.least(i - 1, F.lit(31)).cast("int")
        step = F.when(i < 2, i).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), power))
    else:
        step = i
    return F.pmod(step + start, F.lit(WORD))


def block_pattern(i: Column, base: int) -> Column:
    """The value written to word i: the same within 16 words."""
    return F.pmod(F.floor(i / 16) + base, F.lit(WORD))


def verify_pattern(df: DataFrame, index: str, value: str, base: int, by: list[str] | None = None) -> DataFrame:
    wrong = F.col(value) != block_pattern(F.col(index), base)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(wrong).alias("n_errors"))


def checksum(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Sum of the values modulo 2^32, and their number.

    Each value is reduced first, so partial sums of a 64-bit integer cannot overflow.
    """
    word = F.pmod(F.col(value).cast("bigint"), F.lit(WORD)).cast("decimal(38,0)")
    return df.groupBy(*(by or [])).agg(
        F.pmod(F.sum(word), F.lit(WORD).cast("decimal(38,0)")).cast("bigint").alias("checksum"),
        F.count(F.lit(1)).alias("n_words"))


def latency_summary(df: DataFrame, name: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Count, total, mean, extremes and the exact values at sorted position int(n * p / 100).

    Equal values are counted before anything is sorted; the positions of the distinct values come
    from one distributed sort by (name, value), so no list of a name's values is built.
    """
    counted = stage(df.where(F.col(value).isNotNull()).groupBy(name, value).agg(F.count(F.lit(1)).alias("_n")))
    placed = stage(running_total(counted, [name, value], F.col("_n"), "_at"))
    total = F.sum(F.col(value) * F.col("_n"))
    stats = placed.groupBy(name).agg(
        F.sum("_n").alias("n"), rounded(total).alias("total"), rounded(total / F.sum("_n")).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("most"), F.min("_at").alias("_first"))
    staged = stage_counted(stats)
    at = F.col("_at") - F.col("_first")
    inside = lambda p: (at <= F.floor(F.col("n") * p / 100)) & (F.floor(F.col("n") * p / 100) < at + F.col("_n"))
    picked = keyed_join(placed, Staged(staged.df.select(name, "n", "_first"), staged.rows), [name]).groupBy(name).agg(
        *[F.max(F.when(inside(p), F.col(value))).alias(f"p{p}") for p in percents])
    return staged.df.drop("_first").join(picked, name)


def best_setting(runs: DataFrame, setting: str, value: str, order: str, warmup: int = 3) -> DataFrame:
    """Mean per setting without its first ``warmup`` runs; the fastest is marked."""
    first = F.row_number().over(Window.partitionBy(setting).orderBy(order))
    warm = runs.withColumn("_n", first).where(F.col("_n") <= warmup).groupBy(setting).agg(F.max(order).alias("_warm"))
    means = keyed_join(runs, stage_counted(warm), [setting]).where(F.col(order) > F.col("_warm")).groupBy(setting).agg(
        F.count(F.lit(1)).alias("n_runs"), rounded(F.avg(value)).alias("mean"))
    means = stage(means)
    fastest = means.agg(F.min("mean")).scalar()
    return means.select(setting, "n_runs", "mean", (F.col("mean") == fastest).alias("is_best"))


# What a source line is scanned for: strings and comments, which are passed over, heads of classes, the word
# that marks an overridden step, openings with the word before them, closings, and ends of statements.
SCANNED = r"""\"[^\"]*\"|'[^']*'|//.*|(?:class|struct)\s+\w+|\boverride\b|[\w.#-]*\s*\{|\}|;"""
CLASS_NAME, WORD_BEFORE = r"^(?:class|struct)\s+(\w+)$", r"^([\w.#-]*)\s*\{$"


def source_blocks(lines: DataFrame, file: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Blocks in braces of source files, across lines: (file, at, name, is_class, depth, line_no, last_line, n_overrides).

    ``at`` numbers what was found in a file, ``name`` is the class whose head stands before the brace, or the
    word there, and ``n_overrides`` counts the overridden steps down to its end.  Depth is a running sum
    of openings and closings; on one level they alternate, so a block ends with the next row of its
    level.  A block that is not closed ends with null.  Windows run over one file.
    """
    found = lines.select(file, line_no, F.posexplode(F.regexp_extract_all(line, F.lit(SCANNED), F.lit(0))).alias("_no", "lexeme"))
    lexeme = F.col("lexeme")
    found = found.where(~lexeme.rlike("^[\"'/]")).withColumns({
        "opens": lexeme.rlike(WORD_BEFORE), "closes": lexeme == "}", "_head": F.nullif(F.regexp_extract(lexeme, CLASS_NAME, 1), F.lit(""))})
    order = Window.partitionBy(file).orderBy(line_no, "_no")
    border = F.when(F.col("opens") | F.col("closes") | (lexeme == ";"), 1).otherwise(0)
    marked = found.select(
        file, line_no, "lexeme", "opens", "closes", "_head", (F.row_number().over(order) - 1).cast("int").alias("at"),
        F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(order).cast("int").alias("depth"),
        F.coalesce(F.sum(border).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_statement"),
        F.sum(F.when(lexeme == "override", 1).otherwise(0)).over(order).alias("_so_far"))
    headed = marked.withColumn("_class", F.min("_head").over(Window.partitionBy(file, "_statement")))
    level = F.col("depth") + F.when(F.col("opens"), 0).otherwise(1)
    braces = headed.where(F.col("opens") | F.col("closes")).withColumn("_level", level)
    same = Window.partitionBy(file, "_level").orderBy("at")
    ended = braces.select("*", F.lead(line_no).over(same).alias("last_line"), F.lead("_so_far").over(same).alias("_then"))
    return ended.where("opens").select(
        file, "at", F.coalesce("_class", F.regexp_extract("lexeme", WORD_BEFORE, 1)).alias("name"),
        F.col("_class").isNotNull().alias("is_class"), "depth", line_no, "last_line",
        (F.col("_then") - F.col("_so_far")).alias("n_overrides"))

"""Document collections as (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(df: DataFrame, name: str) -> Column | None:
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else None


def titled_corpus(df: DataFrame, title: str = "title", text: str = "text", key: str = "_id") -> DataFrame:
    """Title and text joined by a blank; rows with neither are dropped.

    The id is the column ``key``; without one a position in file order is given, which costs
    no shuffle because it is made of the partition and the row in it.
    """
    parts = [c for c in (_filled(df, title), _filled(df, text)) if c is not None]
    joined = F.concat_ws(" ", *parts)
    ident = F.col(key) if key in df.columns else F.monotonically_increasing_id()
    return df.select(ident.alias("doc_id"), joined.alias("text")).where(F.col("text") != "")


def generic_corpus(df: DataFrame, key: str = "id") -> DataFrame:
    """The first filled one of text, content, document; else the row as JSON."""
    parts = [c for c in (_filled(df, n) for n in ("text", "content", "document")) if c is not None]
    ident = F.col(key) if key in df.columns else F.monotonically_increasing_id()
    return df.select(ident.alias("doc_id"), F.coalesce(*parts, F.to_json(F.struct("*"))).alias("text"))


def parse_ids(values: Column, limit: int = 65536) -> Column:
    """Valid ids in [0, limit) of a comma-separated list, each once; the rest is skipped."""
    numbers = F.transform(F.split(values, ","), lambda s: F.trim(s).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 0) & (n < limit)))

"""Readers and writers for rules and summaries in JSON."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    api: str
    max_data: int
    max_memory: int | None
    devices: tuple[str, ...]


def read_rules(spark: SparkSession, path: str, apis: list[str]) -> list[Rule]:
    """Schedule file: per call of ``apis`` a list of rules with sizes and devices, in order."""
    rule = ("array<struct<retrieved_data:bigint,memory:bigint,query:bigint,output:bigint,"
            "config:string>>")
    df = spark.read.option("multiLine", True).schema(", ".join(f"{a} {rule}" for a in apis)).json(path)
    rules: list[Rule] = []
    for api in apis:
        rows = df.select(F.posexplode(api).alias("no", "r")).select("no", "r.*").orderBy("no").collect()
        for r in rows:
            devices = tuple(re.findall(r"\w+", r["config"]))  # one name or a list of names
            rules.append(Rule(api, r["retrieved_data"], r["memory"], devices))
    return rules


def write_ranked(df: DataFrame, order: str | list[str], path: str, n: int = 10) -> None:
    """The best ``n`` configurations as JSON lines, in order."""
    df.orderBy(order).limit(n).coalesce(1).write.mode("overwrite").json(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """One-row summaries as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)

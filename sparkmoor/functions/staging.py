"""Materialising intermediate results in the shared folder of the cluster.

A staged table cuts lineage, survives the loss of executors, keeps column pruning, and
tells Catalyst its true size, so that a later join can choose broadcast by fact instead of
by guess.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows (of a few dozen bytes each) that every executor may hold as one hash table.
BROADCAST_ROWS = 200_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="sparkmoor-")
    return _local_dirs[app]


class Staged(NamedTuple):
    df: DataFrame
    rows: int

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_records: list[list[str]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of the shared one that is not taken yet."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    for r in _records:
        r.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are taken while the block runs."""
    paths: list[str] = []
    _records.append(paths)
    try:
        yield paths
    finally:
        _records[:] = [r for r in _records if r is not paths]


def drop_folders(spark: SparkSession, paths: list[str], reader: DataFrame) -> None:
    """Delete written folders, unless ``reader`` still reads from one of them."""
    used = reader.inputFiles()
    if any(f"/{p.rsplit('/', 1)[-1]}/" in f for p in paths for f in used):
        return
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_counted(df: DataFrame) -> Staged:
    """Stage and count; the count is answered from the Parquet footers."""
    written = stage(df)
    return Staged(written, written.count())


# Rows the driver may hold: query batches, selections of a few pages, model parameters.
DRIVER_ROWS = 4096


def hold(df: DataFrame) -> Staged:
    """Materialise a table that is expected to be small: its rows if there are at most
    ``DRIVER_ROWS``, else a staged table."""
    rows = df.limit(DRIVER_ROWS + 1).collect()
    if len(rows) > DRIVER_ROWS:
        return stage_counted(df)
    return Staged(df.sparkSession.createDataFrame(rows, df.schema), len(rows))


# A key is hot when it holds more than 1/HOT_SHARE of the rows; at most HOT_SHARE keys can.
HOT_SHARE = 10_000


def salts_of(spark: SparkSession) -> int:
    """Tasks a hot key is spread over, in line with the shuffles of the session."""
    return min(512, max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle rows by key into the session's number of partitions.

    The explicit number keeps them from being merged by size: what follows costs far more
    time per byte than a plain scan.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def keyed_join(big: DataFrame, small: Staged, on: list[str]) -> DataFrame:
    """Inner join of a table with hot keys to a staged one that has each key once.

    Below ``BROADCAST_ROWS`` the staged side is broadcast and ``big`` never moves.  Above it
    the keys of ``big`` are counted: the rows of hot keys, at most ``HOT_SHARE`` of them, are
    broadcast, and only the other rows are shuffled, among which no key stands out.
    """
    if small.broadcastable:
        return big.join(F.broadcast(small.df), on)
    counts = stage(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > total / HOT_SHARE).drop("_n")
    of_hot = big.join(F.broadcast(small.df.join(F.broadcast(hot), on, "left_semi")), on)
    of_rest = big.join(F.broadcast(hot), on, "left_anti").join(small.df, on)
    return of_hot.unionByName(of_rest)


def salted_join(big: DataFrame, small: Staged, on: list[str], salt_from: str) -> DataFrame:
    """Inner join to a staged table that may repeat its keys.

    Too large to broadcast, it is copied once per salt, and ``big`` draws its salt from
    ``salt_from``, so that a key holding a large share of the rows reaches many tasks.
    """
    if small.broadcastable:
        return big.join(F.broadcast(small.df), on)
    salts = salts_of(big.sparkSession)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    spread = small.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"]).drop("_salt")

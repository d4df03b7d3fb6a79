"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import BROADCAST_ROWS, stage

BLANKS = "\t\n\x0b\x0c\r "  # the white space that ends a word; bytes.split() uses the same six


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words of blank-separated text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def per_row(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], inputs: list[str],
            fields: str) -> DataFrame:
    """Append columns computed from ``inputs``, a batch of rows at a time.

    ``make`` runs once in each task and returns the function from the input lists to one tuple
    per row; ``fields`` is the DDL of the new columns, whose names must not be taken.
    """
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*df.schema.fields, *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(added)]
    names = [*df.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        work = make()
        for batch in batches:
            for part in pieces(batch):
                rows = work(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs])
                new = list(zip(*rows)) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(v, k) for v, k in zip(new, kinds)]], names=names)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes, so that what is held at once stays
    bounded by that or by the longest single row."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def small_enough(staged: DataFrame, row_bytes: int = 64, most: int = 16 << 20) -> bool:
    """Whether a written table may be broadcast: counted from its Parquet footers."""
    n = staged.count()
    return n <= BROADCAST_ROWS and n * row_bytes <= most


def join_checked(big: DataFrame, small: DataFrame, on: list[str] | Column, how: str,
                 row_bytes: int = 64) -> DataFrame:
    """Join to a written table: broadcast if its counted size allows, else shuffled, where
    Spark's adaptive skew join splits the keys that hold too many rows of ``big``."""
    return big.join(F.broadcast(small) if small_enough(small, row_bytes) else small, on, how)


class HashOf(dict):
    """64-bit hashes of words; forgets all of them when it has grown beyond ``most``."""

    def __init__(self, most: int = 1_000_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def give_back() -> None:
    """Return memory that a task has freed to the system, for the tasks that come after it in this worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # not the C library that keeps freed memory
        pass


lasting: dict = {}   # what a worker remembers beyond the end of a task


def let_go() -> None:
    """At the start of a task that has no use for what others remember: forget it, so that the memory of
    stages does not add up in a worker."""
    if lasting:
        lasting.clear()
        give_back()


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
NAME = re.compile(r"[A-Za-z_]\w*")

__all__ = ["BLANKS", "HashOf", "ascii_lower", "fresh", "give_back", "join_checked", "lasting", "let_go", "per_row", "pieces",
           "small_enough", "stage", "words_of"]

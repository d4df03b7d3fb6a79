"""Index frames from a spool folder as a stream whose offset is a place in a file.

The files of the folder, in the order of their names, are one run of bytes: a receiver appends to the
last file and begins a new one when it likes, also inside a frame.  An offset names a file and a byte in
it, always at a border of frames, so a frame that was cut off is read when its rest has arrived,
wherever that is, and a restarted query goes on where it stopped.  Files before the offset may be
removed; nothing else may change.  The folder must be one that driver and executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.frames import FRAME_BYTES, IDS_PER_FRAME

SCHEMA = "sender_ns bigint, ids array<int>, file string, byte bigint"
FRAME = np.dtype([("sender_ns", ">u8"), ("ids", ">i4", IDS_PER_FRAME)])
FRAMES = 1 << 16    # frames of a partition


class Pieces(InputPartition):
    """Pieces (file, first byte, end) that make up whole frames."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def sizes(folder: str) -> list[tuple[str, int]]:
    """Name and size of the files, in order; names that begin with a dot or an underscore are not there yet."""
    return sorted((f.name, f.stat().st_size) for f in os.scandir(folder) if f.is_file() and f.name[0] not in "._")


def ahead(files: list[tuple[str, int]], file: str, byte: int) -> list[tuple[str, int, int]]:
    """What lies behind an offset, as pieces."""
    return [(n, byte if n == file else 0, s) for n, s in files if n > file or (n == file and s > byte)]


def cut(pieces: list[tuple[str, int, int]], n: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The first ``n`` bytes, and the rest."""
    head, rest = [], list(pieces)
    while n and rest:
        name, a, z = rest.pop(0)
        end = min(z, a + n)
        head.append((name, a, end))
        n -= end - a
        if end < z:
            rest.insert(0, (name, end, z))
    return head, rest


class SpoolReader(DataSourceStreamReader):
    def __init__(self, folder: str, frames: int):
        self.folder, self.frames = folder, frames

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        """The last border of frames; counted from the first file that is there, which begins at one."""
        pieces = ahead(sizes(self.folder), *self._known())
        whole = sum(z - a for _, a, z in pieces) // FRAME_BYTES * FRAME_BYTES
        if whole:
            name, _, end = cut(pieces, whole)[0][-1]
            self._at = (name, end)
        file, byte = self._known()
        return {"file": file, "byte": byte}

    def _known(self) -> tuple[str, int]:
        return getattr(self, "_at", ("", 0))

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        self._at = (end["file"], end["byte"])           # also after a restart
        files = [(n, end["byte"] if n == end["file"] else s) for n, s in sizes(self.folder) if n <= end["file"]]
        rest, out = ahead(files, start["file"], start["byte"]), []
        while rest:
            head, rest = cut(rest, self.frames * FRAME_BYTES)
            out.append(Pieces(head))
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        data, place = [], []
        for name, a, z in partition.pieces:
            with open(os.path.join(self.folder, name), "rb") as f:
                f.seek(a)
                data.append(f.read(z - a))
            place.append((name, a, z))
        whole = b"".join(data)
        if len(whole) % FRAME_BYTES:
            raise OSError(f"a file of {self.folder} has become shorter")
        frames = np.frombuffer(whole, FRAME)
        starts = np.cumsum([0] + [z - a for _, a, z in place])
        at = np.arange(len(frames)) * FRAME_BYTES
        of = np.searchsorted(starts, at, "right") - 1
        yield pa.RecordBatch.from_arrays([
            pa.array(frames["sender_ns"].astype(np.uint64).view(np.int64)),
            pa.FixedSizeListArray.from_arrays(pa.array(frames["ids"].astype(np.int32).ravel()), IDS_PER_FRAME).cast(pa.list_(pa.int32())),
            pa.array([place[i][0] for i in of]), pa.array([int(place[i][1] + b - starts[i]) for i, b in zip(of, at)], pa.int64())],
            names=["sender_ns", "ids", "file", "byte"])

    def commit(self, end: dict) -> None:
        pass


class SpoolSource(DataSource):
    """Options: ``path``, the folder, and ``frames``, the most of a partition."""

    @classmethod
    def name(cls) -> str:
        return "spooled_frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"], int(self.options.get("frames", FRAMES)))


def spooled_frames(spark: SparkSession, folder: str, frames: int = FRAMES) -> DataFrame:
    """A stream of (sender_ns, ids, file, byte): whole frames and where each begins."""
    spark.dataSource.register(SpoolSource)
    return spark.readStream.format("spooled_frames").option("path", folder).option("frames", frames).load()

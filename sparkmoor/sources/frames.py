"""Index frames: an unsigned 64-bit send time in ns and 64 signed 32-bit ids, big-endian.

A receiver lands the frames as files in a shared folder; a file stream reads them back, which
can be replayed after a failure.  Decoding is done by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDS_PER_FRAME = 64  # fixed layout
TIME_BYTES, ID_BYTES = 8, 4
FRAME_BYTES = TIME_BYTES + IDS_PER_FRAME * ID_BYTES

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _unsigned(data: Column, start: Column | int, size: int) -> Column:
    piece = F.substr(data, F.lit(start) if isinstance(start, int) else start, F.lit(size))
    return F.conv(F.hex(piece), 16, 10).cast("decimal(20,0)")


def decode_frames(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per complete frame: (frame_no, sender_ns, ids).  What a cut-off frame leaves at the end of a
    file is reported by ``cut_off``."""
    whole = F.floor(F.length(content) / FRAME_BYTES).cast("int")
    numbers = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    frames = files.select("*", F.explode(numbers).alias("frame_no")).withColumn(
        "_frame", F.substr(F.col(content), F.col("frame_no") * FRAME_BYTES + 1, F.lit(FRAME_BYTES)))
    half = 2**31

    def signed(i: Column) -> Column:
        n = _unsigned(F.col("_frame"), i * ID_BYTES + TIME_BYTES + 1, ID_BYTES).cast("bigint")
        return F.when(n >= half, n - 2 * half).otherwise(n).cast("int")

    ids = F.transform(F.sequence(F.lit(0), F.lit(IDS_PER_FRAME - 1)), signed)
    return frames.select(*[c for c in files.columns if c != content], "frame_no",
                         _unsigned(F.col("_frame"), 1, TIME_BYTES).cast("bigint").alias("sender_ns"), ids.alias("ids"))


def cut_off(files: DataFrame, content: str = "content") -> DataFrame:
    """Files that end inside a frame, with the bytes behind their last complete one (``rest``): put in
    front of the file that continues them, they are decoded with it."""
    whole = (F.floor(F.length(content) / FRAME_BYTES) * FRAME_BYTES).cast("int")
    rest = F.substr(F.col(content), whole + 1, F.length(content) - whole)
    return files.where(F.length(content) % FRAME_BYTES != 0).select(*[c for c in files.columns if c != content], rest.alias("rest"))


def encode_frames(df: DataFrame) -> DataFrame:
    """(sender_ns, ids) rows with their frame as a binary column."""
    digits = F.lpad(F.hex("sender_ns"), 16, "0")
    low = F.transform("ids", lambda i: F.lpad(F.hex(F.pmod(i.cast("bigint"), F.lit(2**32))), 8, "0"))
    return df.withColumn("frame", F.unhex(F.concat(digits, F.array_join(low, ""))))


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Frames of the files that arrive in ``path``, with their latency on arrival."""
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("maxFilesPerTrigger", files_per_trigger).load(path))
    received = (F.unix_micros("modificationTime") * 1000).alias("received_ns")
    frames = decode_frames(files).select("path", "frame_no", "sender_ns", "ids", received)
    return frames.withColumn("latency_ns", F.col("received_ns") - F.col("sender_ns"))

"""Web archives whose repeated payloads are resolved to revisit records.

Captures are written as WARC records by Spark's text writer, one file per task and at most
``FILE_RECORDS`` records a file.  Resolving works on headers alone: they are shuffled by payload
digest, the largest page id of a digest becomes the response, and the other captures of that
digest become revisit records that refer to it.  A reader parses the archives again and joins
each revisit record to its response.

Defined cases: a null payload is an empty one; payloads below ``MIN_BYTES`` are never revisited;
rows that repeat the largest page id of a digest are all responses; a digest whose page ids are
all null has responses only; a null URL leaves its header out; line ends inside a URL are
escaped; an empty table gives an empty archive and an empty result.  Other columns are never
looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_dir
from .common import join_checked, stage

MIN_BYTES = 1000
FILE_RECORDS = 5000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_FIELDS = ("page_id long, url string, record_id string, record_type string, payload_digest string, "
                 "payload_bytes long, refers_to_id string")


def headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes) of every capture."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        body.alias("payload"), F.sha1(F.encode(body, "UTF-8")).alias("payload_digest"),
                        F.octet_length(body).cast("long").alias("payload_bytes"))


def originals(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, original): the response of each digest that occurs more than once.  The
    maximum is taken before and after the shuffle, so a digest of very many captures is no burden."""
    return heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest") \
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")) \
        .where((F.col("n") > 1) & F.col("original").isNotNull()).drop("n")


def record_id(page_id: Column, digest: Column) -> Column:
    """A name for the record, made from what it holds, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def record(revisit: Column) -> Column:
    """Text of a whole record but for its last line end, which the writer adds."""
    crlf = "\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(crlf))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(crlf * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("original"), F.col("payload_digest"))),
                                 F.lit(f"WARC-Profile: {PROFILE}{crlf}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(crlf), block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, **columns: str) -> None:
    """Write deduplicated archives (gzip) of ``pages`` into the folder ``path``."""
    heads = headers(pages, **columns)
    first = stage(originals(heads, min_bytes))
    resolved = join_checked(heads, first, ["payload_digest"], "left", row_bytes=96)
    revisit = F.col("original").isNotNull() & (F.coalesce(F.col("page_id"), F.lit(-1)) != F.col("original"))
    resolved.select(record(revisit).alias("value")).write.option("lineSep", "\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r]*)\r\n")


class _Source:
    """A gzip file as a stream of bytes, inflated as far as is asked for."""

    def __init__(self, content: bytes):
        self.left, self.inflate, self.have = memoryview(content), zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while len(self.left):
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.left[:1 << 16])
            used = min(len(self.left), 1 << 16) - len(self.inflate.unused_data)
            self.left = self.left[used:]
            if got:
                self.have += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark))
            if not self.more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one gzip archive."""
    source = _Source(content)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not end where it says")
        yield fields, block


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its payload measured and hashed anew where the record holds one."""
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse(content.as_py()):
                    kind, body = f["warc-type"], block.partition(b"\r\n\r\n")[2]
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    rows.append((int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-target-uri"),
                                 f["warc-record-id"], kind, digest, len(body) if kind == "response" else None,
                                 f.get("warc-refers-to")))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, HEADER_FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in HEADER_FIELDS.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives with each revisit joined to its response: (page_id, url, record_type,
    payload_digest, payload_bytes, refers_to)."""
    records = stage(read_headers(spark, path))
    answered = stage(records.where("record_type = 'revisit'").select("payload_digest", "refers_to_id").distinct())
    # one row per response that is referred to, the sums being taken before the shuffle
    targets = stage(
        join_checked(records.where("record_type = 'response'"),
                     answered.withColumnRenamed("refers_to_id", "record_id"), ["payload_digest", "record_id"],
                     "left_semi", row_bytes=160)
        .groupBy("payload_digest", F.col("record_id").alias("refers_to_id"))
        .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("original_bytes")))
    return join_checked(records, targets, ["payload_digest", "refers_to_id"], "left", row_bytes=160).select(
        "page_id", "url", "record_type", "payload_digest",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "refers_to")


def deduplicated(pages: DataFrame, min_bytes: int = MIN_BYTES, **columns: str) -> DataFrame:
    """Write archives into the shared folder of the cluster and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes, **columns)
    return resolve(spark, path)

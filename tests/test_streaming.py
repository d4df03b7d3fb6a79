"""Streams replayed from files give the batch answers."""

import struct

from pyspark.sql import functions as F

from sparkmoor.operators import bm25, rag
from sparkmoor.plans import decoding_queries
from sparkmoor.plans.decoding_queries import LENGTH, PAST
from sparkmoor.sources import frames
from sparkmoor.sources.tables import table
from sparkmoor.streaming import growing, retrieval


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_growing_keys(spark, root, tmp_path):
    e = decoding_queries.sequences(spark, root).select(
        "seq_id", "at", F.col("q").cast("array<double>").alias("q"), F.col("k").cast("array<double>").alias("k"))
    # three files, so that the state has to carry keys from one micro-batch to the next
    for i, (a, z) in enumerate([(0, 40), (40, 85), (85, LENGTH)]):
        e.where((F.col("at") >= a) & (F.col("at") < z)).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    flat = f"{tmp_path}/flat"
    for i in range(3):
        spark.read.parquet(f"{tmp_path}/in/part={i}").coalesce(1).write.mode("append").parquet(flat)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    got = drain(growing.growing_scores(stream, PAST), "grown")
    assert rows(got.select("seq_id", "round", "pos", "score")) == rows(decoding_queries.growing_scores(spark, root))


def test_running_doc_freq(spark, root, tmp_path):
    docs = table(spark, root, "documents").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    got = drain(retrieval.running_doc_freq(stream), "frequencies", "complete")
    assert rows(got) == rows(bm25.doc_freq(bm25.postings_of(docs)))


def test_sentence_retrieval(spark, root, tmp_path):
    docs = table(spark, root, "documents").select("doc_id", "text")
    said = table(spark, root, "conversations").where("turn = 0").select("conv_id", "turn", "text")
    said.repartition(2).write.parquet(f"{tmp_path}/said")
    index = bm25.build_index(docs)
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/said")
    retrieval.sentence_retrieval(stream, ["conv_id", "turn"], index, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(300)
    by = ["conv_id", "turn", "sentence_no"]
    terms = bm25.query_terms(rag.split_sentences(said, by[:2]), "sentence", by)
    want = bm25.rank_documents(bm25.score_documents(index, terms, bm25.CPU, by), 3, by)
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert rows(got) == rows(want)


def test_frames(spark, tmp_path):
    def frame(ns, ids):
        return struct.pack(">Q64i", ns, *ids)

    one, two = list(range(64)), [-i * 70000 for i in range(64)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(frame(1_700_000_000_000_000_000, one) + frame(5, two) + b"cut")
    (tmp_path / "in" / "b.bin").write_bytes(b"short")
    got = drain(frames.frame_stream(spark, str(tmp_path / "in")), "frames").orderBy("frame_no").collect()
    assert [(r.frame_no, r.sender_ns, r.ids) for r in got] == [(0, 1_700_000_000_000_000_000, one), (1, 5, two)]
    assert all(r.latency_ns == r.received_ns - r.sender_ns for r in got)
    back = frames.encode_frames(spark.createDataFrame([(5, two)], "sender_ns bigint, ids array<int>")).first()
    assert bytes(back.frame) == frame(5, two)


def test_cut_off_frames(spark):
    import struct

    whole = struct.pack(">Q64i", 7, *range(64))
    first, second = whole + whole[:100], whole[100:]
    files = spark.createDataFrame([("a", bytearray(first)), ("b", bytearray(whole))], "path string, content binary")
    assert frames.decode_frames(files).count() == 2
    rest = frames.cut_off(files).collect()
    assert [(r.path, bytes(r.rest)) for r in rest] == [("a", whole[:100])]
    joined = spark.createDataFrame([("b", bytearray(bytes(rest[0].rest) + second))], "path string, content binary")
    assert [r.sender_ns for r in frames.decode_frames(joined).collect()] == [7]


def test_frames_across_files_and_restarts(spark, tmp_path):
    """Frames that are cut at the end of a file go on in the next one, and arrive once."""
    import struct

    from sparkmoor.streaming import spool

    def frame(i):
        return struct.pack(">Q64i", i, *range(-i, 64 - i))

    folder, out, state = tmp_path / "spool", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        q = spool.spooled_frames(spark, str(folder), 3).writeStream.format("parquet").option("checkpointLocation", state) \
            .trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted((r.sender_ns, tuple(r.ids), r.file, r.byte) for r in spark.read.schema(spool.SCHEMA).parquet(out).collect())

    whole = b"".join(map(frame, range(10)))
    size = len(frame(0))
    want = [(i, tuple(range(-i, 64 - i))) for i in range(10)]
    (folder / "_part").write_bytes(b"not there yet")
    (folder / "a").write_bytes(whole[:2 * size + 100])          # the third frame is cut off
    assert [r[:2] for r in run()] == want[:2]
    assert [r[:2] for r in run()] == want[:2]                   # nothing new
    (folder / "b").write_bytes(whole[2 * size + 100:2 * size + 150])    # still cut off
    assert [r[:2] for r in run()] == want[:2]
    (folder / "c").write_bytes(whole[2 * size + 150:5 * size])
    assert [r[:2] for r in run()] == want[:5]
    with open(folder / "c", "ab") as f:                         # the last file grows
        f.write(whole[5 * size:7 * size + 1])
    (folder / "d").write_bytes(b"")
    (folder / "a").unlink()
    (folder / "e").write_bytes(whole[7 * size + 1:])
    got = run()
    assert [r[:2] for r in got] == want and got[2][2:] == ("a", 2 * size) and got[7][2:] == ("c", 7 * size - (2 * size + 150))

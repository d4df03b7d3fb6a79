"""Kept indexes: versions, crashes, segments, and ranking by blocks."""

import random

import pytest
from pyspark.sql import functions as F

from sparkmoor.operators import bm25, ranking
from sparkmoor.sources import bundle

WORDS = [f"w{i}" for i in range(30)]


def documents(spark, ids, words=WORDS):
    data = [(i, " ".join(random.Random(i).choices(words, k=1 + i % 7))) for i in ids]
    return spark.createDataFrame(data, "doc_id bigint, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_bundle_is_its_documents(spark, tmp_path):
    path = str(tmp_path / "bundle")
    assert bundle.open_bundle(spark, path) is None
    bundle.create(documents(spark, range(40)), path)
    with pytest.raises(FileExistsError):
        bundle.create(documents(spark, range(40)), path)
    bundle.append(bundle.open_bundle(spark, path), documents(spark, range(40, 55)))
    for version, n in ((1, 40), (2, 55), (None, 55)):
        held, want = bundle.open_bundle(spark, path, version), bm25.build_index(documents(spark, range(n)))
        assert (held.index.n_docs, held.index.mean_len) == (want.n_docs, want.mean_len)
        assert rows(held.index.postings) == rows(want.postings)
        assert rows(held.doc_freq().select("token", "df")) == rows(bm25.doc_freq(want.postings))
        assert rows(held.texts) == rows(documents(spark, range(n)))


def test_adding_writes_only_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundle, "FIRST_TIER", 10)
    held = bundle.create(documents(spark, range(8)), str(tmp_path / "b"))
    for i in range(1, 10):
        before = {s.name for s in held.segments}
        held = bundle.append(held, documents(spark, range(8 * i, 8 * i + 8)))
        new = [s for s in held.segments if s.name not in before]
        assert len(new) == 1 and new[0].docs in (8, 32)      # the part alone, or it and three of its size
        assert len(held.segments) <= 1 + 3 + 3
    assert sorted(s.docs for s in held.segments) == [8, 8, 32, 32]
    assert rows(held.index.postings) == rows(bm25.build_index(documents(spark, range(80))).postings)


@pytest.mark.parametrize("dies_at", ["texts", "postings", "frequencies", "version"])
def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "b")
    first = bundle.create(documents(spark, range(10)), path)
    if dies_at == "version":
        monkeypatch.setattr(bundle, "_write_version", lambda *a: (_ for _ in ()).throw(OSError))
    elif dies_at == "frequencies":
        monkeypatch.setattr(bundle, "doc_freq", lambda p: (_ for _ in ()).throw(OSError))
    elif dies_at == "postings":
        monkeypatch.setattr(bundle, "postings_of", lambda *a, **k: (_ for _ in ()).throw(OSError))
    bad = documents(spark, range(10, 12))
    if dies_at == "texts":
        bad = bad.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        bundle.append(first, bad)
    monkeypatch.undo()
    again = bundle.open_bundle(spark, path)
    assert again.version == 1 and rows(again.texts) == rows(documents(spark, range(10)))
    assert bundle.append(again, documents(spark, range(10, 12))).index.n_docs == 12


def test_two_writers_of_a_version(spark, tmp_path):
    held = bundle.create(documents(spark, range(5)), str(tmp_path / "b"))
    bundle.append(held, documents(spark, range(5, 7)))
    with pytest.raises(Exception):
        bundle.append(held, documents(spark, range(7, 9)))     # it has not seen version 2
    assert bundle.open_bundle(spark, held.path).index.n_docs == 7


def test_the_tokenizer_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundle, "_tokenizers", {"words": None})
    letters = lambda texts: [list(t.replace(" ", "")) for t in texts]
    bundle.register_tokenizer("letters", letters)
    docs = spark.createDataFrame([(1, "ab b"), (2, "c")], "doc_id bigint, text string")
    held = bundle.create(docs, str(tmp_path / "b"), "letters")
    held = bundle.append(held, spark.createDataFrame([(3, "ba")], "doc_id bigint, text string"))
    assert rows(held.doc_freq()) == [("a", 2), ("b", 2), ("c", 1)]
    grown = bm25.add_documents(held.index, spark.createDataFrame([(4, "cab")], "doc_id bigint, text string"))
    assert rows(bm25.doc_freq(grown.postings)) == [("a", 3), ("b", 3), ("c", 2)] and grown.n_docs == 4
    monkeypatch.setattr(bundle, "_tokenizers", {"words": None})
    with pytest.raises(LookupError):
        bundle.open_bundle(spark, held.path).index


def test_blocks_are_skipped(spark):
    """Rare words in one block, frequent ones everywhere: most blocks are never scored."""
    rng = random.Random(4)
    data = [(i, " ".join(rng.choices(["the", "of", "and", "to"], k=20) + [f"x{i // 20}"] + ([f"rare{i}"] if i % 50 == 0 else [])))
            for i in range(2000)]
    index = bm25.build_index(spark.createDataFrame(data, "doc_id bigint, text string"))
    asked = spark.createDataFrame([(q, f"the of x{q} rare{q * 50}") for q in range(30)] + [(99, None), (98, "nowhere")],
                                  "query_id bigint, text string")
    terms = bm25.query_terms(asked)
    blocks = ranking.block_postings(index, bm25.CPU, docs=32)
    plan = ranking.plan_blocks(blocks, terms, ["query_id"])
    seeded = ranking.score_blocks(blocks, plan, plan.seeds, 5)
    left = ranking.remaining(plan, ranking.bars(seeded, plan, 5)).count()
    possible = plan.bounds.count()
    assert possible > 1500 and left + plan.seeds.count() < possible / 10
    want = rows(bm25.rank_documents(bm25.score_documents(index, terms, bm25.CPU), 5, ["query_id"]).select("query_id", "doc_id", "score", "rank"))
    assert rows(ranking.top_documents(blocks, terms, bm25.CPU, 5)) == want
    # bounds hold: no document scores above its block's
    scores = bm25.score_documents(index, terms, bm25.CPU).select(
        F.struct("query_id").alias("q"), F.floor(F.col("doc_id") / 32).alias("block"), "score")
    assert scores.join(plan.bounds, ["q", "block"]).where("score > bound").count() == 0
    assert scores.join(plan.bounds, ["q", "block"], "left_anti").count() == 0

"""What must not grow: pieces of blocks, what is shuffled and what a task holds."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkmoor.llm import toxicity
from sparkmoor.operators import bm25, ngram, ranking
from sparkmoor.plans import text_queries


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lookup_of_what_rows_become(spark):
    """A table whose rows are summed first is held where the sums fit, and no position is joined."""
    table = spark.createDataFrame([(i, [float(i), 0.5, -2.0]) for i in range(9)], "row_id bigint, vec array<float>")
    asked = spark.createDataFrame([(i, [i % 9, 20, 8]) for i in range(30)], "pos bigint, rows array<bigint>")
    whole = {p: [sum(f[:3]), sum(f[3:6]), sum(f[6:])] for p, f in rows(ngram.lookup(asked, ["pos"], table, 3))}
    for limit, moves in ((9, False), (8, True)):
        got = ngram.lookup(asked, ["pos"], table, 1, limit, each=lambda x: x.sum(axis=1, dtype=np.float64, keepdims=True))
        assert dict(rows(got)) == whole
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == moves


def test_hashes_leave_in_pieces(monkeypatch):
    taken = []
    monkeypatch.setattr(ngram, "map_blocks", lambda df, fn, schema: taken.append(fn))

    class Frame:
        dtypes = [("seq", "int"), ("ids", "array<bigint>")]

        def select(self, *columns):
            return self

    monkeypatch.setattr(ngram.F, "col", lambda c: Frame.column)
    Frame.column = type("Column", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})()
    sizes, factors = [[7, 11], [13, 17]], ngram.multipliers(3)
    ngram.ngram_hash(Frame(), ["seq"], factors, sizes, 2)
    seqs = [[i % 1000 for i in range(50_000)], None, [], [5, 3], [9]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array(seqs, pa.list_(pa.int64()))], names=["seq", "ids"])
    found = taken[0](batch)
    pieces = [found] if isinstance(found, dict) else list(found)
    assert max(len(p["pos"]) for p in pieces) <= 16_384 and sum(len(p["pos"]) for p in pieces) == 50_003
    at = {(s, p): h for piece in pieces for s, p, h in zip(piece["seq"].to_pylist(), piece["pos"], piece["heads"].to_pylist())}
    for s, p in ((0, 0), (0, 16_384), (0, 16_385), (0, 49_999), (3, 0), (3, 1), (4, 0)):
        ids = [seqs[s][p - k] if p >= k else 2 for k in range(3)]
        two = ids[0] * factors[0] ^ ids[1] * factors[1]
        three = two ^ ids[2] * factors[2]
        assert at[s, p] == [two % 7, two % 11, three % 13, three % 17]


def test_ranking_moves_documents_once(spark, monkeypatch):
    """What is shuffled and written for many queries does not grow with pairs of queries and blocks of documents."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    data = [(i, " ".join(r.choices(common, k=15) + [f"x{r.randrange(300)}"])) for i in range(700)]
    index = bm25.build_index(spark.createDataFrame(data, "doc_id bigint, text string"))
    asked = spark.createDataFrame([(q, " ".join(r.sample(common, 4) + [f"x{q}", "nowhere"])) for q in range(250)], "query_id bigint, text string")
    terms = bm25.query_terms(asked)
    want = rows(bm25.rank_documents(bm25.score_documents(index, terms, bm25.CPU), 3, ["query_id"]).select("query_id", "doc_id", "score", "rank"))
    written = []
    counted, staged = ranking.stage_counted, ranking.stage
    monkeypatch.setattr(ranking, "stage_counted", lambda df: written.append(counted(df)) or written[-1])
    monkeypatch.setattr(ranking, "stage", lambda df: written.append(staged(df)) or written[-1])
    monkeypatch.setattr(ranking, "DRIVER_ROWS", 4096, raising=False)
    assert rows(ranking.top_documents(index, terms, bm25.CPU, 3)) == want
    assert max(getattr(w, "df", w).count() for w in written) <= 700
    monkeypatch.setattr(ranking, "DRIVER_ROWS", 0)
    monkeypatch.setattr(ranking, "TILE_DOCS", 200)
    monkeypatch.setattr(ranking, "CELLS", 1000)
    for formula in (bm25.CPU, bm25.PACKED):
        want = rows(bm25.rank_documents(bm25.score_documents(index, terms, formula), 3, ["query_id"]).select("query_id", "doc_id", "score", "rank"))
        assert rows(ranking.top_documents(index, terms, formula, 3)) == want


def test_rounds_of_tiles_spare_documents(spark, monkeypatch):
    """Many queries: later tiles give only what reaches the bars of earlier ones, and the best are the same."""
    r = random.Random(11)
    data = [(i, " ".join(r.choices([f"c{i}" for i in range(20)], k=12) + [f"x{r.randrange(60)}" for _ in range(r.randrange(4))])) for i in range(900)]
    index = bm25.build_index(spark.createDataFrame(data, "doc_id bigint, text string"))
    words = [" ".join([f"c{r.randrange(20)}", f"x{r.randrange(60)}", f"x{r.randrange(70)}"][: 1 + q % 3]) for q in range(300)] + ["", "nowhere"]
    asked = spark.createDataFrame([(q if q else None, w) for q, w in enumerate(words)], "query_id bigint, text string")
    terms = bm25.query_terms(asked)
    monkeypatch.setattr(ranking, "DRIVER_ROWS", 0)
    for name, value in (("TILE_DOCS", 40), ("SEED_DOCS", 100), ("CELLS", 4000), ("PACK", 50), ("SLOTS", 4)):
        monkeypatch.setattr(ranking, name, value, raising=False)
    sent, top_k = [], ranking.top_k
    monkeypatch.setattr(ranking, "top_k", lambda scores, *a, **b: sent.append(scores.count()) or top_k(scores, *a, **b))
    for formula in (bm25.CPU, bm25.PACKED):
        sent.clear()
        want = bm25.rank_documents(bm25.score_documents(index, terms, formula), 3, ["query_id"]).select("query_id", "doc_id", "score", "rank")
        assert rows(ranking.top_documents(index, terms, formula, 3).fillna(-1, "query_id")) == rows(want.fillna(-1, "query_id"))
        assert formula.idf_plus_one is False or sum(sent) < 300 * 3 * 10    # 24 tiles


def test_bars_rise_inside_a_tile(monkeypatch):
    """Without a bar, most documents of a tile are never scored in full, and the best of every query are found."""
    r = random.Random(5)
    words = [f"c{i}" for i in range(40)]
    texts = [Counter(r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randrange(5, 60)) + [f"x{r.randrange(400)}"]) for _ in range(3000)]
    texts[7:40] = [texts[7]] * 33                           # copies, of which those with the lowest ids count
    docs = pa.RecordBatch.from_pylist([{"doc_id": 9000 - i, "dl": sum(t.values()), "tokens": [*t], "tfs": [*t.values()]} for i, t in enumerate(texts)],
                                      pa.schema([("doc_id", pa.int64()), ("dl", pa.int32()), ("tokens", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))]))
    mean = sum(sum(t.values()) for t in texts) / len(texts)
    tile = ranking.make_tile([docs], bm25.CPU, mean, 32_000_000)
    asked = [[*dict.fromkeys(r.choices(words, k=1 + q % 9) + [f"x{r.randrange(500)}"] * (q % 2))] for q in range(200)] + [[*texts[7]]]
    code = {t: i for i, t in enumerate(tile.tokens.to_pylist())}
    df = Counter(w for t in texts for w in t)
    flat = [(q, code[w], float(np.log(1 + (3000 - df[w] + 0.5) / (df[w] + 0.5)))) for q, ws in enumerate(asked) for w in ws if w in code]
    q, codes, idf = (np.array(x) for x in zip(*flat))
    scored, scores_of = [], ranking._scores_of
    monkeypatch.setattr(ranking, "_scores_of", lambda *a: scored.append(len(a[-1])) or scores_of(*a), raising=False)
    weight = [{w: bm25.CPU.weights(np.array([n]), np.array([sum(t.values())]), mean)[0] for w, n in t.items()} for t in texts]
    for k in (1, 3):
        want = []
        for i in range(len(asked)):
            mine = [(c, v) for j, c, v in flat if j == i]
            found = [(-round(sum(v * w[tile.tokens[c].as_py()] for c, v in mine if tile.tokens[c].as_py() in w), 6), 9000 - d) for d, w in enumerate(weight)]
            want += [(i, d, -s) for s, d in sorted(found)[:k] if s < 0]
        got = sorted((int(a), int(d), float(s)) for a, d, s in zip(*ranking.above_bars(tile, q, codes, idf, np.zeros(len(asked)), k)))
        assert [g[:2] for g in got] == sorted(w[:2] for w in want)
        assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=2e-6)
    assert 0 < sum(scored) < 2 * len(asked) * 300           # of 3,000


def test_kept_frequencies_are_not_counted_again(spark, root, monkeypatch):
    """Many sentences are weighed with the frequencies of the index."""
    index = text_queries.text_index(spark, root)
    terms = spark.createDataFrame([(1, "the"), (2, "of"), (2, "nowhere")], "query_id bigint, token string")
    want = rows(bm25.weighted_terms(index._replace(frequencies=None), terms, bm25.CPU).df.select("query_id", "token", "idf"))
    monkeypatch.setattr(bm25, "doc_freq", lambda *a: pytest.fail("postings are counted again"))
    assert rows(bm25.weighted_terms(index, terms, bm25.CPU).df.select("query_id", "token", "idf")) == want != []


def test_whole_documents_are_not_shuffled(spark, monkeypatch):
    """Only documents that a batch of postings cuts are put together by a shuffle."""
    data = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 40))) for i in range(600)]
    index = bm25.build_index(spark.createDataFrame(data, "doc_id bigint, text string"))
    plans, stage = [], ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df: plans.append((df._jdf.queryExecution().executedPlan().toString(), stage(df))) or plans[-1][1])
    found = ranking.block_postings(index, bm25.CPU).rows
    assert sum(df.count() for plan, df in plans if "Exchange" in plan) < 100
    want = {d: sorted(Counter(t.split()).items()) for d, t in data}
    assert {r["doc_id"]: sorted(zip(r["tokens"], r["tfs"])) for r in found.collect()} == want


def test_pairs_are_counted_in_small_pieces(monkeypatch):
    taken, sizes = [], []

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)
            raise LookupError

    with pytest.raises(LookupError):
        toxicity.pair_counts(Frame())
    pairs = toxicity._pairs
    monkeypatch.setattr(toxicity, "_pairs", lambda texts, held: sizes.append(texts.nbytes) or pairs(texts, held))
    batch = pa.RecordBatch.from_arrays([pa.array(["a bc " * 100_000] * 20), pa.array([0, 1] * 10)], names=["text", "label"])
    found = [row for part in taken[0](iter([batch])) for row in part.to_pylist()]
    assert max(sizes) <= 5 << 20
    assert sum(row["n"] & 0xFFFFFFFF for row in found) == sum(row["n"] >> 32 for row in found) == 10 * 200_000


def test_vocabulary_does_not_count_again(spark, root, monkeypatch):
    """The frequencies that an index keeps are numbered; its postings are not read for that."""
    counted = dict(rows(bm25.doc_freq(text_queries.text_index(spark, root).postings)))
    monkeypatch.setattr(text_queries, "_held", {})
    monkeypatch.setattr(bm25, "doc_freq", lambda *a: pytest.fail("postings are counted again"))
    got = rows(text_queries.vocabulary(spark, root).df.select("vocab_idx", "token", "df"))
    assert got == [(i, t, counted[t]) for i, t in enumerate(sorted(counted, key=str.encode))]

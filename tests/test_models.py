"""Operators against plain Python models on small inputs, also on their large-input paths."""

import json
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmoor.functions import ordering, quant, staging, vectors
from sparkmoor.functions import text as tx
from sparkmoor.functions.staging import Staged, stage_counted
from sparkmoor.operators import bm25, decoding, experts, memory, ngram, rag, ranking, score, sizes, sparse, utility
from sparkmoor.plans import steps
from sparkmoor.sources import configs, corpus


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)


# ---- joins and orders ---------------------------------------------------------------


def test_joins_beyond_broadcast(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 4)
    big = spark.range(200).select(F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k int, v string")
    want = rows(big.join(small, "k").select("k", "id", "v"))
    held = stage_counted(small)
    assert not held.broadcastable
    assert rows(staging.keyed_join(big, held, ["k"]).select("k", "id", "v")) == want
    twice = stage_counted(small.union(small.withColumn("v", F.lit("again"))))
    got = staging.salted_join(big, twice, ["k"], "id").select("k", "id", "v")
    assert rows(got) == rows(big.join(twice.df, "k").select("k", "id", "v"))


def test_global_order(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("t"), "id").repartition(5)
    for parts in (1, 3, 8):
        got = {r.t: r.idx for r in ordering.global_index(df, ["t"], "idx", parts).collect()}
        assert got == {t: i for i, t in enumerate(sorted(got))}
        sums = {r.t: (r.id, r.s) for r in ordering.running_total(df, ["t"], F.col("id") + 1, "s", parts).collect()}
        acc = 0
        for t in sorted(sums):
            assert sums[t][1] == acc
            acc += sums[t][0] + 1


# ---- BM25 ---------------------------------------------------------------------------


WORDS = [f"w{i}" for i in range(30)]


def texts(n=70, seed=5):
    r = random.Random(seed)
    out = [" ".join(r.choices(WORDS, weights=[40] + [2] * 29, k=r.randint(1, 40))) for _ in range(n)]
    out[3], out[4] = "", "..."
    out[5] = " ".join(["w1"] * 300)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def index(docs):
    return bm25.build_index(docs)


def model_scores(query, formula):
    split = [t.split() if t != "..." else [] for t in texts()]
    n = math.ceil(len(split) / formula.pad_docs) * formula.pad_docs
    mean = sum(map(len, split)) / len(split)
    scores = {}
    for d, words in enumerate(split):
        for t in set(query) & set(words):
            df = sum(t in w for w in split)
            odds = (n - df + 0.5) / (df + 0.5)
            tf = min(words.count(t), formula.tf_limit or 10**9)
            norm = 1 - formula.b + formula.b * len(words) / mean if formula.b else 1
            w = tf * (formula.k1 + 1 if formula.numerator else 1) / (tf + formula.k1 * norm)
            scores[d] = scores.get(d, 0) + math.log(odds + (1 if formula.idf_plus_one else 0)) * w
    return scores


@pytest.mark.parametrize("formula", [bm25.CPU, bm25.PACKED, bm25.LUCENE])
def test_bm25(spark, index, formula, monkeypatch):
    assert index.n_docs == 70
    asked = spark.createDataFrame([(0, "W1 w2 w2 zzz"), (1, "w0 w9"), (2, "  ")], "query_id bigint, text string")
    terms = bm25.query_terms(asked)
    plain = rows(bm25.score_documents(index, terms, formula).select("query_id", "doc_id", "score"))
    for q, words in ((0, ["w1", "w2"]), (1, ["w0", "w9"])):
        got = {d: s for i, d, s in plain if i == q}
        want = model_scores(words, formula)
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-5 for d in got)
    assert not [1 for i, _, _ in plain if i == 2]
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(staging, "HOT_SHARE", 5)
    salted = bm25.score_documents(index, terms, formula).select("query_id", "doc_id", "score")
    assert rows(salted) == plain
    single = bm25.score_all_documents(index, terms.where("query_id = 0").select("token"), formula)
    assert single.count() == 70


@pytest.mark.parametrize("formula", [bm25.CPU, bm25.PACKED])
def test_top_documents(spark, index, formula, monkeypatch):
    asked = spark.createDataFrame([(q, 7 - q, " ".join(random.Random(q).sample(WORDS, 4))) for q in range(8)] + [(9, 9, "zzz")],
                                  "query_id bigint, part int, text string")
    by = ["query_id", "part"]
    terms = bm25.query_terms(asked, by=by)
    for k in (1, 5, 100):
        want = rows(bm25.rank_documents(bm25.score_documents(index, terms, formula, by), k, by)
                    .select(*by, "doc_id", "score", "rank"))
        assert rows(ranking.top_documents(index, terms, formula, k, by)) == want
        blocks = ranking.block_postings(index, formula, docs=3)
        assert rows(ranking.top_documents(blocks, terms, formula, k, by)) == want
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    assert rows(ranking.top_documents(blocks, terms, formula, 100, by)) == want


def test_vocabulary_split(index, monkeypatch):
    vocab = stage_counted(bm25.vocabulary(index.postings))
    want = rows(bm25.with_vocab(index.postings, vocab).select("doc_id", "token", "vocab_idx"))
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(bm25, "HOT_TOKENS", 20)
    assert rows(bm25.with_vocab(index.postings, vocab).select("doc_id", "token", "vocab_idx")) == want
    ids = {t: i for _, t, i in want}
    assert ids == {t: i for i, t in enumerate(sorted(ids))}


def test_packed_layout(index):
    numbered = bm25.with_vocab(index.postings, stage_counted(bm25.vocabulary(index.postings)))
    got = rows(bm25.pack_documents(numbered))
    want = []
    per_doc = {}
    for r in numbered.collect():
        if r.vocab_idx % 16 == r.doc_id % 16:
            per_doc.setdefault(r.doc_id, []).append((r.vocab_idx, min(r.tf, 255)))
    for d, entries in per_doc.items():
        for row, (i, tf) in enumerate(sorted(entries)):
            want.append((d // 64, d % 64 // 16, d % 16, row, tf << 32 | i))
    assert got == sorted(want)
    n = {r.batch: r.n_rows for r in bm25.packed_rows(bm25.pack_documents(numbered), 70).collect()}
    assert n == {b: max([1] + [len(e) for d, e in per_doc.items() if d // 64 == b]) for b in (0, 1)}


def test_added_documents(spark, index):
    more = bm25.add_documents(index, spark.createDataFrame([(70, "w1 new")], "doc_id bigint, text string"))
    old, new = dict(rows(bm25.doc_freq(index.postings))), dict(rows(bm25.doc_freq(more.postings)))
    assert new["w1"] == old["w1"] + 1 and new["new"] == 1 and more.n_docs == 71
    assert abs(more.mean_len - (index.mean_len * 70 + 2) / 71) < 1e-12


def test_prompts(spark, docs):
    asked = spark.createDataFrame([(0, "w1 w2"), (1, "")], "query_id bigint, text string")
    flow = steps.document_prompts(2)
    got = {r.query_id: r for r in flow.build_and_apply(docs, asked).collect()}
    assert got[0].prompt.startswith("Based on the following context, answer the question.\n\nContext:\n[Document 1] ")
    assert "\n\n[Document 2] " in got[0].prompt and got[0].prompt.endswith("\n\nQuestion: w1 w2\n\nAnswer:")
    assert got[1].prompt.endswith("Context:\n\n\nQuestion: \n\nAnswer:")
    df = spark.createDataFrame([("q", ["a" * 1200, "b"])], "text string, docs array<string>")
    row = rag.with_context(df, "see ").first()
    assert row.context == "see [Document 1] " + "a" * 1000 + "\n\n[Document 2] b"
    chat = rag.with_prompt(df, template=lambda system, user: F.concat(F.lit("<s>"), system, F.lit("</s>"), user)).first()
    assert chat.prompt.startswith("<s>You are a helpful assistant") and "Answer:" not in chat.prompt
    cont = rag.with_continuation(df.withColumn("p", F.lit("P")), "p", "text").first().continued
    assert cont == "Pq\n\n[Additional Context from Retrieval]\n[Doc 1] " + "a" * 500 + "\n[Doc 2] b\n\n[Continue Answer]\n"
    told = rag.generate(df, "text", lambda prompts: [p.upper() for p in prompts]).first()
    assert told.answer == "Q"
    assert rag.generate(df.withColumn("docs", F.array().cast("array<string>")), "text").first().answer == ""


# ---- text ---------------------------------------------------------------------------


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_expressions(spark):
    assert one(spark, tx.tokens, "Ärger, it's 3.5") == ["ärger", "it", "s", "3", "5"]
    assert one(spark, tx.sentences, " One. Two!\nThree?  four") == ["One.", "Two!", "Three?", "four"]
    for name, want in [("PagedKVIndexBuilder", "paged_kv_index_builder"), ("BM25Fpga", "bm25_fpga"), ("topK", "top_k"), ("HTTPServer2", "http_server_2")]:
        got = one(spark, tx.snake_case, name)
        assert got == want, name
    assert list(tx.normal_form(pd.Series(["É  x", " ", "ﬁn", "́", "\t a "]))) == ["e x", " ", "fin", "́", "a"]
    df = spark.createDataFrame([("a b",)], "text string")
    assert tx.tokenize(df, tokenizer=lambda b: [t.split() for t in b]).first().tokens == ["a", "b"]


def test_operator_counts(spark):
    def count(line):
        cols = {**tx.arithmetic_counts(F.col("x")), **tx.math_call_counts(F.col("x"))}
        r = spark.createDataFrame([(line,)], "x string").select(*[c.alias(n) for n, c in cols.items()]).first()
        return {n: r[n] for n in cols if r[n]}

    assert count("y = a + b * c - (d) / e;") == {"add": 1, "mul": 1, "sub": 1, "div": 1}
    assert count("x += 1; p->q; i++; s = \"a + b\";") == {"add": 1}
    assert count("// a + b") == count("\t // a + b") == count("\t// expf(x)") == {}
    assert count("a + 'b + c' * d") == {} and count("a /= b / c") == {"div": 2}
    assert count("z = expf(x) * sqrt(y) - fabs(v);") == {"exp": 1, "sqrt": 1, "other": 1, "mul": 1, "sub": 1}


def test_compressed_vocabulary(spark):
    words = ["b", "É", "e", " ", "B ", "�x", "zz"]
    got = tx.compress_vocabulary(spark.createDataFrame(list(enumerate(words)), "token_id bigint, token string"))
    ids = {r.token: r.new_id for r in got.collect()}
    assert ids == {"b": 0, "É": 1, "e": 1, " ": 2, "B ": 0, "�x": 3, "zz": 4}


def test_corpora(spark):
    df = spark.createDataFrame([("x", "t", "body"), ("y", "", "only"), ("z", None, "")], "_id string, title string, text string")
    assert rows(corpus.titled_corpus(df)) == [("x", "t body"), ("y", "only")]
    g = spark.createDataFrame([(1, None, "c"), (2, "t", "c"), (3, "", None)], "id int, text string, content string")
    assert rows(corpus.generic_corpus(g)) == [(1, "c"), (2, "t"), (3, '{"id":3,"text":""}')]
    assert sorted(one(spark, corpus.parse_ids, "5, 7,x,-1,70000,5,")) == [5, 7]


# ---- growing sequences --------------------------------------------------------------


def sequence(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(-9, 10, size=(n, dim)), rng.integers(-9, 10, size=(n, dim))


def positions(spark, sequences):
    """(seq_id, at, q, k) of sequences given as pairs of matrices."""
    data = [(s, i, q[i].tolist(), k[i].tolist()) for s, (q, k) in sequences.items() for i in range(len(q))]
    return spark.createDataFrame(data, "seq_id bigint, at int, q array<int>, k array<int>").repartition(3)


def model_rounds(q, k, past):
    """Keys visible in each round, by overwriting slots."""
    held = list(k[:past])
    for r in range(len(q) - past):
        slot = past + r // 8
        held[slot:slot + 1] = [k[past + r]]
        yield r, [int(q[past + r] @ key) for key in held]


@pytest.mark.parametrize("tile", [1024, 16])
def test_growing_scores(spark, tile, monkeypatch):
    """One long sequence, short ones that share tiles, and one without a round."""
    monkeypatch.setattr(decoding, "TILE", tile)
    sequences = {0: sequence(48, 6), 7: sequence(420, 6, 1), 9: sequence(29, 6, 2), 11: sequence(28, 6, 3)}
    p, past = positions(spark, sequences), 28
    got, bits, pages, keys = {}, {}, {}, {}
    for r in decoding.growing_scores(p, past).collect():
        got.setdefault((r.seq_id, r["round"]), {})[r.pos] = r.score
    for r in decoding.threshold_bits(p, past, 20).collect():
        bits.setdefault((r.seq_id, r["round"]), {})[r.word] = r.bits
    for r in decoding.best_pages(p, past, 4, 3).collect():
        pages.setdefault((r.seq_id, r["round"]), []).append((r["rank"], r.page_id))
    for r in decoding.budget_keys(p, past, 5).collect():
        keys.setdefault((r.seq_id, r["round"]), []).append((r["rank"], r.pos))
    want = {(s, r): x for s, (q, k) in sequences.items() for r, x in model_rounds(q, k, past)}
    assert got.keys() == bits.keys() == pages.keys() == keys.keys() == want.keys() and len(want) == 20 + 392 + 1
    for at, scores in want.items():
        assert [got[at][i] for i in range(len(scores))] == scores and len(got[at]) == len(scores)
        assert bits[at] == {0: (sum(1 << i for i, s in enumerate(scores[:64]) if s > 20) + 2**63) % 2**64 - 2**63,
                            1: sum(1 << i for i, s in enumerate(scores[64:]) if s > 20)}
        best = [max(scores[i:i + 4]) for i in range(0, len(scores), 4)]
        assert [i for _, i in sorted(pages[at])] == sorted(range(len(best)), key=lambda i: (-best[i], i))[:3]
        assert [i for _, i in sorted(keys[at])] == sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:5]


def test_a_long_sequence_uses_many_tasks(spark):
    n, past = 60_000, 80
    rows = spark.range(n).select(F.lit(3).cast("bigint").alias("seq_id"), F.col("id").cast("int").alias("at"),
                                 F.array(F.col("id") % 7, F.col("id") % 5).cast("array<smallint>").alias("q"),
                                 F.array(F.col("id") % 11, F.col("id") % 3).cast("array<smallint>").alias("k"))
    tiles = decoding.over_tiles(rows, past, lambda t: {"round": t.rounds[:1], "n": np.array([t.seen.sum()])},
                                "seq_id bigint, round int, n bigint")
    found = tiles.withColumn("part", F.spark_partition_id()).collect()
    rounds = np.arange(n - past)
    assert sum(r.n for r in found) == (past + rounds // 8 + 1).sum()
    assert max(r.n for r in found) <= decoding.TILE ** 2 and len(found) > 200 and len({r.part for r in found}) > 1


def test_windows(spark):
    for n, want in ((7, {0: range(7)}), (10, {0: range(10)}), (25, {0: range(10), 1: range(10, 20), 2: range(15, 25)})):
        rows = spark.range(n).withColumnRenamed("id", "pos").withColumn("v", F.col("pos"))
        got = sorted(map(tuple, decoding.windows(rows, 10, n).collect()))
        assert got == [(s, i, v) for s, vs in want.items() for i, v in enumerate(vs)]


# ---- experts ------------------------------------------------------------------------


def test_gates():
    rng = np.random.default_rng(2)
    z, bias = rng.normal(size=(50, 16)), rng.normal(size=16) / 10
    for mode in ("sigmoid", "softmax"):
        chosen, w = experts.grouped_choice(z, bias, 4, 2, 4, mode)
        for t in range(50):
            p = 1 / (1 + np.exp(-z[t])) if mode == "sigmoid" else np.exp(z[t]) / np.exp(z[t]).sum()
            b = p + bias
            keep = sorted(range(4), key=lambda g: -sum(sorted(b[4 * g:4 * g + 4])[-2:]))[:2]
            want = sorted((e for e in range(16) if e // 4 in keep), key=lambda e: -b[e])[:4]
            assert list(chosen[t]) == want
            share = p[want] / (p[want].sum() if mode == "sigmoid" else 1) * 2.5
            assert np.allclose(w[t], share)
    chosen, w = experts.split_choice(z, bias, 2)
    b = 1 / (1 + np.exp(-z)) + bias
    for t in range(50):
        want = sorted(range(8), key=lambda e: -b[t, e])[:2] + sorted(range(8, 16), key=lambda e: -b[t, e])[:2]
        assert list(chosen[t]) == want and np.allclose(w[t], b[t, want] / b[t, want].sum() * 2.5)
    _, none = experts.split_choice(z, np.full(16, -1e3), 2)
    assert (none == 0).all()


def test_feed_forward_paths(spark):
    rng = np.random.default_rng(4)
    n, e, inner, d = 40, 4, 3, 5
    x, w1, w3, w2 = rng.normal(size=(n, d)), *rng.normal(size=(3, e, inner, d))
    chosen = np.argsort(rng.random((n, e)), axis=1)[:, :2]
    chosen[: n // 2, 0], chosen[: n // 2, 1] = 0, 3  # a hot expert
    w = rng.random((n, 2))
    wide = spark.createDataFrame([(i, x[i].tolist(), chosen[i].tolist(), w[i].tolist()) for i in range(n)], experts.WIDE).repartition(3)
    layers = spark.createDataFrame(
        [(i, r, w1[i, r].tolist(), w3[i, r].tolist(), w2[i, r].tolist()) for i in range(e) for r in range(inner)],
        "expert int, row int, w1 array<double>, w3 array<double>, w2 array<double>")
    want = np.zeros((n, d))
    for t in range(n):
        for s, i in enumerate(chosen[t]):
            h = w1[i] @ x[t]
            want[t] += w[t, s] * (w2[i].T @ (h / (1 + np.exp(-h)) * (w3[i] @ x[t])))
    for limit in (experts.WEIGHT_LIMIT, 1):
        got = experts.feed_forward(wide, layers, d, limit).orderBy("token_id").collect()
        assert np.allclose([r.y for r in got], want)
    counts = experts.expert_counts(wide, 5)
    sizes = [int((chosen == i).sum()) for i in range(5)]
    assert [r.n_tokens for r in counts.orderBy("expert_id").collect()] == sizes
    desc = experts.group_descriptors(counts, 8).orderBy("expert_id").collect()
    padded = [0]
    for s in sizes[:-1]:
        padded.append(padded[-1] + math.ceil((s + 1) / 8) * 8)
    assert [r.start for r in desc] == [sum(sizes[:i]) for i in range(5)] and [r.padded_start for r in desc] == padded
    blocks = [r.expert_id for r in experts.block_experts(counts, 8).orderBy("block").collect()]
    assert blocks == [max(i for i in range(5) if padded[i] <= b * 8) for b in range(math.ceil(sum(sizes) / 8) + 5)]


def test_quantisation(spark):
    df = spark.createDataFrame([(0, [0.5, -1.0, 2.5]), (1, [0.0, 0.25, -2.0])], "id int, x array<double>")
    assert quant.tensor_scale(df, "x", 16) == 2.5 / 32767
    zero = df.select(F.transform("x", lambda v: v * 0).alias("x"))
    assert quant.tensor_scale(zero, "x", 16) == 1.0 and quant.tensor_scale(zero, "x", 8) == 1e-8 / 127
    half = spark.createDataFrame([([0.5, 1.5, 2.5, -0.5, 1e9],)], "x array<double>")
    assert half.select(quant.quantise(F.col("x"), 1.0, 8)).first()[0] == [0, 2, 2, 0, 127]
    h = quant.hadamard(spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "id int, x array<double>"), ["id"], "x").first()
    assert h.vec == [10, -2, -4, 0]


# ---- n-gram memory ------------------------------------------------------------------


def test_tables_and_factors():
    assert ngram.table_sizes([1])[1] == [
        [646403, 646411, 646421, 646423, 646433, 646453, 646519, 646523],
        [646537, 646543, 646549, 646571, 646573, 646577, 646609, 646619]]
    assert ngram.table_sizes([1, 15])[15][0][0] == 646631 and ngram.table_sizes([1, 15])[15][1][0] == 646781
    for f in ngram.multipliers(1):
        assert f % 2 == 1 and f * (ngram.VOCAB_SIZE - 1) < 2**63


@pytest.mark.parametrize("bits", [None, 40])
def test_ngram_hash(spark, bits):
    sizes, factors = [[7, 11], [13, 17]], ngram.multipliers(3)
    seqs = [[5, 3, 129279, 4], [], [8]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq int, ids array<bigint>").coalesce(1)
    got = {(r.seq, r.pos): r.heads for r in ngram.ngram_hash(df, ["seq"], factors, sizes, 2, bits=bits).collect()}
    want = {}
    for i, s in enumerate(seqs):
        for t in range(len(s)):
            at = [s[t - k] if t >= k else 2 for k in range(3)]
            two = at[0] * factors[0] ^ at[1] * factors[1]
            three = two ^ at[2] * factors[2]
            cut = (1 << bits) - 1 if bits else -1
            want[i, t] = [(two & cut) % 7, (two & cut) % 11, (three & cut) % 13, (three & cut) % 17]
    assert got == want


def test_lookup_paths(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 4)
    table = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(9)], "row_id bigint, vec array<float>")
    asked = spark.createDataFrame([(i, [i % 9, 0, 8]) for i in range(30)], "pos bigint, rows array<bigint>")
    near = rows(ngram.lookup(asked, ["pos"], table, 2))
    assert near[10] == (10, [1.0, -1.0, 0.0, 0.0, 8.0, -8.0])
    assert rows(ngram.lookup(asked, ["pos"], table, 2, limit=2)) == near
    hashed = spark.createDataFrame([([1, 2, 3],)], "heads array<bigint>")
    assert ngram.row_ids(hashed, [[5, 7], [9]]).first().rows == [1, 7, 15]
    assert ngram.row_ids(hashed, [[5, 7], [9]], 10).first().rows == [1, 7, 5]


def test_gate_and_convolution(spark):
    rng = np.random.default_rng(6)
    n, g, d, taps = 25, 2, 3, 4
    kv, hidden = rng.normal(size=(n, (g + 1) * d)), rng.normal(size=(n, g * d))
    n1, n2, n3 = rng.normal(size=(3, g, d))
    cw = rng.normal(size=(g * d, taps))
    df = spark.createDataFrame([(0, t, kv[t].tolist(), hidden[t].tolist()) for t in range(n)],
                               "seq_id bigint, t bigint, kv array<double>, hidden array<double>").repartition(4)
    gated = np.zeros((n, g * d))
    for t in range(n):
        for i in range(g):
            k, h = kv[t, i * d:(i + 1) * d], hidden[t, i * d:(i + 1) * d]
            s = ((k / math.sqrt((k * k).mean() + 1e-5) * n1[i]) * (h / math.sqrt((h * h).mean() + 1e-5) * n2[i])).sum() / math.sqrt(d)
            root = math.copysign(math.sqrt(max(abs(s), 1e-6)), s)
            gated[t, i * d:(i + 1) * d] = kv[t, g * d:] / (1 + math.exp(-root))
    step = ngram.gated_value(df, ["seq_id", "t"], g, d, n1, n2)
    assert np.allclose([r.gated for r in step.orderBy("t").collect()], gated)
    want = np.zeros_like(gated)
    for t in range(n):
        acc = np.zeros(g * d)
        for k in range(taps):
            if t - 3 * k >= 0:
                x = gated[t - 3 * k].reshape(g, d)
                acc += cw[:, k] * (x / np.sqrt((x * x).mean(axis=1, keepdims=True) + 1e-5) * n3).ravel()
        want[t] = acc / (1 + np.exp(-acc))
    got = ngram.short_conv(step, g, d, cw, n3).orderBy("t").collect()
    assert len(got) == n and np.allclose([r.out for r in got], want)
    full = ngram.short_conv(step, g, d, cw, n3, residual=True).orderBy("t").collect()
    assert np.allclose([r.out for r in full], want + gated + hidden)


def test_constant_memory_gives_constant_projection(spark):
    """All-ones rows projected by all-ones weights give the row length everywhere."""
    from sparkmoor.operators import memory

    df = spark.createDataFrame([(i, [1.0] * 8) for i in range(5)], "t int, flat array<double>")
    got = memory.project(df, "flat", np.ones((6, 8)), "kv").collect()
    assert all(r.kv == [8.0] * 6 for r in got)


# ---- sparse products and utilities --------------------------------------------------


def test_spmv(spark, monkeypatch):
    r = random.Random(9)
    cells = [(i, r.randrange(20), float(r.randint(-5, 5))) for i in range(20) if i != 4 for _ in range(r.randint(3, 10))]
    m = spark.createDataFrame(cells, "row bigint, col bigint, val double")
    x = spark.range(20).select(F.col("id").alias("col"), (F.col("id") + 1).cast("double").alias("x"))
    picked = [3, 4, 23, 39, 3]
    sel = spark.createDataFrame(list(enumerate(picked)), "place bigint, row bigint")
    y = [sum(v * (c + 1) for i, c, v in cells if i == row) for row in range(20)]
    for limit in (staging.BROADCAST_ROWS, 0):
        monkeypatch.setattr(staging, "BROADCAST_ROWS", limit)
        held = Staged(x, 20)
        assert rows(sparse.spmv_rows(m, held, sel, 20)) == [(i, y[i]) for i in (3, 4, 19)]
        assert rows(sparse.spmv_positions(m, held, sel, 20)) == [(p, y[i % 20]) for p, i in enumerate(picked)]
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k int, y double")
    b = spark.createDataFrame([(0, 1.000001), (1, 2.1)], "k int, y double")
    assert rows(sparse.count_mismatches(a, b, "k", "y")) == [(2, 1)]


def test_scatter(spark):
    buffer = spark.createDataFrame([(i, 0.0) for i in range(4)], "idx bigint, value double")
    writes = spark.createDataFrame([(1, 5.0, 0), (1, 6.0, 1), (9, 7.0, 2), (3, 8.0, 3)], "dest bigint, data double, n int")
    assert rows(sparse.scatter(buffer, writes, ["n"])) == [(0, 0.0), (1, 6.0), (2, 0.0), (3, 8.0)]


def test_patterns(spark):
    i = F.col("id")
    got = spark.range(40).select(utility.generated_index(i, "pattern").alias("p"), utility.generated_index(i, "strided", 3, 2).alias("s"),
                                 utility.generated_index(i, start=2**32 - 1).alias("w"), utility.block_pattern(i, 170).alias("b")).collect()
    assert [r.p for r in got[:6]] == [0, 1, 2, 4, 8, 16] and got[39].p == 2**31
    assert [r.s for r in got[:3]] == [2, 5, 8] and [r.w for r in got[:3]] == [2**32 - 1, 0, 1]
    assert [got[j].b for j in (0, 15, 16, 39)] == [170, 170, 171, 172]
    data = spark.range(1024).select((i * 7 + 42).alias("v"))
    assert rows(utility.checksum(data, "v")) == [(3709440, 1024)]
    assert rows(utility.checksum(spark.createDataFrame([(-1,), (3,)], "v int"), "v")) == [(2, 2)]


def test_latencies(spark):
    r = random.Random(1)
    data = [(r.choice("ab"), float(r.randint(0, 9)), i) for i in range(300)]
    got = utility.latency_summary(spark.createDataFrame(data, "name string, v double, id int").repartition(4), "name", "v")
    for row in got.collect():
        vals = sorted(v for n, v, _ in data if n == row.name)
        assert (row.n, row.least, row.most) == (len(vals), vals[0], vals[-1])
        assert [row.p50, row.p90, row.p99] == [vals[int(len(vals) * p / 100)] for p in (50, 90, 99)]
    runs = spark.createDataFrame([("x", 100.0, 0), ("x", 1.0, 1), ("x", 3.0, 2), ("y", 0.0, 3), ("y", 5.0, 4)], "s string, v double, n int")
    assert rows(utility.best_setting(runs, "s", "v", "n", 1)) == [("x", 2, 2.0, True), ("y", 1, 5.0, False)]


# ---- configurations and sizes ----------------------------------------------------


def test_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"build_memory": [{"retrieved_data": 4096, "config": "fpga"}, {"retrieved_data": -1, "config": "gpu"}],
                                "manage_memory_and_apply": [{"retrieved_data": 4096, "memory": 4096, "query": 1, "output": 1, "config": ["fpga", "fpga", "gpu"]}],
                                "build_and_apply_memory": []}, indent=1))
    rules = configs.read_rules(spark, str(path), ["build_and_apply_memory", "build_memory", "manage_memory_and_apply"])
    assert rules == [configs.Rule("build_memory", 4096, None, ("fpga",)), configs.Rule("build_memory", -1, None, ("gpu",)),
                     configs.Rule("manage_memory_and_apply", 4096, 4096, ("fpga", "fpga", "gpu"))]
    df = spark.createDataFrame([(4096, 10), (4097, 10), (10, 5000)], "d int, m int")
    configs.write_ranked(df, "d", str(tmp_path / "ranked"), 2)
    assert [r.d for r in spark.read.json(str(tmp_path / "ranked")).collect()] == [10, 4096]


def test_model_sizes(spark):
    c = [F.lit(v).cast("bigint") for v in (7168, 2048, 256, 1)]
    params = sizes.weights(sizes.expert_layer(*c))
    row = spark.range(1).select(params.alias("p"), sizes.gigabytes(params, 2, binary=False).alias("gb")).first()
    assert row.p == 256 * 3 * 7168 * 2048 + 3 * 7168 * 2048 + 256 * 7168 and abs(row.gb - row.p * 2 / 1e9) < 1e-9
    a = [F.lit(v).cast("bigint") for v in (7168, 1536, 512, 128, 128, 64, 128)]
    got = spark.range(1).select(sizes.weights(sizes.latent_attention(*a))).first()[0]
    assert got == 7168 * 1536 + 1536 * 128 * 192 + 7168 * 576 + 512 * 128 * 256 + 128 * 128 * 7168


def test_metadata_sink(spark, index, tmp_path):
    from sparkmoor.functions.staging import stage_counted as held

    numbered = bm25.with_vocab(index.postings, held(bm25.vocabulary(index.postings)))
    stats = bm25.index_statistics(index, bm25.pack_documents(numbered))
    configs.write_metadata(stats, str(tmp_path / "meta"))
    back = spark.read.json(str(tmp_path / "meta")).first()
    assert back.n_docs == 70 and back.n_entries == numbered.count() and back.n_batches == 2


# ---- the same answer on every path ---------------------------------------------------


def test_lookup_of_missing_rows(spark):
    asked = spark.createDataFrame([(0, [0, 5, 2]), (1, [7, 7, 7]), (2, [2, 2, 0])], "pos int, rows array<bigint>").repartition(2)
    table = spark.createDataFrame([(0, [1.0, 1.0]), (2, [3.0, 3.0])], "row_id bigint, vec array<double>")
    want = [(0, [1, 1, 0, 0, 3, 3]), (1, [0] * 6), (2, [3, 3, 3, 3, 1, 1])]
    for limit in (ngram.TABLE_LIMIT, 1):
        assert rows(ngram.lookup(asked, ["pos"], table, 2, limit=limit).orderBy("pos")) == want
        assert ngram.lookup(asked, ["pos"], table.limit(0), 2, limit=limit).where("exists(flat, x -> x != 0)").count() == 0


def test_experts_without_weights(spark):
    wide = spark.createDataFrame([(0, [1.0, 2.0], [0, 1], [1.0, 1.0]), (1, [1.0, 0.0], [1, 2], [0.5, 0.5])], experts.WIDE)
    layers = spark.createDataFrame([(0, 0, [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]), (0, 1, [0.0, 1.0], [1.0, 0.0], [2.0, 0.0])],
                                   "expert int, row int, w1 array<double>, w3 array<double>, w2 array<double>")
    silu = lambda h: h / (1 + np.exp(-h))
    want = [[silu(1) * 2 + silu(2) * 2, silu(1) * 2], [0.0, 0.0]]
    for limit in (experts.WEIGHT_LIMIT, 1):
        got = experts.feed_forward(wide, layers, 2, limit).orderBy("token_id").collect()
        assert np.allclose([r.y for r in got], want)
        got = experts.quantised_feed_forward(wide, layers, 2, 1.0, (1.0, 1.0, 1.0), limit=limit).orderBy("token_id").collect()
        assert np.allclose([r.y for r in got], want, atol=1e-3)


def test_many_heads(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, q, w = rng.normal(size=(20, 4)), rng.normal(size=(7, 4)), rng.random(7)
    memory = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "mem_id bigint, vec array<double>")
    heads = spark.createDataFrame([(i, q[i].tolist(), float(w[i])) for i in range(7)], "head int, q array<double>, w double")
    want = np.maximum(x @ q.T, 0) @ w
    for most in (4096, 3):
        monkeypatch.setattr(score, "QUERY_ROWS", most)
        got = score.multi_head(memory, heads).orderBy("mem_id").collect()
        assert np.allclose([r.score for r in got], want, atol=1e-6)


def test_ranking_of_any_ids(spark, monkeypatch):
    docs = spark.createDataFrame([("x", "a b b"), ("y", "a c"), ("z", "d")], "doc_id string, text string")
    index = bm25.build_index(docs)
    asked = spark.createDataFrame([(1, "b"), (None, "a"), (2, "c d")], "query_id long, text string")
    terms = bm25.query_terms(asked)
    want = {(1, "x", 0), (None, "y", 0), (None, "x", 1), (2, "z", 0), (2, "y", 1)}
    for most in (200_000, 0):
        monkeypatch.setattr(staging, "BROADCAST_ROWS", most)
        got = ranking.top_documents(index, terms, bm25.CPU, 5)
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == want
    own = bm25.build_index(docs, tokenizer=lambda texts: [list(t) for t in texts])
    found = ranking.top_documents(own, bm25.query_terms(asked, tokenizer=lambda texts: [list(t) for t in texts]), bm25.CPU, 1)
    assert {(r["query_id"], r["doc_id"]) for r in found.collect()} == {(1, "x"), (None, "y"), (2, "y")} or found.count() == 3


def test_vectors_of_unequal_length():
    with pytest.raises(ValueError):
        vectors.as_matrix(pa.array([[1.0], [1.0, 2.0, 3.0]]))
    with pytest.raises(ValueError):
        vectors.as_matrix(pa.array([[1.0], None]))


def test_merged_vectors(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), None if k == 3 else "s", v.tolist(), float(w)) for k, v, w in
            zip(rng.integers(0, 4, 500), rng.normal(size=(500, 70)), rng.random(500))]
    df = spark.createDataFrame(data, "k int, s string, v array<double>, w double").repartition(5)
    got = vectors.merge_vectors(df, ["k", "s"], {"a": ("v", "sum"), "b": ("v", "min"), "c": ("v", "max")}, ("w",)).orderBy("k").collect()
    for r in got:
        own = np.array([v for k, _, v, _ in data if k == r.k])
        assert np.allclose(r.a, own.sum(axis=0)) and r.b == own.min(axis=0).tolist() and r.c == own.max(axis=0).tolist()
        assert r.n == len(own) and abs(r.w - sum(w for k, _, _, w in data if k == r.k)) < 1e-9
    assert len(got) == 4


def test_vocabulary_is_whole(spark):
    numbered = spark.createDataFrame([(5, 70_005, 300), (5, 70_006, 1), (5, 21, 2)], "doc_id bigint, vocab_idx bigint, tf int")
    assert rows(bm25.pack_documents(numbered).select("row", "packed").orderBy("row")) == [(0, (2 << 32) + 21), (1, (255 << 32) + 70_005)]
    df = spark.createDataFrame([(0, 3), (70_005, 1)], "vocab_idx bigint, df bigint")
    assert bm25.first_ids(df).count() == 2 * 65536 and bm25.first_ids(df, 10).count() == 10


def test_expert_layers_in_blocks(spark, monkeypatch):
    """Tiles of tokens and blocks of rows, with a hot expert, against layers that are held whole."""
    rng = np.random.default_rng(5)
    tokens = [(t, rng.normal(size=6).tolist(), [0, 1 + t % 3], [0.5, 0.25]) for t in range(90)]
    layers = [(e, r, *[rng.normal(size=6).tolist() for _ in range(3)]) for e in range(3) for r in range(11 + e)]
    wide = spark.createDataFrame(tokens, experts.WIDE).repartition(3)
    weights = spark.createDataFrame(layers, "expert int, row int, w1 array<double>, w3 array<double>, w2 array<double>").repartition(4)
    monkeypatch.setattr(experts, "TILE_NUMBERS", 60)
    monkeypatch.setattr(experts, "BLOCK_ROWS", 4)
    for fn in (experts.feed_forward, lambda *a, **k: experts.quantised_feed_forward(*a, 0.1, (0.1, 0.2, 0.3), (0.0, 0.1, 0.0), **k)):
        held, streamed = (sorted(fn(wide, weights, 6, limit=n).collect()) for n in (experts.WEIGHT_LIMIT, 1))
        assert len(held) == 90 and np.allclose([r.y for r in held], [r.y for r in streamed])


def test_a_large_layer_has_small_rows(spark):
    """7168 inputs: no row of the plan is larger than two vectors."""
    dim, rows = 7168, 40
    rng = np.random.default_rng(6)
    x = rng.normal(size=dim)
    w = rng.normal(size=(rows, 3, dim)) / 100
    weights = spark.createDataFrame([(0, r, *[v.tolist() for v in w[r]]) for r in range(rows)],
                                    "expert int, row int, w1 array<double>, w3 array<double>, w2 array<double>")
    wide = spark.createDataFrame([(1, x.tolist(), [0], [2.0])], experts.WIDE)
    got = experts.feed_forward(wide, weights, dim, limit=1).first().y
    a, b = w[:, 0] @ x, w[:, 1] @ x
    assert np.allclose(got, 2 * ((a / (1 + np.exp(-a)) * b) @ w[:, 2]))


def test_many_edits(spark):
    """A hundred edits at once, against a list."""
    rng, held, log = random.Random(8), list(range(40)), memory.edit(
        spark.createDataFrame([(i, [float(i)]) for i in range(40)], "mem_id bigint, vec array<double>"))
    fresh = 1000
    for _ in range(100):
        what = rng.choice(["delete", "delete", "insert", "pop"])
        if what == "insert":
            n = rng.randrange(0, 4)
            log = log.insert(spark.createDataFrame([(n - i, [float(fresh + n - i)]) for i in range(n)], "mem_id bigint, vec array<double>"))
            held += [fresh + 1 + i for i in range(n)]
            fresh += n
        elif held and what == "delete":
            i = rng.randrange(len(held))
            log, _ = log.delete(i), held.pop(i)
        elif held:
            log, _ = log.pop_last(), held.pop()
    got = {r.mem_id: r.vec[0] for r in log.apply().collect()}
    assert [got[i] for i in range(len(got))] == held
    with pytest.raises(IndexError):
        log.delete(len(held)).apply()


@pytest.mark.parametrize("mode", ["sigmoid", "softmax"])
def test_gates_over_tiles(spark, mode, monkeypatch):
    """Ten thousand experts, and few in tiles of seven: as the dense choice."""
    rng = np.random.default_rng(9)
    for n, groups, tile in ((10_000, 8, 2048), (48, 6, 7)):
        gate = [(e, rng.normal(size=4).round(3).tolist(), float(rng.normal() / 10 if mode == "sigmoid" else rng.normal() / n)) for e in range(n)]
        tokens = [(t, rng.normal(size=4).round(3).tolist()) for t in range(12)]
        w, bias = np.array([g[1] for g in gate]), np.array([g[2] for g in gate])
        z = np.array([x for _, x in tokens]) @ w.T
        gates = spark.createDataFrame(gate, "expert int, vec array<double>, bias double").repartition(3)
        asked = spark.createDataFrame(tokens, "token_id bigint, x array<double>")
        monkeypatch.setattr(experts, "GATE_ROWS", 40)
        monkeypatch.setattr(experts, "GATE_TILE", tile)
        got = experts.route_grouped(asked, gates, groups, 3, 5, mode).orderBy("token_id").collect()
        chosen, weights = experts.grouped_choice(z, bias, groups, 3, 5, mode)
        assert [r.experts for r in got] == chosen.tolist() and np.allclose([r.weights for r in got], weights)
        if mode == "sigmoid":
            got = experts.route_split(asked, gates, 5).orderBy("token_id").collect()
            chosen, weights = experts.split_choice(z, bias, 5)
            assert [r.experts for r in got] == chosen.tolist() and np.allclose([r.weights for r in got], weights)
            got = experts.gate_scores(asked, gates).orderBy("token_id").collect()
            assert np.allclose([r.scores for r in got], 1 / (1 + np.exp(-z)) + bias)
        monkeypatch.undo()


def test_source_blocks(spark):
    source = ["class A : public Step {", "  void run() override {", "    if (x) { y = \"}\"; }  // }", "  }", "  void test() override;", "};",
              "struct B", "{", "  int f() { return 1; }", "};", "void g() {"]
    lines = spark.createDataFrame([("a.h", i, s) for i, s in enumerate(source)], "file string, line_no int, line string")
    got = sorted(map(tuple, utility.source_blocks(lines, "file").drop("at").collect()), key=lambda r: r[4])
    assert got == [("a.h", "A", True, 1, 0, 5, 2), ("a.h", "", False, 2, 1, 3, 0), ("a.h", "", False, 3, 2, 2, 0),
                   ("a.h", "B", True, 1, 7, 9, 0), ("a.h", "", False, 2, 8, 8, 0), ("a.h", "", False, 1, 10, None, None)]

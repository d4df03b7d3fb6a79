"""Hand-computed cases of the four stages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmoor.operators import attention, memory, retrieve, score
from sparkmoor.plans import steps


def mem(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)],
                                 "mem_id bigint, vec array<float>")


def queries(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)],
                                 "query_id bigint, q array<float>")


def scored(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)],
                                 "query_id bigint, mem_id bigint, score double")


def cache(spark, keys, values=None):
    values = values or keys
    return spark.createDataFrame(
        [(i, [float(x) for x in k], [float(x) for x in v]) for i, (k, v) in enumerate(zip(keys, values))],
        "pos bigint, k array<float>, v array<float>")


def by_id(df, key="mem_id", value="score"):
    return [r[value] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize("rows, q, want", [
    ([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)], (1, 2, 3, 4), [1, 2, 3]),
    ([(1, 2, 3), (4, 5, 6), (-1, -2, -3)], (1, 1, 1), [6, 15, -6]),
    ([], (1, 1), []),
    ([(2, 3, 4)], (1, 2, 3), [20]),
    ([(0, 0), (0, 0)], (5, 7), [0, 0]),
    ([(1, 2, 3, 4)], (1, 1), [3]),  # the sum runs over the query's length
])
def test_inner_product(spark, rows, q, want):
    assert by_id(score.inner_products(mem(spark, rows), queries(spark, q))) == want


def test_wrong_expectation_is_noticed(spark):
    got = by_id(score.inner_products(mem(spark, [(1, 2)]), queries(spark, (1, 1))))
    assert got != [4.0]


@pytest.mark.parametrize("values, k, want", [
    ((1, 5, 3, 4, 2), 3, [1, 3, 2]), ((3, 1, 2), 5, [0, 2, 1]), ((1,), 1, [0]), ((7, 7, 7, 7), 2, [0, 1]),
    ((-1, -5, -2, -3), 2, [0, 2]), ((1.5, 2.5, 0.5), 2, [1, 0]), ((), 3, []),
])
def test_top_k(spark, values, k, want):
    for by in (None, ["query_id"]):
        got = retrieve.top_k(scored(spark, values), k, by=by)
        assert [r.mem_id for r in got.orderBy("rank").collect()] == want
    spread = retrieve.top_k(scored(spark, values), k, by=["query_id"], spread=3)
    assert [r.mem_id for r in spread.orderBy("rank").collect()] == want


@pytest.mark.parametrize("values, t, want", [
    ((1, 5, 3, 4, 2), 3, [14]), ((1, 2, 3), 10, [0]), ((1, 2, 3, 4), 1, [15]), ((-5, -3, -1, 0), -3, [14]),
    ((2.9, 3.0, 3.1), 3.0, [6]),
    (tuple(range(100)), 50, [-1125899906842624, 68719476735]),
])
def test_threshold(spark, values, t, want):
    s = scored(spark, values)
    words = retrieve.threshold_bitmap(s, t)
    assert by_id(words, "word", "bits") == want
    ids = sorted(r.mem_id for r in retrieve.decode_bitmap(words).collect())
    assert ids == [i for i, v in enumerate(values) if v >= t]
    strict = retrieve.threshold_bitmap(s, t, inclusive=False)
    assert sorted(r.mem_id for r in retrieve.decode_bitmap(strict).collect()) == [i for i, v in enumerate(values) if v > t]
    fused = score.threshold_words(mem(spark, [(v,) for v in values]), queries(spark, (1,)), np.float32(t))
    assert by_id(fused, "word", "bits") == want


RAMP = [(1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12)]


@pytest.mark.parametrize("keys, page, weights, want", [
    (RAMP, 2, [(1, 0, 0), (0, 1, 0)], [[2.5, 3.5], [8.5, 9.5]]),
    ([(2, 3), (6, 9)], 4, [(1, 0), (0, 1)], [[4, 6]]),
    ([(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)], 2, [(1, 0)], [[1.5], [3.5], [5]]),
    ([(1, 2, 3), (1, 2, 3)], 2, [(1, 1, 1), (1, -1, 0)], [[6, -1]]),
    ([(1, 2), (3, 4)], 1, [(1, 0), (0, 1)], [[1, 2], [3, 4]]),
    ([(1, 2, 3, 4), (4, 6, 5, 5)], 1, [(1, 1, 1, 1)], [[10], [20]]),
])
def test_paged_index(spark, keys, page, weights, want):
    index = memory.paged_index(cache(spark, keys), page, len(keys[0]), np.array(weights, float))
    assert by_id(index, "mem_id", "vec") == want


def test_paged_index_without_match(spark):
    kv = cache(spark, RAMP)
    assert memory.paged_index(kv.limit(0), 2, 3, np.eye(3)).count() == 0
    assert memory.paged_index(kv, 2, 3, np.eye(4)).count() == 0


def test_large_projection_equals_literal(spark, monkeypatch):
    w = memory.lcg_weights(3, 2)
    small = by_id(memory.project(mem(spark, RAMP), "vec", w), "mem_id", "vec")
    monkeypatch.setattr(memory, "LITERAL_WEIGHTS", 0)
    large = by_id(memory.project(mem(spark, RAMP), "vec", w), "mem_id", "vec")
    assert np.allclose(small, large) and np.allclose(small, np.array(RAMP) @ w.T)


def test_folding_the_query(spark):
    w = memory.lcg_weights(3, 2)
    q = queries(spark, (0.5, -1.0))
    index = memory.paged_index(cache(spark, RAMP), 2, 3)
    left = by_id(score.inner_products(memory.project(index, "vec", w), q))
    assert np.allclose(left, by_id(score.inner_products(index, memory.fold_query(q, w))), atol=1e-5)


def dense(q, keys, values, picked):
    k, v = np.array(keys, float)[picked], np.array(values, float)[picked]
    s = k @ np.array(q, float) / math.sqrt(len(q))
    w = np.exp(s - s.max())
    return (w[:, None] * v).sum(axis=0) / w.sum()


def attend(spark, q, keys, values, pages, size):
    chosen = spark.createDataFrame([(0, p) for p in pages], "query_id bigint, page_id bigint")
    out = attention.block_sparse_attention(cache(spark, keys, values), queries(spark, q), chosen, size, len(q))
    return out.first()["out"]


def test_attention(spark):
    ones = [(1, 1)] * 4
    assert np.allclose(attend(spark, (1, 1), ones, [(0, 0), (2, 2), (1, 1), (1, 1)], [0, 1], 2), (1, 1))
    keys = [(1, 0), (0, 1), (1, 1), (2, 0), (0, 3)]
    values = [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    assert np.allclose(attend(spark, (1, 1), keys, values, [2], 2), (9, 10))
    assert attend(spark, (1, 1), keys, values, [], 2) == [0, 0]
    assert np.allclose(attend(spark, (1, 2), keys, values, [0, 2], 2), dense((1, 2), keys, values, [0, 1, 4]))
    assert np.allclose(attend(spark, (1, 2), keys, values, [1, 1, 0], 2), dense((1, 2), keys, values, [0, 1, 2, 3, 2, 3]))
    assert np.allclose(attend(spark, (1, 2), keys, values, [0, 1, 2], 2), dense((1, 2), keys, values, range(5)))
    assert np.allclose(attend(spark, (1000, 0), keys, values, [0, 1, 2], 2), (7, 8))


def test_latent_attention(spark):
    rng = np.random.default_rng(3)
    lat, pe = rng.normal(size=(9, 6)), rng.normal(size=(9, 2))
    q, qp, wk, wv = rng.normal(size=(3, 4)), rng.normal(size=(3, 2)), rng.normal(size=(3, 4, 6)), rng.normal(size=(3, 5, 6))
    kv = spark.createDataFrame([(i % 2, lat[i].tolist(), pe[i].tolist()) for i in range(9)],
                               "query_id bigint, latent array<double>, k_pe array<double>").repartition(4)
    got = attention.latent_attention(kv, q, qp, wk, wv, 0.3).orderBy("query_id", "head").collect()
    for r in got:
        rows = np.arange(9) % 2 == r.query_id
        s = (np.einsum("n,nc,tc->t", q[r["head"]], wk[r["head"]], lat[rows]) + pe[rows] @ qp[r["head"]]) * 0.3
        w = np.exp(s - s.max())
        assert np.allclose(r.out, wv[r["head"]] @ (w @ lat[rows] / w.sum()))
    assert len(got) == 6


def test_many_queries_take_the_joined_path(spark):
    rng = np.random.default_rng(1)
    m, q = rng.integers(-3, 4, size=(300, 5)), rng.integers(-3, 4, size=(40, 5))
    mdf, qdf = mem(spark, m).repartition(3), queries(spark, *q)
    for k in (1, 7, 400):
        few = score.top_inner_products(mdf, qdf, k)
        many = score.top_inner_products(mdf, qdf, k, limit=6)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    s = m @ q.T
    best = score.top_inner_products(mdf, qdf, 7).where("query_id = 5").orderBy("rank").collect()
    want = sorted(range(300), key=lambda i: (-s[i, 5], i))[:7]
    assert [r.mem_id for r in best] == want
    ints = score.integer_products(mdf, qdf, limit=6)
    assert sorted(map(tuple, ints.collect())) == sorted((j, i, int(s[i, j])) for i in range(300) for j in range(40))
    few = score.threshold_words(mdf, qdf, 2.0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, score.threshold_words(mdf, qdf, 2.0, limit=6).collect()))


def test_memory_edits(spark):
    m = mem(spark, RAMP)
    assert by_id(memory.delete(m, 1), "mem_id", "vec") == [list(r) for r in (RAMP[0], RAMP[2], RAMP[3])]
    assert by_id(memory.delete(m, 1), "mem_id", "mem_id") == [0, 1, 2]
    assert by_id(memory.pop_last(m), "mem_id", "mem_id") == [0, 1, 2]
    assert by_id(memory.insert(m, mem(spark, [(0, 0, 1)])), "mem_id", "vec")[4] == [0, 0, 1]
    assert memory.get(m, 2).first()["vec"] == [7, 8, 9]
    for bad in (lambda: memory.get(m, 9), lambda: memory.delete(m, -1), lambda: memory.pop_last(m.limit(0))):
        with pytest.raises(IndexError):
            bad()


def test_segments(spark):
    held = memory.segment_memory(cache(spark, [(i, -i) for i in range(12)]), 4, 2, 2)
    assert by_id(memory.read_segment(held), "segment_id", "vec")[1] == [4.5, -4.5, 6.5, -6.5]
    assert memory.context_length(held, 4, 2).first()[0] == 12
    assert by_id(memory.delete_segment(held, 0), "slot", "segment_id").count(0) == 2
    assert memory.pop_segment(held).select("segment_id").distinct().count() == 2
    more = memory.insert_segment(held, held.where("segment_id = 0"))
    assert more.where("segment_id = 3").count() == 2


def test_minmax(spark):
    index = memory.minmax_index(cache(spark, [(1, -1), (3, -5), (2, 2)]), 2, 2, 2)
    assert [tuple(r) for r in index.orderBy("entry_id").collect()] == [(0, 0, [1, -5], [3, -1]), (1, 0, [2, 2], [2, 2])]
    assert memory.minmax_page(index, 0).count() == 2


def test_flow(spark):
    flow = steps.paged_attention(2, 2, 2)
    keys = [(1, 0), (0, 1), (1, 1), (2, 0), (0, 3)]
    kv, q = cache(spark, keys), queries(spark, (1, 0))
    whole = flow.build_and_apply(kv, q).first()["out"]
    assert np.allclose(whole, dense((1, 0), keys, keys, [0, 1, 2, 3]))
    held = flow.build_memory(kv)
    assert flow.manage_and_apply(held, kv, q).first()["out"] == whole

    @steps.register("fused", "first_page")
    def first_page(held, query):
        return query.select("query_id", F.lit(0).cast("bigint").alias("mem_id"))

    other = flow.with_steps(fused="first_page").build_and_apply(kv, q).first()["out"]
    assert np.allclose(other, dense((1, 0), keys, keys, [0, 1]))
    with pytest.raises(ValueError):
        steps.MemoryFlow(build=flow.build, apply=flow.apply)
    with pytest.raises(KeyError):
        flow.with_steps(fused="missing")

"""Importance resampling against a plain version."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import LOWER, WORD
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmoor.llm import resampling


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, target, percent=25, min_words=20):
    s = Counter(b for _, t in docs for b in plain_features(t)[1])
    t = Counter(b for x in target for b in plain_features(x)[1])
    up, down = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * up / ((s[b] + 1) * down))) for b in range(10_000)]
    out = []
    for key, text in docs:
        w, f = plain_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def got(spark, docs, target, params=resampling.Params()):
    found = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), params, keep=["doc_id"])
    return sorted((tuple(r) for r in found.select("doc_id", "draw.*").collect()), key=repr)


def test_odd_rows(spark, odd, none):
    small = [(d, t) for d, t, *_ in ODD]
    target = ["word end w7 w8", None, "", "İstanbul ß", "say it"]
    for params in (resampling.Params(), resampling.Params(percent=100, min_words=3)):
        assert got(spark, odd, target, params) == plain(small, target, params.percent, params.min_words)
    assert got(spark, odd, []) == plain(small, [])
    assert got(spark, none, target) == []
    clash = odd.withColumn("draw", F.lit(1)).withColumn("weight", F.lit("x")).withColumn("_draw", F.lit(2))
    out = resampling.resample(clash, none)
    assert out.columns == [*[c for c in clash.columns if c != "text"], "draw_"] and out.count() == len(ODD)


def test_ties_go_to_the_smaller_key(spark):
    """Equal texts and an equal digest: the same key twice, and keys that share all but the order."""
    docs = [(i, " ".join(f"x{j}" for j in range(25))) for i in (3, 3, 1, 2, 1, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = resampling.Params(percent=100)
    assert got(spark, df, ["x1"], every) == plain(docs, ["x1"], 100)


@given(st.lists(st.text(st.sampled_from("aAbZ1 é中\x00-_"), max_size=90), max_size=8), st.sampled_from([8, 40, 1 << 22]))
@settings(deadline=None)
def test_scans(texts, size):
    words = resampling.Dictionary()
    for _ in range(3):      # unknown words, then an automaton, then a larger one
        found, n = [[] for _ in texts], np.zeros(len(texts), int)
        for of, both, bucket in resampling.features([t.encode() for t in texts], words, 10_000, size):
            n += np.bincount(of, minlength=len(n))
            for i, b in zip(both.tolist(), bucket.tolist()):
                found[i].append(b)
        for t, f, m in zip(texts, found, n):
            w, b = plain_features(t)
            assert (m, sorted(f)) == (len(w), sorted(b))


@pytest.mark.parametrize("length", [1, 63, 64, 65, 5000])
def test_long_words(length):
    words = resampling.Dictionary()
    text = f"a {'x' * length} b {'x' * length}"
    for _ in range(2):
        found = [b for _, _, bucket in resampling.features([text.encode()], words, 10_000, 50) for b in bucket.tolist()]
        assert sorted(found) == sorted(plain_features(text)[1])


def test_a_full_dictionary_changes_nothing(monkeypatch):
    monkeypatch.setattr(resampling, "MOST_LETTERS", 40)
    text, words = " ".join(f"w{i % 50}" for i in range(500)), resampling.Dictionary()
    for _ in range(3):
        found = [b for _, _, bucket in resampling.features([text.encode()], words, 10_000, 64) for b in bucket.tolist()]
        assert sorted(found) == sorted(plain_features(text)[1])
    assert words.letters < 50

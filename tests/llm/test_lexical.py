"""Ranked search against a plain version, and the treap against its cells."""

import math
from collections import Counter

import numpy as np
import pytest
from brute import LOWER, WORD
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmoor.llm import lexical


def terms(text):
    return Counter(WORD.findall((text or "").translate(LOWER)))


def plain(docs, items, k):
    """Sorted (item_id, rank, doc_id, score)."""
    held = [(d, t) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_docs, n_words = len(held), sum(sum(t.values()) for _, t in held)
    df = Counter(w for _, t in held for w in t)
    out = []
    for item, text in items:
        found = []
        for d, t in held:
            m = 75 + (25 * sum(t.values()) * n_docs) // n_words
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 12 * m))
                        for w, n in terms(text).items() if w in t)
            if score > 0:
                found.append((-score, d is None, d, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, i + 1, f[2], f[3]) for i, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def got(index, items, k):
    return sorted((tuple(r) for r in lexical.search(index, items, k).collect()), key=repr)


ITEMS = [(1, "One, TWO two"), (2, "w5 w6 w7 w8 w9 w399 w400"), (3, None), (4, ""), (5, "one two"), (6, "word"), (6, "say again say"),
         (None, "say it again"), (7, "ß x É é"), (8, "nowhere to be found"), (9, " ".join(f"w{i % 500}" for i in range(3000)))]


def test_odd_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("x"))
    small = [(d, t) for d, t, *_ in ODD]
    for cells, chunk, together, k in ((lexical.CELLS, lexical.CHUNK, lexical.TOGETHER, 20), (3, 4, 2, 2), (50, 100, 1, 3)):
        monkeypatch.setattr(lexical, "CHUNK", chunk)
        monkeypatch.setattr(lexical, "TOGETHER", together)
        assert got(lexical.build_index(odd, cells=cells), items, k) == plain(small, ITEMS, k)
    assert got(lexical.build_index(odd), items.limit(0), 20) == []
    assert got(lexical.build_index(none), items, 20) == []
    assert got(lexical.build_index(odd.where("text IS NULL OR text = ''")), items, 20) == []


def test_a_written_index(spark, odd, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    made = lexical.build_index(odd, str(tmp_path / "index"))
    again = lexical.open_index(spark, str(tmp_path / "index"))
    assert again[1:] == made[1:] and got(again, items, 5) == got(made, items, 5)


def test_ties_and_hot_rows(spark):
    """A thousand copies, of which the smallest ids win, beside texts of one frequent word."""
    docs = [(i, "common rare words here") for i in range(1000, 0, -1)] + [(5000 + i, "common " * (i % 7 + 1)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = [(1, "rare"), (2, "common"), (3, "common rare common")]
    index = lexical.build_index(df, cells=700)
    assert got(index, spark.createDataFrame(items, "item_id long, text string"), 20) == plain(docs, items, 20)


cells = st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 25)), st.integers(1, 30), min_size=1, max_size=120)


@given(cells)
@settings(deadline=None)
def test_treap_keeps_its_cells(grid):
    row, col = np.array(list(grid)).T
    value = np.array(list(grid.values()))
    treap = lexical.read_treap(*lexical.write_treap(row, col, value))
    assert treap.maxima[0] == value.max()
    for (r, c), v in grid.items():
        node = 0
        for level in range(treap.height):
            quarter = 2 * (r >> (treap.height - 1 - level) & 1) + (c >> (treap.height - 1 - level) & 1)
            assert treap.quarters[node] >> quarter & 1 and treap.maxima[node] >= v
            node = treap.first[node] + lexical.BEFORE[treap.quarters[node], quarter]
        assert treap.maxima[node] == v


@given(cells, st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=12), st.integers(1, 4))
@settings(deadline=None)
def test_descent(grid, asked, k):
    row, col = np.array(list(grid)).T
    treap = lexical.read_treap(*lexical.write_treap(row, col, np.array(list(grid.values()))))
    asked = [a for a in {(i, r): (i, r, w) for i, r, w in asked}.values() if any(r == a[1] for r, _ in grid)]
    if not asked:
        return
    item, rows, weight = np.array(asked).T
    best = lexical.Best(3, k)
    keys = np.arange(26) // 2 * 5     # some keys are the same
    lexical.search_block(treap, keys, item, rows, weight, best)
    expected = []
    for i in set(item.tolist()):
        scores = Counter()
        for a, r, w in asked:
            for (x, c), v in grid.items():
                if a == i and x == r:
                    scores[c] += int(w) * v
        expected += [(i, s, int(keys[c])) for c, s in sorted(scores.items(), key=lambda e: (-e[1], keys[e[0]]))[:k]]
    assert sorted(zip(best.item.tolist(), best.score.tolist(), best.key.tolist())) == sorted(expected)


def test_bounds_spare_most_ranges():
    """Where one document holds an item's rare terms, only ranges around it are split."""
    rng = np.random.default_rng(1)
    n = 1 << 12
    row = np.concatenate([np.repeat(np.arange(3), n), rng.integers(3, 4000, 8 * n)])
    col = np.concatenate([np.tile(np.arange(n), 3), rng.integers(0, n, 8 * n)])
    place = np.unique(row * n + col)
    row, col = place // n, place % n
    treap = lexical.read_treap(*lexical.write_treap(row, col, np.full(len(row), 500)))
    rare = np.unique(row[col == 77])
    best = lexical.Best(1, 1)
    weight = np.where(rare < 3, 1, 100)
    split = lexical.search_block(treap, np.arange(n), np.zeros(len(rare), np.int64), rare, weight, best)
    assert best.key.tolist() == [77] and split < n // 4


@pytest.mark.parametrize("text, words", [(None, []), ("", []), ("Ab-c 1É\x00d", [b"ab", b"c", "1É".encode(), b"d"])])
def test_terms(text, words):
    assert [w for some in lexical.terms_of(text) for w in some] == words

"""Every operator against a plain version, on a small table and on odd rows."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from check import compare, connect
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmoor.llm import (common, decontaminate, graph, jaccard, language, packing, pii, quality, repair, tokens, toxicity,
                           url_filter, warc)
from sparkmoor.llm.catalog import QUERIES, SQL

SMALL = [(d, t) for d, t, *_ in ODD]


def rows(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


def same(got, expected):
    assert got == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def docs(spark, root):
    return [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, root, name):
    assert compare(QUERIES[name](spark, root), connect(root), SQL[name]) is None


# decontamination

def test_contamination(spark, root, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    same(rows(QUERIES["op1_positional_index"](spark, root), 6), brute.contamination(docs, items))


ITEMS = [(1, "One, TWO"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (3, None), (4, ""), (5, "one two"), (6, "word"),
         (7, "w9 w5 w6 w7 w8 w10 w11 w12 w13 w14"), (None, "say it again")]


def test_contamination_of_odd_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute.contamination(SMALL, [x for x in ITEMS if x[0]])
    for chunk, block in ((100_000, 1 << 21), (3, 300)):   # in one go, and in many chunks and blocks
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        index = decontaminate.build_index(odd, block_words=block)
        got = decontaminate.report(index, decontaminate.phrases_of(items.where("item_id IS NOT NULL")))
        same(rows(got.select(F.col("doc_key").cast("long"), "n_words", "n_hit", "n_items",
                             F.sha2(F.concat_ws(",", "items"), 256), "contaminated")), expected)
    near = {r["doc_key"]: r["n_near"] for r in got.collect()}
    assert near["11"] == 2 and near["1"] == 0   # the shuffled item is near, not exact
    clean = decontaminate.without_contaminated(odd, items)
    assert clean.columns == odd.columns
    hit = {d for d, _, n, *_ in brute.contamination(SMALL, ITEMS) if n}
    assert {r["doc_id"] for r in clean.collect()} == {1, 2, 3, None, 9, 8, 13} and {4, 5, 6, 7, 10, 11} <= hit
    assert decontaminate.report(decontaminate.build_index(none), decontaminate.phrases_of(items)).count() == 0
    assert decontaminate.report(index, decontaminate.phrases_of(items.limit(0))).where("contaminated").count() == 0


@given(st.lists(st.integers(0, 2**31), max_size=60))
@settings(deadline=None)
def test_packed_numbers(xs):
    data, ends = decontaminate.pack(np.array(xs, np.int64))
    assert decontaminate.unpack(data.tobytes()).tolist() == xs and len(ends) == len(xs)


# URL filters

def test_url_intervals(spark):
    changes = spark.createDataFrame([
        ("spam", "domain", "Bad.example", "add", "2024-01-10", 1), ("spam", "domain", "bad.example", "add", "2024-01-12", 2),
        ("spam", "domain", "bad.example", "remove", "2024-01-20", 3), ("spam", "domain", "bad.example", "add", "2024-01-20", 4),
        ("spam", "domain", "bad.example", "remove", "2024-02-01", 5), ("ads", "path", "ok.example/ads", "add", "2024-01-01", 1),
        ("ads", "host", "x.bad.example", "add", "2024-03-01", 1), ("ads", "host", None, "add", "2024-03-01", 1)],
        "list string, kind string, pattern string, action string, changed_on string, seq int") \
        .withColumn("changed_on", F.col("changed_on").cast("date"))
    urls = [("http://a.bad.example/", "2024-01-09", ""), ("http://a.BAD.example/", "2024-01-10", "spam"),
            ("https://u@bad.example:80", "2024-01-31", "spam"), ("http://bad.example/", "2024-02-01", ""),
            ("http://notbad.example/", "2024-01-15", ""), ("http://ok.example/ads/x?y", "2024-01-01", "ads"),
            ("http://ok.example/adserver", "2024-01-01", ""), ("http://x.bad.example/ads", "2024-03-02", "ads"),
            ("http://y.x.bad.example/", "2024-03-02", ""), (None, "2024-01-15", ""), ("nonsense", "2024-01-15", ""),
            ("http://bad.example/", None, ""), ("http://bad.example/", "2024-01-15", "spam")] * 2
    captures = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "n int, url string, fetched_on string, want string")
    got = url_filter.filter_urls(captures.withColumn("lists", F.lit(1)), changes, keep=("n", "want"))
    assert {r["n"]: ",".join(r["lists"]) for r in got.collect()} == {i: u[2] for i, u in enumerate(urls)}
    assert url_filter.filter_urls(captures, changes.limit(0), keep=("n",)).where("blocked").count() == 0


def test_url_plan_is_native(spark, root, capsys):
    QUERIES["op2_temporal_lists"](spark, root).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


# personal data

def test_personal_data(spark, root, docs):
    got = {r["doc_id"]: r for r in QUERIES["op3_anchor_pii"](spark, root).collect()}
    for d, t in docs:
        base = brute.base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in brute.PATTERNS] == [sum(x[0] == k for x in base) for k in brute.PATTERNS]
        assert set(filter(None, text.split(","))) <= set(got[d]["spans"].split(","))


@given(st.text(st.sampled_from("1234567890 .-+@ab()%_٣é\n"), max_size=60))
@settings(deadline=None, max_examples=500)
def test_anchors_find_the_base(text):
    spans = pii.find_spans(text, pii.automaton())
    assert [s for s in spans if s[0] in pii.BASE] == brute.base_spans(text)


def test_masking(spark, odd, none):
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in pii.mask_texts(odd).collect()}
    assert got[(8, 44)] == "mail <email> or <phone> now" and got[(1, 0)] is None
    assert got[(13, 0)] == "<card> and <ip>, token = \"<account>\" <url>."
    assert pii.mask_texts(odd).columns == odd.columns and pii.mask_texts(none).count() == 0
    assert "spans_" in pii.with_spans(odd).columns


def test_identifier_cues():
    find = lambda t: pii.find_spans(t, pii.automaton())
    assert find("IBAN: GB82 WEST 1234 5698 7654 32.") == [("iban", 6, 33)]
    assert find("the token of our time") == [] and find("mytoken = abcd1234efgh") == []


# quality

def test_quality(spark, root, docs):
    same(rows(QUERIES["op4_host_quality"](spark, root), 7), brute.quality(docs))


def test_quality_of_odd_rows(spark, odd, none):
    judged = quality.judge(odd)
    assert judged.columns == [*odd.columns, "quality_"]
    same(rows(judged.select("doc_id", *[f"quality_.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                                "n_repeat_words", "base_failed")])), brute.quality(SMALL))
    assert judged.where("quality_.base_failed AND quality_.kept").count() == 0
    assert quality.quality_filter(odd).columns == odd.columns and quality.quality_filter(none).count() == 0


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    text = b" ".join(words).decode()
    assert quality.repeated_words(words) == brute.quality([(0, text)])[0][5]


def test_prior_and_hosts(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "good") for i in range(60)]
    bad = [(100 + i, "spam " * 30, "bad") for i in range(40)] + [(200, good[0][1], "bad")]
    one = [(300, "spam " * 30, "tiny"), (301, good[1][1], "tiny")]
    df = spark.createDataFrame(good + bad + one, "doc_id long, text string, source string")
    kept = {r[0] for r in quality.quality_filter(df).select("doc_id").collect()}
    assert kept == {*range(60), 301}     # one clean document of a hopeless host goes, none of a small one
    hosts = spark.createDataFrame([(10, 1), (1000, 100), (50, 5)], "n long, f long")
    prior = quality.fit_prior(hosts, "f", "n")
    assert 0.09 < prior.a / (prior.a + prior.b) < 0.11 and prior.a + prior.b > 100   # no spread: a heavy prior


# token files

@pytest.fixture(scope="module")
def word_encoder():
    return tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_remembered_ids(name, docs):
    enc = tokens.Encoder(tokens.vocabulary(name))
    texts = [t for _, t in docs] + [t for _, t in SMALL]
    for _ in range(2):
        ids, counts = enc.encode(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert all(p.tolist() == enc.library.encode(t or "", add_special_tokens=False).ids for p, t in zip(parts, texts))

    @given(st.text(st.sampled_from("abXé ßÉİΣ中09.,!'-_*  \n\t́ \x1c"), max_size=30))
    @settings(deadline=None, max_examples=400)
    def odd_texts(t):
        assert enc.encode([t])[0].tolist() == enc.library.encode(t, add_special_tokens=False).ids

    odd_texts()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens(name):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.vocabulary(name))
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", end, end * 2, f"{start}word {end}", f"one\n{start}\n\ntwo {end}. ",
             "<|ENDOFTEXT|> x", "<|endof text|>", "<|endof", "text|> plain words", f"plain {end}words", None, "hello world"]
    enc = tokens.Encoder(tokens.vocabulary(name))
    for _ in range(2):
        ids, counts = enc.encode(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]

    @given(st.lists(st.sampled_from([end, start, "ab", " ", "\n", "<|", "|>", "end", "é.", "of", "text"]), max_size=12).map("".join))
    @settings(deadline=None, max_examples=300)
    def mixed(t):
        assert enc.encode([t])[0].tolist() == fresh.encode(t, add_special_tokens=False).ids

    mixed()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_what_comes_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 700)
    enc = tokens.Encoder(tokens.vocabulary(name))
    learned, asked = [], []
    learn, put_words = enc._learn, enc._put_words
    monkeypatch.setattr(enc, "_learn", lambda p: (learned.extend(p), learn(p)))
    monkeypatch.setattr(enc, "_put_words", lambda w: (asked.extend(w), put_words(w)))
    often = " ".join(f"Again{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    for k in range(12):
        text = f"{often} " + " ".join(f"Once{''.join(chr(97 + int(c)) for c in str(100 * k + i))}," for i in range(100))
        assert enc.encode([text, None])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
        assert len(enc.places) <= 700 + 500
    assert sum("Againab" in p for p in learned) == 1
    assert enc.encode(["so Word WORD wOrd"])[0].tolist() == enc.library.encode("so Word WORD wOrd", add_special_tokens=False).ids
    assert sum("word" in w.lower() for w in asked) == (1 if enc.folds else 3)


def test_tasks_let_go_of_encoders(spark, docs):
    table = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    assert packing.tokenised(table, "byte_bpe_50k.json", 0).count() == 2
    left = common.per_row(table, lambda: lambda texts: [(len(common.lasting),) for _ in texts], ["text"], "n long")
    tokens.encoder("byte_bpe_50k.json")
    assert common.lasting and {r["n"] for r in left.collect()} == {0}
    common.let_go()
    assert not common.lasting


def test_added_tokens_in_shards_and_sequences(spark):
    from tokenizers import Tokenizer

    docs = [(1, "first one"), (2, "hello <|endoftext|> world <|startoftext|>"), (3, "the<|endoftext|>last")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name, run, end in (("word_bpe_49k.json", repair.round_trip, 1), ("byte_bpe_50k.json", packing.pack, 0)):
        library = Tokenizer.from_file(tokens.vocabulary(name))
        ids = [library.encode(t, add_special_tokens=False).ids + [end] for _, t in docs]
        assert [r["ids_crc32"] for r in run(df).orderBy("doc_id").collect()] == [crc(i) for i in ids]


def ids_of(enc, texts, end):
    return [enc.library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repair_shards(spark, root, docs, word_encoder):
    at, expected = 0, []
    for (d, t), ids in zip(sorted(docs), ids_of(word_encoder, [t for _, t in sorted(docs)], 1)):
        expected.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    same(rows(QUERIES["op5_repair_shards"](spark, root)), expected)


def test_repair_of_odd_rows(spark, odd, none, word_encoder):
    got = repair.round_trip(odd, shard_ids=1000)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted(
        (len(i), crc(i)) for i in ids_of(word_encoder, [t for _, t in SMALL], 1))
    ordered = got.orderBy("start").collect()
    assert [r["doc_id"] for r in ordered] == sorted((d for d, _ in SMALL), key=lambda d: (d is not None, d or 0))
    assert repair.round_trip(none).count() == 0


@given(st.lists(st.integers(0, 5), max_size=200), st.integers(0, 220), st.integers(0, 220))
@settings(deadline=None, max_examples=200)
def test_grammar(ids, a, b):
    ids = np.array(ids, np.int32)
    g = repair.build(ids, 1, 10, 60, 2)
    shard = repair.read_shard(repair.write_shard([3, None], [1, len(ids)], g))
    assert shard.keys == [3, None] and (shard.ids() == ids).all()
    assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    assert 1 not in g.left and 1 not in g.right


def test_grammar_shrinks_repeats():
    ids = np.tile(np.arange(2, 50, dtype=np.int32), 400)
    g = repair.build(ids, 1, 100)
    assert len(g.symbols) + 2 * len(g.left) < len(ids) / 10 and (repair.expand(g, g.symbols) == ids).all()


# packing

def pieces(enc, docs, capacity=2048):
    out = []
    for (d, _), ids in zip(docs, ids_of(enc, [t for _, t in docs], 0)):
        at = 0
        for k, n in enumerate(packing.cut(len(ids), capacity)):
            out.append((d, k, at, n, crc(ids[at:at + n])))
            at += n
    return out


def well_packed(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, root, docs):
    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    got = QUERIES["op6_dominance_packing"](spark, root).collect()
    same(sorted((tuple(r)[:5] for r in got), key=repr), pieces(enc, docs))
    assert well_packed(got, 2048) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_of_odd_rows(spark, odd, none):
    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    packed = packing.pack(odd, capacity=64, keep_ids=True)
    got = packed.collect()
    same(sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr),
         pieces(enc, SMALL, 64))
    n = well_packed(got, 64)
    whole = packing.sequences(packed).collect()
    assert len(whole) == n and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(none).count() == 0


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@given(st.sampled_from([10, 17, 23]), st.data())
@settings(deadline=None, max_examples=300)
def test_reduction_keeps_the_optimum(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=8))
    fixed, left = packing.reduce({n: items.count(n) for n in set(items)}, capacity)
    assert sum(p.times for p in fixed) + fewest(list(left.elements()), capacity) == fewest(items, capacity)
    plan = packing.plan({n: items.count(n) for n in set(items)}, capacity)
    assert sorted(n for p in plan for n in p.lengths * p.times) == sorted(items)
    assert all(sum(p.lengths) <= capacity for p in plan)


# language and toxicity

def test_language(spark, root, odd, none):
    got = QUERIES["op7_hyperdimensional"](spark, root).join(
        spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    strange = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert len(strange) == len({d for d, _ in SMALL}) and strange[1]["lang_pred"] == strange[3]["lang_pred"] == "und"
    assert language.identify(none).count() == 0
    assert language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def toxic_table(spark):
    import random

    rng = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grobian", "lump", "schuft"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(None, "lump"), (5000, None), (5001, ""), (5002, "schuft lump schuft")]
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)),
            spark.createDataFrame(labels + [(3, None), (3, 0)], "doc_id long, toxic int"))


def test_toxicity(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.score(docs, labels)
    rated = {r["doc_id"]: r for r in got.collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rated[i]["held_out"] == (i in held) for i in range(20))
    assert all(rated[i]["predicted"] == (i % 5 == 0) for i in held)
    assert rated[5002]["predicted"] == 1 and rated[5000]["score"] == rated[5001]["score"] < 0.5
    joined = toxicity.score(docs, labels, most_rows=0)          # the way for a model too large to be sent
    other = {r["doc_id"]: r["score"] for r in joined.collect()}
    assert all(abs(other[d] - r["score"]) < 1e-6 for d, r in rated.items())
    assert toxicity.score(docs, labels.limit(0)).where("score != 0").count() == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_copies_are_no_evidence(spark):
    texts = [(f"quite ordinary words number{i} stand here", 0) for i in range(300)] + [("a b c d e f g h", 1)] * 100
    counts = toxicity.count_pairs(spark.createDataFrame(texts, "text string, label long"))
    assert counts.where("toxic > 50 AND fresh_toxic < 2").count() == counts.where("toxic > 50").count() > 0


@pytest.mark.parametrize("times", [1, 10, 100])
def test_frequent_pairs_keep_their_evidence(spark, times):
    share = 0.1
    pairs = [("toxic", 50 * times, 10 * times), ("ordinary", 10 * times, 900 * times), ("neither", 10 * times, 90 * times)]
    df = spark.createDataFrame([(n, t, o, t, o) for n, t, o in pairs],
                               "name string, toxic long, ordinary long, fresh_toxic long, fresh_ordinary long")
    told = {r[0] for r in df.where(toxicity._evidence_in_places(share) >= toxicity.EVIDENCE).select("name").collect()}
    assert told == {"toxic", "ordinary"}


def test_places_are_counted_in_full(spark):
    texts = [(f"u{i} bad pair", 1) for i in range(600)] + [(f"u{i} bad pair", 0) for i in range(150)] * 2 \
        + [(f"u{i} good pair", 0) for i in range(5400)] + [(f"u{i} good pair", 1) for i in range(40)]
    labelled = spark.createDataFrame(texts, "text string, label long").repartition(5)
    got = toxicity.count_pairs(labelled).where("fresh_toxic + fresh_ordinary > 2").select(
        "toxic", "ordinary", "fresh_toxic", "fresh_ordinary")
    assert rows(got) == sorted([(600, 300, 600, 150), (40, 5400, 40, 5400)], key=repr)
    assert toxicity.fit(labelled).pairs.count() == 2


def test_curve():
    at, rate = toxicity.curve(np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(rate) >= 0).all() and len(at) == len(rate)


def test_calibration_reads_all_rows(spark):
    df = spark.range(0, 60_000, 1, 3).select((F.col("id") >= 50_000).cast("double").alias("ratio"),
                                             (F.col("id") >= 50_000).cast("long").alias("label"))
    at, rate = toxicity.calibrate(df)     # the toxic rows stand at the end
    assert at.tolist() == [0.0, 1.0] and rate[0] < 0.01 and rate[1] > 0.99


# archives

def test_archives(spark, tmp_path):
    big, html = "x" * 1200, "y" * 999
    pages = spark.createDataFrame([
        (1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX-Bad: 1", big), (4, "http://a", html), (5, "http://b", html),
        (6, "http://c", None), (7, "http://c", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 80), (None, "http://d", big),
        (8, "http://é", "é" * 600), (8, "http://é", "é" * 600)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    got = warc.resolve(spark, f"{tmp_path}/w").collect()
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert kinds == sorted([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (None, "revisit", 3),
                            *[(i, "response", None) for i in (4, 5, 6, 7, 8, 8)]], key=repr)
    assert {r["payload_bytes"] for r in got} == {1200, 999, 0, 26 * 80}
    assert all(r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() for r in got if r["refers_to"])
    import glob

    blocks = [b for f in glob.glob(f"{tmp_path}/w/*.gz") for b in warc.parse(open(f, "rb").read())]
    assert sum(h["warc-type"] == "revisit" and b.endswith(b"\r\n\r\n") for h, b in blocks) == 3
    assert warc.deduplicated(pages.limit(0)).count() == 0


# near copies

def test_components(spark, root, docs):
    same(rows(QUERIES["op10_rare_first_join"](spark, root)), brute.components(docs))


def copies():
    import random

    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    out = [(i, " ".join(f"r{i}q{k}" for k in range(rng.randrange(1, 30)))) for i in range(40)]
    for i in range(120):       # a group of near copies, many of which are near some others only
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append((100 + i, " ".join(w)))
    return out + [(300 + i, f"x{i % 3} y z") for i in range(12)] + [(400, "a b"), (401, "A B"), (402, ""), (403, None)]


@pytest.mark.parametrize("members, small", [(1000, True), (30, False)])
def test_components_of_copies(spark, members, small, monkeypatch):
    """In one block and by broadcasts; and in many blocks, with rows thinned by bitmaps."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    if not small:
        monkeypatch.setattr(jaccard, "small_enough", lambda *a: False)
    got = jaccard.near_duplicates(spark.createDataFrame(copies(), "doc_id long, text string"))
    same(rows(got.drop("text_hash")), brute.components(copies()))


def test_bitmap(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAP_BITS", 22)
    rng = np.random.default_rng(1)
    numbers = rng.integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(x),) for x in numbers], "x long").repartition(3)
    bits = jaccard.bitmap(df, "x")
    assert jaccard._set(bits, numbers).all() and jaccard._set(bits, rng.integers(-2**63, 2**63 - 1, 5000)).mean() < 0.01
    assert not jaccard.bitmap(df.limit(0), "x").any()


def test_texts_move_little(spark, monkeypatch):
    """A cluster of near copies: a member goes to its home and to few others, whatever it has in common."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 150)
    rng, base = random.Random(5), [f"b{i}" for i in range(300)]
    docs = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    signed = jaccard.stage(jaccard.signatures(df))
    classes = jaccard.stage(signed.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"), F.first("node").alias("node")))
    members = jaccard.stage(jaccard.groups_of(signed, classes, jaccard.Params()))
    homes = jaccard.stage(jaccard.homes_of(members, classes))
    assert members.count() > 10 * classes.count() and homes.count() <= classes.count()
    found = jaccard.links(signed, classes, df, "doc_id", "text", jaccard.Params())
    visits = jaccard._visits(members, homes, found, False)
    assert visits.where("visitor").count() < 2 * classes.count()


def test_near_copies_of_odd_rows(spark, odd, none):
    got = rows(jaccard.near_duplicates(odd).select("doc_id", "n_shingles", "component_id"))
    unique = {d: c for d, _, c in got}
    assert unique[5] == unique[6] == 4 and unique[12] == 11 and unique[1] == 1 and unique[None] is None
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or 0 for r in left.collect())) == [0, 1, 2, 3, 4, 7, 8, 8, 9, 10, 11, 13]
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_connected(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 60), (60, 70), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 50 for i in (50, 60, 70, 100)) and len(got) == 44
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0

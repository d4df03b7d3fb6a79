"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import table
from . import (decontaminate, html_text, jaccard, language, lexical, packing, pii, quality, repair, resampling,
               toxicity, url_filter, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, root)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op4_host_quality")
def host_quality(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text", "source")
    return quality.judge(docs, keep=["doc_id"]).select(
        "doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "base_failed", "kept")],
        F.round("quality.host_rate", 6).alias("host_rate"))


@query("op3_anchor_pii")
def anchor_pii(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    return pii.summary(docs).drop("text")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
o AS (SELECT payload_digest, max(page_id) AS original FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM h LEFT JOIN o USING (payload_digest)
"""


@query("op8_warc_revisits", OP8_SQL)
def warc_revisits(spark, root):
    return warc.deduplicated(table(spark, root, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_positional_index")
def positional_index(spark, root):
    index = decontaminate.build_index(table(spark, root, "documents"))
    found = decontaminate.report(index, decontaminate.phrases_of(table(spark, root, "benchmark")))
    return found.select(F.col("doc_key").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


@query("op10_rare_first_join")
def rare_first_join(spark, root):
    return jaccard.near_duplicates(table(spark, root, "documents")).drop("text_hash")


@query("op6_dominance_packing")
def dominance_packing(spark, root):
    return packing.pack(table(spark, root, "documents"))


@query("op5_repair_shards")
def repair_shards(spark, root):
    return repair.round_trip(table(spark, root, "documents"))


def byte_of(column, at):
    """A number from 0 to 255 that hangs on a text alone."""
    return F.conv(F.substring(F.md5(column), at, 2), 16, 10).cast("int")


def dated_captures(pages):
    """Pages with a day of fetching in 2024, which hangs on the page id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"),
                                                     F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched_on"))


def list_changes(pages):
    """Dated changes of three lists about the hosts, parent domains and first path parts of the pages.

    A pattern is added on a day given by its digest, removed 20 to 83 days later unless the digest
    says it stays, and added once more 40 days after that for one digest in four.
    """
    host = url_filter.host_of(F.col("url"))
    first = F.split(url_filter.path_of(F.col("url")), "/")[0]
    named = pages.select(F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("pattern")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.[^.]+\.)", "").alias("pattern")),
        F.struct(F.lit("path").alias("kind"), F.concat_ws("/", host, first).alias("pattern")))).alias("n")) \
        .select("n.*").where("pattern IS NOT NULL").distinct()
    start = F.date_add(F.lit("2024-01-01").cast("date"), byte_of("pattern", 1))
    stays, again = F.pmod(byte_of("pattern", 3), F.lit(3)) == 0, F.pmod(byte_of("pattern", 5), F.lit(4)) == 0
    end = F.date_add(start, 20 + F.pmod(byte_of("pattern", 7), F.lit(64)))
    change = lambda action, day, n: F.struct(F.lit(action).alias("action"), day.alias("changed_on"), F.lit(n).alias("seq"))
    changes = F.filter(F.array(change("add", start, 1), F.when(~stays, change("remove", end, 2)),
                               F.when(~stays & again, change("add", F.date_add(end, 40), 3))), lambda c: c.isNotNull())
    listed = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), F.pmod(byte_of("pattern", 9), F.lit(3)) + 1)
    return named.where(byte_of("pattern", 11) < 160) \
        .select(listed.alias("list"), "kind", "pattern", F.explode(changes).alias("c")).select("list", "kind", "pattern", "c.*")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
names AS (
  SELECT 'host' AS kind, host AS pattern FROM p
  UNION SELECT 'domain', CASE WHEN host LIKE '%.%.%.%' THEN regexp_replace(host, '^[^.]+\.', '') ELSE host END FROM p
  UNION SELECT 'path', host || '/' || split_part(path, '/', 1) FROM p),
b AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 2))::INT AS b1, ('0x' || substr(md5(pattern), 3, 2))::INT % 3 = 0 AS stays,
         ('0x' || substr(md5(pattern), 5, 2))::INT % 4 = 0 AS again, ('0x' || substr(md5(pattern), 7, 2))::INT % 64 AS b4,
         ['adult', 'malware', 'spam'][('0x' || substr(md5(pattern), 9, 2))::INT % 3 + 1] AS list
  FROM names WHERE ('0x' || substr(md5(pattern), 11, 2))::INT < 160),
spans AS (
  SELECT list, kind, pattern, DATE '2024-01-01' + b1 AS since,
         CASE WHEN stays THEN DATE '9999-12-31' ELSE DATE '2024-01-01' + b1 + 20 + b4 END AS until FROM b
  UNION ALL
  SELECT list, kind, pattern, DATE '2024-01-01' + b1 + 60 + b4, DATE '9999-12-31' FROM b WHERE NOT stays AND again),
hits AS (
  SELECT DISTINCT p.page_id, s.list, s.since FROM p JOIN spans s ON s.since <= p.fetched_on AND p.fetched_on < s.until
  AND ((s.kind = 'host' AND s.pattern = p.host) OR (s.kind = 'domain' AND ('.' || p.host) LIKE ('%.' || s.pattern))
    OR (s.kind = 'path' AND (p.host || '/' || lower(p.path) || '/') LIKE (s.pattern || '/%') AND p.path <> '')))
SELECT p.page_id, p.host, CAST(p.fetched_on AS VARCHAR) AS fetched_on,
       coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists,
       CAST(min(h.since) AS VARCHAR) AS since, count(h.list) > 0 AS blocked
FROM p LEFT JOIN hits h ON p.page_id = h.page_id GROUP BY ALL
"""


@query("op2_temporal_lists", OP2_SQL)
def temporal_lists(spark, root):
    pages = table(spark, root, "pages").select("page_id", "url")
    return url_filter.filter_urls(dated_captures(pages), list_changes(pages), keep=("page_id",)).select(
        "page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"),
        F.array_join("lists", ",").alias("lists"), F.col("since").cast("string").alias("since"), "blocked")


@query("op7_hyperdimensional")
def hyperdimensional(spark, root):
    return language.identify(table(spark, root, "documents"))


@query("op9_kneser_ney")
def kneser_ney(spark, root):
    return toxicity.score(table(spark, root, "documents"), table(spark, root, "labels"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i::UINTEGER AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS n, text FROM documents
          UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, id, n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, n, unnest(w) AS f FROM words
  UNION ALL SELECT side, n, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words),
counted AS (SELECT side, n, f, count(*) AS c FROM features GROUP BY ALL),
hex AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce([('0x' || substr(h, 2 * i - 1, 2))::UINTEGER for i in range(1, len(h) // 2 + 1)],
    lambda c, b: xor(c >> 8, t[xor(c & 255, b)::INT + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) % 10000 AS b
  FROM hex, crc),
bucketed AS (SELECT side, n, b, sum(c)::BIGINT AS c FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(c) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(c) FILTER (side = 1), 0)::BIGINT AS t
         FROM bucketed GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (tot_s + 10000) / ((s + 1)::DOUBLE * (tot_t + 10000))))::BIGINT AS g
          FROM sums, (SELECT sum(s)::DOUBLE AS tot_s, sum(t)::DOUBLE AS tot_t FROM sums)),
weights AS (SELECT n, sum(c)::BIGINT AS m, floor(sum(c * g)::DOUBLE / sum(c))::BIGINT AS weight
            FROM bucketed JOIN gains USING (b) WHERE side = 0 GROUP BY n),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(m, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT
           AS score
  FROM words LEFT JOIN weights USING (n) WHERE side = 0),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 25 // 100 AS drawn
           FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


@query("op11_dictionary_resampling", OP11_SQL)
def dictionary_resampling(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, root, "benchmark"), keep=["doc_id"]).select(
        "doc_id", *[f"draw.{c}" for c in ("n_features", "weight", "score", "rank")])


@query("op12_tag_ratio_text")
def tag_ratio_text(spark, root):
    pages = table(spark, root, "pages").select("page_id", "url", "html")
    return html_text.with_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
totals AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (SELECT r, item_id, term, count(*) AS rep FROM (SELECT r, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
            FROM tf, totals GROUP BY term, big_n),
scored AS (
  SELECT a.r, a.item_id, t.r AS dr, t.doc_id,
         sum(rep * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked a JOIN tf t USING (term) JOIN weights USING (term), totals GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


@query("op13_treap_search", OP13_SQL)
def treap_search(spark, root):
    index = lexical.build_index(table(spark, root, "documents"))
    return lexical.search(index, table(spark, root, "benchmark"), k=20)

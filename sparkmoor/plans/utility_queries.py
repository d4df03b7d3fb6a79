"""Queries on sparse matrices, patterns, checksums and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import Staged
from ..functions.vectors import rounded
from ..functions.staging import new_folder
from ..operators import sizes, sparse, utility
from ..sources import configs
from ..sources.tables import table
from .registry import query, r6


def order_matrix(spark, root):
    """Orders by parts: quantities ordered."""
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))


def part_vector(spark, root) -> Staged:
    x = table(spark, root, "part").select(F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("x"))
    return Staged(x, x.count())


def chosen_rows(spark, root):
    orders = table(spark, root, "orders")
    return orders.select(F.col("o_orderkey").alias("place"), (F.col("o_orderkey") * 2 + F.col("o_custkey")).alias("row")), orders.count()


PRODUCT = """m AS (SELECT l_orderkey AS row, sum(l_quantity * p_retailprice) AS y FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
  sel AS (SELECT o_orderkey AS place, (o_orderkey * 2 + o_custkey) % (SELECT count(*) FROM orders) AS row FROM orders)"""


@query("spmv_rows", f"WITH {PRODUCT} SELECT row, {r6('coalesce(y, 0)')} AS y FROM (SELECT DISTINCT row FROM sel) LEFT JOIN m USING (row)")
def spmv_rows(spark, root):
    rows, n = chosen_rows(spark, root)
    return sparse.spmv_rows(order_matrix(spark, root), part_vector(spark, root), rows, n).withColumn("y", rounded("y"))


@query("spmv_positions", f"WITH {PRODUCT} SELECT place, {r6('coalesce(y, 0)')} AS y FROM sel LEFT JOIN m USING (row)")
def spmv_positions(spark, root):
    rows, n = chosen_rows(spark, root)
    return sparse.spmv_positions(order_matrix(spark, root), part_vector(spark, root), rows, n).withColumn("y", rounded("y"))


@query("spmv_verify", f"""WITH {PRODUCT}, a AS (SELECT DISTINCT row, coalesce(y, 0) AS y FROM sel LEFT JOIN m USING (row)),
  e AS (SELECT l_orderkey AS row, list_inner_product(list(l_quantity::DOUBLE), list(p_retailprice::DOUBLE)) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS y
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
  SELECT count(*) AS n_rows, count_if(abs(a.y - e.y) > 1e-5)::BIGINT AS n_errors FROM a JOIN e USING (row)""")
def spmv_verify(spark, root):
    """The product against one by lists of each order's cells, spoilt in every fifth order."""
    price = table(spark, root, "part").select(F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("x"))
    cells = order_matrix(spark, root).join(price, "col")
    by_order = cells.groupBy("row").agg(F.collect_list(F.struct("val", "x")).alias("cells"))   # the lines of one order
    product = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["val"] * c["x"])
    expected = by_order.select("row", (product + F.when(F.col("row") % 5 == 0, 1.0).otherwise(0.0)).alias("y"))
    return sparse.count_mismatches(spmv_rows(spark, root), expected, "row", "y")


@query("scatter_write", """WITH w AS (SELECT l_partkey * 7 AS idx, max_by(l_extendedprice, l_orderkey * 16 + l_linenumber) AS data FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS idx, coalesce(data, o_totalprice) AS value FROM orders LEFT JOIN w ON idx = o_orderkey""")
def scatter_write(spark, root):
    buffer = table(spark, root, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("value"))
    writes = table(spark, root, "lineitem").select((F.col("l_partkey") * 7).alias("dest"), F.col("l_extendedprice").alias("data"),
                                                   (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("n"))
    return sparse.scatter(buffer, writes, ["n"])


@query("index_patterns", """SELECT o_orderkey, (o_orderkey + 5) % 4294967296 AS sequential, (o_orderkey * 300007 + 5) % 4294967296 AS strided,
  (CASE WHEN o_orderkey < 2 THEN o_orderkey ELSE 1::BIGINT << least(o_orderkey - 1, 31)::INTEGER END + 5) % 4294967296 AS pattern,
  (o_orderkey // 16 + 170) % 4294967296 AS written FROM orders""")
def index_patterns(spark, root):
    i = F.col("o_orderkey")
    return table(spark, root, "orders").select(
        i, utility.generated_index(i, start=5).alias("sequential"),
        utility.generated_index(i, "strided", 300007, 5).alias("strided"),
        utility.generated_index(i, "pattern", start=5).alias("pattern"),
        utility.block_pattern(i, 170).alias("written"))


@query("pattern_verify", """SELECT o_orderstatus, count(*) AS n_words, count_if(o_custkey % 3 = 0)::BIGINT AS n_errors FROM orders GROUP BY 1""")
def pattern_verify(spark, root):
    """A third of the written words are spoilt and have to be found."""
    i = F.col("o_orderkey")
    spoilt = F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)
    words = table(spark, root, "orders").select("o_orderstatus", i, (utility.block_pattern(i, 170) + spoilt).alias("word"))
    return utility.verify_pattern(words, "o_orderkey", "word", 170, ["o_orderstatus"])


@query("checksum", """SELECT l_returnflag, (sum((l_partkey * 1000003 - l_suppkey) % 4294967296 + 4294967296) % 4294967296)::BIGINT AS checksum,
  count(*) AS n_words FROM lineitem GROUP BY 1""")
def checksum(spark, root):
    words = table(spark, root, "lineitem").select("l_returnflag", (F.col("l_partkey") * 1000003 - F.col("l_suppkey")).alias("word"))
    return utility.checksum(words, "word", ["l_returnflag"])


_PCT = ", ".join(f"list_sort(list(value))[(count(*) * {p} // 100 + 1)::BIGINT] AS p{p}" for p in (50, 90, 99))


@query("latency_summary", f"""SELECT event_type, count(*) AS n, {r6('sum(value)')} AS total, {r6('avg(value)')} AS mean, min(value) AS least, max(value) AS most, {_PCT}
  FROM events GROUP BY 1""")
def latency_summary(spark, root):
    """Event values as latencies of their type."""
    return utility.latency_summary(table(spark, root, "events"), "event_type", "value")


@query("best_setting", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
  m AS (SELECT event_type, count(*) AS n_runs, {r6('avg(value)')} AS mean FROM r WHERE n > 3 GROUP BY 1)
  SELECT *, mean = (SELECT min(mean) FROM m) AS is_best FROM m""")
def best_setting(spark, root):
    return utility.best_setting(table(spark, root, "events"), "event_type", "value", "event_id")


_SCANNED = utility.SCANNED.replace("'", "''")


@query("source_blocks", rf"""WITH t AS (SELECT page_id, regexp_replace(html, '([;>])', '\1' || chr(10), 'g') AS html FROM pages),
  l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line_no FROM t),
  x AS (SELECT page_id, line_no, unnest(regexp_extract_all(line, '{_SCANNED}')) AS lexeme, generate_subscripts(regexp_extract_all(line, '{_SCANNED}'), 1) AS no FROM l),
  m AS (SELECT *, regexp_matches(lexeme, '{utility.WORD_BEFORE}') AS opens, lexeme = '}}' AS closes, nullif(regexp_extract(lexeme, '{utility.CLASS_NAME}', 1), '') AS head
    FROM x WHERE NOT regexp_matches(lexeme, '^["''/]')),
  d AS (SELECT page_id, line_no, lexeme, opens, closes, head, row_number() OVER w - 1 AS "at", sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER w AS depth,
    coalesce(sum(CASE WHEN opens OR closes OR lexeme = ';' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement,
    sum(CASE WHEN lexeme = 'override' THEN 1 ELSE 0 END) OVER w AS so_far FROM m WINDOW w AS (PARTITION BY page_id ORDER BY line_no, no)),
  h AS (SELECT *, min(head) OVER (PARTITION BY page_id, statement) AS class FROM d),
  e AS (SELECT *, lead(line_no) OVER s AS last_line, lead(so_far) OVER s AS after FROM (
    SELECT *, depth + CASE WHEN opens THEN 0 ELSE 1 END AS level FROM h WHERE opens OR closes) WINDOW s AS (PARTITION BY page_id, level ORDER BY "at"))
  SELECT page_id, "at"::INTEGER AS "at", coalesce(class, regexp_extract(lexeme, '{utility.WORD_BEFORE}', 1)) AS name, class IS NOT NULL AS is_class,
    depth::INTEGER AS depth, line_no::INTEGER AS line_no, last_line::INTEGER AS last_line, (after - so_far)::BIGINT AS n_overrides FROM e WHERE opens""")
def source_blocks(spark, root):
    """Blocks in braces of the pages, whose tags and statements are lines here."""
    broken = F.regexp_replace("html", "([;>])", "$1\n")
    lines = table(spark, root, "pages").select("page_id", F.posexplode(F.split(broken, "\n")).alias("line_no", "line"))
    return utility.source_blocks(lines, "page_id")


@query("ranked_settings", f"""WITH m AS (SELECT user_id, count(*) AS n_runs, {r6('avg(value)')} AS mean FROM events GROUP BY 1)
  SELECT user_id, n_runs, mean FROM m ORDER BY mean, user_id LIMIT 10""")
def ranked_settings(spark, root):
    """The ten settings with the lowest means, kept as JSON lines and read back."""
    means = table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_runs"), rounded(F.avg("value")).alias("mean"))
    path = new_folder(spark, "ranked")
    configs.write_ranked(means, ["mean", "user_id"], path)
    return spark.read.schema(means.schema).json(path)


@query("summary_file", f"""SELECT event_type, count(*) AS n, min(ts)::VARCHAR AS first_ts, {r6('sum(value)')} AS total FROM events GROUP BY 1""")
def summary_file(spark, root):
    """A summary per type, kept as JSON and read back."""
    summary = table(spark, root, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_ts"), rounded(F.sum("value")).alias("total"))
    path = new_folder(spark, "summary")
    configs.write_metadata(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query("model_sizes", f"""WITH d AS (SELECT p_partkey, p_size::BIGINT * 64 AS dim, p_partkey % 32 + 1 AS n FROM part),
  c AS (SELECT *, n * 3 * dim * (2 * dim) + 3 * dim * (1 * 2 * dim) + n * dim AS layer,
    dim * 96 + 96 * n * (24 + 8) + dim * (48 + 8) + 48 * n * (24 + 32) + n * 32 * dim AS attention FROM d)
  SELECT p_partkey, layer::BIGINT AS layer, attention::BIGINT AS attention, {r6('(layer + attention) * 2 / 1073741824.0::DOUBLE')} AS gib FROM c""")
def model_sizes(spark, root):
    """Weights of a layer whose width and number of experts come from each part."""
    dim, n = F.col("p_size").cast("bigint") * 64, F.col("p_partkey") % 32 + 1
    lit = lambda x: F.lit(x).cast("bigint")
    layer = sizes.weights(sizes.expert_layer(dim, dim * 2, n, lit(1)))
    attention = sizes.weights(sizes.latent_attention(dim, lit(96), lit(48), n, lit(24), lit(8), lit(32)))
    return table(spark, root, "part").select("p_partkey", layer.alias("layer"), attention.alias("attention"),
                                             rounded(sizes.gigabytes(layer + attention, 2)).alias("gib"))

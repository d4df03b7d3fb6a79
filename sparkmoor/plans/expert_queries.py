"""Queries on expert routing.  Tokens are the embeddings; gates and layers are means of
cohorts of embeddings, so that every parameter is derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quant
from ..functions.staging import stage
from ..functions.vectors import mean_vectors, rounded, unpack
from ..operators import experts
from ..sources.tables import table
from .registry import query, r6
from .vector_queries import DIM, ELEMENTS

EXPERTS, GROUPS, TOP_GROUPS, TOP_K, INNER = 16, 4, 2, 4, 8
HALF_K = 2


def tokens(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("x"))


def cohort_means(spark, root, n):
    e = table(spark, root, "embeddings")
    return mean_vectors(e.select(F.pmod("vec_id", F.lit(n)).cast("int").alias("cohort"), "embedding"),
                        ["cohort"], "embedding")


def gate(spark, root):
    g = cohort_means(spark, root, EXPERTS)
    return g.select(F.col("cohort").alias("expert"), F.transform("vec", lambda x: x * 4).alias("vec"),
                    ((F.col("cohort") * 7 % 16 - 8) / 100).alias("bias"))


def layers(spark, root, n=EXPERTS):
    """(expert, row, w1, w3, w2): the inner rows of each expert."""
    m = cohort_means(spark, root, n * INNER)
    return m.select(F.floor(F.col("cohort") / INNER).cast("int").alias("expert"), (F.col("cohort") % INNER).alias("row"),
                    F.transform("vec", lambda x: x * 4).alias("w1"), F.transform(F.reverse("vec"), lambda x: x * 4).alias("w3"),
                    F.transform("vec", lambda x: x * 2).alias("w2"))


def grouped(spark, root):
    return experts.route_grouped(tokens(spark, root), gate(spark, root), GROUPS, TOP_GROUPS, TOP_K)


TOKENS = "x AS (SELECT vec_id AS token_id, embedding::DOUBLE[] AS x FROM embeddings)"


def means_sql(n: int, name: str = "cm") -> str:
    return f"{name} AS (SELECT c, list(m ORDER BY d) AS vec FROM (SELECT vec_id % {n} AS c, d, avg(v) AS m FROM el GROUP BY ALL) GROUP BY c)"


GATE = f"""{ELEMENTS}, {means_sql(16)}, {TOKENS}, z AS (SELECT token_id, c::INTEGER AS e, list_inner_product(x, list_transform(vec, lambda v: v * 4)) AS z,
    (c * 7 % 16 - 8) / 100 AS bias FROM x, cm)"""
GROUPED = f"""{GATE}, a AS (SELECT token_id, e, 1 / (1 + exp(-z)) AS p, 1 / (1 + exp(-z)) + bias AS b, e // 4 AS g FROM z),
  gr AS (SELECT token_id, g, sum(b) AS s FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY token_id, g ORDER BY b DESC) <= 2) GROUP BY token_id, g
    QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY s DESC, g) <= 2),
  ch AS (SELECT token_id, (row_number() OVER (PARTITION BY token_id ORDER BY b DESC, e) - 1)::INTEGER AS slot, e AS expert_id, p
    FROM a JOIN gr USING (token_id, g) QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY b DESC, e) <= 4),
  rt AS (SELECT token_id, slot, expert_id, p / sum(p) OVER (PARTITION BY token_id) * 2.5 AS weight FROM ch)"""


@query("gate_scores", f"WITH {GATE} SELECT token_id, e AS expert_id, {r6('1 / (1 + exp(-z)) + bias')} AS score FROM z")
def gate_scores(spark, root):
    s = experts.gate_scores(tokens(spark, root), gate(spark, root))
    return unpack(s, ["token_id"], "scores", "expert_id", "score").withColumn("score", rounded("score"))


@query("gate_grouped", f"WITH {GROUPED} SELECT token_id, slot, expert_id, {r6('weight')} AS weight FROM rt")
def gate_grouped(spark, root):
    return experts.routes(grouped(spark, root)).withColumn("weight", rounded("weight"))


@query("gate_softmax", f"""WITH {GATE}, a AS (SELECT token_id, e, p, p + bias AS b, e // 4 AS g FROM (
    SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY token_id) AS p FROM z)),
  gr AS (SELECT token_id, g, sum(b) AS s FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY token_id, g ORDER BY b DESC) <= 2) GROUP BY token_id, g
    QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY s DESC, g) <= 2)
  SELECT token_id, (row_number() OVER (PARTITION BY token_id ORDER BY b DESC, e) - 1)::INTEGER AS slot, e AS expert_id, {r6('p * 2.5')} AS weight
    FROM a JOIN gr USING (token_id, g) QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY b DESC, e) <= 4""")
def gate_softmax(spark, root):
    wide = experts.route_grouped(tokens(spark, root), gate(spark, root), GROUPS, TOP_GROUPS, TOP_K, "softmax")
    return experts.routes(wide).withColumn("weight", rounded("weight"))


@query("gate_split", f"""WITH {GATE}, a AS (SELECT token_id, e, e // 8 AS h, 1 / (1 + exp(-z)) + bias AS b FROM z),
  ch AS (SELECT token_id, e, b, h, row_number() OVER (PARTITION BY token_id, h ORDER BY b DESC, e) AS n FROM a QUALIFY n <= 2)
  SELECT token_id, (h * 2 + n - 1)::INTEGER AS slot, e AS expert_id, {r6('b * 2.5 / sum(b) OVER (PARTITION BY token_id)')} AS weight FROM ch""")
def gate_split(spark, root):
    wide = experts.route_split(tokens(spark, root), gate(spark, root), HALF_K)
    return experts.routes(wide).withColumn("weight", rounded("weight"))


COUNTS = f"{GROUPED}, n AS (SELECT e::INTEGER AS expert_id, count(expert_id) AS n_tokens FROM range(16) t(e) LEFT JOIN rt ON expert_id = e GROUP BY 1)"


@query("expert_counts", f"WITH {COUNTS} SELECT expert_id, n_tokens FROM n")
def expert_counts(spark, root):
    return experts.expert_counts(grouped(spark, root), EXPERTS)


PADDED = f"""{COUNTS}, gd AS (SELECT expert_id, n_tokens, coalesce(sum(n_tokens) OVER w, 0)::BIGINT AS start,
    coalesce(sum(ceil((n_tokens + 1) / 32) * 32) OVER w, 0)::BIGINT AS padded_start FROM n
    WINDOW w AS (ORDER BY expert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("group_descriptors", f"WITH {PADDED} SELECT * FROM gd")
def group_descriptors(spark, root):
    return experts.group_descriptors(expert_counts(spark, root), 32)


@query("block_experts", f"""WITH {PADDED} SELECT b.range AS block, max(expert_id)::INTEGER AS expert_id
  FROM range((SELECT ceil(sum(n_tokens) / 32)::BIGINT + 16 FROM n)) b JOIN gd ON padded_start <= b.range * 32 GROUP BY 1""")
def block_experts(spark, root):
    return experts.block_experts(expert_counts(spark, root), 32)


def ffn_sql(source: str, w1: str = "w1", w3: str = "w3", w2: str = "w2", x: str = "x") -> str:
    """Inner products, SwiGLU, then the weighted sum over rows and experts."""
    return f"""i AS (SELECT token_id, weight * (h1 / (1 + exp(-h1))) * h3 AS u, {w2} AS w2 FROM (
      SELECT token_id, weight, {w2}, list_inner_product({w1}, {x}) AS h1, list_inner_product({w3}, {x}) AS h3 FROM {source})),
    y AS (SELECT token_id, dim::INTEGER AS dim, sum(u * w) AS value FROM (
      SELECT token_id, u, unnest(w2) AS w, generate_subscripts(w2, 1) - 1 AS dim FROM i) GROUP BY ALL)"""


def layer_sql(n: int) -> str:
    return f"""{means_sql(n * 8, 'lm')}, ly AS (SELECT (c // 8)::INTEGER AS expert_id, c % 8 AS row, list_transform(vec, lambda v: v * 4) AS w1,
      list_transform(list_reverse(vec), lambda v: v * 4) AS w3, list_transform(vec, lambda v: v * 2) AS w2 FROM lm)"""


SRC = "src AS (SELECT token_id, weight, w1, w3, w2, x FROM rt JOIN x USING (token_id) JOIN ly USING (expert_id))"
FFN = f"WITH {GROUPED}, {layer_sql(16)}, {SRC}, {ffn_sql('src')} SELECT token_id, dim, {r6('value')} AS value FROM y"


def _rows(y):
    return unpack(y, ["token_id"], "y").withColumn("value", rounded("value"))


@query("expert_feed_forward", FFN)
def expert_feed_forward(spark, root):
    return _rows(experts.feed_forward(grouped(spark, root), layers(spark, root), DIM))


@query("expert_accumulate", FFN)
def expert_accumulate(spark, root):
    """The same sums by joining tiles of tokens with the weights of their expert."""
    return _rows(experts.accumulate(experts.expert_parts(grouped(spark, root), layers(spark, root), DIM)))


@query("shared_expert", f"""WITH {ELEMENTS}, {TOKENS}, {layer_sql(1)}, src AS (SELECT token_id, 1.0 AS weight, w1, w3, w2, x FROM x, ly),
  {ffn_sql('src')} SELECT token_id, dim, {r6('value')} AS value FROM y""")
def shared_expert(spark, root):
    return _rows(experts.shared_expert(tokens(spark, root), layers(spark, root, 1), DIM))


def quant_sql(scale: str, v: str, top: int) -> str:
    return f"least(greatest(round_even({v} * (1.0::DOUBLE / {scale}), 0), {-top - 1}), {top})"


@query("quantise_int16", f"""WITH {ELEMENTS}, s AS (SELECT max(abs(v)) / 32767 AS s FROM el)
  SELECT vec_id AS token_id, d::INTEGER AS dim, {quant_sql('s', 'v', 32767)}::INTEGER AS value FROM el, s""")
def quantise_int16(spark, root):
    t = tokens(spark, root)
    q = t.withColumn("q", quant.quantise(F.col("x"), quant.tensor_scale(t, "x", 16), 16))
    return unpack(q, ["token_id"], "q").withColumn("value", F.col("value").cast("int"))


INT8 = f"""{layer_sql(16)}, le AS (SELECT expert_id, row, unnest(w1) AS v, generate_subscripts(w1, 1) - 1 AS d FROM ly),
  sc AS (SELECT expert_id, greatest(max(abs(v)), 1e-8) / 127 AS scale FROM le GROUP BY 1)"""


@query("quantise_int8", f"""WITH {ELEMENTS}, {INT8} SELECT expert_id AS expert, row::INTEGER AS row, d::INTEGER AS dim, {r6('scale')} AS scale,
  {quant_sql('scale', 'v', 127)}::INTEGER AS value FROM le JOIN sc USING (expert_id)""")
def quantise_int8(spark, root):
    q = quant.grouped_int8(layers(spark, root), "expert", ["w1"])
    return unpack(q, ["expert", "row", "w1_scale"], "w1").select(
        "expert", "row", "dim", rounded("w1_scale").alias("scale"), F.col("value").cast("int").alias("value"))


def _fake_int8(df, group, cols):
    q = quant.grouped_int8(stage(df), group, cols)
    return q.select(*[quant.dequantise(F.col(c), F.col(f"{c}_scale")).alias(c) if c in cols else c for c in df.columns])


def _fake_sql(col: str) -> str:
    peak = f"greatest(max(list_max(list_transform({col}, lambda v: abs(v)))) OVER (PARTITION BY expert_id), 1e-8) / 127"
    return f"{peak} AS s_{col}"


def _deq(col: str) -> str:
    return f"list_transform({col}, lambda v: {quant_sql(f's_{col}', 'v', 127)} * s_{col})"


@query("expert_int8", f"""WITH {GROUPED}, {layer_sql(16)}, ls AS (SELECT *, {_fake_sql('w1')}, {_fake_sql('w3')}, {_fake_sql('w2')} FROM ly),
  lq AS (SELECT expert_id, {_deq('w1')} AS w1, {_deq('w3')} AS w3, {_deq('w2')} AS w2 FROM ls),
  xs AS (SELECT greatest(max(abs(v)), 1e-8) / 127 AS s FROM el), xq AS (SELECT token_id, list_transform(x, lambda v: {quant_sql('s', 'v', 127)} * s) AS x FROM x, xs),
  src AS (SELECT token_id, weight, w1, w3, w2, xq.x AS x FROM rt JOIN xq USING (token_id) JOIN lq USING (expert_id)),
  {ffn_sql('src')} SELECT token_id, dim, {r6('value')} AS value FROM y""")
def expert_int8(spark, root):
    """Feed-forward on 8-bit inputs and weights, routed by the full-precision gate."""
    wide = grouped(spark, root)
    scale = quant.tensor_scale(wide, "x", 8)
    wide = wide.withColumn("x", quant.dequantise(quant.quantise(F.col("x"), scale, 8), F.lit(scale)))
    return _rows(experts.feed_forward(wide, _fake_int8(layers(spark, root), "expert", ["w1", "w3", "w2"]), DIM))


@query("expert_int16", f"""WITH {GROUPED}, {layer_sql(16)}, xs AS (SELECT max(abs(v)) / 32767 AS s FROM el),
  xq AS (SELECT token_id, s AS xs, list_transform(x, lambda v: {quant_sql('s', 'v', 32767)}) AS x FROM x, xs),
  lq AS (SELECT expert_id, row, list_transform(w1, lambda v: round_even(v * 1000, 0)) AS w1, list_transform(w3, lambda v: round_even(v * 1000, 0)) AS w3,
    list_transform(w2, lambda v: round_even(v * 1000, 0)) AS w2 FROM ly),
  h AS (SELECT token_id, expert_id, weight, w2, list_inner_product(w1, xq.x) * 0.001::DOUBLE * xs AS h1, list_inner_product(w3, xq.x) * 0.001::DOUBLE * xs AS h3
    FROM rt JOIN xq USING (token_id) JOIN lq USING (expert_id)),
  u AS (SELECT *, h1 / (1 + exp(-h1)) * h3 AS inner_ FROM h),
  q AS (SELECT *, max(abs(inner_)) OVER (PARTITION BY token_id, expert_id) / 32767 AS sc FROM u),
  p AS (SELECT token_id, weight * round_even(inner_ * (1.0::DOUBLE / sc), 0) * sc * 0.001::DOUBLE AS f, w2 FROM q),
  e AS (SELECT token_id, f, unnest(w2) AS w, generate_subscripts(w2, 1) - 1 AS dim FROM p)
  SELECT token_id, dim::INTEGER AS dim, {r6('sum(f * w)')} AS value FROM e GROUP BY 1, 2""")
def expert_int16(spark, root):
    """Feed-forward on 16-bit inputs and weights with a requantised inner vector."""
    wide = grouped(spark, root)
    scale = quant.tensor_scale(wide, "x", 16)
    wide = wide.withColumn("x", quant.quantise(F.col("x"), scale, 16).cast("array<double>"))
    w = layers(spark, root)
    for c in ("w1", "w3", "w2"):
        w = w.withColumn(c, F.transform(c, lambda v: F.bround(v * 1000)))
    return _rows(experts.quantised_feed_forward(wide, w, DIM, scale, (0.001, 0.001, 0.001)))


@query("fp8_blocks", f"""WITH {ELEMENTS}, b AS (SELECT *, greatest(max(abs(v)) OVER (PARTITION BY vec_id, d // 16), 1e-12) / 448 AS sc FROM el)
  SELECT vec_id AS token_id, d::INTEGER AS dim, {r6('least(greatest(v / sc, -448), 448)')} AS value, {r6('sc')} AS scale FROM b""")
def fp8_blocks(spark, root):
    q = quant.block_scaled(tokens(spark, root), ["token_id"], "x", 16)
    return q.select("token_id", "scales", F.posexplode("scaled").alias("dim", "value")).select(
        "token_id", "dim", rounded("value").alias("value"), rounded(F.col("scales")[F.floor(F.col("dim") / 16).cast("int")]).alias("scale"))


@query("hadamard", f"""WITH {ELEMENTS}, s AS (SELECT i.range AS i, j.range AS j, CASE WHEN bit_count(i.range & j.range) % 2 = 0 THEN 1 ELSE -1 END AS sg FROM range(64) i, range(64) j)
  SELECT vec_id AS token_id, i::INTEGER AS dim, {r6('sum(v * sg) * 0.125')} AS value FROM el JOIN s ON d = j GROUP BY 1, 2""")
def hadamard(spark, root):
    t = quant.hadamard(tokens(spark, root), ["token_id"], "x", 0.125)
    return unpack(t, ["token_id"], "vec").withColumn("value", rounded("value"))

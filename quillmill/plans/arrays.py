"""Queries over vectors: kernels as array expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import arrays as A
from quillmill.operators import attention, blocks, tensors
from quillmill.operators import evaluation as E
from quillmill.plans.registry import Catalog

query = Catalog()

_X = "list_transform(embedding, lambda v: v::DOUBLE)"
_SOFT = f"list_transform({_X}, lambda v: exp(v - list_max({_X})) / list_sum(list_transform({_X}, lambda u: exp(u - list_max({_X})))))"
_LSE = f"(list_max({_X}) + ln(list_sum(list_transform({_X}, lambda v: exp(v - list_max({_X}))))))"


def _doubles(embeddings):
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _checks(x):
    """A vector as its weighted sum and maximum, which pin it down well enough to compare."""
    weighted = A.array_sum(F.transform(x, lambda v, i: v * (i + 1)))
    return [F.round(weighted, 6).alias("weighted"), F.round(F.array_max(x), 6).alias("top")]


def _checks_sql(x: str) -> str:
    return f"round(list_sum(list_transform({x}, lambda v, i: v * i)), 6) AS weighted, round(list_max({x}), 6) AS top"


@query("vec_softmax", "embeddings", sql=f"SELECT vec_id, {_checks_sql('s')} FROM (SELECT vec_id, {_SOFT} AS s FROM embeddings)")
def vec_softmax(embeddings):
    return _doubles(embeddings).select("vec_id", A.softmax(F.col("x")).alias("s")).select("vec_id", *_checks(F.col("s")))


@query("vec_rmsnorm", "embeddings", sql=f"SELECT vec_id, {_checks_sql('s')} FROM (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / len(x) + 1e-5)) AS s FROM (SELECT vec_id, {_X} AS x FROM embeddings))")
def vec_rmsnorm(embeddings):
    return _doubles(embeddings).select("vec_id", A.rmsnorm(F.col("x")).alias("s")).select("vec_id", *_checks(F.col("s")))


@query("vec_dot", "embeddings", sql=f"SELECT vec_id, round(list_sum(list_transform({_X}, lambda v: v * v)), 6) AS self, round(list_sum(list_transform({_X}, lambda v, i: v * i)), 6) AS ramp FROM embeddings")
def vec_dot(embeddings):
    ramp = F.transform(F.sequence(F.lit(1), F.size("x")), lambda i: i.cast("double"))
    return _doubles(embeddings).select("vec_id", F.round(A.dot(F.col("x"), F.col("x")), 6).alias("self"), F.round(A.dot(F.col("x"), ramp), 6).alias("ramp"))


@query("cross_entropy", "embeddings", sql=f"SELECT vec_id, round({_LSE} - embedding[label + 1]::DOUBLE, 6) AS loss FROM embeddings")
def cross_entropy(embeddings):
    return _doubles(embeddings).select("vec_id", F.round(A.cross_entropy(F.col("x"), F.col("label")), 6).alias("loss"))


@query("perplexity", "embeddings", sql=f"SELECT round(exp(avg({_LSE} - embedding[label + 1]::DOUBLE)), 5) AS perplexity FROM embeddings")
def perplexity(embeddings):
    return _doubles(embeddings).agg(F.round(F.exp(F.avg(A.cross_entropy(F.col("x"), F.col("label")))), 5).alias("perplexity"))


@query("token_entropy", "embeddings", sql=f"SELECT vec_id, round({_LSE} - list_sum(list_transform(list_zip({_SOFT}, {_X}), lambda z: z[1] * z[2])), 6) AS entropy FROM embeddings")
def token_entropy(embeddings):
    return _doubles(embeddings).select("vec_id", F.round(A.entropy(F.col("x")), 6).alias("entropy"))


@query("gather_log_probs", "embeddings", sql=f"SELECT vec_id, round(embedding[label + 1]::DOUBLE - {_LSE}, 6) AS log_prob FROM embeddings")
def gather_log_probs(embeddings):
    return _doubles(embeddings).select("vec_id", F.round(A.gather_log_prob(F.col("x"), F.col("label")), 6).alias("log_prob"))


@query("reduce_axis_mean", "embeddings", sql=f"SELECT label, i::INTEGER AS axis, round(avg(v), 6) AS mean FROM (SELECT label, unnest({_X}) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def reduce_axis_mean(embeddings):
    return _doubles(embeddings).select("label", F.posexplode("x").alias("axis", "v")).groupBy("label", "axis").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("rearrange_rows", "embeddings", sql=f"SELECT vec_id, {_checks_sql('list_transform(range(64), lambda k: x[k % 8 * 8 + k // 8 + 1])')} FROM (SELECT vec_id, {_X} AS x FROM embeddings)")
def rearrange_rows(embeddings):
    """Eight rows of eight, transposed."""
    turned = F.flatten(A.transpose(A.reshape(F.col("x"), 8)))
    return _doubles(embeddings).select("vec_id", turned.alias("t")).select("vec_id", *_checks(F.col("t")))


@query("rearrange_pattern", "embeddings", sql="SELECT i::BIGINT // 8 AS axis0, vec_id AS axis1, i::BIGINT % 8 AS axis2, round(v, 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def rearrange_pattern(embeddings):
    out = tensors.rearrange(tensors.vectors_as_tensor(embeddings, "vec_id", "embedding"), "n (row column) -> row n column", column=8)
    return out.select("axis0", "axis1", "axis2", F.round("value", 6).alias("value"))


@query("reduce_pattern", "embeddings", sql="SELECT vec_id AS axis0, (i % 8)::BIGINT AS axis1, round(max(v), 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def reduce_pattern(embeddings):
    out = tensors.rearrange(tensors.vectors_as_tensor(embeddings, "vec_id", "embedding"), "n (row column) -> n column", "max", column=8)
    return out.select("axis0", "axis1", F.round("value", 6).alias("value"))


@query("repeat_pattern", "embeddings", sql="SELECT vec_id AS axis0, (i * 3 + r)::BIGINT AS axis1, round(v, 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), (SELECT unnest(range(3)) AS r)")
def repeat_pattern(embeddings):
    out = tensors.rearrange(tensors.vectors_as_tensor(embeddings, "vec_id", "embedding"), "n d -> n (d times)", times=3)
    return out.select("axis0", "axis1", F.round("value", 6).alias("value"))


@query("repeat_elements", "embeddings", sql=f"SELECT vec_id, 2 * len(embedding) AS n, round(2 * list_sum({_X}), 6) AS total FROM embeddings")
def repeat_elements(embeddings):
    return _doubles(embeddings).select("vec_id", A.repeat(F.col("x"), 2).alias("r")).select("vec_id", F.size("r").cast("long").alias("n"), F.round(A.array_sum(F.col("r")), 6).alias("total"))


_ROWS8 = "list_transform(range(8), lambda r: {}(x[r * 8 + 1:r * 8 + 8]))"


@query("reduce_rows", "embeddings", sql="SELECT vec_id, " + ", ".join(
    f"round(list_sum(list_transform({_ROWS8.format(f)}, lambda v, i: v * i)){d}, 6) AS {n}" for n, f, d in (("top", "list_max", ""), ("low", "list_min", ""), ("mean", "list_sum", " / 8"))) + f" FROM (SELECT vec_id, {_X} AS x FROM embeddings)")
def reduce_rows(embeddings):
    """Each of eight rows reduced; the weighted sum of the eight results."""
    x = _doubles(embeddings).select("vec_id", A.reshape(F.col("x"), 8).alias("m"))
    weighted = lambda how: A.array_sum(F.transform(A.reduce_rows(F.col("m"), how), lambda v, i: v * (i + 1)))
    return x.select("vec_id", *[F.round(weighted(how), 6).alias(name) for name, how in (("top", "max"), ("low", "min"), ("mean", "mean"))])


_CELLS = f"SELECT vec_id, unnest({_X}) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


@query("einsum_gram", "embeddings", sql=f"SELECT a.i::INTEGER AS d, b.i::INTEGER AS e, round(sum(a.v * b.v), 5) AS value FROM ({_CELLS}) a JOIN ({_CELLS}) b USING (vec_id) GROUP BY ALL")
def einsum_gram(embeddings):
    """Second moments of all vectors; linear in their number."""
    x = blocks.from_vectors(embeddings, "vec_id", "embedding")
    return blocks.einsum("n d, n e -> d e", x, x).cells().select(F.col("d").cast("int").alias("d"), F.col("e").cast("int").alias("e"), F.round("value", 5).alias("value"))


@query("einsum_outer", "embeddings", sql=f"""WITH c AS ({_CELLS}), m AS (SELECT i, sum(v) AS m FROM c GROUP BY i)
SELECT vec_id AS n, m.i::BIGINT AS e, round(sum(c.v) * min(m.m), 4) AS value FROM c, m GROUP BY vec_id, m.i""")
def einsum_outer(embeddings):
    """Operands without a shared axis: every vector's sum times every component's sum over all vectors."""
    x = blocks.from_vectors(embeddings, "vec_id", "embedding")
    sums, columns = blocks.einsum("n d -> n", x), blocks.einsum("n d -> d", x)
    out = blocks.einsum("n, e -> n e", sums, columns).cells().join(embeddings.select(F.col("vec_id").alias("n")), "n", "left_semi")
    return out.select("n", "e", F.round("value", 4).alias("value"))


@query("linear_layer", "embeddings", sql=f"""SELECT vec_id, {_checks_sql('list_transform(range(4), lambda r: list_sum(list_transform(x, lambda v, i: v * ((i - 1) * (r + 1) % 7 - 3))))')}
FROM (SELECT vec_id, {_X} AS x FROM embeddings)""")
def linear_layer(embeddings):
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * (r + 1) % 7 - 3).cast("double")))
    return _doubles(embeddings).select("vec_id", A.linear(F.col("x"), rows).alias("y")).select("vec_id", *_checks(F.col("y")))


@query("silu", "embeddings", sql=f"SELECT vec_id, {_checks_sql('list_transform(x, lambda v: v / (1 + exp(-v)))')} FROM (SELECT vec_id, {_X} AS x FROM embeddings)")
def silu(embeddings):
    return _doubles(embeddings).select("vec_id", A.silu(F.col("x")).alias("y")).select("vec_id", *_checks(F.col("y")))


@query("pack_unpack", "embeddings", sql=f"SELECT vec_id, round(list_sum(x[1:10]), 6) AS first_part, round(list_sum(x[11:64]), 6) AS second_part FROM (SELECT vec_id, {_X} AS x FROM embeddings)")
def pack_unpack(embeddings):
    packed = _doubles(embeddings).select("vec_id", A.pack(F.slice("x", 1, 10), F.slice("x", 11, 54)).alias("p"))
    return packed.select("vec_id", F.round(A.array_sum(A.unpack(F.col("p"), 0)), 6).alias("first_part"), F.round(A.array_sum(A.unpack(F.col("p"), 1)), 6).alias("second_part"))


_SPAN = 32


@query("attention_window", "embeddings", sql=f"""
WITH h AS (SELECT label, vec_id, {_X} AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
s AS (SELECT q.vec_id AS q, list_sum(list_transform(list_zip(q.x, k.x), lambda z: z[1] * z[2])) / 8.0 AS score, k.x[1] AS v FROM h q JOIN h k ON q.label = k.label AND k.r BETWEEN q.r - {_SPAN - 1} AND q.r)
SELECT q AS vec_id, round(sum(exp(score) * v) / sum(exp(score)), 6) AS out0 FROM s GROUP BY q""")
def attention_window(embeddings):
    """Masked attention: each row looks at itself and the rows before it in its class, as far as a window reaches."""
    before = Window.partitionBy("label").orderBy("vec_id").rowsBetween(1 - _SPAN, 0)
    seen = _doubles(embeddings).select("vec_id", "x", F.collect_list("x").over(before).alias("keys"))
    first = F.transform("keys", lambda k: F.slice(k, 1, 1))
    return seen.select("vec_id", F.round(A.attention(F.col("x"), F.col("keys"), first)[0], 6).alias("out0"))


@query("causal_attention", "embeddings", sql=f"""WITH h AS (SELECT vec_id, {_X} AS x FROM embeddings),
s AS (SELECT q.vec_id AS q, k.vec_id AS k, exp(list_sum(list_transform(list_zip(q.x, k.x), lambda z: z[1] * z[2])) / 8.0) AS w FROM h q JOIN h k ON k.vec_id <= q.vec_id),
o AS (SELECT q AS vec_id, i, sum(w * v) / sum(w) AS v FROM s JOIN (SELECT vec_id AS k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM h) USING (k) GROUP BY ALL)
SELECT vec_id, round(sum(v * i), 5) AS weighted, round(max(v), 6) AS top FROM o GROUP BY vec_id""")
def causal_attention(embeddings):
    """All vectors as one sequence in order of their ids, each seeing itself and all before it; every component."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.lit(0).alias("sequence"), F.col("vec_id").alias("position"), x.alias("q"), x.alias("k"), x.alias("v"))
    out = attention.tiled_attention(rows, 64)
    weighted = A.array_sum(F.transform("out", lambda v, i: v * (i + 1)))
    return out.select(F.col("position").alias("vec_id"), F.round(weighted, 5).alias("weighted"), F.round(F.array_max("out"), 6).alias("top"))


_LOGITS = "SELECT vec_id, i - 1 AS token, v AS logit FROM (SELECT vec_id, unnest(list_transform(embedding, lambda u: u::DOUBLE * 10)) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def _logits(embeddings):
    return embeddings.select("vec_id", F.posexplode("embedding").alias("token", "v")).select("vec_id", "token", (F.col("v").cast("double") * 10).alias("logit"))


@query("top_p_filter", "embeddings", sql=f"""WITH p AS (SELECT vec_id, token, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS prob FROM ({_LOGITS})),
c AS (SELECT *, sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT vec_id, token::INTEGER AS token, round(prob, 6) AS prob FROM c WHERE c - prob <= 0.9""")
def top_p_filter(embeddings):
    return E.top_p(_logits(embeddings), "vec_id", "token", "logit", 0.9).select("vec_id", "token", F.round("prob", 6).alias("prob"))


@query("top_k_filter", "embeddings", sql=f"SELECT vec_id, token::INTEGER AS token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r FROM ({_LOGITS})) WHERE r <= 5")
def top_k_filter(embeddings):
    return E.top_k(_logits(embeddings), "vec_id", "token", "logit", 5).select("vec_id", "token")


@query("masked_mean_arrays", "embeddings", sql=f"SELECT vec_id, round(list_sum(list_transform({_X}, lambda v, i: CASE WHEN i % 2 = 1 THEN v ELSE 0 END)) / 32, 6) AS mean FROM embeddings")
def masked_mean_arrays(embeddings):
    mask = F.transform("x", lambda v, i: ((i + 1) % 2).cast("double"))
    return _doubles(embeddings).select("vec_id", F.round(A.masked_mean(F.col("x"), mask), 6).alias("mean"))


_ANGLE = "(vec_id % 7) / pow(10000, (i // 2 * 2) / 64.0)"


@query("rope", "embeddings", sql=f"""SELECT vec_id, {_checks_sql('list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN x[i + 1] * cos(' + _ANGLE + ') - x[i + 2] * sin(' + _ANGLE + ') ELSE x[i] * sin(' + _ANGLE + ') + x[i + 1] * cos(' + _ANGLE + ') END)')}
FROM (SELECT vec_id, {_X} AS x FROM embeddings)""")
def rope(embeddings):
    return _doubles(embeddings).select("vec_id", A.rope(F.col("x"), F.col("vec_id") % 7).alias("r")).select("vec_id", *_checks(F.col("r")))

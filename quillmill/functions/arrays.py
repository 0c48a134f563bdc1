"""Numeric kernels over array columns, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import let


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; an empty array stays empty."""
    z = let(F.array_max(x).cast("double"), lambda top: F.transform(x, lambda v: F.exp((v.cast("double") - top) / temperature)))
    return let(z, lambda e: let(array_sum(e), lambda total: F.transform(e, lambda v: v / total)))


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x).cast("double"), lambda top: top + F.log(array_sum(F.transform(x, lambda v: F.exp(v.cast("double") - top)))))


def rmsnorm(x: Column, eps: float = 1e-5, gain: Column | None = None) -> Column:
    scale = F.lit(1.0) / F.sqrt(array_sum(F.transform(x, lambda v: v.cast("double") * v.cast("double"))) / F.size(x) + eps)
    out = let(scale, lambda s: F.transform(x, lambda v: v.cast("double") * s))
    return out if gain is None else F.zip_with(out, gain, lambda v, g: v * g)


def linear(x: Column, rows: Column) -> Column:
    """``rows`` (array of weight rows) times ``x``."""
    return F.transform(rows, lambda w: dot(x, w))


def attention(query: Column, keys: Column, values: Column, mask: Column | None = None) -> Column:
    """Weighted mean of ``values`` by the softmax of scaled scores; ``mask`` (array of booleans) leaves keys out."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"), *([] if mask is None else [mask.alias("m")]))
    pairs = pairs if mask is None else F.filter(pairs, lambda p: p["m"])
    scaled = F.sqrt(F.size(query).cast("double"))
    weights = softmax(F.transform(pairs, lambda p: dot(query, p["k"]) / scaled))
    places = F.sequence(F.lit(1), F.size(values[0]))
    return let(weights, lambda w: F.transform(places, lambda j: dot(w, F.transform(pairs, lambda p: F.element_at(p["v"], j)))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Minus the log-probability of the target (0-based)."""
    return logsumexp(logits) - F.element_at(logits, target + 1).cast("double")


def gather_log_prob(logits: Column, target: Column) -> Column:
    return -cross_entropy(logits, target)


def entropy(logits: Column) -> Column:
    """logZ - E[logit]."""
    return logsumexp(logits) - dot(softmax(logits), logits)


def masked_mean(x: Column, mask: Column) -> Column:
    """Null where the mask is empty."""
    return F.try_divide(dot(x, mask), array_sum(mask))


def masked_normalize(x: Column, mask: Column, constant: float) -> Column:
    return dot(x, mask) / constant


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v * sigmoid(v))


def swiglu(x: Column, w1: Column, w2: Column, w3: Column) -> Column:
    gate = silu(linear(x, w1))
    return linear(F.zip_with(gate, linear(x, w3), lambda a, b: a * b), w2)


def rope(x: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Rotates consecutive pairs by position-dependent angles."""
    n = F.size(x)
    angle = lambda i: position.cast("double") / F.pow(F.lit(theta), (F.floor(i / 2) * 2) / n)
    at = lambda i: F.element_at(x, (i + 1).cast("int")).cast("double")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(i % 2 == 0, at(i) * F.cos(angle(i)) - at(i + 1) * F.sin(angle(i))).otherwise(at(i - 1) * F.sin(angle(i)) + at(i) * F.cos(angle(i))),
    )


def lr_cosine(step: Column, top: float, low: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up, cosine decay, floor."""
    part = (step - warmup) / (cycle - warmup)
    return F.when(step < warmup, step / F.lit(float(warmup)) * top).when(step > cycle, F.lit(low)).otherwise(
        F.lit(low) + 0.5 * (1 + F.cos(part * F.pi())) * (top - low)
    )


def reshape(x: Column, width: int) -> Column:
    """Rows of ``width`` consecutive elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda i: F.slice(x, i * width + 1, width))


def transpose(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(rows[0])), lambda j: F.transform(rows, lambda r: F.element_at(r, j)))


def repeat(x: Column, times: int) -> Column:
    """Each element ``times`` over."""
    return F.flatten(F.transform(x, lambda v: F.array_repeat(v, times)))


def reduce_rows(rows: Column, how: str) -> Column:
    """sum, mean, min, max or prod of each row."""
    ops = {
        "sum": array_sum,
        "mean": lambda r: array_sum(r) / F.size(r),
        "min": F.array_min,
        "max": F.array_max,
        "prod": lambda r: F.aggregate(r, F.lit(1.0), lambda a, v: a * v.cast("double")),
        "any": lambda r: F.exists(r, lambda v: v != 0),
        "all": lambda r: F.forall(r, lambda v: v != 0),
    }
    return F.transform(rows, ops[how])


def pack(*parts: Column) -> Column:
    """One array and the lengths that take it apart again."""
    return F.struct(F.concat(*parts).alias("packed"), F.array(*[F.size(p) for p in parts]).alias("lengths"))


def unpack(packed: Column, k: int) -> Column:
    """Part ``k`` of a packed column."""
    lengths = packed["lengths"]
    start = F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda a, v: a + v) if k else F.lit(0)
    return F.slice(packed["packed"], start + 1, lengths[k])

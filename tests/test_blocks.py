"""Block tensors and tiled attention against NumPy."""

import numpy as np
import pytest

from quillmill.operators import attention, blocks

RNG = np.random.default_rng(3)


def table(spark, x, names):
    return spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(x)], ", ".join(f"{n} long" for n in names) + ", value double")


def dense(tensor):
    out = np.zeros(list(tensor.lengths.values()))
    for r in tensor.cells().collect():
        out[tuple(r)[:-1]] = r["value"]
    return out


def test_einsum(spark):
    x, y, z = RNG.normal(size=(7, 10)), RNG.normal(size=(10, 5)), RNG.normal(size=(5,))
    a, b, c = (blocks.from_cells(table(spark, v, n), 4) for v, n in ((x, "ik"), (y, "kj"), (z, "j")))
    assert np.allclose(dense(a), x)
    for pattern, tensors, want in (
        ("i k, k j -> i j", (a, b), x @ y), ("i k, k j -> j i", (a, b), (x @ y).T), ("i k, k j, j -> i", (a, b, c), x @ y @ z), ("i k -> k", (a,), x.sum(axis=0)), ("i k -> k i", (a,), x.T),
        ("i k, j -> i j", (a, c), np.outer(x.sum(axis=1), z)), ("i k, j -> k i j", (a, c), np.einsum("ik,j->kij", x, z)), ("j, j ->", (c, c), z @ z), ("i k, i l -> k l", (a, a), x.T @ x),
    ):
        got = blocks.einsum(pattern, *tensors)
        assert np.allclose(got.cells().first()["value"] if not got.sides else dense(got), want), pattern
    assert blocks.size(a) == 70
    for pattern, tensors in (("i k, k j -> i j", (a,)), ("i i -> i", (a,)), ("i k, k j -> i q", (a, b)), ("i, k j -> i", (a, b)), ("i k, k j -> i j", (a, a))):
        with pytest.raises(ValueError):
            blocks.einsum(pattern, *tensors)


def test_vectors_move_as_blocks(spark):
    x = RNG.normal(size=(90, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if i % 10], "vec_id long, embedding array<double>").repartition(5)
    tensor = blocks.from_vectors(rows, "vec_id", "embedding", 16)
    x[::10] = 0
    assert np.allclose(dense(tensor), x) and tensor.frame.count() == 6
    assert np.allclose(dense(blocks.einsum("n d, n e -> d e", tensor, tensor)), x.T @ x)
    assert blocks.from_vectors(rows.limit(0), "vec_id", "embedding").frame.count() == 0


@pytest.mark.parametrize(("causal", "tile", "tiles"), [(True, 8, 2), (False, 8, 2), (True, 256, 64), (True, 1, 1)])
def test_attention(spark, causal, tile, tiles):
    want, rows = {}, []
    for sequence, n in (("a", 37), ("b", 1), ("c", 16)):
        q, k, v = RNG.normal(size=(n, 4)) * 20, RNG.normal(size=(n, 4)) * 20, RNG.normal(size=(n, 3))
        places = np.sort(RNG.choice(60, n, replace=False))
        scores = q @ k.T / 2
        scores[~(places[None, :] <= places[:, None])] = -np.inf if causal else scores[~(places[None, :] <= places[:, None])]
        w = np.exp(scores - scores.max(axis=1, keepdims=True))
        out = w @ v / w.sum(axis=1, keepdims=True)
        want |= {(sequence, int(p)): o for p, o in zip(places, out, strict=True)}
        rows += [(sequence, int(p), q[i].tolist(), k[i].tolist(), v[i].tolist()) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, "sequence string, position long, q array<double>, k array<double>, v array<double>").repartition(3)
    got = {(r["sequence"], r["position"]): r["out"] for r in attention.tiled_attention(df, 4, causal, tile, tiles).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert attention.tiled_attention(df.limit(0), 4).count() == 0

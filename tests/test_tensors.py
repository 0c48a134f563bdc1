import numpy as np
import pytest

from quillmill.operators import tensors as T


def table(spark, x):
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(x) for at in [at]]
    return spark.createDataFrame(rows, ", ".join(f"a{i} long" for i in range(x.ndim)) + ", value double")


def array(df):
    rows = [tuple(r) for r in df.collect()]
    out = np.full([max(r[i] for r in rows) + 1 for i in range(len(rows[0]) - 1)], np.nan)
    for r in rows:
        assert np.isnan(out[r[:-1]])
        out[r[:-1]] = r[-1]
    return out


X = np.arange(24.0).reshape(4, 6) ** 1.5


@pytest.mark.parametrize("pattern,how,sizes,want", [
    ("a b -> b a", None, {}, X.T),
    ("a (b c) -> c a b", None, {"c": 3}, X.reshape(4, 2, 3).transpose(2, 0, 1)),
    ("(a b) c -> a (c b)", None, {"b": 2}, X.reshape(2, 2, 6).transpose(0, 2, 1).reshape(2, 12)),
    ("a (b c) -> b", "mean", {"c": 2}, X.reshape(4, 3, 2).mean(axis=(0, 2))),
    ("a b -> a", "prod", {}, X.prod(axis=1)),
    ("a b -> a", "all", {}, X.all(axis=1).astype(float)),
    ("a b -> b r a", None, {"r": 2}, np.repeat(X.T[:, None], 2, axis=1)),
    ("a b -> (a r) b", None, {"r": 3}, np.repeat(X, 3, axis=0)),
])
def test_rearrange(spark, pattern, how, sizes, want):
    assert np.allclose(array(T.rearrange(table(spark, X), pattern, how, **sizes)), want)


def test_einsum(spark):
    y, z = np.arange(18.0).reshape(6, 3), np.arange(6.0).reshape(3, 2)
    assert np.allclose(array(T.einsum("i k, k j -> i j", table(spark, X), table(spark, y))), X @ y)
    assert np.allclose(array(T.einsum("i k, k j, j l -> l", table(spark, X), table(spark, y), table(spark, z))), (X @ y @ z).sum(axis=0))
    assert np.allclose(array(T.einsum("n d, n e -> d e", table(spark, X), table(spark, X))), X.T @ X)


def test_what_cannot_be_read(spark):
    for pattern, sizes in (("a b -> a", {}), ("a (b c) -> a b c", {}), ("a a -> a", {}), ("a b -> a b d", {}), ("a+b -> a", {}), ("a -> a", {})):
        with pytest.raises(ValueError):
            T.rearrange(table(spark, X), pattern, **sizes)
    assert T.parse_shape("batch _ width", (2, 3, 4)) == {"batch": 2, "width": 4}
    with pytest.raises(ValueError):
        T.parse_shape("a b", (1,))

import numpy as np
import pytest

from loamlearn.functions import losses as L

S = np.array([-7.3, -2.1, -0.6, -0.2, 0.3, 0.8, 1.7, 6.2])


@pytest.mark.parametrize("name", L.SCALAR_NAMES)
def test_first_derivative(name):
    o = L.loss(name)
    for y in ([0.0, 1.0] if o.classification else [1.0, 2.5, 4.0]):
        yy, e = np.full(len(S), y), 1e-6
        num = (o.loss(L.A, S + e, yy) - o.loss(L.A, S - e, yy)) / (2 * e)
        if name == "exponential":
            ok = -(2 * y - 1) * S < 7.9
        else:
            ok = np.ones(len(S), bool)
        np.testing.assert_allclose(np.asarray(o.first(L.A, S, yy), float)[ok], num[ok], rtol=1e-4, atol=1e-6)


@pytest.mark.parametrize("name", L.MULTI_NAMES)
def test_multi_first_derivative(name):
    o = L.loss(name)
    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        s = [rng.normal(size=20) for _ in range(k)]
        t = rng.integers(0, k, 20)
        y = [(t == j).astype(float) for j in range(k)]
        got = o.first(L.A, s, y)
        for j in range(k):
            up, down = [x.copy() for x in s], [x.copy() for x in s]
            up[j] += 1e-6
            down[j] -= 1e-6
            np.testing.assert_allclose(got[j], (o.loss(L.A, up, y) - o.loss(L.A, down, y)) / 2e-6, rtol=1e-4, atol=1e-5)
        if "hinge" not in name:
            np.testing.assert_allclose(sum(o.predict(L.A, s)), 1)


def test_inverse_and_options():
    for name in ("sigmoid", "poisson"):
        o = L.loss(name)
        p = np.array([0.1, 0.5, 0.9])
        np.testing.assert_allclose(o.predict(L.A, o.inverse(L.A, p)), p)
    assert L.loss("huber@2").delta == 2
    o = L.loss("sigmoid", zmax=2.0)
    g, h = o.first(L.A, S, np.zeros(8)), o.second_for_trees(L.A, S, np.zeros(8))
    assert (np.abs(g / h) <= 2 + 1e-9).all()
    with pytest.raises(ValueError):
        L.loss("nope")


def test_columns_and_arrays_agree(spark):
    from pyspark.sql import functions as F

    for name in L.SCALAR_NAMES:
        o, y = L.loss(name), 1.0
        df = spark.createDataFrame([(float(s), y) for s in S], "s double, y double")
        got = df.select(o.loss(L.C, F.col("s"), F.col("y")), o.first(L.C, F.col("s"), F.col("y")), o.second(L.C, F.col("s"), F.col("y"))).collect()
        yy = np.full(len(S), y)
        np.testing.assert_allclose(np.array(got, float).T, [o.loss(L.A, S, yy), o.first(L.A, S, yy), o.second(L.A, S, yy)], rtol=1e-9, atol=1e-12)

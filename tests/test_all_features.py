"""Queries over all features of S_bin, price among them, against brute force."""

from collections import Counter

import numpy as np
import pytest

from loamlearn.plans import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return Q.s_bin(spark, DIR).select("w", "y", "l_linenumber", *Q.NAMES).toPandas()


@pytest.fixture(scope="module")
def long(table):
    miss = {n: table[n].where((table["l_linenumber"] % 3 != 0) | (n != "discount")).to_numpy() for n in Q.NAMES}
    assert len(np.unique(miss["price"])) > 1000
    return miss


def test_bins_and_missing(spark, long):
    got = {(r["feature"], r["value"]) for r in Q.queries()["bins_nosample_all"](spark, DIR).collect()}
    assert got == {(n, round(float(v), 6)) for n, x in long.items() for v in x[~np.isnan(x)]}
    got = {(r["feature"], r["value"]): r["n"] for r in Q.queries()["missing_value_all"](spark, DIR).collect()}
    assert got == Counter((n, round(float(v), 6)) for n, x in long.items() for v in np.where(np.isnan(x), -1.0, x))


@pytest.mark.parametrize("name", ["standardize_all", "scale_range_all"])
def test_transforms(spark, long, name):
    rows = Q.queries()[name](spark, DIR).collect()
    for n, x in long.items():
        x = x[~np.isnan(x)]
        want = (x - x.mean()) / x.std() if name == "standardize_all" else -1 + 2 * (x - x.min()) / (x.max() - x.min())
        mine = sorted((r["value"], r["scaled"], r["n"]) for r in rows if r["feature"] == n)
        values, first, counts = np.unique(x, return_index=True, return_counts=True)
        assert [m[2] for m in mine] == counts.tolist()
        np.testing.assert_allclose([m[0] for m in mine], values, atol=1e-6)
        np.testing.assert_allclose([m[1] for m in mine], want[first], atol=1e-4)


def test_trees(spark, table):
    values = {n: np.unique(table[n]) for n in Q.NAMES} | {"price": Q._price_values(spark, DIR)}
    assert 32 < len(values["price"]) <= Q._PRICE_BINS
    g, h = (table["w"] * (0.5 - table["y"])).to_numpy(), (table["w"] * 0.25).to_numpy()
    want, top = {}, (-1.0, "", 0)
    for n in Q.NAMES:
        v = values[n]
        b = np.searchsorted((v[1:] + v[:-1]) / 2, table[n], "right")
        for i in range(len(v)):
            want[n, i] = (g[b == i].sum(), h[b == i].sum(), int((b == i).sum()))
            gl, hl = g[b <= i].sum(), h[b <= i].sum()
            if hl >= 1 and h.sum() - hl >= 1 and i + 1 < len(v):
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                top = max(top, (gain, n, i), key=lambda t: t[0])
    got = {(r["feature"], r["bin"]): (r["g"], r["h"], r["n"]) for r in Q.queries()["gbdt_hist_all"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-3) for k in want)
    best = Q.queries()["gbdt_best_split_all"](spark, DIR).first()
    assert (best["feature"], best["bin"]) == top[1:] and abs(best["gain"] - top[0]) < 1e-3
    root = {r["node"]: r for r in Q.queries()["gbdt_stump_all"](spark, DIR).collect()}[0]
    v = values[top[1]]
    assert root["feature"] == top[1] and abs(root["threshold"] - (v[top[2]] + v[top[2] + 1]) / 2) < 1e-5 and root["sample_cnt"] == len(table)
    assert "price" in {r["feature"] for r in Q.queries()["gbdt_train"](spark, DIR).collect()}

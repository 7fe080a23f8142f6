"""Quantiles, ranks, signed ranks and rank correlation against numpy, with one group of most rows, ties and nulls."""

import math

import numpy as np
import pytest

from tessera.operators import order_stats as Q
from tessera.operators import stats as T


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(3000):
        g = "hot" if i % 3 else [None, "a", "b"][i % 9 // 3]
        x = None if i % 50 == 0 else float(rng.choice([7.0, round(rng.normal(), 2), rng.integers(5)]))
        y = None if i % 70 == 0 else float(round(rng.normal() + (x or 0), 1))
        out.append((g, x, y, i))
    return [*out, ("one", 4.0, 1.0, -1), ("none", None, 1.0, -2), ("flat", 2.0, 1.0, -3), ("flat", 2.0, 5.0, -4)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, y double, n long").repartition(5)


def series(rows, g, k=1):
    return np.array([r[k] for r in rows if r[0] == g and r[k] is not None])


def ranks(v):
    _, back, n = np.unique(v, return_inverse=True, return_counts=True)
    below = np.concatenate(([0], np.cumsum(n)[:-1]))
    return (below + (n + 1) / 2)[back]


def test_describe(rows, table):
    got = {r.g: r for r in T.describe(table, "x", ("g",)).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        v = series(rows, g)
        assert r.n == len(v)
        if len(v):
            assert np.allclose([r["mean"], r["median"], r.q1, r.q3, r.iqr, r["min"], r["max"]], [v.mean(), np.median(v), *np.quantile(v, (0.25, 0.75)), np.subtract(*np.quantile(v, (0.75, 0.25))), v.min(), v.max()])
        else:
            assert r["median"] is None and r.q1 is None
    [r] = T.describe(table, "x").collect()
    v = np.array([x for _, x, _, _ in rows if x is not None])
    assert np.allclose([r.n, r["median"], r.q1, r.q3], [len(v), *np.quantile(v, (0.5, 0.25, 0.75))])
    assert T.describe(table.limit(0), "x").first()["median"] is None


@pytest.mark.parametrize("p", [0.0, 0.3, 0.95, 1.0])
def test_elements(rows, table, p):
    got = {r.g: r["quantile"] for r in T.quantile_higher(table, "x", p, ("g",)).collect()}
    want = {g: np.sort(v)[math.ceil(p * (len(v) - 1))] for g in {r[0] for r in rows} if len(v := series(rows, g))}
    assert got == want


def test_no_group_in_one_window(table):
    """The ranks of the group that holds two thirds of the rows come from several ranges."""
    ranked = Q.ranked_values(table.where("g = 'hot'"), "n", ["g"])
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r['_below'] for r in ranked.orderBy("n").collect()] == list(range(2000))


def test_signed_ranks(rows, table):
    pairs = table.withColumnsRenamed({"x": "left", "y": "right"})
    for by in (("g",), ()):
        for r in T.signed_ranks(pairs, by).collect():
            mine = [(x, y) for g, x, y, _ in rows if x is not None and y is not None and (not by or g == r["g"])]
            d = np.array([y - x for x, y in mine if y != x])
            a = ranks(np.abs(d)) if len(d) else np.zeros(0)
            t = np.unique(np.abs(d), return_counts=True)[1].astype(float)
            assert (r.pairs, r.nonzero) == (len(mine), len(d))
            assert np.allclose([r.w_plus, r.w_minus, r.ties], [a[d > 0].sum(), a[d < 0].sum(), (t * (t * t - 1)).sum()])


def test_spearman(rows, table):
    for r in T.spearman(table, "x", "y", ("g",)).collect():
        v = np.array([(x, y) for g, x, y, _ in rows if g == r.g and x is not None and y is not None])
        assert r.n == len(v)
        if len(v) < 2:
            assert r.rho is None and r.reason == "too_few"
        elif len(set(v[:, 0])) == 1:
            assert r.rho is None and r.reason == "constant"
        else:
            assert np.isclose(r.rho, np.corrcoef(ranks(v[:, 0]), ranks(v[:, 1]))[0, 1])

"""Shares of random graphs: against all graphs, against drawn graphs, and at sizes whose pairs no task can hold."""

import math

import numpy as np
import pytest

from tessera.operators import stats as T


@pytest.mark.parametrize(("total", "good", "draws"), [(10, 4, 3), (15, 15, 4), (15, 0, 4), (21, 6, 21), (28, 7, 25), (1225, 300, 400)])
def test_distribution(total, good, draws):
    low, cdf = T.hypergeometric_cdf(total, good, draws)
    of = lambda k: math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
    want = np.cumsum([of(k) for k in range(max(0, draws - total + good), low + len(cdf))])[-len(cdf) :]
    assert np.allclose(cdf, want, atol=1e-12) and cdf[-1] == pytest.approx(1)


def test_shares_are_those_of_drawn_graphs(spark):
    labels = np.repeat(np.arange(4), (3, 9, 14, 14))
    got = np.sort([r.mapped_ratio for r in T.random_baseline(spark, labels, 120, 2000).collect()])
    e = [T.random_edges(40, 120, k, 10_000) for k in range(2000)]
    want = np.sort([(labels[x[:, 0]] == labels[x[:, 1]]).mean() for x in e])
    at = np.unique(np.concatenate((got, want)))
    apart = np.abs(np.searchsorted(got, at, side="right") - np.searchsorted(want, at, side="right")).max() / 2000
    assert apart < 1.95 * math.sqrt(2 / 2000)  # Kolmogorov-Smirnov at 0.001
    assert set(np.round(got * 120, 9) % 1) == {0.0}


def test_pairs_beyond_a_task(spark):
    """60,000 classes have 1.8e9 pairs: a list of them took 14 GB, for each of the tasks."""
    labels = np.arange(60_000) % 25
    rows = T.random_baseline(spark, labels, 30_000_000).collect()
    shares = np.array([r.mapped_ratio for r in rows])
    p = (2400 - 1) / (60_000 - 1)
    sd = math.sqrt(p * (1 - p) / 3e7 * (1 - 3e7 / 1.79997e9))
    assert sorted(r.repetition for r in rows) == list(range(1000))
    assert abs(shares.mean() - p) < 4 * sd / math.sqrt(1000) and 0.9 < shares.std() / sd < 1.1
    assert rows == T.random_baseline(spark, labels, 30_000_000).collect()


def test_edges_none_all_or_too_many(spark):
    labels = np.array([0, 0, 1])
    assert [r.mapped_ratio for r in T.random_baseline(spark, labels, 0, 2).collect()] == [None, None]
    assert [r.mapped_ratio for r in T.random_baseline(spark, labels, 3, 2).collect()] == [1 / 3, 1 / 3]
    with pytest.raises(ValueError, match="4 edges of 3 pairs"):
        T.random_baseline(spark, labels, 4)


def test_query_of_60000_classes(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans import catalog

    pq.write_table(pa.table({"s_suppkey": range(60_000), "s_name": ["s"] * 60_000, "s_nationkey": [k % 25 for k in range(60_000)]}), tmp_path / "supplier.parquet")
    monkeypatch.setattr(catalog, "semantic", lambda s, d: s.range(30_000_000))
    shares = [r.mapped_ratio for r in catalog.queries()["stat24_random_baseline"](spark, str(tmp_path)).collect()]
    assert len(shares) == 1000 and 0.039 < min(shares) < max(shares) < 0.041

"""Largest matchings and MoJo by joins, against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from tessera.operators import matching as H
from tessera.operators import similarity as C
from tests import local_matching as L


@pytest.mark.parametrize("seed", range(4))
def test_largest_matching(spark, seed):
    rng = random.Random(seed)
    n, m, k = [(12, 9, 20), (30, 30, 60), (8, 20, 90), (25, 25, 40)][seed]
    edges = [(f"a{rng.randrange(n):02d}", f"b{rng.randrange(m):02d}") for _ in range(k)]
    got = H.largest_matching(spark.createDataFrame([*edges, edges[0], (None, "b01"), ("a01", None)], "l string, r string")).collect()
    assert set(map(tuple, got)) <= set(edges)
    assert len({r.l for r in got}) == len({r.r for r in got}) == len(got)
    names = {x: i for i, x in enumerate(sorted({x for e in edges for x in e}))}
    assert len(got) == L.largest_matching([(names[a], names[b]) for a, b in sorted(set(edges))])


def test_long_paths(spark):
    """A chain on which a greedy matching is one short, and the only path that mends it uses all edges."""
    edges = [(f"l{i:02d}", f"r{i:02d}") for i in range(12)] + [(f"l{i + 1:02d}", f"r{i:02d}") for i in range(11)]
    assert H.largest_matching(spark.createDataFrame(edges, "l string, r string")).count() == 12
    assert H.largest_matching(spark.createDataFrame([], "l string, r string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_mojo(spark, seed):
    rng = random.Random(seed)
    size = [0, 40, 90][seed]
    a = [(f"c{i}", rng.randrange(9)) for i in range(size)]
    b = [(c, rng.randrange(5) if rng.random() < 0.7 else g % 5) for c, g in a]
    frame = lambda rows: spark.createDataFrame(rows, "class_id string, cluster_id int")
    [got] = C.mojo(frame(a), frame(b)).collect()
    table = pd.DataFrame({"l": [g for _, g in a], "r": [g for _, g in b], "n": 1}) if size else pd.DataFrame({"l": [], "r": [], "n": []})
    want = L.mojo_fm(table).iloc[0]
    assert got.mojo == want.mojo and np.isclose(got.mojofm, want.mojofm)
    if size:
        [same] = C.mojo(frame(a), frame(a)).collect()
        assert (same.mojo, same.mojofm) == (0, 100.0)

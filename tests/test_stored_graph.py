"""Runs read their graph from the shared folder: the same graph, the same groups, and no row of an edge a run."""

import os

import numpy as np
import pandas as pd
import pytest

from tessera.operators import search as X
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def groups_by_definition(g, groups, largest):
    part, left = list(range(g.n)), g.n
    for e in np.lexsort((g.t, g.s, -g.w)):
        a, b = part[g.s[e]], part[g.t[e]]
        if left > groups and a != b and part.count(a) + part.count(b) <= largest:
            part = [min(a, b) if x in (a, b) else x for x in part]
            left -= 1
    return X.canonical(np.array(part))


def test_same_graph_and_groups(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 50)
    rng = np.random.default_rng(4)
    n, m = 60, 700
    s, t = np.sort(rng.integers(0, n, (2, m)), axis=0)
    w = rng.integers(1, 9, m).astype(float)
    ids = [f"c{k:02d}" for k in range(n)]
    nodes = spark.createDataFrame([(x,) for x in rng.permutation(ids).tolist()], "class_id string")
    edges = spark.createDataFrame([(ids[a], ids[b], float(x)) for a, b, x in zip(s, t, w)] + [(ids[0], "unknown", 1.0)], "source string, target string, w double")
    params = spark.createDataFrame([(k,) for k in (2, 5, 30)], "groups long")

    def run(classes, g, p):
        assert isinstance(g, X.StoredGraph) and list(classes) == ids
        found = X.strongest_edge_groups(g, int(p["groups"]), 24)  # before the edges are arrays
        assert "_arrays" not in vars(g)
        return pd.DataFrame([(int(p["groups"]), found.tolist(), g.s.tolist(), g.t.tolist(), g.w.tolist(), g.degree.tolist(), sorted(g.near(7)[0].tolist()))])

    got = X.per_run(nodes, edges, "w", params, ["groups"], run, "groups long, found array<long>, s array<long>, t array<long>, w array<double>, degree array<double>, near array<long>")
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    o = np.lexsort((w, t, s))
    g = X.Graph(n, s[o], t[o], w[o])
    rows = got.collect()
    assert sorted(r.groups for r in rows) == [2, 5, 30]
    for r in rows:
        assert (r.s, r.t, r.w, r.degree) == (g.s.tolist(), g.t.tolist(), g.w.tolist(), g.degree.tolist())
        assert r.near == sorted(g.near(7)[0].tolist()) == sorted([*t[s == 7], *s[t == 7]])
        assert r.found == groups_by_definition(g, r.groups, 24).tolist() == X.strongest_edge_groups(g, r.groups, 24).tolist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["evo01_start_population", "evo05_run", "evo11_groupings", "evo12_distinct_seeds"])
def test_no_edge_is_sent_to_a_run(spark, name):
    assert "CoGroup" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

"""Registered queries without SQL do the whole job."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Two groups of three suppliers; the part keys of an order's lines all differ modulo 20."""
    d = tmp_path_factory.mktemp("lines")
    pq.write_table(pa.table({"s_suppkey": range(6), "s_name": [f"s{k}" for k in range(6)], "s_nationkey": [0, 0, 0, 1, 1, 1]}), d / "supplier.parquet")
    rows = [(o, o % 2 * 3 + k, 7 * k + 1, k + 1) for o in range(4) for k in range(3)]
    order, supplier, part, number = (list(x) for x in zip(*rows, strict=True))
    pq.write_table(pa.table({"l_orderkey": order, "l_suppkey": supplier, "l_partkey": part, "l_linenumber": number, "l_linestatus": ["O"] * 12, "l_returnflag": ["R", "A", "N"] * 4}), d / "lineitem.parquet")
    return str(d)


def test_searches_see_every_line_pair(spark, lines):
    groups = {}
    for r in catalog.queries()["clu01_leiden"](spark, lines).where("seed = 1").collect():
        groups.setdefault(r.cluster_id, set()).add(r.class_id)
    assert sorted(map(sorted, groups.values())) == [["0", "1", "2"], ["3", "4", "5"]]
    assert catalog.semantic(spark, lines).count() == 4  # from the first supplier of each group


def test_repetitions_of_the_reference(spark, lines, monkeypatch):
    asked = {}
    monkeypatch.setattr(catalog.T, "random_baseline", lambda s, k, edges, repetitions=1000, base=0: asked.update(baseline=(len(k), edges, repetitions)))
    monkeypatch.setattr(catalog.X, "nsga2_runs", lambda nodes, edges, weight, params, population=100, generations=100: asked.update(nsga2=(params.count(), population, generations)) or params.selectExpr("array(seed) AS label_vector"))
    catalog.queries()["stat24_random_baseline"](spark, lines)
    catalog.queries()["evo08_nsga2"](spark, lines)
    assert asked == {"baseline": (6, 4, 1000), "nsga2": (30, 100, 100)}
    assert {(r.graph, r.pairs) for r in catalog.queries()["clu05_seed_stability"](spark, lines).collect()} == {("raw", 435), ("ssa", 435)}

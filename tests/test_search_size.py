"""clu01_leiden, clu04_sweep, evo15_same_seed: graphs of 60,000 classes and 70 million edges are searched run by run, held small, and written once."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import community as Y
from tessera.operators import search as X
from tessera.plans import catalog
from tessera.sources.shared import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("weights", "bytes_"), [([1.0, 41.25, 511.75], 2), ([1.0, 600.0, 2.0], 4), ([1.0, 0.125, 2.0], 4), ([0.1, 0.2, 1.0], 8)])
def test_bytes_at_an_end(tmp_path, weights, bytes_):
    s, t = np.array([0, 0, 1, 1, 2, 2]), np.array([1, 2, 0, 2, 0, 1])
    w = np.array(weights)[[0, 1, 0, 2, 1, 2]]
    pq.write_table(pa.table({"s": s.astype(np.int32), "t": t.astype(np.int32), "w": w}), tmp_path / "part-0.parquet")
    for n, wide in ((3, 2), (1 << 16, 2), ((1 << 16) + 1, 4)):
        g = X.StoredGraph(n, str(tmp_path), None)
        assert g._arrays[0].itemsize == wide and g._arrays[0].tolist() == t.tolist()
        assert g._weights.itemsize == bytes_ and g._weights.astype(float).tolist() == w.tolist()
        assert g.total == pytest.approx(sum(weights)) and g.inside([np.zeros(n, int)]).sum() == pytest.approx(sum(weights))


def test_graphs_of_the_size_go_run_by_run():
    assert Y.AT_ONCE >= 75_000_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["clu01_leiden", "clu04_sweep", "evo15_same_seed"])
def test_edges_are_dropped_and_not_summed_again(spark, monkeypatch, name):
    made, cut = [], Tables.cut

    def spy(self, df, name="part"):
        out = cut(self, df, name)
        if name == "edges":
            made.append((out._table_path.removeprefix("file:"), df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(Tables, "cut", spy)
    catalog.queries()[name](spark, SF)
    assert made and not any(os.path.exists(path.replace("///", "/")) for path, _ in made)
    assert all("Aggregate [least(source" not in plan for _, plan in made)

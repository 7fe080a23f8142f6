"""Steps of the search that know classes by their places only read no dependency: a folder of suppliers is enough."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def suppliers(tmp_path_factory):
    d = tmp_path_factory.mktemp("suppliers")
    n = 2011
    pq.write_table(pa.table({"s_suppkey": range(n), "s_name": [f"s{k}" for k in range(n)], "s_nationkey": [k % 25 for k in range(n)]}), d / "supplier.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["enc04_random_labels", "evo02_crossover", "evo03_mutation", "evo04_repair", "evo10_perturbed"])
def test_promises_hold_without_a_graph(spark, suppliers, name):
    rows = catalog.queries()[name](spark, suppliers).collect()
    assert sorted(r["seed"] for r in rows) == list(range(30))
    assert all(v is True for r in rows for k, v in r.asDict().items() if k != "seed")

"""stat24_random_baseline: the sizes of the labels are summed by the tasks, and the shares are those of the labels."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tessera.operators import stats as T
from tessera.plans import catalog


def test_no_label_goes_through_the_driver(spark, tmp_path, monkeypatch):
    labels = [k * k % 25 for k in range(600)]
    pq.write_table(pa.table({"s_suppkey": range(600), "s_name": ["s"] * 600, "s_nationkey": labels}), tmp_path / "supplier.parquet")
    monkeypatch.setattr(catalog, "semantic", lambda s, d: s.range(3000))
    want = T.random_baseline(spark, np.array(labels), 3000).collect()
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows of all classes"))
    assert catalog.queries()["stat24_random_baseline"](spark, str(tmp_path)).collect() == want

"""Every registered query outside of the text folder against its SQL, at the smallest scale."""

import os

import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v if isinstance(v, (str, bool)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    import duckdb

    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name not in catalog.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    num = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert rows == sorted((tuple(plain(num(r[i])) for i in order) for r in want.fetchall()), key=str)

"""Fronts by grid cells against the definition, and a run whose rows are all on the front."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import skyline as K


def brute(rows):
    """(run, vector) -> the rows that no row of the run dominates."""
    out = []
    for r, x in rows:
        f = np.array([y for q, y in rows if q == r])
        if not ((f <= x).all(1) & (f < x).any(1)).any():
            out.append((r, *x))
    return sorted(out, key=repr)


@pytest.mark.parametrize("d", [1, 2, 3, 4])
@pytest.mark.parametrize(("at_once", "block", "window", "cells"), [(1 << 12, 1 << 13, 1 << 13, 1 << 15), (0, 20, 15, 100), (0, 1 << 13, 40, 1 << 15)])
def test_against_definition(spark, monkeypatch, d, at_once, block, window, cells):
    for name, value in (("AT_ONCE", at_once), ("BLOCK", block), ("WINDOW", window), ("CELLS", cells)):
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(d)
    x = rng.integers(0, 30, (400, d)).astype(float)
    x[200:, 0] = 40 - x[200:, 1:].sum(1) / max(1, d - 1) if d > 1 else x[200:, 0]  # anticorrelated
    x[:5] = -0.0
    runs = [None if r == 3 else f"r{r}" for r in rng.integers(0, 4, 400)]
    rows = [(r, tuple(v.tolist())) for r, v in zip(runs, x, strict=True)]
    names = [f"c{k}" for k in range(d)]
    df = spark.createDataFrame([(r, i, *v) for i, (r, v) in enumerate(rows)], f"run string, run_ long, {', '.join(f'{n} double' for n in names)}").repartition(3)
    got = [(r.run, *(r[n] for n in names)) for r in K.skyline(df, names, ("run",)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_missing_objectives(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, 0.0), ("a", float("nan"), 0.0), ("a", float("inf"), 0.5), ("a", float("-inf"), float("inf"))]
    df = spark.createDataFrame(rows, "run string, x double, y double")
    got = K.skyline(df, ("x", "y"), ("run",)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(r) for i, r in enumerate(rows) if i != 1)
    assert K.skyline(df.limit(0), ("x", "y"), ("run",)).collect() == []


def test_cells(monkeypatch):
    """A cell that is dropped holds no front point; dominators are in the cell or in its partners."""
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    place = (x * 5).astype(int)
    cell, back = np.unique(place, axis=0, return_inverse=True)
    back = back.reshape(-1)
    low, high = (np.array([f(x[back == c], axis=0) for c in range(len(cell))]) for f in (np.min, np.max))
    keep, partners = K.kept_cells(cell, low, high, 5)
    front = K.local_skyline(x)
    assert set(back[front]) <= set(keep.tolist()) and len(keep) < len(cell)
    at = {c: i for i, c in enumerate(keep.tolist())}
    for i in np.flatnonzero(~front):
        if back[i] in at:
            near = {int(keep[p]) for p in partners[at[back[i]]]}
            assert any(back[j] in near and (x[j] <= x[i]).all() and (x[j] < x[i]).any() for j in np.flatnonzero(front))


def test_whole_run_on_the_front_in_many_tasks(spark):
    """30,000 rows of one run, none of which dominates another, and as many that are dominated; the units spread."""
    n = 30_000
    rows = spark.range(2 * n, numPartitions=4).withColumn("a", F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1e6).withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1e6)
    rows = rows.withColumn("c", 5 - F.col("a") - F.col("b") + F.when(F.col("id") % 2 == 1, 1.5).otherwise(0.0)).withColumn("run", F.lit(1))
    got = K.skyline(rows, ("a", "b", "c"), ("run",))
    found = got.agg(F.count_if(F.col("id") % 2 == 0).alias("even"), F.count("*").alias("n")).first()
    assert found["even"] == n and found["n"] < 2 * n
    t = rows.toPandas()
    f, whole = t[["a", "b", "c"]].to_numpy(), t[t["id"] % 2 == 0][["a", "b", "c"]].to_numpy()
    odd = t[t["id"] % 2 == 1].sample(300, random_state=1)
    stays = {r["id"] for r in got.where("id % 2 = 1").collect()}
    assert {int(i) for i, x in zip(odd["id"], odd[["a", "b", "c"]].to_numpy(), strict=True) if not ((f <= x).all(1) & (f < x).any(1)).any()} == stays & set(odd["id"].tolist())
    assert len(whole) == n

"""Counts of all pairs of partitions by blocks of classes, against plain Python."""

import random
from collections import Counter

import pytest

from tessera.operators import similarity as C


@pytest.mark.parametrize("rows", [1 << 18, 60, 1])
def test_cross_counts(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "BLOCK_ROWS", rows)
    rng = random.Random(rows)
    labels = {(k, f"c{i}"): rng.choice([None, 0, 1, 2, 5]) for k in ("a", "b", "c", "d") for i in range(60) if rng.random() < 0.9}
    table = spark.createDataFrame([(c, k, v, "x") for (k, c), v in labels.items()] + [(None, "a", 1, "x"), ("c1", None, 1, "x")], "class_id string, run string, cluster_id int, block string").repartition(4)
    want = Counter((i, j, labels[i, c], labels[j, c]) for i, c in labels for j in "abcd" if i < j and (j, c) in labels)
    assert {(r.i, r.j, r.l, r.r): r.n for r in C.cross_counts(table, "run").collect()} == want
    pairs = {(r.i, r.j) for r in C.all_pairs(table.where("cluster_id IS NOT NULL"), "run").collect()}
    assert pairs == {(i, j) for i in "abcd" for j in "abcd" if i < j}
    assert C.cross_counts(table.limit(0), "run").count() == 0


def test_plan_and_repeats(spark):
    """The labels aren't joined with themselves; a class that stands twice is an error."""
    table = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("y", 1, 0), ("y", 2, 0)], "class_id string, run long, cluster_id long")
    assert "Join" not in C.cross_counts(table, "run")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="stands twice"):
        C.cross_counts(table.union(table.limit(1)), "run").collect()

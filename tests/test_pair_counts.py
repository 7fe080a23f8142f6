"""Dominating pairs against the predicates on all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fronts as P
from tessera.operators import pair_counts as N


@pytest.mark.parametrize("bits", [3, 12])
@pytest.mark.parametrize("names", [("x",), ("x", "y"), ("x", "y", "z")])
def test_against_all_pairs(spark, monkeypatch, bits, names):
    monkeypatch.setattr(N, "BITS", bits)
    rng = random.Random(7 * bits + len(names))
    value = lambda: rng.choice([None, float("nan"), 0.0, -0.0, float("inf"), *(float(rng.randrange(20)) for _ in range(25)), *(rng.random() * 20 for _ in range(25))])
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *(f"s{k:03d}" for k in range(90))]), value(), value(), value()) for _ in range(300)] + [("alone", "s", 1.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "run string, id string, x double, y double, z double")
    j = t.alias("a").join(t.alias("b"), (F.col("a.run") == F.col("b.run")) & (F.col("b.id") < F.col("a.id")))
    want = j.groupBy(F.col("a.run").alias("run")).agg(F.count("*").alias("pairs"), F.count_if(P.dominates("a", "b", names)).alias("exact"), F.count_if(P.dominates("a", "b", names, 1.5)).alias("near"))
    got = N.dominance_counts(t, "run", "id", names, {"exact": 0.0, "near": 1.5})
    assert sorted(got.collect()) == sorted(want.collect())


def test_makes_no_row_a_pair(spark):
    """40,000 rows have 800 million pairs; the join took minutes."""
    t = spark.range(40_000).select(F.lit("r").alias("run"), "id", (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"))
    got = N.dominance_counts(t, "run", "id", ("x", "y"), {"exact": 0.0})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # an earlier row has a smaller y, or the same y and a smaller x: no later row dominates it
    assert [tuple(r) for r in got.collect()] == [("r", 799_980_000, 0)]
    back = N.dominance_counts(t.withColumn("id", -F.col("id")), "run", "id", ("x", "y"), {"exact": 0.0}).collect()
    assert [tuple(r) for r in back] == [("r", 799_980_000, (1000 * 1001 // 2) * (40 * 41 // 2) - 40_000)]

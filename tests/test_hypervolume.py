"""Volumes by slices and staircases against grid cells and the recursive definition."""

import numpy as np
import pytest

from tessera.operators import fronts as P


def recursive(p, ref):
    p = p[(p < ref).all(1)]
    if not len(p):
        return 0.0
    if len(ref) == 1:
        return float(ref[0] - p.min())
    p = p[np.argsort(p[:, -1], kind="stable")]
    tops = np.append(p[1:, -1], ref[-1])
    return float(sum((t - p[i, -1]) * recursive(p[: i + 1, :-1], ref[:-1]) for i, t in enumerate(tops) if t > p[i, -1]))


@pytest.mark.parametrize("seed", range(6))
def test_staircase(seed):
    rng = np.random.default_rng(seed)
    stairs, seen = P.Staircase(10.0, 9.0), []
    for x, y in rng.integers(0, 9, (60, 2)).astype(float).tolist():
        stairs.add(x, y)
        seen.append((x, y))
        assert np.isclose(stairs.area, P.hypervolume(np.array(seen), (10.0, 9.0)))
        assert stairs.xs == sorted(set(stairs.xs)) and stairs.ys == sorted(set(stairs.ys), reverse=True)


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_definition(d):
    rng = np.random.default_rng(d)
    for n in (0, 1, 7, 25):
        p = np.concatenate((rng.integers(0, 6, (n, d)).astype(float), rng.random((n, d)) * 8))
        assert np.isclose(P.hypervolume(p, (7.0,) * d), recursive(p, np.full(d, 7.0)))


@pytest.mark.parametrize(("size", "slices"), [(1 << 12, 64), (5, 64), (1, 8)])
def test_sliced(spark, monkeypatch, size, slices):
    monkeypatch.setattr(P, "SLICE_POINTS", size)
    monkeypatch.setattr(P, "SLICES", slices)
    rng = np.random.default_rng(size)
    rows = [(r, *v) for r in ("a", "b", None) for v in rng.integers(0, 12, (80, 3)).tolist()] + [("far", 50, 50, 50), ("one", 1, 2, 3), ("c", 5, 5, 1), ("c", 1, 1, 1), ("c", 0, 9, 1)]
    df = spark.createDataFrame(rows, "run string, x int, y int, z int").repartition(4)
    got = {r.run: r.hypervolume for r in P.hypervolumes(df, ("x", "y", "z"), (13, 13, 11), "run").collect()}
    cells = np.stack(np.meshgrid(*(np.arange(n) for n in (13, 13, 11)), indexing="ij"), -1).reshape(-1, 3)
    for run in {r[0] for r in rows}:
        p = np.array([r[1:] for r in rows if r[0] == run])
        assert np.isclose(got[run], (p[None] <= cells[:, None]).all(2).any(1).sum())
    assert P.hypervolumes(df.limit(0), ("x", "y", "z"), (13, 13, 11), "run").collect() == []


def test_many_points_of_one_run(spark):
    """60,000 points, most of them on the front, over 16 slices."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000, numPartitions=4).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1009)) / 1009).withColumn("y", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1013)) / 1013)
    rows = rows.withColumn("z", 2 - F.col("x") - F.col("y")).withColumn("run", F.lit(1))
    [got] = P.hypervolumes(rows, ("x", "y", "z"), (1.0, 1.0, 2.0), "run").collect()
    assert np.isclose(got.hypervolume, P.hypervolume(rows.select("x", "y", "z").toPandas().to_numpy(), (1.0, 1.0, 2.0)))
    assert 0.9 < got.hypervolume < 1.0

"""Components: contraction in one task, and the distributed steps."""

import random

import pytest


@pytest.mark.parametrize("limit", [1 << 21, 40])
def test_components(spark, monkeypatch, limit):
    from tessera.llm import shared

    monkeypatch.setattr(shared, "CONTRACT", limit)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = shared.components(shared.Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in up}
    assert len(got) == len(up)
    assert shared.components(shared.Scratch(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0

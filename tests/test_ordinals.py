"""Ordinals, carries and nearest values over ranges, against plain Python; no plan has one task for all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordinals as O
from tessera.operators import partition as M
from tessera.operators import selection as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinals(spark):
    rng = random.Random(3)
    values = [rng.randrange(50) for _ in range(500)] + [7] * 400 + [None] * 5
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id long, v long, _extra string").repartition(5)
    got = O.with_ordinal(df, [F.desc("v"), F.col("id")], "place", 1)
    assert "SinglePartition" not in plan(got)
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert {r.id: r.place for r in got.collect()} == {i: k + 1 for k, i in enumerate(order)}
    ties = O.with_ordinal(df, [F.col("v")], "place").orderBy("place").collect()
    assert [r.place for r in ties] == list(range(len(values)))
    assert [r.v for r in ties] == sorted(values, key=lambda v: (v is not None, v))
    assert O.with_ordinal(df.limit(0), [F.col("v")], "place").collect() == []


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_carry(spark, share):
    rng = random.Random(int(share * 100))
    rows = [(i, rng.randrange(200) if i % 3 else 77, i if rng.random() < share else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v long, mark long").repartition(4)
    got = O.with_carry(df, [F.col("v"), F.col("id")], "mark", "below", "above")
    assert "SinglePartition" not in plan(got)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    below, above, last = {}, {}, None
    for i, _, m in order:
        last = m if m is not None else last
        below[i] = last
    last = None
    for i, _, m in reversed(order):
        last = m if m is not None else last
        above[i] = last
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.id: (r.below, r.above) for r in found} == {i: (below[i], above[i]) for i in below}


def test_nearest_pooled(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([0.5, rng.random(), rng.random()]), 3) for i in range(150)]
    right = [(i % 9, f"s{i}", rng.choice([0.25, rng.random()]), 3) for i in range(80)]
    a = spark.createDataFrame(left, "seed long, imbalance double, cluster_count long")
    b = spark.createDataFrame(right, "seed long, solution_id string, imbalance double, cluster_count long")
    got = S.nearest_match(a, b, "pooled")
    assert "SinglePartition" not in plan(got)
    want = {k: min((abs(v - w), s, i) for s, i, w, _ in right) for k, v, _ in left}
    assert {r.left_key: (r.gap, r.right_key, r.right_id) for r in got.collect()} == want
    none = S.nearest_match(a, b.limit(0), "pooled").collect()
    assert len(none) == len(left) and not any(r.match_found for r in none)


def test_nearest_count_meets_few_rows(spark):
    """5,000 x 5,000 rows of three counts: a join by count makes 20 million pairs."""
    rng = random.Random(8)
    value = lambda: rng.choice([None, 0.5, *(rng.random() for _ in range(20))])
    left = [(i, value(), rng.choice([3, 3, 3, 4, 9, None])) for i in range(5000)]
    right = [(i % 900, f"s{i}", value(), rng.choice([2, 3, 4, 5, None])) for i in range(5000)]
    a = spark.createDataFrame(left, "seed long, imbalance double, cluster_count long")
    b = spark.createDataFrame(right, "seed long, solution_id string, imbalance double, cluster_count long")
    got = S.nearest_match(a, b, "count")
    text = plan(got)
    assert "SinglePartition" not in text and "left_count" not in "".join(x for x in text.splitlines() if "Join" in x)
    far = lambda v, w: math.inf if v is None or w is None else abs(v - w)
    fits = {c: [r for r in right if c is not None and r[3] is not None and abs(c - r[3]) <= 1] for c in (3, 4, 9, None)}
    rows = {r.left_key: r for r in got.collect()}
    assert len(rows) == len(left)
    for k, v, c in left[:1500]:
        best = min(((far(v, w), s, i) for s, i, w, _ in fits[c]), default=(math.inf, None, None))
        assert (math.inf if rows[k].gap is None else rows[k].gap, rows[k].right_key, rows[k].right_id) == best
        assert rows[k].match_found == (best[2] is not None)


def test_names_and_segments(spark):
    rng = random.Random(6)
    labels = spark.createDataFrame([(f"n{i:03d}", rng.randrange(40)) for i in range(300)], "class_id string, cluster_id long")
    members = {}
    for r in labels.collect():
        members.setdefault(r.cluster_id, []).append(r.class_id)
    names = M.signature_names(labels)
    assert "SinglePartition" not in plan(names)
    order = sorted(members, key=lambda c: sorted(members[c]))
    assert {r.cluster_id: r.cluster_name for r in names.collect()} == {c: f"C{i + 1}" for i, c in enumerate(order)}
    segments = M.cluster_segments(labels)
    assert "SinglePartition" not in plan(segments)
    rows = segments.orderBy("segment").collect()
    assert [r.segment for r in rows] == list(range(1, len(members) + 1))
    assert rows == sorted(rows, key=lambda r: (-r["size"], r.signature))

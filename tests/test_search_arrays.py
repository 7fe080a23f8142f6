"""What a run reads of its graph, what it holds, and how runs are dealt."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import TaskContext

from tessera.operators import search as X
from tessera.plans import catalog
from tessera.sources.shared import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables_cut(monkeypatch):
    """Names of the tables that a query writes."""
    names, cut = [], Tables.cut
    monkeypatch.setattr(Tables, "cut", lambda self, df, name="part": names.append(name) or cut(self, df, name))
    return names


def stored(folder, n, s, t, w):
    """The files of a stored graph: both ends in order, and by weight."""
    ends = np.concatenate((np.stack((s, t, w, 0 * w)), np.stack((t, s, w, 0 * w + 1))), axis=1)
    a, b, c, _ = ends[:, np.lexsort((ends[2], ends[3], ends[1], ends[0]))]
    o = np.lexsort((t, s, -w))
    for name, columns in (("ends", {"s": a.astype(np.int32), "t": b.astype(np.int32), "w": c}), ("weight", {"s": s[o].astype(np.int32), "t": t[o].astype(np.int32)})):
        (folder / name).mkdir()
        pq.write_table(pa.table(columns), folder / name / "part-0.parquet")
    return X.StoredGraph(n, str(folder / "ends"), str(folder / "weight"))


def dense(folder, n=700, seed=2):
    s, t = np.triu_indices(n, 1)
    return stored(folder, n, s, t, np.random.default_rng(seed).integers(1, 9, len(s)).astype(float)), len(s)


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("step", [1.0, 0.1])
def test_partitions_side_by_side(tmp_path, step):
    """Dense and sparse nodes, loops, repeated pairs, a node without edges; weights that single precision holds, and others."""
    rng = np.random.default_rng(5)
    n = 90
    s, t = np.sort(np.concatenate((rng.integers(0, n - 1, (2, 900)), np.stack((np.zeros(200, int), rng.integers(0, n - 1, 200)))), axis=1), axis=0)
    w = rng.integers(1, 9, len(s)) * step
    xs = [X.canonical(rng.integers(0, k, n)) for k in (1, 2, 5, 40, 300)]
    for g in (X.Graph(n, s, t, w), stored(tmp_path, n, s, t, w)):
        assert g.total == pytest.approx(w.sum())
        for x, found in zip(xs, X.objectives_of(g, xs, g), strict=True):
            inside, size = np.bincount(x[s], w * (x[s] == x[t]), x.max() + 1), np.bincount(x)
            cohesion = [2 * i / (k * (k - 1)) if k > 1 else 0 for i, k in zip(inside, size, strict=True)]
            outside = 1 - inside.sum() / w.sum()
            assert found == pytest.approx([outside, -np.mean(cohesion), size.std() / size.mean(), outside], abs=1e-12)
            assert X.quality(g, x) == pytest.approx(inside.sum() / w.sum() - ((np.bincount(x, g.degree) / (2 * w.sum())) ** 2).sum(), abs=1e-12)


def test_search_holds_neighbours_and_weights_only(tmp_path):
    """evo05_run: 8 bytes at each end of an edge, and little besides."""
    g, m = dense(tmp_path, 1500)
    assert peak(lambda: X.nsga2(g, [], 3, 6, 2)) < 28 * m


def test_seeds_read_no_weights(tmp_path):
    """evo01_start_population: seeds and the population of them need neighbours, and edges as a stream."""
    g, m = dense(tmp_path)
    rng = np.random.default_rng(0)
    used = peak(lambda: X.start_population(g, [x for _, x in X.seeds(g, X.random_labels(g.n, rng), 0)], rng, 20))
    assert "_weights" not in vars(g) and used < 40 * m


def test_perturbed_copies_hold_four_bytes_an_end(tmp_path):
    """evo12_distinct_seeds."""
    g, m = dense(tmp_path, 1500)
    x, got = X.random_labels(g.n, np.random.default_rng(1)), []
    used = peak(lambda: got.extend(X.perturbed(g, x, 0.2, np.random.default_rng(k)) for k in range(3)))
    assert [len(y) for y in got] == [g.n] * 3 and used < 16 * m


def test_seeds_hold_no_edges(tmp_path):
    """evo12_distinct_seeds: neighbours are read at the places that the copies ask for, so a run holds nothing of the size of its graph."""
    g, m = dense(tmp_path, 2000)
    rng, got = np.random.default_rng(0), []
    used = peak(lambda: got.extend(X.seeds(g, X.random_labels(g.n, rng), 0)))
    assert len(got) >= 16 and "_arrays" not in vars(g) and "_weights" not in vars(g) and used < 4 * m


@pytest.mark.parametrize("batch", [1, 50, 1 << 16])
def test_perturbed_as_node_by_node(tmp_path, monkeypatch, batch):
    """evo12_distinct_seeds: the same copies as with the neighbours of each node at hand; loops, repeated pairs, nodes without edges, runs of several batches and files."""
    monkeypatch.setattr(X, "CHUNK", batch)
    rng = np.random.default_rng(7)
    n, shares = 40, [0.05, 0.3, 1.0, 1.0]
    s, t = np.sort(np.concatenate((rng.integers(3, n - 2, (2, 300)), np.full((2, 4), 5)), axis=1), axis=0)
    w, labels = rng.integers(1, 9, len(s)).astype(float), rng.integers(0, 9, n)
    plain, g = X.Graph(n, s, t, w), stored(tmp_path, n, s, t, w)
    whole = pq.read_table(tmp_path / "ends" / "part-0.parquet")
    for k, at in enumerate((0, 111, 300)):
        pq.write_table(whole.slice(at, (111, 189, whole.num_rows)[k]), tmp_path / "ends" / f"part-{k}.parquet")
    assert g.bounds.tolist() == plain.bounds.tolist() == [0, *np.cumsum(np.bincount(np.concatenate((s, t)), minlength=n))]
    held = X.StoredGraph(n, str(tmp_path / "ends"), None)
    held._arrays  # noqa: B018
    for graph in (g, plain, held):
        one, rng = np.random.default_rng(3), np.random.default_rng(3)
        for share, x in zip(shares, X.perturbed_copies(graph, labels, shares, rng), strict=True):
            y = labels.copy()
            for i in one.choice(n, max(1, round(share * n)), replace=False):
                if len(to := held.neighbours(int(i)) if graph is not plain else plain.neighbours(int(i))):
                    y[i] = labels[one.choice(to)]
            assert x.tolist() == X.canonical(y).tolist()
        assert one.integers(1 << 40) == rng.integers(1 << 40)
    assert "_arrays" not in vars(g)


@pytest.mark.parametrize(("most", "join"), [(1 << 17, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_edges_are_numbered_without_a_shuffle(spark, monkeypatch, most, join):
    """evo12_distinct_seeds: the numbers of few classes go to the edges, the edges nowhere; those of many are joined by class."""
    plans, cut = {}, Tables.cut
    monkeypatch.setattr(Tables, "cut", lambda self, df, name="part": plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or cut(self, df, name))
    monkeypatch.setattr(X, "BROADCAST", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "class_id string")
        edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "unknown", 1.0)], "source string, target string, w double")

        def run(ids, g, p):
            return pd.DataFrame({"s": g.s, "t": g.t, "w": g.w})

        rows = X.per_run(nodes, edges, "w", spark.range(1).withColumnRenamed("id", "seed"), ["seed"], run, "s long, t long, w double").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, rows)) == [(0, 1, 1.0), (1, 2, 2.0)]
    assert plans["numbered"].count(join) >= 2 and ("SortMergeJoin" in plans["numbered"]) == (join == "SortMergeJoin")


def test_sweep_writes_no_stream_by_weight(spark, tables_cut):
    """clu04_sweep."""
    catalog.queries()["clu04_sweep"](spark, SF)
    assert "by-ends" in tables_cut and "by-weight" not in tables_cut


def test_a_task_for_each_run(spark):
    """clu05_seed_stability: no task has two runs while others have none."""
    nodes = spark.createDataFrame([("a",), ("b",)], "class_id string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "source string, target string, w double")

    def run(ids, g, p):
        return pd.DataFrame({"seed": [int(p["seed"])], "task": [TaskContext.get().partitionId()]})

    rows = X.per_run(nodes, edges, "w", spark.range(30).union(spark.range(3)).withColumnRenamed("id", "seed"), ["seed"], run, "seed long, task long").collect()
    assert sorted(r.seed for r in rows) == list(range(30)) == sorted(r.task for r in rows)


def test_moves_as_with_a_sort():
    """evo15_same_seed: links of a node are summed without a sort, and of equal communities the smallest is taken, as before."""
    rng = np.random.default_rng(8)
    s, t = np.triu_indices(50, 1)
    keep = rng.random(len(s)) < 0.3
    g = X.Graph(50, s[keep], t[keep], rng.integers(1, 4, int(keep.sum())).astype(float))

    def moved(rng, within):
        labels, total, queue, head = np.arange(50), g.degree.copy(), rng.permutation(50).tolist(), 0
        while head < len(queue):
            i, head = queue[head], head + 1
            to, w = g.near(i)
            to, w = to[within[to] == within[i]], w[within[to] == within[i]]
            if not len(to):
                continue
            total[labels[i]] -= g.degree[i]
            options, back = np.unique(np.append(labels[to], labels[i]), return_inverse=True)
            gain = np.bincount(back, np.append(w, 0.0)) - g.degree[i] * total[options] / (2 * g.total)
            new = options[np.argmax(gain)] if gain.max() > gain[np.searchsorted(options, labels[i])] + 1e-12 else labels[i]
            total[new] += g.degree[i]
            if new != labels[i]:
                labels[i] = new
                queue += [j for j in to[labels[to] != new].tolist() if j not in queue[head:]]
        return labels

    for seed in range(4):
        for within in (np.zeros(50, int), np.arange(50) % 3):
            assert X.local_moves(g, np.arange(50), 1.0, np.random.default_rng(seed), within).tolist() == moved(np.random.default_rng(seed), within).tolist()


def test_same_seed_writes_no_stream_by_weight(spark, tables_cut):
    """evo15_same_seed."""
    catalog.queries()["evo15_same_seed"](spark, SF)
    assert tables_cut.count("by-ends") == 2 and "by-weight" not in tables_cut


def test_a_generation_goes_over_the_edges_once(tmp_path, monkeypatch):
    """evo08_nsga2: the children of a generation are compared side by side."""
    g, _ = dense(tmp_path, 60)
    seen, inside = [], X.Graph.inside
    monkeypatch.setattr(X.Graph, "inside", lambda self, xs: seen.append(len(xs)) or inside(self, xs))
    X.nsga2(g, [], 3, 20, 5)
    assert len(seen) == 6 and max(seen) == 20


@pytest.mark.parametrize("cells", [0, X.CELLS])
def test_leiden_holds_neighbours_and_weights_only(tmp_path, monkeypatch, cells):
    """evo13_seeds: coarser graphs are summed some edges at a time."""
    monkeypatch.setattr(X, "CELLS", cells)
    monkeypatch.setattr(X, "SUMMED", 1 << 14)
    g, m = dense(tmp_path, 1500)
    found = []
    assert peak(lambda: found.append(X.leiden(g, seed=1))) < 32 * m
    part = np.arange(1500) % 40
    small = g.merged(part, 40)
    assert small.total == g.total and len(small.s) == 40 * 41 // 2
    assert np.allclose(small.degree, np.bincount(part, g.degree))


def test_strongest_edges_write_no_ends(spark, tables_cut):
    """clu03_strongest_edges: its runs read a stream by weight only."""
    catalog.queries()["clu03_strongest_edges"](spark, SF)
    assert "by-weight" in tables_cut and "by-ends" not in tables_cut

"""Partition similarity from one contingency table; reference metrics; matching.

Two NMIs exist on purpose: nmi_geometric divides by the geometric mean of the entropies, nmi_arithmetic by their arithmetic mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matching import largest_matching
from tessera.operators.ordinals import with_prefix_sum
from tessera.operators.partition import contingency, safe_ratio
from tessera.sources.shared import Tables


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def similarity(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, ari, nmi_geometric, nmi_arithmetic for each key.

    Fewer than two classes, or a zero denominator: ARI 1. Both entropies 0: NMI 1; a zero denominator otherwise: 0.
    """
    c = contingency(left, right, keys)
    n, a, b = (F.col(x).cast("double") for x in "nab")
    # a_i stands in every cell of its row: n_ij / a_i of it sums to the row once
    s = c.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(_pairs(n)).alias("s_n"), F.sum(_pairs(a) * n / a).alias("s_a"), F.sum(_pairs(b) * n / b).alias("s_b"),
        F.sum(n * F.ln(n)).alias("l_n"), F.sum(n * F.ln(a)).alias("l_a"), F.sum(n * F.ln(b)).alias("l_b"),
    )
    t = F.col("total").cast("double")
    expected, top = F.col("s_a") * F.col("s_b") / F.greatest(_pairs(t), F.lit(1.0)), (F.col("s_a") + F.col("s_b")) / 2
    ari = F.when(t < 2, 1.0).when(F.abs(top - expected) < 1e-12, 1.0).otherwise((F.col("s_n") - expected) / F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise(top - expected))
    hl, hr = (F.greatest(F.ln(t) - F.col(x) / t, F.lit(0.0)) for x in ("l_a", "l_b"))
    mutual = F.greatest((F.col("l_n") - F.col("l_a") - F.col("l_b")) / t + F.ln(t), F.lit(0.0))
    out = s.select(*keys, "total", ari.alias("ari"), hl.alias("hl"), hr.alias("hr"), mutual.alias("mutual"))

    def nmi(bottom: Column) -> Column:
        return F.when((F.col("hl") < 1e-12) & (F.col("hr") < 1e-12), 1.0).when(bottom < 1e-12, 0.0).otherwise(F.col("mutual") / F.when(bottom < 1e-12, 1.0).otherwise(bottom))

    return out.select(*keys, F.col("total").alias("n"), "ari", nmi(F.sqrt(F.col("hl") * F.col("hr"))).alias("nmi_geometric"), nmi((F.col("hl") + F.col("hr")) / 2).alias("nmi_arithmetic"))


#: Rows (a class of a partition) of a block of classes.
BLOCK_ROWS = 1 << 18


def _cross_counts(schema_of: tuple[str, ...]):
    """Rows (block, key, class_id, cluster_id), sorted by block -> (i, j, l, r, n): shared classes of cluster pairs of partitions i < j within the block."""

    def block(t: pd.DataFrame) -> Iterator[pd.DataFrame]:
        place, classes = pd.factorize(t["class_id"])
        runs = sorted(t["key"].unique())
        label, names = np.full((len(runs), len(classes)), -1, np.int64), []
        for row, run in zip(label, runs, strict=True):
            mine = np.flatnonzero((t["key"] == run).to_numpy())
            if len(np.unique(place[mine])) < len(mine):
                raise ValueError(f"a class stands twice in partition {run}")
            code, found = pd.factorize(t["cluster_id"].iloc[mine], use_na_sentinel=False)
            row[place[mine]] = code
            names.append(np.asarray(found, object))
        for i in range(len(runs) - 1):
            out = []
            for j in range(i + 1, len(runs)):
                both = (label[i] >= 0) & (label[j] >= 0)
                cell, n = np.unique(label[i][both] * len(names[j]) + label[j][both], return_counts=True)
                out.append(pd.DataFrame({"i": runs[i], "j": runs[j], "l": names[i][cell // len(names[j])], "r": names[j][cell % len(names[j])], "n": n}))
            yield pd.concat(out, ignore_index=True)[list(schema_of)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            t = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(t):
                continue
            last = t["block"].iloc[-1]
            whole, held = t[t["block"] != last], t[t["block"] == last]
            for _, part in whole.groupby("block", sort=False):
                yield from block(part)
        if held is not None and len(held):
            yield from block(held)

    return run


def cross_counts(labels: DataFrame, by: str) -> DataFrame:
    """(i, j, l, r, n) of every pair of partitions i < j of the key column.

    The labels are dealt once into blocks of classes, with all partitions of a class in one; a block counts the cells of every pair, and the blocks'
    cells are added up. So the labels cross a shuffle once, however many pairs there are. A class counts once in a partition; twice is an error.
    """
    kind = dict(labels.dtypes)
    rows = labels.where(F.col("class_id").isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("key"), "class_id", "cluster_id")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block")
    out = ("i", "j", "l", "r", "n")
    schema = f"i {kind[by]}, j {kind[by]}, l {kind['cluster_id']}, r {kind['cluster_id']}, n long"
    return dealt.mapInPandas(_cross_counts(out), schema).groupBy("i", "j", "l", "r").agg(F.sum("n").alias("n"))


def all_pairs(labels: DataFrame, by: str) -> DataFrame:
    """Similarity of every pair of partitions i < j of one key column."""
    n = cross_counts(labels, by)
    w = lambda c: Window.partitionBy("i", "j", c)
    return _from_counts(n.withColumns({"a": F.sum("n").over(w("l")), "b": F.sum("n").over(w("r"))}), ("i", "j"))


def _from_counts(c: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """ARI and arithmetic NMI from a contingency table with its margins."""
    n, a, b = (F.col(x).cast("double") for x in "nab")
    s = c.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(_pairs(n)).alias("s_n"), F.sum((a - 1) / 2 * n).alias("s_a"), F.sum((b - 1) / 2 * n).alias("s_b"), F.sum(n * F.ln(n)).alias("l_n"), F.sum(n * F.ln(a)).alias("l_a"), F.sum(n * F.ln(b)).alias("l_b"))
    t = F.col("total").cast("double")
    expected, top = F.col("s_a") * F.col("s_b") / F.greatest(_pairs(t), F.lit(1.0)), (F.col("s_a") + F.col("s_b")) / 2
    flat = (t < 2) | (F.abs(top - expected) < 1e-12)
    hl, hr = (F.greatest(F.ln(t) - F.col(x) / t, F.lit(0.0)) for x in ("l_a", "l_b"))
    mutual = F.greatest((F.col("l_n") - F.col("l_a") - F.col("l_b")) / t + F.ln(t), F.lit(0.0))
    bottom = (hl + hr) / 2
    return s.select(
        *keys, F.when(flat, 1.0).otherwise((F.col("s_n") - expected) / F.when(flat, 1.0).otherwise(top - expected)).alias("ari"),
        F.when(bottom < 1e-12, 1.0).otherwise(mutual / F.when(bottom < 1e-12, 1.0).otherwise(bottom)).alias("nmi_arithmetic"),
    )


def stability(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.avg(F.when(F.col("ari") >= 1 - 1e-12, 1.0).otherwise(0.0)).alias("identical_share"), *(f(m).alias(f"{m}_{name}") for m in ("ari", "nmi_arithmetic") for name, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))


def medoid(pairs: DataFrame) -> DataFrame:
    """The partition with the largest mean ARI to the others; ties go to the smaller key."""
    both = pairs.select(F.col("i").alias("key"), "ari").union(pairs.select("j", "ari"))
    return both.groupBy("key").agg(F.avg("ari").alias("mean_ari")).orderBy(F.desc(F.round("mean_ari", 12)), "key").limit(1)


def pair_counts(left: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 against a reference."""
    n, a, b = (F.col(x).cast("double") for x in "nab")
    s = contingency(left, reference).agg(F.sum(_pairs(n)).alias("tp"), F.sum((a - 1) / 2 * n).alias("p"), F.sum((b - 1) / 2 * n).alias("r"))
    out = s.select(safe_ratio(F.col("tp"), F.col("p")).alias("precision"), safe_ratio(F.col("tp"), F.col("r")).alias("recall"))
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def coverage(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """How many classes are mapped; names that only one side has."""
    a, b = nodes.select("class_name"), mapping.select("class_name")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(a, "classes").crossJoin(one(a.join(b, "class_name", "left_semi"), "mapped")).crossJoin(one(a.join(b, "class_name", "left_anti"), "unmapped")).crossJoin(one(b.join(a, "class_name", "left_anti"), "unknown"))  # one row each
    return out.withColumn("coverage", safe_ratio(F.col("mapped") * 1.0, F.col("classes")))


def mojo_bound(sizes: Column) -> Column:
    """The distance of the worst partition, from an array of the sizes of the target clusters."""
    groups = F.aggregate(F.array_sort(sizes), F.lit(0).cast("long"), lambda m, x: F.when(x > m, m + 1).otherwise(m))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda m, x: m + x) - groups


def mojo(left: DataFrame, reference: DataFrame) -> DataFrame:
    """MoJo distance and MoJoFM, one row: sums over the contingency table and a largest matching of its edges, all by joins.

    The distance is the classes outside of each cluster's best service, plus the clusters that share theirs. The worst distance is all classes but as many as
    there can be clusters that each lose one to a service of its own: the least, over x, of x plus the services of more than x classes.
    """
    tables = Tables(left.sparkSession, "mojo")
    c = tables.cut(contingency(left, reference).select(F.col("l").cast("string").alias("l"), F.col("r").cast("string").alias("r"), "n"), "overlap")
    best = c.groupBy("l").agg(F.max("n").alias("best"))
    pairs = largest_matching(c.join(best, "l").where("n = best").select("l", "r"))
    sums = best.agg(F.coalesce(F.sum("best"), F.lit(0)).alias("stay"), F.count("*").alias("clusters"))
    sizes = c.groupBy("r").agg(F.sum("n").alias("size")).groupBy("size").agg(F.count("*").alias("services"))
    places = with_prefix_sum(sizes, [], [F.desc("size")], "services", "larger")
    worst = places.agg(F.coalesce(F.sum(F.col("size") * F.col("services")), F.lit(0)).alias("classes"), F.sum("services").alias("all"), F.min(F.col("size") + F.col("larger")).alias("least"))
    one = sums.crossJoin(F.broadcast(worst)).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("matched"))))  # one row each
    distance = F.col("classes") - F.col("stay") + F.col("clusters") - F.col("matched")
    most = F.col("classes") - F.coalesce(F.least("all", "least"), F.lit(0))
    share = F.when(F.col("classes") == 0, 0.0).when(most <= 0, F.when(distance == 0, 100.0).otherwise(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (1 - distance / F.when(most <= 0, 1).otherwise(most)))))
    return one.select(distance.cast("long").alias("mojo"), share.alias("mojofm"))


def assignment(overlap: np.ndarray) -> list[tuple[int, int]]:
    """Matching of rows to columns with the largest total overlap (shortest augmenting paths)."""
    flip = overlap.shape[0] > overlap.shape[1]
    cost = -(overlap.T if flip else overlap).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = match[j0]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, low[1:])))
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def overlap_matching(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r and overlap of the maximum-overlap matching of clusters."""

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        p = t.pivot_table(index="l", columns="r", values="n", fill_value=0, aggfunc="sum").sort_index().sort_index(axis=1)
        n = p.to_numpy()
        return pd.DataFrame([(str(p.index[i]), str(p.columns[j]), int(n[i, j])) for i, j in assignment(n)], columns=["l", "r", "overlap"])

    c = contingency(left, right).select(F.col("l").cast("string").alias("l"), F.col("r").cast("string").alias("r"), "n")
    return c.groupBy(F.lit(1).alias("one")).applyInPandas(lambda t: solve(t), "l string, r string, overlap long")


def flows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared classes of cluster pairs, with the barycentre of each right cluster over left ids."""
    c = contingency(left, right).select("l", "r", F.col("n").alias("shared"))
    return c.withColumn("barycentre", F.sum(F.col("l") * F.col("shared")).over(Window.partitionBy("r")) / F.sum("shared").over(Window.partitionBy("r")))

"""Objectives of candidate partitions, bounds, Pareto fronts and hypervolume."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order_stats import matched
from tessera.operators.partition import safe_ratio
from tessera.operators.skyline import local_skyline, skyline  # noqa: F401
from tessera.sources.shared import Tables

TOLERANCE = 1e-12


def structural_objectives(edges: DataFrame, candidates: DataFrame, weight: str, keys: tuple[str, ...] = ("solution_id",)) -> DataFrame:
    """coupling, cohesion and imbalance of each candidate partition (keys, class_id, cluster_id)."""
    sizes = candidates.groupBy(*keys, "cluster_id").agg(F.count("*").alias("size"))
    a = candidates.select(*keys, F.col("class_id").alias("source"), F.col("cluster_id").alias("source_cluster"))
    b = candidates.select(*keys, F.col("class_id").alias("target"), F.col("cluster_id").alias("target_cluster"))
    placed = a.join(edges.select("source", "target", F.col(weight).alias("w")), "source").join(b, [*keys, "target"])
    inner = F.col("source_cluster") == F.col("target_cluster")
    per = placed.groupBy(*keys, F.col("source_cluster").alias("cluster_id")).agg(F.sum("w").alias("all"), F.sum(F.when(inner, F.col("w")).otherwise(0.0)).alias("inside"))
    density = safe_ratio(2 * F.coalesce("inside", F.lit(0.0)), F.col("size") * (F.col("size") - 1.0))
    joined = sizes.join(per, [*keys, "cluster_id"], "left")
    out = joined.groupBy(*keys).agg(F.sum("all").alias("total"), F.sum("inside").alias("inside"), F.avg(density).alias("cohesion"), F.coalesce(safe_ratio(F.stddev_pop("size"), F.avg("size")), F.lit(0.0)).alias("imbalance"))
    return out.select(*keys, F.coalesce(safe_ratio(F.col("total") - F.col("inside"), F.col("total")), F.lit(0.0)).alias("coupling"), "cohesion", "imbalance")


def internal_weights(edges: DataFrame, candidates: DataFrame, weight: str, keys: tuple[str, ...] = ("solution_id",)) -> DataFrame:
    a = candidates.select(*keys, F.col("class_id").alias("source"), "cluster_id")
    b = candidates.select(*keys, F.col("class_id").alias("target"), "cluster_id")
    return a.join(edges.select("source", "target", weight), "source").join(b, [*keys, "target", "cluster_id"]).groupBy(*keys, "cluster_id").agg(F.sum(weight).alias("internal_weight"))


def admissibility(candidates: DataFrame, largest_share: float = 0.4, keys: tuple[str, ...] = ("solution_id",)) -> DataFrame:
    """Violations: largest share over the limit, clusters missing to two; feasible when neither is positive."""
    s = candidates.groupBy(*keys, "cluster_id").agg(F.count("*").alias("size")).groupBy(*keys).agg((F.max("size") / F.sum("size") - largest_share).alias("size_violation"), (2 - F.count("*")).alias("count_violation"))
    return s.withColumn("feasible", (F.col("size_violation") <= 0) & (F.col("count_violation") <= 0))


def semantic_total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))


def semantic_objective(edges: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("solution_id",)) -> DataFrame:
    """1 - internal share of semantic weight; no weight at all gives 1."""
    e = edges.select(F.col("class_id_a").alias("source"), F.col("class_id_b").alias("target"), "weight")
    inside = internal_weights(e, candidates, "weight", keys).groupBy(*keys).agg(F.sum("internal_weight").alias("inside"))
    every = candidates.select(*keys).distinct().crossJoin(semantic_total(edges))  # one row
    j = every.join(inside, list(keys), "left")
    return j.select(*keys, F.when(F.col("total_weight") == 0, 1.0).otherwise(1 - F.coalesce("inside", F.lit(0.0)) / F.when(F.col("total_weight") == 0, 1.0).otherwise(F.col("total_weight"))).alias("f_semantic"))


def imbalance_bound(n: Column, largest_share: Column) -> Column:
    """The largest population std over mean of the sizes of any admissible partition of n classes."""
    top = F.greatest(F.lit(1), F.floor(n * largest_share)).cast("int")

    def at(k: Column) -> Column:
        spare = n - k
        full = F.when(top > 1, F.floor(spare / F.greatest(top - 1, F.lit(1)))).otherwise(0)
        rest = spare - full * (top - 1)
        squares = full * top * top + F.when(rest > 0, (rest + 1) * (rest + 1)).otherwise(0) + (k - full - F.when(rest > 0, 1).otherwise(0))
        mean = n / k
        fits = (full + F.when(rest > 0, 1).otherwise(0) <= k) & ((top > 1) | (spare == 0))
        return F.when(fits, F.sqrt(F.greatest(squares / k - mean * mean, F.lit(0.0))) / mean)

    return F.when(n < 2, 0.0).otherwise(F.array_max(F.transform(F.sequence(F.lit(2), F.greatest(n.cast("int"), F.lit(2))), at)))


def theoretical_bounds(nodes: DataFrame, edges: DataFrame, weight: str = "raw_weight", largest_share: float = 0.4) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.coalesce(F.max(weight), F.lit(0.0)).alias("w")))  # one row each
    return n.select(F.lit(0.0).alias("coupling_low"), F.lit(1.0).alias("coupling_high"), (-F.col("w")).alias("cohesion_low"), F.lit(0.0).alias("cohesion_high"), F.lit(0.0).alias("imbalance_low"), imbalance_bound(F.col("n"), F.lit(largest_share)).alias("imbalance_high"))


def observed_bounds(front: DataFrame, objectives: Sequence[str]) -> DataFrame:
    pad = lambda c: F.greatest(0.1 * (F.max(c) - F.min(c)), F.lit(1e-6))
    return front.agg(*(x for c in objectives for x in ((F.min(c) - pad(c)).alias(f"{c}_low"), (F.max(c) + pad(c)).alias(f"{c}_high"))))


def reference_point(front: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Nadir plus the larger of 10% of the span and 1e-6; an empty front has a fixed point."""
    empty = (1.1, 0.1, 1.1)
    return front.agg(*(F.coalesce(F.max(c) + F.greatest(0.1 * (F.max(c) - F.min(c)), F.lit(1e-6)), F.lit(e)).alias(f"{c}_reference") for c, e in zip(objectives, empty, strict=False)))


def normalized(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    span = high - low
    z = safe_ratio(value - low, span)
    return F.when((z < -TOLERANCE) | (z > 1 + TOLERANCE), F.raise_error(F.lit("objective outside its bounds")).cast("double")).otherwise(F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)))


def dominates(a: str, b: str, objectives: Sequence[str], tolerance: float = 0.0) -> Column:
    """Row a dominates row b (minimisation)."""
    le = [F.col(f"{a}.{c}") <= F.col(f"{b}.{c}") + tolerance for c in objectives]
    lt = [F.col(f"{a}.{c}") < F.col(f"{b}.{c}") - tolerance for c in objectives]
    out, some = le[0], lt[0]
    for x in le[1:]:
        out = out & x
    for x in lt[1:]:
        some = some | x
    return out & some


def nondominated(rows: DataFrame, objectives: Sequence[str], keys: tuple[str, ...]) -> DataFrame:
    """Rows that no other row of the same run dominates; duplicates all stay."""
    return skyline(rows, objectives, keys)


def feasible_front(rows: DataFrame, objectives: Sequence[str], keys: tuple[str, ...]) -> DataFrame:
    """The front among feasible rows of a run; among all rows of runs without any."""
    some = rows.withColumn("_any", F.max("feasible").over(Window.partitionBy(*keys)))
    return nondominated(some.where("feasible OR NOT _any").drop("_any"), objectives, keys)


def numbered(rows: DataFrame, objectives: Sequence[str], labels: str = "label_vector") -> DataFrame:
    """One row for each canonical partition of a seed, in order of objectives and labels, named seed<n>_solution<iii>."""
    one = rows.withColumn("_k", F.row_number().over(Window.partitionBy("seed", labels).orderBy(*objectives))).where("_k = 1").drop("_k")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(*objectives, labels)) - 1
    return one.withColumn("solution_id", F.format_string("seed%d_solution%03d", F.col("seed"), place))


def projected(rows: DataFrame, objectives: Sequence[str], keys: tuple[str, ...]) -> DataFrame:
    """Front of fewer objectives; of equal objective vectors the smallest solution_id stays."""
    front = nondominated(rows, objectives, keys)
    w = Window.partitionBy(*keys, *objectives).orderBy("solution_id")
    return front.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


class Staircase:
    """Nondominated (x, y) in order of x, and the area that they dominate up to the reference."""

    def __init__(self, x: float, y: float):
        self.x, self.y, self.xs, self.ys, self.area = x, y, [], [], 0.0

    def add(self, x: float, y: float) -> None:
        i = bisect_left(self.xs, x)
        if i and self.ys[i - 1] <= y:
            return
        if i < len(self.xs) and self.xs[i] == x and self.ys[i] <= y:
            return
        j = i
        while j < len(self.xs) and self.ys[j] >= y:
            j += 1
        # strips from x to the first step that stays, over the heights that they had
        left, top = x, self.ys[i - 1] if i else self.y
        for k in range(i, j):
            self.area += (self.xs[k] - left) * (top - y)
            left, top = self.xs[k], self.ys[k]
        self.area += ((self.xs[j] if j < len(self.xs) else self.x) - left) * (top - y)
        self.xs[i:j], self.ys[i:j] = [x], [y]


def swept_volume(points: np.ndarray, reference: Sequence[float], below: np.ndarray | None = None, end: float | None = None) -> float:
    """Volume between the smallest z of the points and `end` that they, and points (x, y) below, dominate: a sweep along z."""
    stairs, volume = Staircase(*reference[:2]), 0.0
    for x, y in below.tolist() if below is not None else ():
        stairs.add(x, y)
    p = points[np.argsort(points[:, 2], kind="stable")]
    tops = np.append(p[1:, 2], reference[2] if end is None else end)
    for (x, y, z), top in zip(p.tolist(), tops.tolist(), strict=True):
        stairs.add(x, y)
        volume += (top - z) * stairs.area
    return volume


def hypervolume(points: np.ndarray, reference: Sequence[float]) -> float:
    """Dominated volume to the reference point: closed up to two objectives, a sweep for three, slices of the last one beyond."""
    p = np.asarray(points, float).reshape(-1, len(reference))
    ref = np.asarray(reference, float)
    p = p[(p < ref).all(1)]
    if not len(p):
        return 0.0
    if len(ref) == 1:
        return float(ref[0] - p.min())
    if len(ref) == 2:
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        low = np.minimum.accumulate(p[:, 1])
        right = np.append(p[1:, 0], ref[0])
        return float(((right - p[:, 0]) * (ref[1] - low)).sum())
    if len(ref) == 3:
        return swept_volume(p, ref.tolist())
    p = p[np.argsort(p[:, -1], kind="stable")]
    tops = np.append(p[1:, -1], ref[-1])
    return float(sum((t - p[i, -1]) * hypervolume(p[: i + 1, :-1], ref[:-1]) for i, t in enumerate(tops) if t > p[i, -1]))


#: Points of a slice, and slices of a run at most.
SLICE_POINTS, SLICES = 1 << 12, 64


def hypervolumes(front: DataFrame, objectives: Sequence[str], reference: Sequence[float], key: str) -> DataFrame:
    """One value a run. With three objectives a run is dealt to tasks by slices of the third; else a run, whose front is as large as a population, is one task."""
    names = list(objectives)
    if len(names) == 3:
        return sliced_volumes(front, names, reference, key)

    def run(k, t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "hypervolume": [hypervolume(t[names].to_numpy(float), reference)]})

    kind = front.schema[key].dataType.simpleString()
    return front.groupBy(key).applyInPandas(run, f"{key} {kind}, hypervolume double")


def sliced_volumes(front: DataFrame, names: Sequence[str], reference: Sequence[float], key: str) -> DataFrame:
    """Volumes of three objectives: each slice of z sweeps its own points over the staircases of the slices before.

    A slice ends where the next one begins, so the slices' volumes add up. A slice sends the staircase of its points, not the points. A run
    without points inside the reference has volume 0.
    """
    tables, ref = Tables(front.sparkSession, "volumes"), [float(r) for r in reference]
    x, y, z = (F.col(c).cast("double") for c in names)
    inside = (x < ref[0]) & (y < ref[1]) & (z < ref[2])
    points = tables.cut(front.where(inside).select(F.col(key).alias("key"), x.alias("x"), y.alias("y"), z.alias("z")).distinct(), "points")
    cuts = points.groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("z", [k / SLICES for k in range(1, SLICES)], 10_000).alias("at"))
    step = F.greatest(F.lit(1), F.floor(F.lit(SLICES) / F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / SLICE_POINTS)))))).cast("int")
    cuts = cuts.select("key", F.filter("at", lambda _, i: (i + 1) % step == 0).alias("at"))
    placed = tables.cut(matched(points, cuts, ["key"]).select("key", "x", "y", "z", F.expr("size(filter(at, c -> c <= z))").alias("slice")), "slices")
    starts = placed.groupBy("key", "slice").agg(F.min("z").alias("z"))
    ends = tables.cut(starts.withColumn("end", F.coalesce(F.lead("z").over(Window.partitionBy("key").orderBy("slice")), F.lit(ref[2]))).drop("z"), "ends")  # a row a slice

    def stairs(k, t: pd.DataFrame) -> pd.DataFrame:
        s = Staircase(*ref[:2])
        for a, b in t[["x", "y"]].sort_values(["x", "y"]).to_numpy(float).tolist():
            s.add(a, b)
        return pd.DataFrame({"key": [k[0]] * len(s.xs), "slice": k[1], "x": s.xs, "y": s.ys})

    kind = points.schema["key"].dataType.simpleString()
    below = placed.groupBy("key", "slice").applyInPandas(stairs, f"key {kind}, slice int, x double, y double")
    later = ends.select(F.col("key").alias("_key"), F.col("slice").alias("later"))
    sent = below.join(later, F.col("key").eqNullSafe(F.col("_key")) & (F.col("later") > F.col("slice"))).select("key", F.col("later").alias("slice"), "x", "y", F.lit(None).cast("double").alias("z"))
    every = matched(placed.select("key", "slice", "x", "y", "z").union(sent), ends, ["key", "slice"])

    def sweep(k, t: pd.DataFrame) -> pd.DataFrame:
        own = t["z"].notna().to_numpy()
        p = t[["x", "y", "z"]].to_numpy(float)
        return pd.DataFrame({"key": [k[0]], "part": [swept_volume(p[own], ref, p[~own][:, :2], float(t["end"].iloc[0]))]})

    parts = every.groupBy("key", "slice").applyInPandas(sweep, f"key {kind}, part double").groupBy("key").agg(F.sum("part").alias("volume"))
    runs = front.select(F.col(key).alias("key")).distinct()
    return matched(runs, parts, ["key"], "left").select(F.col("key").alias(key), F.coalesce("volume", F.lit(0.0)).alias("hypervolume"))


def hypervolume_2d(front: DataFrame, x: str, y: str, reference: tuple[float, float], keys: tuple[str, ...]) -> DataFrame:
    """Two objectives in window functions."""
    inside = front.where((F.col(x) < reference[0]) & (F.col(y) < reference[1])).select(*keys, x, y).distinct()
    w = Window.partitionBy(*keys).orderBy(x, y)
    low = F.min(y).over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = (F.coalesce(F.lead(x).over(w), F.lit(float(reference[0]))) - F.col(x)) * (reference[1] - low)
    return inside.withColumn("_v", step).groupBy(*keys).agg(F.sum("_v").alias("hypervolume"))


def hypervolume_summary(values: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    v = F.col("hypervolume")
    return values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def best_so_far(history: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return history.withColumn("best", F.max("hypervolume").over(Window.partitionBy(*keys).orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)))


def plateau(history: DataFrame, keys: tuple[str, ...], share: float = 0.01, last: int = 20) -> DataFrame:
    """First generation within a share of the final best, and the gain of the last generations."""
    h = best_so_far(history, keys)
    w = Window.partitionBy(*keys)
    h = h.withColumns({"final": F.max("best").over(w), "n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("generation")) - 1})
    return h.groupBy(*keys).agg(
        F.min(F.when(F.col("best") >= (1 - share) * F.col("final"), F.col("generation"))).alias("plateau_generation"),
        (F.max("final") - F.max(F.when(F.col("i") == F.greatest(F.col("n") - last, F.lit(0)), F.col("best")))).alias("late_gain"),
    )


def baseline_diagnostics(front: DataFrame, baseline: DataFrame, objectives: Sequence[str], key: str) -> DataFrame:
    """For each run: front rows that dominate the baseline, and that it dominates."""
    j = front.alias("f").join(baseline.alias("l"), F.col(f"f.{key}") == F.col(f"l.{key}"))
    return j.groupBy(F.col(f"f.{key}").alias(key)).agg(
        F.count("*").alias("front_size"), F.count_if(dominates("f", "l", objectives)).alias("dominating"), F.count_if(dominates("l", "f", objectives)).alias("dominated")
    )

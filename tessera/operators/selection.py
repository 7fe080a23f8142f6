"""Representatives by a modularity band and lexicographic order. The four selectors keep their own tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_carry

TOLERANCE = 1e-12
BUDGETS = (0.0, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15)


def relative_loss(best: Column, q: Column, absolute: bool = False) -> Column:
    """Loss against the best; a tiny best counts as 1 (or gives the absolute loss, which is the same number)."""
    return (best - q) / F.when(F.abs(best) <= TOLERANCE, 1.0).otherwise(F.abs(best))


def select_solution(front: DataFrame, keys: tuple[str, ...], band: float = 0.05) -> DataFrame:
    """Feasible rows (all, where none is) in the band; least imbalance, most modularity, least coupling, id, labels."""
    w = Window.partitionBy(*keys)
    usable = front.withColumn("_any", F.max("feasible").over(w)).where("feasible OR NOT _any")
    usable = usable.withColumn("_q", F.max("weighted_modularity").over(w)).where(relative_loss(F.col("_q"), F.col("weighted_modularity")) <= band + TOLERANCE)
    order = w.orderBy("imbalance", F.desc("weighted_modularity"), "coupling", "solution_id", *(["label_vector"] if "label_vector" in front.columns else []))
    return usable.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_any", "_q", "_k")


def select_budgets(front: DataFrame, keys: tuple[str, ...], budgets=BUDGETS) -> DataFrame:
    """One row for each run and budget, with the best modularity and the number of eligible rows."""
    b = F.explode(F.array(*(F.lit(float(x)) for x in budgets)))
    w = Window.partitionBy(*keys, "budget")
    rows = front.withColumn("q_max", F.max("weighted_modularity").over(Window.partitionBy(*keys))).withColumn("budget", b)
    rows = rows.where(relative_loss(F.col("q_max"), F.col("weighted_modularity")) <= F.col("budget") + TOLERANCE).withColumn("eligible", F.count("*").over(w))
    order = w.orderBy("imbalance", F.desc("weighted_modularity"), "coupling", "solution_id")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


RULES = {
    "balance": ("imbalance", "-weighted_modularity", "solution_id"),
    "semantic": ("f_semantic", "-weighted_modularity", "solution_id"),
    "modularity": ("-weighted_modularity", "imbalance", "solution_id"),
}


def _order(keys) -> list[Column]:
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]


def select_candidate(front: DataFrame, keys: tuple[str, ...], rule: str, budget: float | None = None) -> DataFrame:
    """front needs q_loss (against the baseline) where a budget is given; runs without an eligible row give none."""
    rows = front if budget is None else front.where(F.col("q_loss") <= budget + TOLERANCE)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(RULES[rule])))).where("_k = 1").drop("_k")


#: The operating profiles, their band and orders.
PROFILES = {
    "P0": (False, ("-weighted_modularity", "imbalance", "coupling", "-cohesion", "f_semantic", "solution_id")),
    "P1": (True, ("imbalance", "-weighted_modularity", "coupling", "-cohesion", "solution_id")),
    "P2": (True, ("coupling", "-weighted_modularity", "imbalance", "-cohesion", "solution_id")),
    "P3": (True, ("-cohesion", "-weighted_modularity", "imbalance", "coupling", "solution_id")),
    "P4": (True, ("f_semantic", "-weighted_modularity", "imbalance", "coupling", "-cohesion", "solution_id")),
}


def operating_profiles(front: DataFrame, keys: tuple[str, ...], band: float = 0.05) -> DataFrame:
    """The row of each run and profile; runs whose best modularity is not positive are an error."""
    w = Window.partitionBy(*keys)
    rows = front.where("feasible").withColumn("q_max", F.max("weighted_modularity").over(w))
    rows = rows.withColumn("q_max", F.when(F.col("q_max") <= 0, F.raise_error(F.lit("modularity must be positive")).cast("double")).otherwise(F.col("q_max")))
    rows = rows.withColumn("in_band", (F.col("q_max") - F.col("weighted_modularity")) / F.col("q_max") <= band + TOLERANCE)
    ranks = {}
    for name, (banded, order) in PROFILES.items():
        first = [F.desc("in_band")] if banded else []
        ranks[f"_{name}"] = F.row_number().over(w.orderBy(*first, *_order(order)))
    ranked = rows.withColumns(ranks)
    names = F.filter(F.array(*(F.when(F.col(f"_{n}") == 1, n) for n in PROFILES)), lambda x: x.isNotNull())
    return ranked.withColumn("profile_id", F.explode(names)).drop(*ranks)


def band_membership(front: DataFrame, profiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each row of the front with one flag a profile."""
    picked = profiles.groupBy(*keys, "solution_id").agg(*(F.max(F.col("profile_id") == p).alias(f"selected_{p}") for p in PROFILES))
    flags = [F.coalesce(f"selected_{p}", F.lit(False)).alias(f"selected_{p}") for p in PROFILES]
    return front.select(*keys, "solution_id").join(picked, [*keys, "solution_id"], "left").select(*keys, "solution_id", *flags)


def summarize_selection(selected: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return selected.groupBy(*by).agg(F.avg("imbalance").alias("imbalance_mean"), F.median("imbalance").alias("imbalance_median"), F.countDistinct("solution_id").alias("solutions"))


def admissible(sweep: DataFrame) -> DataFrame:
    """Flags of a parameter sweep and is_candidate; the target cluster count is the rounded (half-even) median."""
    target = sweep.agg(F.greatest(F.lit(1), F.bround(F.median("cluster_count"), 0).cast("int")).alias("_target"))
    f = sweep.crossJoin(F.broadcast(target))  # one row
    flags = {
        "rejected_extreme_cluster_count": F.col("cluster_count") > F.greatest(F.col("_target") * 3, F.col("_target") + 10),
        "rejected_high_max_cluster_ratio": F.col("max_cluster_ratio") > 0.4,
        "rejected_high_singleton_ratio": F.col("singleton_ratio") > 0.15,
        "rejected_low_reference_coverage": F.col("reference_coverage_ratio") < 0.8,
        "rejected_high_ssa_lambda": F.col("ssa_lambda") > 1.0,
    }
    out = f.withColumns(flags).drop("_target")
    rejected = F.lit(False)
    for name in flags:
        rejected = rejected | F.col(name)
    return out.withColumns({"is_candidate": ~rejected, "resolution_distance": F.abs(F.col("resolution") - 1.0), "is_stress_lambda": F.col("ssa_lambda") > 1.0})


TAIL = ("-internal_edge_weight_ratio", "max_cluster_ratio", "singleton_ratio", "resolution_distance", "-pairwise_f1", "-mojofm_vs_reference")


def ranked_settings(sweep: DataFrame, top: int = 10) -> DataFrame:
    return admissible(sweep).orderBy(F.desc("is_candidate"), "is_stress_lambda", F.desc("weighted_modularity"), *_order(TAIL), "setting").limit(top)


def baseline_profile(sweep: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The admissible flow setting within a tolerance of the best modularity with the smallest lambda."""
    ok = admissible(sweep).where("is_candidate AND ssa_lambda > 0")
    best = ok.agg(F.max("weighted_modularity").alias("_best"))
    return ok.crossJoin(F.broadcast(best)).where(F.col("weighted_modularity") >= F.col("_best") - tolerance).drop("_best").orderBy("ssa_lambda", *_order(TAIL), "setting").limit(1)


def threshold_sensitivity(front: DataFrame, keys: tuple[str, ...], column: str, thresholds) -> DataFrame:
    """The selection of each run after rows over a threshold go, and the share that went; empty runs are left out."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))
    rows = front.withColumn("threshold", t)
    share = rows.groupBy(*keys, "threshold").agg(F.avg(F.when(F.col(column) > F.col("threshold"), 1.0).otherwise(0.0)).alias("trimmed_share"))
    return select_solution(rows.where(F.col(column) <= F.col("threshold")), (*keys, "threshold")).join(share, [*keys, "threshold"])


def nearest_match(left: DataFrame, right: DataFrame, scope: str, value: str = "imbalance", key: str = "seed") -> DataFrame:
    """For each left row the right row of nearest value, in the same seed, pooled, or with a cluster count within 1.

    The pooled and the count scope find the neighbours in the union sorted by value (in the count scope, by count and value, where a right row stands in for each
    count that it matches), so no row meets all others.
    """
    a = left.select(F.col(key).alias("left_key"), F.col(value).alias("left_value"), F.col("cluster_count").alias("left_count"))
    b = right.select(F.col(key).alias("right_key"), F.col("solution_id").alias("right_id"), F.col(value).alias("right_value"), F.col("cluster_count").alias("right_count"))
    if scope == "same":
        j = a.join(b, F.col("left_key") == F.col("right_key"), "left")
    elif scope in ("pooled", "count"):
        # only the nearest distinct value on either side can win: both are carried along the union, range by range
        counts = F.array(F.col("right_count") - 1, F.col("right_count"), F.col("right_count") + 1)
        near = b.withColumn("_c", F.explode(counts) if scope == "count" else F.lit(0))
        wanted = a.withColumn("_c", F.col("left_count") if scope == "count" else F.lit(0))
        first = near.groupBy("_c", "right_value").agg(F.min(F.struct("right_key", "right_id", "right_count")).alias("m"))
        one = first.select("_c", F.struct("right_value", "m.right_key", "m.right_id", "m.right_count", F.col("_c").alias("right_c")).alias("r"), F.col("right_value").alias("v"))
        mine = wanted.where("left_value IS NOT NULL").select("_c", F.lit(None).cast(one.schema["r"].dataType).alias("r"), F.col("left_value").alias("v"), F.struct(*a.columns).alias("l"))
        both = one.withColumn("l", F.lit(None).cast(mine.schema["l"].dataType)).unionByName(mine)
        seen = with_carry(both, [F.col("_c"), F.col("v"), F.col("r").isNull()], "r", "below", "above").where("l IS NOT NULL")
        # what was carried in from another count is no neighbour
        own = lambda side: F.when(F.col(side)["right_c"] == F.col("_c"), F.col(side))
        j = seen.select("l.*", F.explode(F.array(own("below"), own("above"))).alias("r")).select(*a.columns, "r.*").drop("right_c")
        # no value is equally far from all: the first right row is taken
        any_ = near.groupBy("_c").agg(F.min(F.struct("right_key", "right_id", "right_value", "right_count")).alias("m"))
        j = j.unionByName(wanted.where("left_value IS NULL").join(any_, "_c", "left").select(*a.columns, "m.*"))
    else:
        raise ValueError(scope)
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    w = Window.partitionBy("left_key").orderBy(gap.asc_nulls_last(), "right_key", "right_id")
    return j.withColumns({"gap": gap, "match_found": F.col("right_id").isNotNull()}).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def caliper_counts(matches: DataFrame, calipers=(0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    c = F.explode(F.array(*(F.lit(float(x)) for x in calipers)))
    return matches.withColumn("caliper", c).groupBy("caliper").agg(F.count_if(F.col("match_found") & (F.col("gap") <= F.col("caliper"))).alias("within"), F.count("*").alias("rows"))


def relative_gain(base: Column, value: Column) -> Column:
    return F.when(base == 0, F.raise_error(F.lit("baseline is zero")).cast("double")).otherwise((base - value) / F.when(base == 0, 1.0).otherwise(F.abs(base)))


def reverse_targets(front: DataFrame, keys: tuple[str, ...], gains=(0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """Smallest modularity loss of a run that reaches each semantic gain, and a summary over runs."""
    g = F.explode(F.array(*(F.lit(float(x)) for x in gains)))
    per = front.withColumn("target", g).groupBy(*keys, "target").agg(F.min(F.when(F.col("semantic_gain") >= F.col("target") - TOLERANCE, F.col("q_loss"))).alias("loss"))
    return per.groupBy("target").agg(F.count("*").alias("runs"), F.count("loss").alias("available"), F.median("loss").alias("median_loss"), F.max("loss").alias("max_loss"))

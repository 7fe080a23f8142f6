"""Checks of inputs: each returns counts or offenders, and `require` turns them into errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Evidence kinds and the dependency type that each implies, and flow types.
KIND_TYPES = {"inheritance": "type", "interface_implementation": "type", "field_type_reference": "type", "method_parameter_type_reference": "type", "method_return_type_reference": "type", "method_call": "call"}
FLOW_TYPES = ("return_value_flow", "argument_passing_flow")
CHANNEL_WEIGHTS = {"type": 1.0, "call": 2.0, "return_value_flow": 3.0, "argument_passing_flow": 3.0}


class ValidationError(ValueError):
    pass


def weight_faults(rows: DataFrame, column: str = "weight") -> DataFrame:
    v = F.col(column).try_cast("double")
    return rows.agg(F.count_if(v.isNull() | F.isnan(v)).alias("not_numeric"), F.count_if(v < 0).alias("negative"), F.count("*").alias("rows"))


def missing_values(rows: DataFrame, columns) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def not_allowed(rows: DataFrame, column: str, allowed) -> DataFrame:
    return rows.where(~F.col(column).isin(*allowed)).select(F.col(column).alias("value")).distinct()


def kind_conflicts(rows: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in KIND_TYPES.items() for x in kv))
    return rows.where(F.try_element_at(table, F.col("evidence_kind")) != F.col("dependency_type")).select("evidence_kind", "dependency_type").distinct()


def unknown_ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends that are no node; null ends are left out here."""
    ends = rows.select(F.explode(F.array("source", "target")).alias("class_id")).where("class_id IS NOT NULL").distinct()
    return ends.join(nodes.select("class_id"), "class_id", "left_anti")


def channel_weights(rows: DataFrame, channel: str, expected: dict[str, float] | None = None) -> DataFrame:
    """Observed distinct weights of each channel against the expected one; a channel without rows passes."""
    table = F.create_map(*(F.lit(x) for kv in (expected or CHANNEL_WEIGHTS).items() for x in kv))
    seen = rows.groupBy(F.col(channel).alias("channel")).agg(F.sort_array(F.collect_set("weight")).alias("observed"), F.count("*").alias("rows"))
    return seen.select("channel", "rows", F.to_json("observed").alias("observed"), (F.col("observed") == F.array(F.try_element_at(table, F.col("channel")))).alias("valid"))


def partition_scope(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes that a partition has more than once, lacks, or adds."""
    n = labels.groupBy("class_id").agg(F.count("*").alias("n"))
    j = nodes.select("class_id", F.lit(1).alias("known")).join(n, "class_id", "full")
    return j.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("extra"))


def semantic_edge_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    w = F.col("weight")
    one = edges.agg(F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))).alias("not_finite"), F.count_if(w < 0).alias("negative"), F.count_if(F.col("class_id_a") == F.col("class_id_b")).alias("loops"), F.count_if(F.col("class_id_a") > F.col("class_id_b")).alias("unordered"), (F.count("*") - F.countDistinct("class_id_a", "class_id_b")).alias("repeated"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    ends = edges.select(F.explode(F.array("class_id_a", "class_id_b")).alias("class_id")).distinct()
    return one.crossJoin(ends.join(nodes, "class_id", "left_anti").agg(F.count("*").alias("unknown")))  # one row each


def run_grid(runs: DataFrame, subjects: DataFrame, seeds: int) -> DataFrame:
    """Runs of the (subject, seed) grid that are missing, repeated or extra; the grid is subjects x seeds."""
    grid = subjects.select("subject", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).withColumn("_e", F.lit(1))
    n = runs.groupBy("subject", F.col("seed").cast("int").alias("seed")).agg(F.count("*").alias("n"))
    j = grid.join(n, ["subject", "seed"], "full")
    return j.select("subject", "seed", F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("n") > 1, "repeated").alias("fault")).where("fault IS NOT NULL")


def universe_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("class_id"), b.select("class_id")
    return x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))


def objective_mismatch(saved: DataFrame, recomputed: DataFrame, keys, objectives, tolerance: float = 1e-12) -> DataFrame:
    j = saved.alias("a").join(recomputed.alias("b"), list(keys), "full")
    bad = F.lit(False)
    for c in objectives:
        bad = bad | ~F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance, F.lit(False))
    return j.where(bad).select(*keys)


def text_hash_faults(inputs: DataFrame) -> DataFrame:
    return inputs.agg(F.count("*").alias("rows"), F.countDistinct("class_id").alias("ids"), F.count_if(F.sha2("semantic_text", 256) != F.col("input_hash")).alias("wrong_hash"))


def inventory_faults(found: DataFrame, expected: DataFrame) -> DataFrame:
    """path and fault (missing, extra, changed) of an inventory of files (path, sha256) against the expected one."""
    j = found.select("path", F.col("sha256").alias("_f")).join(expected.select("path", F.col("sha256").alias("_e")), "path", "full")
    return j.select("path", F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_f") != F.col("_e"), "changed").alias("fault")).where("fault IS NOT NULL")


def require(faults: DataFrame, message: str) -> None:
    """Raise when a table of offenders has rows; the message shows at most ten."""
    rows = faults.limit(10).collect()
    if rows:
        raise ValidationError(f"{message}: {', '.join(sorted(str(r[0]) for r in rows))}")

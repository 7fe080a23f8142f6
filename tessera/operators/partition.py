"""Metrics of one partition, differences between two, and label vectors.

Ratios follow the documented rules for empty cases: a share of nothing is 0, internal over external weight with no external weight is the
internal weight itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import PAIR, canonical_pairs, ends, labelled
from tessera.operators.ordinals import with_ordinal


def safe_ratio(top: Column, bottom: Column, empty: Column | float = 0.0) -> Column:
    return F.when(bottom == 0, empty if isinstance(empty, Column) else F.lit(empty)).otherwise(top / F.when(bottom == 0, F.lit(None)).otherwise(bottom))


def weight_split(edges: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    """internal_weight and external_weight; edges with an unmapped end are left out."""
    inner = F.col("source_cluster") == F.col("target_cluster")
    return labelled(edges, labels).agg(
        F.coalesce(F.sum(F.when(inner, F.col(weight))), F.lit(0.0)).alias("internal_weight"), F.coalesce(F.sum(F.when(~inner, F.col(weight))), F.lit(0.0)).alias("external_weight")
    )


def modularity_parts(edges: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    """cluster_id, internal weight, degree sum and its contribution to weighted modularity."""
    e = labelled(edges, labels).where(F.col(weight) != 0)
    inner = F.when(F.col("source_cluster") == F.col("target_cluster"), F.col(weight)).otherwise(0.0)
    sides = e.select(F.col("source_cluster").alias("cluster_id"), inner.alias("inside"), F.col(weight).alias("w")).union(e.select("target_cluster", F.lit(0.0), F.col(weight)))
    per = sides.groupBy("cluster_id").agg(F.sum("inside").alias("inside"), F.sum("w").alias("degree"))
    total = per.agg((F.sum("degree") / 2).alias("total"))
    part = F.col("inside") / F.col("total") - F.pow(F.col("degree") / (2 * F.col("total")), 2)
    return per.crossJoin(F.broadcast(total)).select("cluster_id", "inside", "degree", part.alias("contribution"))  # total is one row


def modularity(edges: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    return modularity_parts(edges, labels, weight).agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("weighted_modularity"))


def modularity_extremes(edges: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    p = modularity_parts(edges, labels, weight)
    key = F.struct("contribution", "cluster_id")
    return p.agg(F.max_by("cluster_id", key).alias("highest"), F.min_by("cluster_id", key).alias("lowest"), F.sum("contribution").alias("weighted_modularity"))


def size_metrics(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("class_count"), F.count("*").alias("cluster_count"), F.max("size").alias("largest"), F.min("size").alias("smallest"),
        F.avg("size").alias("mean_size"), F.count_if(F.col("size") == 1).alias("singletons"), safe_ratio(F.max("size") * 1.0, F.sum("size")).alias("largest_share"),
        F.coalesce(safe_ratio(F.stddev_pop("size"), F.avg("size")), F.lit(0.0)).alias("size_cv"),
    )


def partition_metrics(edges: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    """One row: sizes, internal and external weight and their ratios, coupling and weighted modularity."""
    row = size_metrics(labels).crossJoin(weight_split(edges, labels, weight)).crossJoin(modularity(edges, labels, weight))  # one row each
    i, e = F.col("internal_weight"), F.col("external_weight")
    return row.withColumns({"internal_external_ratio": safe_ratio(i, e, i), "internal_share": safe_ratio(i, i + e), "external_share": safe_ratio(e, i + e)})


def size_distribution(labels: DataFrame) -> DataFrame:
    """JSON text size -> count; keys in order as text, so "10" stands before "2"."""
    n = labels.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    item = F.concat(F.lit('"'), F.col("size").cast("string"), F.lit('": '), F.col("n").cast("string"))
    return n.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("}")).alias("distribution"))


def summarize_clusters(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("class_name")), ";").alias("class_names"))


def new_edge_share(raw: DataFrame, ssa: DataFrame) -> DataFrame:
    new = ssa.join(raw.select(*PAIR), PAIR, "left_anti").agg(F.count("*").alias("new_edges"))
    return new.crossJoin(ssa.agg(F.count("*").alias("ssa_edges"))).withColumn("new_edge_ratio", safe_ratio(F.col("new_edges") * 1.0, F.col("ssa_edges")))


def ssa_weight_share(ssa: DataFrame) -> DataFrame:
    flow = F.col("ssa_flow_weight") if "ssa_flow_weight" in ssa.columns else F.col("return_flow_weight") + F.col("argument_flow_weight")
    return ssa.agg(F.sum(flow).alias("ssa_weight"), F.sum("g_ssa_weight").alias("total_weight")).withColumn("ssa_weight_share", safe_ratio(F.col("ssa_weight"), F.col("total_weight")))


def cross_cluster_ratio(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of distinct pairs that cross clusters; unmapped pairs stay in the denominator."""
    p = labelled(edges.select(*PAIR).distinct(), labels, "left")
    return p.agg(F.count_if(F.col("source_cluster") != F.col("target_cluster")).alias("crossing"), F.count("*").alias("pairs")).withColumn("cross_cluster_ratio", safe_ratio(F.col("crossing") * 1.0, F.col("pairs")))


def pair_weights(raw: DataFrame, ssa: DataFrame) -> DataFrame:
    both = raw.select(*PAIR, F.col("raw_weight").alias("before"), F.lit(1).alias("had")).join(ssa.select(*PAIR, F.col("g_ssa_weight").alias("after")), PAIR, "full")
    return both.select(*PAIR, F.coalesce("before", F.lit(0.0)).alias("raw_weight"), F.coalesce("after", F.lit(0.0)).alias("g_ssa_weight"), F.col("had").isNull().alias("is_new"))


def impact_new(raw: DataFrame, ssa: DataFrame, top: int = 20) -> DataFrame:
    return pair_weights(raw, ssa).where("is_new").orderBy(F.desc("g_ssa_weight"), *PAIR).limit(top)


def impact_increased(raw: DataFrame, ssa: DataFrame, top: int = 20) -> DataFrame:
    grown = pair_weights(raw, ssa).where("NOT is_new AND g_ssa_weight > raw_weight").withColumn("increase", F.col("g_ssa_weight") - F.col("raw_weight"))
    return grown.orderBy(F.desc("increase"), *PAIR).limit(top)


def flow_summary(flows: DataFrame) -> DataFrame:
    per = canonical_pairs(flows).groupBy(*PAIR, "flow_type").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    text = F.format_string("%s:%d rows/%.1f weight", "flow_type", "n", "w")
    return per.groupBy(*PAIR).agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("summary"))


def contingency(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n_ij with row and column sums a_i and b_j for labels of the same classes."""
    r = right.select(*keys, "class_id", F.col("cluster_id").alias("r"))
    n = left.select(*keys, "class_id", F.col("cluster_id").alias("l")).join(r, [*keys, "class_id"]).groupBy(*keys, "l", "r").agg(F.count("*").alias("n"))
    by = lambda c: Window.partitionBy(*keys, c)
    return n.withColumns({"a": F.sum("n").over(by("l")), "b": F.sum("n").over(by("r"))})


def moved_classes(nodes: DataFrame, left: DataFrame, right: DataFrame, top: int = 20) -> DataFrame:
    """Classes whose cluster mates changed: lost and gained counts and the Jaccard similarity, in closed form."""
    c = contingency(left, right)
    both = left.select("class_id", F.col("cluster_id").alias("l")).join(right.select("class_id", F.col("cluster_id").alias("r")), "class_id").join(c, ["l", "r"])
    union = F.col("a") + F.col("b") - F.col("n") - 1
    j = both.select("class_id", (F.col("a") - F.col("n")).alias("lost"), (F.col("b") - F.col("n")).alias("gained"), F.when(union == 0, 1.0).otherwise((F.col("n") - 1) / F.when(union == 0, 1).otherwise(union)).alias("jaccard"))
    return j.where("lost > 0 OR gained > 0").join(nodes.select("class_id", "class_name"), "class_id").orderBy("jaccard", F.desc(F.col("lost") + F.col("gained")), "class_name").limit(top)


def changed_ratio(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of classes whose set of cluster mates differs."""
    c = contingency(left, right)
    same = F.sum(F.when((F.col("n") == F.col("a")) & (F.col("n") == F.col("b")), F.col("n")).otherwise(0))
    return c.agg(F.coalesce(safe_ratio(F.sum("n") - same, F.sum("n") * 1.0), F.lit(0.0)).alias("changed_ratio"))


def canonical_labels(labels: Column) -> Column:
    """First-seen order, from 0."""
    return F.transform(labels, lambda x: (F.array_position(F.array_distinct(labels), x) - 1).cast("int"))


def vector_rows(vectors: DataFrame, column: str = "label_vector") -> DataFrame:
    """posexplode of a label vector: place and cluster_id."""
    rest = [c for c in vectors.columns if c != column]
    return vectors.select(*rest, F.posexplode(column).alias("place", "cluster_id"))


def cluster_by_class(nodes: DataFrame, vectors: DataFrame, column: str = "label_vector") -> DataFrame:
    """Label vectors (arrays, or their JSON) as rows of class_id and cluster_id: places stand for classes in order of class_id. A vector of another length is an error."""
    rest = [c for c in vectors.columns if c != column]
    v = F.from_json(column, "array<int>") if dict(vectors.dtypes)[column] == "string" else F.col(column)
    ids = nodes.agg(F.array_sort(F.collect_list("class_id")).alias("_ids"))  # one row, as long as a vector
    both = vectors.withColumn("_v", v).crossJoin(F.broadcast(ids))
    whole = F.when(F.size("_v") == F.size("_ids"), F.arrays_zip(F.col("_ids").alias("class_id"), F.col("_v").alias("cluster_id")))
    rows = both.select(*rest, F.explode(F.coalesce(whole, F.raise_error(F.lit("a label vector needs one label for each class")).cast("array<struct<class_id:string,cluster_id:int>>"))).alias("_r"))
    return rows.select(*rest, F.col("_r")["class_id"].alias("class_id"), F.col("_r")["cluster_id"].alias("cluster_id"))


def partition_key(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Canonical label vector in order of class_id. A vector is as long as a solution has classes."""
    v = labels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "cluster_id"))), lambda s: s["cluster_id"]).alias("v"))
    return v.select(*keys, canonical_labels(F.col("v")).alias("partition_key"))


def partition_hash(keys: DataFrame) -> DataFrame:
    return keys.withColumn("partition_sha256", F.sha2(F.to_json("partition_key"), 256))


def signature_names(labels: DataFrame) -> DataFrame:
    """Clusters named C1, C2, ... in order of their sorted members."""
    c = labels.groupBy("cluster_id").agg(F.array_sort(F.collect_list("class_id")).alias("members"))
    return with_ordinal(c, [F.col("members")], "number", 1).select("cluster_id", F.concat(F.lit("C"), "number").alias("cluster_name"), F.size("members").alias("size"))


def cluster_segments(labels: DataFrame) -> DataFrame:
    c = labels.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("class_id")), "\n"), 256).alias("signature"))
    return with_ordinal(c, [F.desc("size"), F.col("signature")], "segment", 1)


def split_oversized(labels: DataFrame, largest: int) -> DataFrame:
    """One repair pass: clusters over the limit become chunks in order of place."""
    w = Window.partitionBy("cluster_id").orderBy("place")
    chunk = F.when(F.count("*").over(Window.partitionBy("cluster_id")) > largest, F.floor((F.row_number().over(w) - 1) / largest)).otherwise(0)
    return labels.withColumn("chunk", chunk)


def aligned(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.select("class_id", "class_name").join(labels.select("class_id", "cluster_id"), "class_id", "left")


def neighbours_kept(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each node of before: neighbours that stay, and their share (1 where there were none)."""
    a = before.select("class_id", F.col("neighbours").alias("x"))
    b = after.select("class_id", F.col("neighbours").alias("y"))
    none = F.array().cast("array<string>")
    kept = F.size(F.array_intersect("x", F.coalesce("y", none)))
    return a.join(b, "class_id", "left").select("class_id", kept.alias("retained"), F.when(F.size("x") == 0, 1.0).otherwise(kept / F.greatest(F.size("x"), F.lit(1))).alias("retention"))


def change_fraction(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("class_id", F.sort_array("neighbours").alias("x")), after.select("class_id", F.sort_array("neighbours").alias("y"))
    j = a.join(b, "class_id", "full")
    return j.agg(safe_ratio(F.count_if(~F.col("x").eqNullSafe(F.col("y"))) * 1.0, F.count("*")).alias("change_fraction"))


def edge_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = ends(edges).groupBy("node").agg(F.sort_array(F.collect_set("neighbour")).alias("neighbours"))
    return nodes.join(n, nodes["class_id"] == n["node"], "left").select("class_id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))

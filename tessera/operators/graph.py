"""Evidence rows -> weighted undirected edges, and tables about the graph.

An edge is the pair (smaller id, larger id) in binary string order; nodes without edges stay in the node table.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder

PAIR = ["source", "target"]


def canonical_pairs(rows: DataFrame) -> DataFrame:
    """Ordered ends; self loops go."""
    return rows.where("source <> target").withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})


def self_loops(rows: DataFrame) -> DataFrame:
    """How many rows canonical_pairs drops."""
    return rows.agg(F.count_if(F.col("source") == F.col("target")).alias("self_loops"), F.count("*").alias("rows"))


def _sum_when(kind: str, value: str) -> Column:
    return F.sum(F.when(F.col(kind) == value, F.col("weight")).otherwise(0.0))


def raw_edges(dependencies: DataFrame) -> DataFrame:
    """One row a pair: type, call and raw weight. Conditional sums, so one partial aggregation and one shuffle."""
    return canonical_pairs(dependencies).groupBy(*PAIR).agg(_sum_when("dependency_type", "type").alias("type_weight"), _sum_when("dependency_type", "call").alias("call_weight")).withColumn("raw_weight", F.col("type_weight") + F.col("call_weight"))


def flow_weights(flows: DataFrame) -> DataFrame:
    return canonical_pairs(flows).groupBy(*PAIR).agg(_sum_when("flow_type", "return_value_flow").alias("return_flow_weight"), _sum_when("flow_type", "argument_passing_flow").alias("argument_flow_weight"))


def ssa_edges(raw: DataFrame, flows: DataFrame, ssa_lambda: float = 1.0) -> DataFrame:
    """Raw and flow evidence by full outer join; pairs whose combined weight is 0 go."""
    if ssa_lambda < 0:
        raise ValueError("ssa_lambda must not be negative")
    weights = ("type_weight", "call_weight", "return_flow_weight", "argument_flow_weight")
    joined = raw.select(*PAIR, "type_weight", "call_weight").join(flow_weights(flows), PAIR, "full")
    zero = joined.select(*PAIR, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in weights))
    flow = zero.withColumn("ssa_flow_weight", F.lit(float(ssa_lambda)) * (F.col("return_flow_weight") + F.col("argument_flow_weight")))
    return flow.withColumn("g_ssa_weight", F.col("type_weight") + F.col("call_weight") + F.col("ssa_flow_weight")).where("g_ssa_weight > 0")


def weight_or_zero(value: Column) -> Column:
    """Null, NaN and blank text count as 0; a negative weight is an error."""
    v = F.coalesce(value.try_cast("double"), F.lit(0.0))
    v = F.when(F.isnan(v), 0.0).otherwise(v)
    return F.when(v < 0, F.raise_error(F.lit("weights must not be negative")).cast("double")).otherwise(v)


def edge_formulas(rows: DataFrame, ssa_lambda: float = 1.0) -> DataFrame:
    """raw_weight, ssa_flow_weight and g_ssa_weight of rows with the four channel weights."""
    t, c, r, a = (weight_or_zero(F.col(x)) for x in ("type_weight", "call_weight", "return_flow_weight", "argument_flow_weight"))
    out = rows.withColumns({"raw_weight": t + c, "ssa_flow_weight": F.lit(float(ssa_lambda)) * (r + a)})
    return out.withColumn("g_ssa_weight", F.col("raw_weight") + F.col("ssa_flow_weight"))


def configured_weight(kinds: Column, weights: dict[str, float]) -> Column:
    """Sum of the configured weights of an array of evidence types; an unknown type is an error."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    one = lambda k: F.coalesce(F.try_element_at(table, k), F.raise_error(F.concat(F.lit("unknown evidence type: "), k)).cast("double"))
    return F.aggregate(kinds, F.lit(0.0), lambda s, k: s + one(k))


def normalized_weight(weight: Column, largest: Column) -> Column:
    return F.when(largest > 0, weight / largest).otherwise(F.raise_error(F.lit("the largest weight must be positive")).cast("double"))


def ends(edges: DataFrame, *columns: str) -> DataFrame:
    """Both directions: node, neighbour and the named columns."""
    a = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), *columns)
    return a.union(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), *columns))


def graph_nodes(nodes: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """Every node with its degree and weighted degree; isolated nodes have 0."""
    degree = ends(edges, weight).groupBy("node").agg(F.count("*").alias("degree"), F.sum(weight).alias("weighted_degree"))
    return nodes.join(degree, nodes["class_id"] == degree["node"], "left").select("class_id", "class_name", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("node_count")), edges.agg(F.count("*").alias("edge_count"))
    both = n.crossJoin(e)  # one row each
    return both.select(
        "node_count", "edge_count",
        F.when(F.col("node_count") > 1, 2.0 * F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1))).otherwise(0.0).alias("density"),
        F.when(F.col("node_count") > 0, 2.0 * F.col("edge_count") / F.col("node_count")).otherwise(0.0).alias("average_degree"),
    )


def adjacency(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.sort_array(F.collect_set("neighbour")).alias("neighbours"))


def top_degree(nodes: DataFrame, edges: DataFrame, weight: str, top: int = 20) -> DataFrame:
    incident = ends(edges, weight).groupBy("node").agg(F.sum(weight).alias("incident_weight"), F.count("*").alias("incident_edges"))
    return incident.join(nodes, incident["node"] == nodes["class_id"]).select("class_id", "class_name", "incident_weight", "incident_edges").orderBy(F.desc("incident_weight"), F.desc("incident_edges"), "class_name").limit(top)


def evidence_category(structural: DataFrame, semantic: DataFrame) -> DataFrame:
    a = structural.select(*PAIR, F.col("raw_weight").alias("structural_weight"))
    b = semantic.select(F.col("class_id_a").alias("source"), F.col("class_id_b").alias("target"), F.col("weight").alias("semantic_weight"))
    kind = F.when(F.col("semantic_weight").isNull(), "structural_only").when(F.col("structural_weight").isNull(), "semantic_only").otherwise("overlap")
    return a.join(b, PAIR, "full").withColumn("category", kind)


def flow_only_pairs(raw: DataFrame, flows: DataFrame) -> DataFrame:
    pairs = canonical_pairs(flows).join(raw.select(*PAIR), PAIR, "left_anti")
    return pairs.groupBy(*PAIR).agg(F.array_join(F.sort_array(F.collect_set("flow_type")), ";").alias("flow_types"), F.count("*").alias("records"), F.countDistinct("evidence_method").alias("methods"))


def bridge_context(raw: DataFrame, new_pairs: DataFrame) -> DataFrame:
    """Neighbours of at least two nodes of the new pairs, which are no such node themselves."""
    new = ends(new_pairs).select("node").distinct()
    near = ends(raw).join(new, "node")
    found = near.groupBy(F.col("neighbour").alias("class_id")).agg(F.countDistinct("node").alias("bridged")).where("bridged >= 2")
    return found.join(new.withColumnRenamed("node", "class_id"), "class_id", "left_anti")


def labelled(edges: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """edges with source_cluster and target_cluster."""
    a = labels.select(F.col("class_id").alias("source"), F.col("cluster_id").alias("source_cluster"))
    b = labels.select(F.col("class_id").alias("target"), F.col("cluster_id").alias("target_cluster"))
    return edges.join(a, "source", how).join(b, "target", how)


def cluster_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between and within clusters: count and weights for each cluster pair."""
    both = labelled(edges, labels)
    return both.groupBy(F.least("source_cluster", "target_cluster").alias("cluster_a"), F.greatest("source_cluster", "target_cluster").alias("cluster_b")).agg(
        F.count("*").alias("edge_count"), F.sum("type_weight").alias("type_weight"), F.sum("call_weight").alias("call_weight"), F.sum("raw_weight").alias("raw_weight")
    )


def cluster_nodes(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, size, and classes without any edge."""
    touched = ends(edges).select(F.col("node").alias("class_id")).distinct().withColumn("has_edge", F.lit(1))
    return labels.join(nodes.select("class_id"), "class_id").join(touched, "class_id", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if(F.col("has_edge").isNull()).alias("isolated"))


def package_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = nodes.select("class_id", F.col("package").alias("cluster_id"))
    both = labelled(edges, p)
    return both.groupBy(F.least("source_cluster", "target_cluster").alias("package_a"), F.greatest("source_cluster", "target_cluster").alias("package_b")).agg(F.count("*").alias("edge_count"), F.sum("raw_weight").alias("raw_weight"))


def top_package_relations(matrix: DataFrame, top: int = 5) -> DataFrame:
    return matrix.where("package_a <> package_b").orderBy(F.desc("raw_weight"), F.desc("edge_count"), "package_a", "package_b").limit(top)


def boundary_rows(edges: DataFrame, labels: DataFrame, weight: str = "raw_weight") -> DataFrame:
    """Edges that leave a cluster, seen from each side: focal and external class and cluster."""
    b = labelled(edges, labels).where("source_cluster <> target_cluster")
    out = b.select(F.col("source_cluster").alias("focal"), F.col("target_cluster").alias("external"), F.col("source").alias("focal_class"), F.col("target").alias("external_class"), F.col(weight).alias("weight"))
    return out.union(b.select("target_cluster", "source_cluster", "target", "source", weight))


def boundary_destinations(edges: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """The top external clusters of each cluster by weight; the others are one row OTHER."""
    per = boundary_rows(edges, labels).groupBy("focal", "external").agg(F.count("*").alias("edge_count"), F.sum("weight").alias("weight"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("focal").orderBy(F.desc("weight"), F.desc("edge_count"), "external")))
    name = F.when(F.col("rank") <= top, F.col("external").cast("string")).otherwise("OTHER")
    return ranked.groupBy("focal", name.alias("destination")).agg(F.sum("edge_count").alias("edge_count"), F.sum("weight").alias("weight"))


def boundary_aggregate(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return boundary_rows(edges, labels).groupBy("focal", "external").agg(
        F.count("*").alias("edge_count"), F.sum("weight").alias("weight"), F.countDistinct("external_class").alias("outside_classes"), F.countDistinct("focal_class").alias("focal_classes")
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """class_id and the smallest class_id of its component; smallest labels spread with a jump each round."""
    label = checkpointed(nodes.select("class_id", F.col("class_id").alias("component")))
    both = checkpointed(ends(edges).select("node", "neighbour"))
    while True:
        near = both.join(label, both["neighbour"] == label["class_id"]).groupBy("node").agg(F.min("component").alias("low"))
        step = label.join(near, label["class_id"] == near["node"], "left").select("class_id", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = step.select(F.col("class_id").alias("at"), F.col("component").alias("further"))
        step = checkpointed(step.join(jump, step["component"] == jump["at"]).select("class_id", "old", F.least("component", "further").alias("component")))
        if step.where("component <> old").isEmpty():
            return step.select("class_id", "component")
        label = step.select("class_id", "component")

"""The driver's tables as inputs of the operators, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("class_id"), F.col("s_name").alias("class_name"), F.col("s_nationkey").cast("string").alias("package"))


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_linenumber"]
    a, b = table(spark, d, "lineitem").select(*cols).alias("a"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").alias("b")
    return a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey")).where(F.col("a.l_suppkey") != F.col("b.l_suppkey"))


def _part_pairs(spark: SparkSession, d: str, ahead: int) -> DataFrame:
    """Lines of an order with those that stand so many places further on: a graph of parts, which is sparse."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", "l_linenumber")
    a, b = lines.withColumn("place", F.col("l_linenumber") + ahead).alias("a"), lines.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("place")).alias("b")
    return a.join(b, ["l_orderkey", "place"]).where(F.col("a.l_partkey") != F.col("b.l_partkey"))


def part_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies(_part_pairs(spark, d, 1), "l_partkey")


def part_flows(spark: SparkSession, d: str) -> DataFrame:
    return _flows(_part_pairs(spark, d, 2), "l_partkey")


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies(_line_pairs(spark, d), "l_suppkey")


def flows(spark: SparkSession, d: str) -> DataFrame:
    return _flows(_line_pairs(spark, d), "l_suppkey")


def _dependencies(found: DataFrame, key: str) -> DataFrame:
    typed = F.col("a.l_linestatus") == "O"
    return found.select(
        F.col(f"a.{key}").cast("string").alias("source"), F.col(f"b.{key}").cast("string").alias("target"), F.when(typed, "type").otherwise("call").alias("dependency_type"),
        F.when(typed, 1.0).otherwise(2.0).alias("weight"), F.when(typed, "field_type_reference").otherwise("method_call").alias("evidence_kind"),
    )


def _flows(found: DataFrame, key: str) -> DataFrame:
    return found.where(F.col("a.l_returnflag").isin("R", "A")).select(
        F.col(f"a.{key}").cast("string").alias("source"), F.col(f"b.{key}").cast("string").alias("target"),
        F.when(F.col("a.l_returnflag") == "R", "return_value_flow").otherwise("argument_passing_flow").alias("flow_type"), F.lit(3.0).alias("weight"), F.col("a.l_linenumber").cast("string").alias("evidence_method"),
    )


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("class_id"), F.col("s_name").alias("class_name"), F.col("s_nationkey").cast("int").alias("cluster_id"))


def labels_mod(spark: SparkSession, d: str, k: int = 7) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("class_id"), F.col("s_name").alias("class_name"), (F.col("s_suppkey") % k).cast("int").alias("cluster_id"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(2), F.lit(12))).alias("k"))
    return s.select(F.concat(F.lit("k"), "k").alias("solution_id"), (F.col("k") % 3).cast("long").alias("seed"), F.col("s_suppkey").cast("string").alias("class_id"), (F.col("s_suppkey") % F.col("k")).cast("int").alias("cluster_id"))


def front(spark: SparkSession, d: str) -> DataFrame:
    """Parts as solutions of runs (brands)."""
    p = table(spark, d, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select(
        F.col("p_brand").alias("run"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("solution_id"), size.alias("coupling"), price.alias("imbalance"), F.length("p_name").cast("double").alias("f_semantic"),
        ((F.col("p_partkey") * 37) % 101).cast("double").alias("cohesion"), (0.2 + ((F.col("p_partkey") * 7919) % 97) / 200.0).alias("weighted_modularity"), (F.col("p_partkey") % 5 != 0).alias("feasible"),
        ((F.col("p_partkey") % 9) + 2).cast("long").alias("cluster_count"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mean event values of users, before and after: a paired series for each event type."""
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 40).alias("bucket"))
    half = F.col("event_id") % 2 == 0
    return e.agg(F.round(F.avg(F.when(half, F.col("value"))), 3).alias("left"), F.round(F.avg(F.when(~half, F.col("value"))), 3).alias("right"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("class_id"), "embedding", "label")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("class_id"), "text", "source", "lang")


_PAIR = "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey <> b.l_suppkey"
_ENDS = "CAST(a.l_suppkey AS VARCHAR) AS source, CAST(b.l_suppkey AS VARCHAR) AS target"
#: Named SQL parts; each may use those before it.
PARTS = {
    "nodes": "SELECT CAST(s_suppkey AS VARCHAR) AS class_id, s_name AS class_name, CAST(s_nationkey AS VARCHAR) AS package FROM supplier",
    "deps": f"SELECT {_ENDS}, CASE WHEN a.l_linestatus = 'O' THEN 'type' ELSE 'call' END AS dependency_type, CASE WHEN a.l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight {_PAIR}",
    "flows": f"SELECT {_ENDS}, CASE WHEN a.l_returnflag = 'R' THEN 'return_value_flow' ELSE 'argument_passing_flow' END AS flow_type, 3.0::DOUBLE AS weight, CAST(a.l_linenumber AS VARCHAR) AS evidence_method {_PAIR} AND a.l_returnflag IN ('R', 'A')",
    "raw": "SELECT least(source, target) AS source, greatest(source, target) AS target, sum(CASE WHEN dependency_type = 'type' THEN weight ELSE 0 END) AS type_weight, sum(CASE WHEN dependency_type = 'call' THEN weight ELSE 0 END) AS call_weight, sum(weight) AS raw_weight FROM deps GROUP BY 1, 2",
    "flow": "SELECT least(source, target) AS source, greatest(source, target) AS target, sum(CASE WHEN flow_type = 'return_value_flow' THEN weight ELSE 0 END) AS return_flow_weight, sum(CASE WHEN flow_type = 'argument_passing_flow' THEN weight ELSE 0 END) AS argument_flow_weight FROM flows GROUP BY 1, 2",
    "ssa": "SELECT source, target, type_weight, call_weight, return_flow_weight, argument_flow_weight, 0.25 * (return_flow_weight + argument_flow_weight) AS ssa_flow_weight, type_weight + call_weight + 0.25 * (return_flow_weight + argument_flow_weight) AS g_ssa_weight FROM (SELECT coalesce(r.source, f.source) AS source, coalesce(r.target, f.target) AS target, coalesce(type_weight, 0) AS type_weight, coalesce(call_weight, 0) AS call_weight, coalesce(return_flow_weight, 0) AS return_flow_weight, coalesce(argument_flow_weight, 0) AS argument_flow_weight FROM raw r FULL JOIN flow f ON r.source = f.source AND r.target = f.target) WHERE type_weight + call_weight + return_flow_weight + argument_flow_weight > 0",
    "ends": "SELECT source AS node, target AS neighbour, raw_weight FROM raw UNION ALL SELECT target, source, raw_weight FROM raw",
    "l": "SELECT CAST(s_suppkey AS VARCHAR) AS class_id, s_name AS class_name, CAST(s_nationkey AS BIGINT) AS cluster_id FROM supplier",
    "r": "SELECT CAST(s_suppkey AS VARCHAR) AS class_id, s_name AS class_name, s_suppkey % 7 AS cluster_id FROM supplier",
    "lab": "SELECT e.*, a.cluster_id AS sc, b.cluster_id AS tc FROM raw e JOIN l a ON e.source = a.class_id JOIN l b ON e.target = b.class_id",
    "cont": "SELECT l, r, n, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY r) AS b FROM (SELECT l.cluster_id AS l, r.cluster_id AS r, count(*) AS n FROM l JOIN r ON l.class_id = r.class_id GROUP BY 1, 2)",
    "cand": "SELECT 'k' || k AS solution_id, k % 3 AS seed, CAST(s_suppkey AS VARCHAR) AS class_id, s_suppkey % k AS cluster_id FROM supplier, range(2, 13) t(k)",
    "front": "SELECT p_brand AS run, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS solution_id, CAST(p_size AS DOUBLE) AS coupling, p_retailprice AS imbalance, CAST(length(p_name) AS DOUBLE) AS f_semantic, CAST((p_partkey * 37) % 101 AS DOUBLE) AS cohesion, 0.2::DOUBLE + ((p_partkey * 7919) % 97) / 200.0::DOUBLE AS weighted_modularity, p_partkey % 5 <> 0 AS feasible, (p_partkey % 9) + 2 AS cluster_count FROM part",
    "pairs": "SELECT event_type, user_id % 40 AS bucket, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 3) AS \"left\", round(avg(CASE WHEN event_id % 2 <> 0 THEN value END), 3) AS \"right\" FROM events GROUP BY 1, 2",
    "vec": "SELECT CAST(vec_id AS VARCHAR) AS class_id, embedding, label FROM embeddings",
    "texts": "SELECT CAST(doc_id AS VARCHAR) AS class_id, text, source, lang FROM documents",
}


def _by_part(sql: str, ahead: int) -> str:
    return sql.replace("l_suppkey", "l_partkey").replace("a.l_orderkey = b.l_orderkey", f"a.l_orderkey = b.l_orderkey AND a.l_linenumber + {ahead} = b.l_linenumber")


#: The graph of parts in place of the graph of suppliers, whose whole joins leave no pair out.
BY_PART = {"deps": _by_part(PARTS["deps"], 1), "flows": _by_part(PARTS["flows"], 2)}


def sql(body: str, *parts: str, **more: str) -> str:
    """body with the named parts, and further ones, as common tables."""
    use = {**{k: PARTS[k] for k in parts}, **more}
    return f"WITH {', '.join(f'{k} AS ({v})' for k, v in use.items())} {body}" if use else body

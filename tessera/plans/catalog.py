"""Registered queries: the operators on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import community as Y
from tessera.operators import fronts as P
from tessera.operators import graph as G
from tessera.operators import partition as M
from tessera.operators import search as X
from tessera.operators import selection as S
from tessera.operators import similarity as C
from tessera.operators import stats as T
from tessera.operators import text as Z
from tessera.operators import validate as V
from tessera.operators import vectors as E
from tessera.plans import adapters as A

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def raw(s, d):
    return G.raw_edges(A.dependencies(s, d))


def ssa(s, d):
    return G.ssa_edges(raw(s, d), A.flows(s, d), 0.25)


def part_raw(s, d):
    return G.raw_edges(A.part_dependencies(s, d))


def part_ssa(s, d):
    return G.ssa_edges(part_raw(s, d), A.part_flows(s, d), 0.25)


RAW = ("deps", "raw")
SSA = ("deps", "flows", "raw", "flow", "ssa")
ENDS = (*RAW, "ends")
LAB = (*RAW, "l", "lab")
CONT = ("l", "r", "cont")


# Graph tables


@query(A.sql("SELECT * FROM raw", *RAW))
def grf03_raw_edges(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d)


@query(A.sql("SELECT count(*) FILTER (WHERE source = target) AS self_loops, count(*) AS rows FROM deps", "deps"))
def grf02_self_loops(s, d):
    return G.self_loops(A.dependencies(s, d))


@query(A.sql("SELECT class_id, class_name, coalesce(count(node), 0) AS degree, coalesce(sum(raw_weight), 0) AS weighted_degree FROM nodes LEFT JOIN ends ON class_id = node GROUP BY 1, 2", *ENDS, "nodes"))
def grf04_graph_nodes(s, d):
    return G.graph_nodes(A.nodes(s, d), raw(s, d), "raw_weight")


@query(A.sql("SELECT * FROM flow", "flows", "flow"))
def grf05_flow_weights(s, d):
    return G.flow_weights(A.flows(s, d))


@query(A.sql("SELECT * FROM ssa", *SSA))
def grf06_ssa_edges(s, d):
    return ssa(s, d)


@query(A.sql("SELECT class_id, class_name, count(node) AS degree, coalesce(sum(w), 0) AS weighted_degree FROM nodes LEFT JOIN (SELECT source AS node, g_ssa_weight AS w FROM ssa UNION ALL SELECT target, g_ssa_weight FROM ssa) ON class_id = node GROUP BY 1, 2", *SSA, "nodes"))
def grf07_ssa_graph(s, d):
    return G.graph_nodes(A.nodes(s, d), ssa(s, d), "g_ssa_weight")


@query(A.sql("SELECT source, target, type_weight + call_weight AS raw_weight, 0.5 * (return_flow_weight + argument_flow_weight) AS ssa_flow_weight, type_weight + call_weight + 0.5 * (return_flow_weight + argument_flow_weight) AS g_ssa_weight FROM ssa", *SSA))
def grf08_weight_formulas(s, d):
    rows = ssa(s, d).select("source", "target", "type_weight", "call_weight", "return_flow_weight", "argument_flow_weight")
    return G.edge_formulas(rows, 0.5).select("source", "target", "raw_weight", "ssa_flow_weight", "g_ssa_weight")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 3.0 WHEN o_orderstatus = 'O' THEN 4.0 ELSE 1.0 END::DOUBLE AS weight FROM orders")
def grf09_configured_weight(s, d):
    kinds = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("type"), F.lit("call"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("type"), F.lit("flow"))).otherwise(F.array(F.lit("type")))
    return A.table(s, d, "orders").select("o_orderkey", G.configured_weight(kinds, {"type": 1, "call": 2, "flow": 3}).alias("weight"))


@query(A.sql("SELECT source, target, round(raw_weight / (SELECT max(raw_weight) FROM raw), 6) AS share FROM raw", *RAW))
def grf10_normalized_weight(s, d):
    e = raw(s, d)
    top = e.agg(F.max("raw_weight").alias("top"))
    return rounded(e.crossJoin(F.broadcast(top)).select("source", "target", G.normalized_weight(F.col("raw_weight"), F.col("top")).alias("share")))


@query(A.sql("SELECT node_count, edge_count, round(2.0 * edge_count / (node_count * (node_count - 1)), 6)::DOUBLE AS density, round(2.0 * edge_count / node_count, 6)::DOUBLE AS average_degree FROM (SELECT count(*) AS node_count FROM nodes), (SELECT count(*) AS edge_count FROM raw)", *RAW, "nodes"))
def grf11_graph_metrics(s, d):
    return rounded(G.graph_metrics(A.nodes(s, d), raw(s, d)))


@query(A.sql("SELECT node, string_agg(neighbour, ';' ORDER BY neighbour) AS neighbours FROM ends GROUP BY node", *ENDS))
def grf12_adjacency(s, d):
    return G.adjacency(raw(s, d)).select("node", F.array_join("neighbours", ";").alias("neighbours"))


@query(A.sql("SELECT class_id, class_name, sum(w) AS incident_weight, count(*) AS incident_edges FROM nodes JOIN (SELECT source AS node, ssa_flow_weight AS w FROM ssa UNION ALL SELECT target, ssa_flow_weight FROM ssa) ON class_id = node GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 2 LIMIT 20", *SSA, "nodes"))
def grf13_top_flow_degree(s, d):
    return G.top_degree(A.nodes(s, d), ssa(s, d), "ssa_flow_weight")


SEM = "SELECT source AS class_id_a, target AS class_id_b, argument_flow_weight + 1 AS weight FROM flow WHERE return_flow_weight > 0"


def semantic(s, d):
    return semantic_of(A.flows(s, d))


def semantic_of(flows):
    return G.flow_weights(flows).where("return_flow_weight > 0").select(F.col("source").alias("class_id_a"), F.col("target").alias("class_id_b"), (F.col("argument_flow_weight") + 1).alias("weight"))


@query(A.sql("SELECT coalesce(source, class_id_a) AS source, coalesce(target, class_id_b) AS target, raw_weight AS structural_weight, weight AS semantic_weight, CASE WHEN weight IS NULL THEN 'structural_only' WHEN raw_weight IS NULL THEN 'semantic_only' ELSE 'overlap' END AS category FROM raw FULL JOIN sem ON source = class_id_a AND target = class_id_b", *SSA[:4], sem=SEM, **A.BY_PART))
def grf14_evidence_category(s, d):
    return G.evidence_category(part_raw(s, d), semantic_of(A.part_flows(s, d)))


NEW = "SELECT least(f.source, f.target) AS source, greatest(f.source, f.target) AS target, flow_type, evidence_method FROM flows f WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.source = least(f.source, f.target) AND r.target = greatest(f.source, f.target))"


@query(A.sql("SELECT source, target, string_agg(DISTINCT flow_type, ';' ORDER BY flow_type) AS flow_types, count(*) AS records, count(DISTINCT evidence_method) AS methods FROM fresh GROUP BY 1, 2", *SSA[:3], fresh=NEW, **A.BY_PART))
def grf15_flow_only_pairs(s, d):
    return G.flow_only_pairs(part_raw(s, d), A.part_flows(s, d))


@query(A.sql("SELECT neighbour AS class_id, count(DISTINCT node) AS bridged FROM ends WHERE node IN (SELECT node FROM nn) AND neighbour NOT IN (SELECT node FROM nn) GROUP BY 1 HAVING count(DISTINCT node) >= 2", *SSA[:3], "ends", fresh=NEW, strong="SELECT source, target FROM fresh GROUP BY 1, 2 HAVING count(*) > 1", nn="SELECT source AS node FROM strong UNION SELECT target FROM strong", **A.BY_PART))
def grf16_bridge_context(s, d):
    e = part_raw(s, d)
    return G.bridge_context(e, G.flow_only_pairs(e, A.part_flows(s, d)).where("records > 1").select("source", "target"))


@query(A.sql("SELECT least(sc, tc) AS cluster_a, greatest(sc, tc) AS cluster_b, count(*) AS edge_count, sum(type_weight) AS type_weight, sum(call_weight) AS call_weight, sum(raw_weight) AS raw_weight FROM lab GROUP BY 1, 2", *LAB))
def grf17_cluster_graph(s, d):
    return G.cluster_graph(raw(s, d), A.labels(s, d))


@query(A.sql("SELECT cluster_id, count(*) AS size, count(*) FILTER (WHERE class_id NOT IN (SELECT node FROM ends)) AS isolated FROM l GROUP BY 1", *ENDS, "l"))
def grf17_cluster_nodes(s, d):
    return G.cluster_nodes(A.nodes(s, d), raw(s, d), A.labels(s, d))


MATRIX = "SELECT least(CAST(sc AS VARCHAR), CAST(tc AS VARCHAR)) AS package_a, greatest(CAST(sc AS VARCHAR), CAST(tc AS VARCHAR)) AS package_b, count(*) AS edge_count, sum(raw_weight) AS raw_weight FROM lab GROUP BY 1, 2"


@query(A.sql(MATRIX, *LAB))
def grf18_package_matrix(s, d):
    return G.package_matrix(A.nodes(s, d), raw(s, d))


@query(A.sql("SELECT * FROM m WHERE package_a <> package_b ORDER BY raw_weight DESC, edge_count DESC, package_a, package_b LIMIT 5", *LAB, m=MATRIX))
def grf18_top_relations(s, d):
    return G.top_package_relations(G.package_matrix(A.nodes(s, d), raw(s, d)))


SIDES = "SELECT sc AS focal, tc AS external, source AS focal_class, target AS external_class, raw_weight AS w FROM lab WHERE sc <> tc UNION ALL SELECT tc, sc, target, source, raw_weight FROM lab WHERE sc <> tc"


@query(A.sql("SELECT focal, CASE WHEN rn <= 5 THEN CAST(external AS VARCHAR) ELSE 'OTHER' END AS destination, CAST(sum(n) AS BIGINT) AS edge_count, sum(w) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY w DESC, n DESC, external) AS rn FROM (SELECT focal, external, count(*) AS n, sum(w) AS w FROM sides GROUP BY 1, 2)) GROUP BY 1, 2", *LAB, sides=SIDES))
def grf19_boundary_destinations(s, d):
    return G.boundary_destinations(raw(s, d), A.labels(s, d))


@query("WITH RECURSIVE " + A.sql("SELECT a AS class_id, min(b) AS component FROM reach GROUP BY 1", *RAW, "nodes", step="SELECT source AS a, target AS b FROM raw UNION SELECT target, source FROM raw", reach="SELECT class_id AS a, class_id AS b FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a")[5:])
def grf20_components(s, d):
    return G.connected_components(A.nodes(s, d), raw(s, d).select("source", "target"))


@query(A.sql("SELECT focal, external, count(*) AS edge_count, sum(w) AS weight, count(DISTINCT external_class) AS outside_classes, count(DISTINCT focal_class) AS focal_classes FROM sides GROUP BY 1, 2", *LAB, sides=SIDES))
def grf21_boundary_aggregate(s, d):
    return G.boundary_aggregate(raw(s, d), A.labels(s, d))


# Validation


@query(A.sql("SELECT 0::BIGINT AS not_numeric, count(*) FILTER (WHERE o_totalprice < 0) AS negative, count(*) AS rows FROM orders"))
def val01_weights(s, d):
    return V.weight_faults(A.table(s, d, "orders"), "o_totalprice")


@query("SELECT count(*) FILTER (WHERE s_name IS NULL) AS s_name, count(*) FILTER (WHERE s_acctbal IS NULL) AS s_acctbal FROM supplier")
def val02_missing(s, d):
    return V.missing_values(A.table(s, d, "supplier"), ["s_name", "s_acctbal"])


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def val03_allowed(s, d):
    return V.not_allowed(A.table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT 'method_call' AS evidence_kind, 'call' AS dependency_type WHERE false")
def val04_kinds(s, d):
    return V.kind_conflicts(A.dependencies(s, d))


@query(A.sql("SELECT DISTINCT class_id FROM (SELECT source AS class_id FROM deps UNION ALL SELECT target FROM deps) WHERE class_id NOT IN (SELECT class_id FROM nodes WHERE CAST(class_id AS INTEGER) % 10 <> 3)", "deps", "nodes"))
def val05_unknown_ends(s, d):
    return V.unknown_ends(A.dependencies(s, d), A.nodes(s, d).where("CAST(class_id AS INT) % 10 <> 3"))


@query(A.sql("SELECT dependency_type AS channel, count(*) AS rows, '[' || CASE dependency_type WHEN 'type' THEN '1.0' ELSE '2.0' END || ']' AS observed, true AS valid FROM deps GROUP BY 1", "deps"))
def val06_channel_weights(s, d):
    return V.channel_weights(A.dependencies(s, d), "dependency_type")


@query(A.sql("SELECT 0::BIGINT AS repeated, count(*) FILTER (WHERE s_suppkey % 11 = 0) AS missing, 0::BIGINT AS extra FROM supplier"))
def val08_partition_scope(s, d):
    return V.partition_scope(A.nodes(s, d), A.labels(s, d).where("CAST(class_id AS INT) % 11 <> 0"))


@query(A.sql("SELECT 0::BIGINT AS not_finite, 0::BIGINT AS negative, 0::BIGINT AS loops, 0::BIGINT AS unordered, 0::BIGINT AS repeated, sum(weight) AS total, 0::BIGINT AS unknown FROM sem", "flows", "flow", sem=SEM))
def val09_semantic_edges(s, d):
    return V.semantic_edge_faults(semantic(s, d), A.nodes(s, d).select("class_id"))


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(A.sql(f"SELECT count(*) AS rows, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, 0::BIGINT AS not_finite, count(*) FILTER (WHERE {NORM} = 0) AS zero, round(min({NORM}), 6) AS min_norm, round(avg({NORM}), 6) AS mean_norm, round(max({NORM}), 6) AS max_norm FROM embeddings"))
def val10_embeddings(s, d):
    return rounded(E.embedding_checks(A.table(s, d, "embeddings"), 64))


@query("SELECT subject, CAST(seed AS BIGINT) AS seed, 'missing' AS fault FROM (SELECT DISTINCT p_brand AS subject FROM part), range(0, 12) t(seed) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = subject AND p_size % 13 = seed) UNION ALL SELECT p_brand, p_size % 13, CASE WHEN p_size % 13 = 12 THEN 'extra' ELSE 'repeated' END FROM part GROUP BY 1, 2 HAVING p_size % 13 = 12 OR count(*) > 1")
def val12_run_grid(s, d):
    p = A.table(s, d, "part").select(F.col("p_brand").alias("subject"), (F.col("p_size") % 13).alias("seed"))
    return rounded(V.run_grid(p, p.select("subject").distinct(), 12))


@query(A.sql("SELECT CAST(s_suppkey AS VARCHAR) AS class_id, 'left' AS side FROM supplier WHERE s_suppkey % 9 = 0"))
def val13_universe(s, d):
    return V.universe_difference(A.nodes(s, d), A.labels(s, d).where("CAST(class_id AS INT) % 9 <> 0"))


@query(A.sql("SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, 0::BIGINT AS wrong_hash FROM documents"))
def val17_text_hashes(s, d):
    t = A.texts(s, d).select("class_id", F.col("text").alias("semantic_text"), F.sha2("text", 256).alias("input_hash"))
    return V.text_hash_faults(t)


# Partitions


@query(A.sql("SELECT coalesce(sum(raw_weight) FILTER (WHERE sc = tc), 0) AS internal_weight, coalesce(sum(raw_weight) FILTER (WHERE sc <> tc), 0) AS external_weight FROM lab", *LAB))
def met01_weight_split(s, d):
    return M.weight_split(raw(s, d), A.labels(s, d), "raw_weight")


DEG = "SELECT c, sum(i) AS win, sum(w) AS deg FROM (SELECT sc AS c, CASE WHEN sc = tc THEN raw_weight ELSE 0 END AS i, raw_weight AS w FROM lab UNION ALL SELECT tc, 0, raw_weight FROM lab) GROUP BY 1"
PART = "SELECT c AS cluster_id, win AS inside, deg AS degree, win / t - (deg / (2 * t)) * (deg / (2 * t)) AS contribution FROM deg, (SELECT sum(deg) / 2 AS t FROM deg)"


@query(A.sql("SELECT round(sum(contribution), 6) AS weighted_modularity FROM part_", *LAB, deg=DEG, part_=PART))
def met02_modularity(s, d):
    return rounded(M.modularity(raw(s, d), A.labels(s, d), "raw_weight"))


SIZES = "SELECT cluster_id, count(*) AS size FROM l GROUP BY 1"
SIZE_ROW = "SELECT CAST(sum(size) AS BIGINT) AS class_count, count(*) AS cluster_count, max(size) AS largest, min(size) AS smallest, round(avg(size), 6) AS mean_size, count(*) FILTER (WHERE size = 1) AS singletons, round(max(size) / sum(size), 6) AS largest_share, round(stddev_pop(size) / avg(size), 6) AS size_cv FROM sizes"


@query(A.sql("SELECT z.*, i AS internal_weight, e AS external_weight, round(q, 6) AS weighted_modularity, round(CASE WHEN e = 0 THEN i ELSE i / e END, 6) AS internal_external_ratio, round(i / (i + e), 6) AS internal_share, round(e / (i + e), 6) AS external_share FROM (" + SIZE_ROW + ") z, (SELECT coalesce(sum(raw_weight) FILTER (WHERE sc = tc), 0) AS i, coalesce(sum(raw_weight) FILTER (WHERE sc <> tc), 0) AS e FROM lab), (SELECT sum(contribution) AS q FROM part_)", *LAB, sizes=SIZES, deg=DEG, part_=PART))
def met03_partition_metrics(s, d):
    return rounded(M.partition_metrics(raw(s, d), A.labels(s, d), "raw_weight"))


@query(A.sql("SELECT count(*) AS new_edges, (SELECT count(*) FROM ssa) AS ssa_edges, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM ssa), 6) AS new_edge_ratio FROM ssa x WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.source = x.source AND r.target = x.target)", *SSA, **A.BY_PART))
def met06_new_edges(s, d):
    return rounded(M.new_edge_share(part_raw(s, d), part_ssa(s, d)))


@query(A.sql("SELECT sum(ssa_flow_weight) AS ssa_weight, sum(g_ssa_weight) AS total_weight, round(sum(ssa_flow_weight) / sum(g_ssa_weight), 6) AS ssa_weight_share FROM ssa", *SSA))
def met07_ssa_share(s, d):
    return rounded(M.ssa_weight_share(ssa(s, d)))


@query(A.sql("SELECT count(*) FILTER (WHERE a.cluster_id <> b.cluster_id) AS crossing, count(*) AS pairs, round(count(*) FILTER (WHERE a.cluster_id <> b.cluster_id) * 1.0::DOUBLE / count(*), 6) AS cross_cluster_ratio FROM raw e LEFT JOIN half a ON e.source = a.class_id LEFT JOIN half b ON e.target = b.class_id", *RAW, "l", half="SELECT * FROM l WHERE CAST(class_id AS INTEGER) % 4 <> 0"))
def met08_cross_cluster(s, d):
    return rounded(M.cross_cluster_ratio(raw(s, d), A.labels(s, d).where("CAST(class_id AS INT) % 4 <> 0")))


@query(A.sql("SELECT '{' || string_agg('\"' || size || '\": ' || n, ', ' ORDER BY '\"' || size || '\": ' || n) || '}' AS distribution FROM (SELECT size, count(*) AS n FROM sizes GROUP BY 1)", "l", sizes=SIZES))
def met09_size_distribution(s, d):
    return M.size_distribution(A.labels(s, d))


@query(A.sql(SIZE_ROW, "l", sizes=SIZES))
def met10_size_metrics(s, d):
    return rounded(M.size_metrics(A.labels(s, d)))


PW = "SELECT coalesce(r.source, x.source) AS source, coalesce(r.target, x.target) AS target, coalesce(raw_weight, 0) AS raw_weight, coalesce(g_ssa_weight, 0) AS g_ssa_weight, r.source IS NULL AS is_new FROM raw r FULL JOIN ssa x ON r.source = x.source AND r.target = x.target"


@query(A.sql("SELECT * FROM pw", *SSA, pw=PW, **A.BY_PART))
def met12_pair_weights(s, d):
    return M.pair_weights(part_raw(s, d), part_ssa(s, d))


@query(A.sql("SELECT * FROM pw WHERE is_new ORDER BY g_ssa_weight DESC, source, target LIMIT 20", *SSA, pw=PW, **A.BY_PART))
def met11_impact_new(s, d):
    return M.impact_new(part_raw(s, d), part_ssa(s, d))


@query(A.sql("SELECT *, g_ssa_weight - raw_weight AS increase FROM pw WHERE NOT is_new AND g_ssa_weight > raw_weight ORDER BY increase DESC, source, target LIMIT 20", *SSA, pw=PW, **A.BY_PART))
def met11_impact_increased(s, d):
    return M.impact_increased(part_raw(s, d), part_ssa(s, d))


@query(A.sql("SELECT source, target, string_agg(t, '; ' ORDER BY t) AS summary FROM (SELECT least(source, target) AS source, greatest(source, target) AS target, printf('%s:%d rows/%.1f weight', flow_type, count(*), sum(weight)) AS t FROM flows GROUP BY 1, 2, flow_type) GROUP BY 1, 2", "flows"))
def met13_flow_summary(s, d):
    return M.flow_summary(A.flows(s, d))


MOVED = "SELECT l.class_id, l.class_name, CAST(a - n AS BIGINT) AS lost, CAST(b - n AS BIGINT) AS gained, round(CASE WHEN a + b - n - 1 = 0 THEN 1.0 ELSE (n - 1) / (a + b - n - 1) END, 6)::DOUBLE AS jaccard FROM l JOIN r ON l.class_id = r.class_id JOIN cont ON cont.l = l.cluster_id AND cont.r = r.cluster_id"


@query(A.sql("SELECT * FROM moved WHERE lost > 0 OR gained > 0 ORDER BY jaccard, lost + gained DESC, class_name LIMIT 20", *CONT, moved=MOVED))
def met14_moved_classes(s, d):
    return rounded(M.moved_classes(A.nodes(s, d), A.labels(s, d), A.labels_mod(s, d)))


@query(A.sql("SELECT round(1 - coalesce(sum(n) FILTER (WHERE n = a AND n = b), 0) / sum(n), 6)::DOUBLE AS changed_ratio FROM cont", *CONT))
def met16_changed_ratio(s, d):
    return rounded(M.changed_ratio(A.labels(s, d), A.labels_mod(s, d)))


@query(A.sql("SELECT cluster_id, inside, degree, round(contribution, 6) AS contribution FROM part_", *LAB, deg=DEG, part_=PART))
def met17_contributions(s, d):
    return rounded(M.modularity_parts(raw(s, d), A.labels(s, d), "raw_weight"))


@query(A.sql("SELECT cluster_id, count(*) AS size, string_agg(class_name, ';' ORDER BY class_name) AS class_names FROM l GROUP BY 1", "l"))
def clu02_summarize(s, d):
    return M.summarize_clusters(A.labels(s, d))


VEC = "SELECT solution_id, list(cluster_id ORDER BY class_id) AS v FROM cand GROUP BY 1"
CANON = "list_transform(v, lambda x: len(list_distinct(v[1:list_position(v, x)])) - 1)"


@query(A.sql(f"SELECT solution_id, replace(CAST({CANON} AS VARCHAR), ' ', '') AS partition_key FROM vec_", "cand", vec_=VEC))
def enc06_partition_key(s, d):
    return M.partition_key(A.candidates(s, d), ("solution_id",)).select("solution_id", F.to_json("partition_key").alias("partition_key"))


@query(A.sql(f"SELECT solution_id, sha256(replace(CAST({CANON} AS VARCHAR), ' ', '')) AS partition_sha256 FROM vec_", "cand", vec_=VEC))
def enc09_partition_hash(s, d):
    return M.partition_hash(M.partition_key(A.candidates(s, d), ("solution_id",))).drop("partition_key")


@query(A.sql("SELECT solution_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS place, unnest(v) AS cluster_id FROM vec_", "cand", vec_=VEC))
def enc03_vector_rows(s, d):
    v = A.candidates(s, d).groupBy("solution_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "cluster_id"))), lambda x: x["cluster_id"]).alias("label_vector"))
    return rounded(M.vector_rows(v))


@query(A.sql("SELECT class_id, class_name, CASE WHEN CAST(class_id AS INTEGER) % 5 <> 0 THEN cluster_id ELSE -1 END AS cluster_id FROM l", "l"))
def enc08_aligned(s, d):
    return rounded(M.aligned(A.nodes(s, d), A.labels(s, d).where("CAST(class_id AS INT) % 5 <> 0")).fillna(-1, ["cluster_id"]))


@query(A.sql("SELECT cluster_id, 'C' || row_number() OVER (ORDER BY m) AS cluster_name, len(m) AS size FROM (SELECT cluster_id, list(class_id ORDER BY class_id) AS m FROM l GROUP BY 1)", "l"))
def enc10_signature_names(s, d):
    return rounded(M.signature_names(A.labels(s, d)))


@query(A.sql("SELECT *, row_number() OVER (ORDER BY size DESC, signature) AS segment FROM (SELECT cluster_id, count(*) AS size, sha256(string_agg(class_id, chr(10) ORDER BY class_id)) AS signature FROM l GROUP BY 1)", "l"))
def enc12_segments(s, d):
    return rounded(M.cluster_segments(A.labels(s, d)))


@query("SELECT s_suppkey AS place, CAST(s_nationkey AS BIGINT) AS cluster_id, CAST(CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 3 THEN (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 ELSE 0 END AS BIGINT) AS chunk FROM supplier")
def enc11_split_pass(s, d):
    return rounded(M.split_oversized(A.table(s, d, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_nationkey").alias("cluster_id")), 3))


# Similarity


ROW = "SELECT sum(n) AS t, sum(n * (n - 1) / 2.0) AS sn, sum(n * ln(n)) AS ln_, sum(n * ln(a)) AS la, sum(n * ln(b)) AS lb, sum((a - 1) / 2.0 * n) AS sa, sum((b - 1) / 2.0 * n) AS sb FROM cont"
NMI = "(ln_ - la - lb) / t + ln(t)"


@query(A.sql(f"SELECT CAST(t AS BIGINT) AS n, round((sn - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)), 6)::DOUBLE AS ari, round(({NMI}) / sqrt((ln(t) - la / t) * (ln(t) - lb / t)), 6) AS nmi_geometric, round(({NMI}) / ((ln(t) - la / t + ln(t) - lb / t) / 2), 6) AS nmi_arithmetic FROM w", *CONT, w=ROW))
def sim01_similarity(s, d):
    return rounded(C.similarity(A.labels(s, d), A.labels_mod(s, d)))


ALL = "SELECT i, j, n, sum(n) OVER (PARTITION BY i, j, l) AS a, sum(n) OVER (PARTITION BY i, j, r) AS b FROM (SELECT x.solution_id AS i, y.solution_id AS j, x.cluster_id AS l, y.cluster_id AS r, count(*) AS n FROM cand x JOIN cand y ON x.class_id = y.class_id AND x.solution_id < y.solution_id GROUP BY 1, 2, 3, 4)"
PAIRS = f"SELECT i, j, CASE WHEN abs((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)) < 1e-12 THEN 1.0 ELSE (sn - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)) END AS ari, ({NMI}) / ((ln(t) - la / t + ln(t) - lb / t) / 2) AS nmi_arithmetic FROM (SELECT i, j, {ROW[7:].replace('FROM cont', 'FROM all_ GROUP BY 1, 2')})"


@query(A.sql("SELECT i, j, round(ari, 6)::DOUBLE AS ari, round(nmi_arithmetic, 6) AS nmi_arithmetic FROM p", "cand", all_=ALL, p=PAIRS))
def sim05_all_pairs(s, d):
    return rounded(C.all_pairs(A.candidates(s, d), "solution_id"))


@query(A.sql("SELECT count(*) AS pairs, avg(CASE WHEN ari >= 1 - 1e-12 THEN 1.0 ELSE 0 END) AS identical_share, round(avg(ari), 6)::DOUBLE AS ari_mean, round(median(ari), 6)::DOUBLE AS ari_median, round(min(ari), 6)::DOUBLE AS ari_min, round(max(ari), 6)::DOUBLE AS ari_max, round(avg(nmi_arithmetic), 6) AS nmi_arithmetic_mean, round(median(nmi_arithmetic), 6) AS nmi_arithmetic_median, round(min(nmi_arithmetic), 6) AS nmi_arithmetic_min, round(max(nmi_arithmetic), 6) AS nmi_arithmetic_max FROM p", "cand", all_=ALL, p=PAIRS))
def res04_stability(s, d):
    return rounded(C.stability(C.all_pairs(A.candidates(s, d), "solution_id")))


@query(A.sql("SELECT key, round(avg(ari), 6)::DOUBLE AS mean_ari FROM (SELECT i AS key, ari FROM p UNION ALL SELECT j, ari FROM p) GROUP BY 1 ORDER BY round(avg(ari), 12) DESC, key LIMIT 1", "cand", all_=ALL, p=PAIRS))
def sim07_medoid(s, d):
    return rounded(C.medoid(C.all_pairs(A.candidates(s, d), "solution_id")))


@query(A.sql("SELECT class_id, CAST(len(list_intersect(x, y)) AS BIGINT) AS retained, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(x) END, 6)::DOUBLE AS retention FROM (SELECT class_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM nodes LEFT JOIN (SELECT node, list(neighbour) AS x FROM se GROUP BY 1) ON node = class_id LEFT JOIN (SELECT node AS m, list(neighbour) AS y FROM ends GROUP BY 1) ON m = class_id)", *ENDS, "nodes", "flows", "flow", se="SELECT source AS node, target AS neighbour FROM flow UNION ALL SELECT target, source FROM flow"))
def sim08_retention(s, d):
    n = A.nodes(s, d)
    return rounded(M.neighbours_kept(M.edge_neighbours(n, G.flow_weights(A.flows(s, d))), M.edge_neighbours(n, raw(s, d))))


@query(A.sql("SELECT l, r, n AS shared, round(sum(l * n) OVER (PARTITION BY r) / sum(n) OVER (PARTITION BY r), 6)::DOUBLE AS barycentre FROM cont", *CONT))
def sim10_flows(s, d):
    return rounded(C.flows(A.labels(s, d), A.labels_mod(s, d)))


def _matched_sql(edges: str, gain: str) -> tuple[str, dict[str, str]]:
    """The largest gain of a matching of nations (0 to 24) with the 7 other clusters: nation by nation, over the sets of clusters that are taken."""
    steps = {"e": edges, "s0": "SELECT 0::BIGINT AS mask, 0::BIGINT AS got"}
    for i in range(25):
        steps[f"s{i + 1}"] = f"SELECT mask, max(got) AS got FROM (SELECT mask, got FROM s{i} UNION ALL SELECT mask + (1 << e.r), got + {gain} FROM s{i} JOIN e ON e.l = {i} AND (mask >> e.r) % 2 = 0) GROUP BY 1"
    return "SELECT max(got) FROM s25", steps


_TOTAL, _STEPS = _matched_sql("SELECT CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n FROM cont", "e.n")


@query()
def sim11_matching(s, d):
    return C.overlap_matching(A.labels(s, d), A.labels_mod(s, d))


@query(A.sql(f"SELECT CAST(({_TOTAL}) AS BIGINT) AS total_overlap", *CONT, **_STEPS))
def sim11_total_overlap(s, d):
    return C.overlap_matching(A.labels(s, d), A.labels_mod(s, d)).agg(F.sum("overlap").alias("total_overlap"))


_MATCHED, _STEPS = _matched_sql("SELECT CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r FROM (SELECT l, r, n, max(n) OVER (PARTITION BY l) AS best FROM cont) WHERE n = best", "1")
_MOJO = {
    **_STEPS, "size": "SELECT r, sum(n) AS z FROM cont GROUP BY 1", "least": "SELECT min(x + (SELECT count(*) FROM size WHERE z > x)) AS m FROM (SELECT 0 AS x UNION SELECT z FROM size)",
    "best": "SELECT l, max(n) AS b FROM cont GROUP BY 1", "d": f"SELECT (SELECT sum(z) FROM size) - sum(b) + count(*) - ({_MATCHED}) AS mojo, (SELECT sum(z) FROM size) - (SELECT m FROM least) AS worst FROM best",
}


@query(A.sql("SELECT round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE round(2 * p * r / (p + r), 6) END::DOUBLE AS f1 FROM (SELECT CASE WHEN sa = 0 THEN 0.0 ELSE sn / sa END AS p, CASE WHEN sb = 0 THEN 0.0 ELSE sn / sb END AS r FROM w)", *CONT, w=ROW))
def ref03_pairwise(s, d):
    return rounded(C.pair_counts(A.labels(s, d), A.labels_mod(s, d)))


@query("SELECT count(*) AS classes, count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS mapped, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS unmapped, 0::BIGINT AS unknown, round(count(*) FILTER (WHERE s_suppkey % 3 <> 0) * 1.0::DOUBLE / count(*), 6) AS coverage FROM supplier")
def ref01_coverage(s, d):
    return rounded(C.coverage(A.nodes(s, d), A.labels(s, d).where("CAST(class_id AS INT) % 3 <> 0")))


@query(A.sql("SELECT CAST(mojo AS BIGINT) AS mojo, round(CASE WHEN worst <= 0 THEN CASE WHEN mojo = 0 THEN 100.0 ELSE 0.0 END ELSE least(100.0, greatest(0.0, 100.0 * (1 - mojo / worst))) END, 6)::DOUBLE AS mojofm FROM d", *CONT, **_MOJO))
def ref04_mojo(s, d):
    return rounded(C.mojo(A.labels(s, d), A.labels_mod(s, d)))


# Objectives and fronts


PLACED = "SELECT a.solution_id, a.cluster_id AS sc, b.cluster_id AS tc, raw_weight AS w FROM raw e JOIN cand a ON e.source = a.class_id JOIN cand b ON e.target = b.class_id AND a.solution_id = b.solution_id"
OBJ = "SELECT solution_id, (max(tw) - sum(inside)) / max(tw) AS coupling, avg(CASE WHEN size = 1 THEN 0 ELSE 2 * inside / (size * (size - 1.0)) END) AS cohesion, stddev_pop(size) / avg(size) AS imbalance FROM (SELECT z.*, coalesce((SELECT sum(w) FROM placed p WHERE p.solution_id = z.solution_id AND sc = cluster_id AND tc = cluster_id), 0) AS inside, (SELECT sum(w) FROM placed p WHERE p.solution_id = z.solution_id) AS tw FROM (SELECT solution_id, cluster_id, count(*) AS size FROM cand GROUP BY 1, 2) z) GROUP BY 1"


@query(A.sql("SELECT solution_id, round(coupling, 6) AS coupling, round(cohesion, 6) AS cohesion, round(imbalance, 6) AS imbalance FROM o", *RAW, "cand", placed=PLACED, o=OBJ))
def obj01_structural(s, d):
    return rounded(P.structural_objectives(raw(s, d), A.candidates(s, d), "raw_weight"))


@query(A.sql("SELECT solution_id, sc AS cluster_id, sum(w) AS internal_weight FROM placed WHERE sc = tc GROUP BY 1, 2", *RAW, "cand", placed=PLACED))
def obj02_internal_weights(s, d):
    return rounded(P.internal_weights(raw(s, d), A.candidates(s, d), "raw_weight"))


@query(A.sql("SELECT solution_id, round(max(size) / sum(size) - 0.4, 6)::DOUBLE AS size_violation, 2 - count(*) AS count_violation, max(size) / sum(size) - 0.4 <= 0 AND 2 - count(*) <= 0 AS feasible FROM (SELECT solution_id, cluster_id, count(*) AS size FROM cand GROUP BY 1, 2) GROUP BY 1", "cand"))
def obj03_admissibility(s, d):
    return rounded(P.admissibility(A.candidates(s, d)))


@query(A.sql("SELECT solution_id, round(1 - coalesce((SELECT sum(weight) FROM sem JOIN cand a ON class_id_a = a.class_id JOIN cand b ON class_id_b = b.class_id AND a.solution_id = b.solution_id AND a.cluster_id = b.cluster_id WHERE a.solution_id = o.solution_id), 0) / (SELECT sum(weight) FROM sem), 6) AS f_semantic FROM (SELECT DISTINCT solution_id FROM cand) o", "flows", "flow", "cand", sem=SEM))
def obj05_semantic(s, d):
    return rounded(P.semantic_objective(semantic(s, d), A.candidates(s, d)))


@query(A.sql("SELECT 0.0::DOUBLE AS coupling_low, 1.0::DOUBLE AS coupling_high, -max(raw_weight) AS cohesion_low, 0.0::DOUBLE AS cohesion_high, 0.0::DOUBLE AS imbalance_low, (SELECT round(max(sqrt(greatest(sq / k - (n / k) * (n / k), 0)) / (n / k)), 6) FROM (SELECT n::DOUBLE AS n, k, q * m * m + CASE WHEN rest > 0 THEN (rest + 1) * (rest + 1) ELSE 0 END + (k - q - CASE WHEN rest > 0 THEN 1 ELSE 0 END) AS sq FROM (SELECT n, m, k, (n - k) // (m - 1) AS q, (n - k) % (m - 1) AS rest FROM (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.4) AS BIGINT)) AS m FROM supplier), range(2, (SELECT count(*) + 1 FROM supplier)) t(k)) WHERE q + CASE WHEN rest > 0 THEN 1 ELSE 0 END <= k)) AS imbalance_high FROM raw", *RAW))
def bnd01_theoretical(s, d):
    return rounded(P.theoretical_bounds(A.nodes(s, d), raw(s, d)))


FRONT3 = ("coupling", "imbalance", "f_semantic")
BND3 = ", ".join(f"min({c}) - greatest(0.1 * (max({c}) - min({c})), 1e-6) AS {c}_low, max({c}) + greatest(0.1 * (max({c}) - min({c})), 1e-6) AS {c}_high" for c in FRONT3)


@query(A.sql("SELECT " + ", ".join(f"round({c}_{e}, 6)::DOUBLE AS {c}_{e}" for c in FRONT3 for e in ("low", "high")) + " FROM b", "front", b=f"SELECT {BND3} FROM front"))
def bnd03_observed(s, d):
    return rounded(P.observed_bounds(A.front(s, d), FRONT3))


@query(A.sql("SELECT solution_id, round((imbalance - lo) / (hi - lo), 6) AS z FROM front, (SELECT min(imbalance) AS lo, max(imbalance) AS hi FROM front)", "front"))
def bnd05_normalized(s, d):
    f = A.front(s, d)
    ends = f.agg(F.min("imbalance").alias("lo"), F.max("imbalance").alias("hi"))
    return rounded(f.crossJoin(F.broadcast(ends)).select("solution_id", P.normalized(F.col("imbalance"), F.col("lo"), F.col("hi")).alias("z")))


DOM = "NOT EXISTS (SELECT 1 FROM {t} a WHERE a.run = b.run AND a.coupling <= b.coupling AND a.imbalance <= b.imbalance AND a.f_semantic <= b.f_semantic AND (a.coupling < b.coupling OR a.imbalance < b.imbalance OR a.f_semantic < b.f_semantic))"
ND = "SELECT * FROM front b WHERE " + DOM.format(t="front")


@query(A.sql("SELECT run, solution_id, coupling, imbalance, f_semantic FROM nd", "front", nd=ND))
def dom01_nondominated(s, d):
    return P.nondominated(A.front(s, d).select("run", "solution_id", *FRONT3), FRONT3, ("run",))


FEAS = "SELECT * FROM front f WHERE feasible OR NOT EXISTS (SELECT 1 FROM front g WHERE g.run = f.run AND g.feasible)"


@query(A.sql("SELECT run, solution_id FROM feas b WHERE " + DOM.format(t="feas"), "front", feas=FEAS))
def dom05_feasible_front(s, d):
    return P.feasible_front(A.front(s, d), FRONT3, ("run",)).select("run", "solution_id")


@query(A.sql("SELECT run, solution_id, coupling, imbalance FROM (SELECT *, row_number() OVER (PARTITION BY run, coupling, imbalance ORDER BY solution_id) AS k FROM front b WHERE NOT EXISTS (SELECT 1 FROM front a WHERE a.run = b.run AND a.coupling <= b.coupling AND a.imbalance <= b.imbalance AND (a.coupling < b.coupling OR a.imbalance < b.imbalance))) WHERE k = 1", "front"))
def dom08_projected(s, d):
    return P.projected(A.front(s, d), FRONT3[:2], ("run",)).select("run", "solution_id", "coupling", "imbalance")


@query("SELECT seed, CAST(labels AS BIGINT) AS labels, coupling, 'seed' || seed || '_solution' || lpad(CAST(row_number() OVER (PARTITION BY seed ORDER BY coupling, imbalance, labels) - 1 AS VARCHAR), 3, '0') AS solution_id FROM (SELECT p_size % 5 AS seed, p_partkey % 50 AS labels, min(p_retailprice) AS coupling, arg_min(p_size, p_retailprice)::DOUBLE AS imbalance FROM part GROUP BY 1, 2)")
def dom06_numbered(s, d):
    p = A.table(s, d, "part").select((F.col("p_size") % 5).alias("seed"), (F.col("p_partkey") % 50).alias("labels"), F.col("p_retailprice").alias("coupling"), F.col("p_size").cast("double").alias("imbalance"))
    return rounded(P.numbered(p, ("coupling", "imbalance"), "labels").select("seed", "labels", "coupling", "solution_id"))


@query(A.sql("SELECT f.run, count(*) AS front_size, count(*) FILTER (WHERE f.coupling <= l.coupling AND f.imbalance <= l.imbalance AND (f.coupling < l.coupling OR f.imbalance < l.imbalance)) AS dominating, count(*) FILTER (WHERE l.coupling <= f.coupling AND l.imbalance <= f.imbalance AND (l.coupling < f.coupling OR l.imbalance < f.imbalance)) AS dominated FROM front f JOIN base l ON f.run = l.run GROUP BY 1", "front", base="SELECT run, min(solution_id) AS s, arg_min(coupling, solution_id) AS coupling, arg_min(imbalance, solution_id) AS imbalance FROM front GROUP BY 1"))
def dom09_baseline(s, d):
    f = A.front(s, d)
    base = f.groupBy("run").agg(F.min_by("coupling", "solution_id").alias("coupling"), F.min_by("imbalance", "solution_id").alias("imbalance"))
    return P.baseline_diagnostics(f, base, FRONT3[:2], "run")


@query(A.sql("SELECT run, round(sum((coalesce(nx, 60) - coupling) * (2500 - low)), 4) AS hypervolume FROM (SELECT run, coupling, lead(coupling) OVER w AS nx, min(imbalance) OVER (PARTITION BY run ORDER BY coupling, imbalance ROWS UNBOUNDED PRECEDING) AS low FROM (SELECT DISTINCT run, coupling, imbalance FROM front WHERE coupling < 60 AND imbalance < 2500) WINDOW w AS (PARTITION BY run ORDER BY coupling, imbalance)) GROUP BY 1", "front"))
def hv01_hypervolume_2d(s, d):
    return rounded(P.hypervolume_2d(A.front(s, d), "coupling", "imbalance", (60.0, 2500.0), ("run",)), 4)


@query()
def hv01_hypervolume_3d(s, d):
    return rounded(P.hypervolumes(P.nondominated(A.front(s, d), FRONT3, ("run",)), FRONT3, (60.0, 2500.0, 80.0), "run"), 3)


@query(A.sql("SELECT " + ", ".join(f"round(max({c}) + greatest(0.1 * (max({c}) - min({c})), 1e-6), 6)::DOUBLE AS {c}_reference" for c in FRONT3) + " FROM front", "front"))
def hv02_reference(s, d):
    return rounded(P.reference_point(A.front(s, d), FRONT3))


HIST = "SELECT event_type, CAST(day AS BIGINT) AS generation, hv AS hypervolume FROM (SELECT event_type, dayofyear(ts) AS day, round(max(value), 4) AS hv FROM events GROUP BY 1, 2)"


def history(s, d):
    return A.table(s, d, "events").groupBy("event_type", F.dayofyear("ts").cast("long").alias("generation")).agg(F.round(F.max("value"), 4).alias("hypervolume"))


@query(A.sql("SELECT event_type, round(avg(hypervolume), 6) AS mean, round(coalesce(stddev_samp(hypervolume), 0), 6) AS std, min(hypervolume) AS min, max(hypervolume) AS max FROM h GROUP BY 1", h=HIST))
def hv03_summary(s, d):
    return rounded(P.hypervolume_summary(history(s, d), ("event_type",)))


BEST = "SELECT *, max(hypervolume) OVER (PARTITION BY event_type ORDER BY generation ROWS UNBOUNDED PRECEDING) AS best FROM h"


@query(A.sql(BEST, h=HIST))
def hv04_best_so_far(s, d):
    return P.best_so_far(history(s, d), ("event_type",))


@query(A.sql("SELECT event_type, min(generation) FILTER (WHERE best >= 0.99 * final) AS plateau_generation, round(max(final) - max(best) FILTER (WHERE i = greatest(n - 20, 0)), 6) AS late_gain FROM (SELECT *, max(best) OVER (PARTITION BY event_type) AS final, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY generation) - 1 AS i FROM b) GROUP BY 1", h=HIST, b=BEST))
def hv05_plateau(s, d):
    return rounded(P.plateau(history(s, d), ("event_type",)))


# Selection


BAND = "SELECT *, max(weighted_modularity) OVER (PARTITION BY run) AS qm FROM {t}"
PICK = "SELECT run, solution_id, imbalance, weighted_modularity FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY imbalance, weighted_modularity DESC, coupling, solution_id) AS k FROM q WHERE (qm - weighted_modularity) / qm <= 0.05 + 1e-12) WHERE k = 1"


@query(A.sql(PICK, "front", feas=FEAS, q=BAND.format(t="feas")))
def sel01_solution(s, d):
    return S.select_solution(A.front(s, d), ("run",)).select("run", "solution_id", "imbalance", "weighted_modularity")


BUDGET = "SELECT run, budget, qm AS q_max, eligible, solution_id FROM (SELECT *, count(*) OVER (PARTITION BY run, budget) AS eligible, row_number() OVER (PARTITION BY run, budget ORDER BY imbalance, weighted_modularity DESC, coupling, solution_id) AS k FROM q, (SELECT unnest([0.0, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15])::DOUBLE AS budget) WHERE (qm - weighted_modularity) / qm <= budget + 1e-12) WHERE k = 1"


@query(A.sql(BUDGET, "front", q=BAND.format(t="front")))
def sel02_budgets(s, d):
    return S.select_budgets(A.front(s, d), ("run",)).select("run", "budget", "q_max", "eligible", "solution_id")


LOSS = "SELECT *, (max(weighted_modularity) OVER (PARTITION BY run) - weighted_modularity) / max(weighted_modularity) OVER (PARTITION BY run) AS q_loss FROM front"


def with_loss(s, d):
    from pyspark.sql import Window

    top = F.max("weighted_modularity").over(Window.partitionBy("run"))
    return A.front(s, d).withColumn("q_loss", (top - F.col("weighted_modularity")) / top)


@query(A.sql("SELECT run, solution_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f_semantic, weighted_modularity DESC, solution_id) AS k FROM q WHERE q_loss <= 0.1 + 1e-12) WHERE k = 1", "front", q=LOSS))
def sel03_candidate(s, d):
    return S.select_candidate(with_loss(s, d), ("run",), "semantic", 0.1).select("run", "solution_id")


def _profile_sql() -> str:
    order = lambda keys: ", ".join(f"{k[1:]} DESC" if k.startswith("-") else k for k in keys)
    one = [f"SELECT run, '{p}' AS profile_id, solution_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {order(keys)}) AS k FROM q {'WHERE (qm - weighted_modularity) / qm <= 0.05 + 1e-12' if banded else ''}) WHERE k = 1" for p, (banded, keys) in S.PROFILES.items()]
    return " UNION ALL ".join(one)


@query(A.sql(_profile_sql(), "front", q="SELECT *, max(weighted_modularity) OVER (PARTITION BY run) AS qm FROM front WHERE feasible"))
def sel04_profiles(s, d):
    return S.operating_profiles(A.front(s, d), ("run",)).select("run", "profile_id", "solution_id")


@query(A.sql("SELECT f.run, f.solution_id, " + ", ".join(f"coalesce(bool_or(profile_id = '{p}'), false) AS selected_{p}" for p in S.PROFILES) + " FROM front f LEFT JOIN pr ON f.run = pr.run AND f.solution_id = pr.solution_id GROUP BY 1, 2", "front", q="SELECT *, max(weighted_modularity) OVER (PARTITION BY run) AS qm FROM front WHERE feasible", pr=_profile_sql()))
def sel13_membership(s, d):
    f = A.front(s, d)
    return S.band_membership(f, S.operating_profiles(f, ("run",)), ("run",))


@query(A.sql("SELECT budget, round(avg(imbalance), 6) AS imbalance_mean, round(median(imbalance), 6) AS imbalance_median, count(DISTINCT solution_id) AS solutions FROM (" + BUDGET.replace("SELECT run,", "SELECT imbalance, run,", 1) + ") GROUP BY 1", "front", q=BAND.format(t="front")))
def sel05_summary(s, d):
    return rounded(S.summarize_selection(S.select_budgets(A.front(s, d), ("run",)), ("budget",)))


SWEEP = "SELECT p_partkey AS setting, p_size % 30 + 2 AS cluster_count, (p_partkey % 60) / 100.0::DOUBLE AS max_cluster_ratio, (p_partkey % 23) / 100.0::DOUBLE AS singleton_ratio, 0.7::DOUBLE + (p_partkey % 31) / 100.0::DOUBLE AS reference_coverage_ratio, (p_size % 7) / 4.0::DOUBLE AS ssa_lambda, 0.5::DOUBLE + (p_partkey % 5) / 4.0::DOUBLE AS resolution, ((p_partkey * 7919) % 997) / 1000.0::DOUBLE AS weighted_modularity, (p_partkey % 11) / 10.0::DOUBLE AS internal_edge_weight_ratio, (p_partkey % 13) / 13.0::DOUBLE AS pairwise_f1, (p_partkey % 17)::DOUBLE AS mojofm_vs_reference FROM part"


def sweep(s, d):
    k = F.col("p_partkey")
    return A.table(s, d, "part").select(k.alias("setting"), (F.col("p_size") % 30 + 2).cast("long").alias("cluster_count"), (k % 60 / 100.0).alias("max_cluster_ratio"), (k % 23 / 100.0).alias("singleton_ratio"), (0.7 + k % 31 / 100.0).alias("reference_coverage_ratio"), (F.col("p_size") % 7 / 4.0).alias("ssa_lambda"), (0.5 + k % 5 / 4.0).alias("resolution"), ((k * 7919) % 997 / 1000.0).alias("weighted_modularity"), (k % 11 / 10.0).alias("internal_edge_weight_ratio"), (k % 13 / 13.0).alias("pairwise_f1"), (k % 17).cast("double").alias("mojofm_vs_reference"))


ADM = "SELECT *, NOT (cluster_count > greatest(t * 3, t + 10) OR max_cluster_ratio > 0.4::DOUBLE OR singleton_ratio > 0.15::DOUBLE OR reference_coverage_ratio < 0.8::DOUBLE OR ssa_lambda > 1) AS is_candidate, abs(resolution - 1) AS resolution_distance FROM sweep, (SELECT greatest(1, CAST(round_even(median(cluster_count), 0) AS INTEGER)) AS t FROM sweep)"
TAIL = "internal_edge_weight_ratio DESC, max_cluster_ratio, singleton_ratio, resolution_distance, pairwise_f1 DESC, mojofm_vs_reference DESC, setting"


@query(A.sql(f"SELECT setting, is_candidate, weighted_modularity FROM adm ORDER BY is_candidate DESC, ssa_lambda > 1, weighted_modularity DESC, {TAIL} LIMIT 10", sweep=SWEEP, adm=ADM))
def sel07_ranked_settings(s, d):
    return S.ranked_settings(sweep(s, d)).select("setting", "is_candidate", "weighted_modularity")


@query(A.sql(f"SELECT setting, ssa_lambda, weighted_modularity FROM adm WHERE is_candidate AND ssa_lambda > 0 AND weighted_modularity >= (SELECT max(weighted_modularity) FROM adm WHERE is_candidate AND ssa_lambda > 0) - 0.005 ORDER BY ssa_lambda, {TAIL} LIMIT 1", sweep=SWEEP, adm=ADM))
def sel06_baseline_profile(s, d):
    return S.baseline_profile(sweep(s, d)).select("setting", "ssa_lambda", "weighted_modularity")


THRESH = "SELECT f.*, t.threshold FROM front f, (SELECT unnest([4.0, 6.0, 8.0])::DOUBLE AS threshold) t"


@query(A.sql("SELECT p.run, p.threshold, p.solution_id, round(avg(CASE WHEN rows_.cluster_count > rows_.threshold THEN 1.0 ELSE 0 END), 6)::DOUBLE AS trimmed_share FROM pick p JOIN rows_ ON p.run = rows_.run AND p.threshold = rows_.threshold GROUP BY 1, 2, 3", "front", rows_=THRESH,
    kept="SELECT * FROM rows_ WHERE cluster_count <= threshold", ok="SELECT * FROM (SELECT *, bool_or(feasible) OVER (PARTITION BY run, threshold) AS any_ok FROM kept) WHERE feasible OR NOT any_ok", q="SELECT *, max(weighted_modularity) OVER (PARTITION BY run, threshold) AS qm FROM ok",
    pick="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, threshold ORDER BY imbalance, weighted_modularity DESC, coupling, solution_id) AS k FROM q WHERE (qm - weighted_modularity) / qm <= 0.05 + 1e-12) WHERE k = 1"))
def sel08_thresholds(s, d):
    return rounded(S.threshold_sensitivity(A.front(s, d), ("run",), "cluster_count", (4, 6, 8)).select("run", "threshold", "solution_id", "trimmed_share"))


def _match_sides(s, d):
    k = F.col("p_partkey")
    p = A.table(s, d, "part").select(k.alias("seed"), F.lpad(k.cast("string"), 9, "0").alias("solution_id"), F.col("p_retailprice").alias("imbalance"), (k % 9 + 2).alias("cluster_count"))
    return p.where("seed % 40 = 0"), p.where("seed % 40 <> 0")


MATCH = "SELECT p_partkey AS seed, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS solution_id, p_retailprice AS imbalance, p_partkey % 9 + 2 AS cluster_count FROM part"


def _match_sql(on: str) -> str:
    return A.sql(f"SELECT left_key, right_id, round(gap, 6) AS gap FROM (SELECT a.seed AS left_key, b.solution_id AS right_id, abs(a.imbalance - b.imbalance) AS gap, row_number() OVER (PARTITION BY a.seed ORDER BY abs(a.imbalance - b.imbalance), b.seed, b.solution_id) AS k FROM m a JOIN m b ON a.seed % 40 = 0 AND b.seed % 40 <> 0 AND {on}) WHERE k = 1", m=MATCH)


@query(_match_sql("true"))
def sel09_nearest_pooled(s, d):
    return rounded(S.nearest_match(*_match_sides(s, d), "pooled").select("left_key", "right_id", "gap"))


@query(_match_sql("abs(a.cluster_count - b.cluster_count) <= 1"))
def sel09_nearest_count(s, d):
    return rounded(S.nearest_match(*_match_sides(s, d), "count").select("left_key", "right_id", "gap"))


@query(A.sql("SELECT caliper, count(*) FILTER (WHERE gap <= caliper) AS within, count(*) AS rows FROM g, (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS caliper) GROUP BY 1", m=MATCH, g="SELECT min(abs(a.imbalance - b.imbalance)) AS gap FROM m a JOIN m b ON a.seed % 40 = 0 AND b.seed % 40 <> 0 GROUP BY a.seed"))
def sel10_calipers(s, d):
    return S.caliper_counts(S.nearest_match(*_match_sides(s, d), "pooled"))


@query(A.sql("SELECT target, count(*) AS runs, count(loss) AS available, round(median(loss), 6) AS median_loss, round(max(loss), 6) AS max_loss FROM (SELECT run, target, min(q_loss) FILTER (WHERE g >= target - 1e-12) AS loss FROM (SELECT *, cohesion / 200 AS g FROM q), (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS target) GROUP BY 1, 2) GROUP BY 1", "front", q=LOSS))
def res01_reverse_targets(s, d):
    return rounded(S.reverse_targets(with_loss(s, d).withColumn("semantic_gain", F.col("cohesion") / 200), ("run",)))


# Statistics


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def stat01_describe(s, d):
    out = T.describe(A.table(s, d, "events"), "value", ("event_type",))
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "q1", "q3", "iqr")), "min", "max")


@query("SELECT event_type, value AS quantile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = ceil(0.95 * (n - 1))")
def stat03_quantile_higher(s, d):
    return T.quantile_higher(A.table(s, d, "events"), "value", 0.95, ("event_type",))


RANKED = 'SELECT *, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS r FROM (SELECT *, "right" - "left" AS d FROM pairs) WHERE d <> 0'
SIGNED = "SELECT event_type, count(*) AS nonzero, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm FROM ranked GROUP BY 1"


@query(A.sql("SELECT event_type, nonzero, round(wp, 3)::DOUBLE AS w_plus, round(wm, 3)::DOUBLE AS w_minus, round((wp - wm) / (wp + wm), 6)::DOUBLE AS rank_biserial, round(least(wp, wm), 3)::DOUBLE AS statistic FROM sg", "pairs", ranked=RANKED, sg=SIGNED))
def stat05_signed_ranks(s, d):
    w = T.wilcoxon(T.rank_biserial(T.signed_ranks(A.pairs(s, d), ("event_type",))))
    return w.select("event_type", "nonzero", *(F.round(c, k).alias(c) for c, k in (("w_plus", 3), ("w_minus", 3), ("rank_biserial", 6), ("statistic", 3))))


@query()
def stat05_wilcoxon_p(s, d):
    return T.holm(T.wilcoxon(T.signed_ranks(A.pairs(s, d), ("event_type",))), order=("event_type",)).select("event_type", "statistic", "p_value", "holm")


TESTS = "SELECT n_name AS name, n_regionkey AS family, ((n_nationkey * 7) % 25 + 1) / 250.0::DOUBLE AS p_value FROM nation"


def tests_(s, d):
    return A.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("family"), (((F.col("n_nationkey") * 7) % 25 + 1) / 250.0).alias("p_value"))


@query(A.sql("SELECT name, family, p_value, round(least(1.0, max(s) OVER (PARTITION BY family ORDER BY p_value, name ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, name) + 1) * p_value AS s FROM t)", t=TESTS))
def stat06_holm(s, d):
    return T.holm(tests_(s, d), by=("family",), order=("name",)).withColumn("holm", F.round("holm", 6))


@query(A.sql("SELECT name, family, p_value, n AS size, round(least(1.0, p_value * n), 6) AS bonferroni FROM t JOIN (SELECT family, count(*) AS n FROM t GROUP BY 1) USING (family)", t=TESTS))
def stat07_bonferroni(s, d):
    t = tests_(s, d)
    return T.bonferroni(t, t.groupBy("family").agg(F.count("*").alias("size"))).withColumn("bonferroni", F.round("bonferroni", 6))


@query(A.sql('SELECT event_type, count(*) AS pairs, count(*) FILTER (WHERE -d > 1.0) AS better, count(*) FILTER (WHERE abs(d) <= 1.0) AS tie, count(*) FILTER (WHERE -d < -1.0) AS worse FROM (SELECT *, "right" - "left" AS d FROM pairs) WHERE d IS NOT NULL GROUP BY 1', "pairs"))
def stat08_better_tie_worse(s, d):
    return T.better_tie_worse(A.pairs(s, d), ("event_type",), True, 1.0)


@query(A.sql('SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(min(d), 6) AS min, round(max(d), 6) AS max FROM (SELECT *, "right" - "left" AS d FROM pairs) WHERE d IS NOT NULL GROUP BY 1', "pairs"))
def stat11_paired_summary(s, d):
    return rounded(T.paired_summary(A.pairs(s, d), ("event_type",)))


@query("SELECT event_type, count(value) FILTER (WHERE user_id % 2 = 0) AS n, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS mean, round(median(value) FILTER (WHERE user_id % 2 = 0), 6) AS median FROM events GROUP BY 1")
def stat12_conditional(s, d):
    return rounded(T.conditional_summary(A.table(s, d, "events"), "value", F.col("user_id") % 2 == 0, ("event_type",)))


@query(A.sql("SELECT event_type, count(*) AS n, round(corr(x, y), 6) AS rho, NULL::VARCHAR AS reason FROM (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY \"left\") + (count(*) OVER (PARTITION BY event_type, \"left\") - 1) / 2.0 AS x, rank() OVER (PARTITION BY event_type ORDER BY \"right\") + (count(*) OVER (PARTITION BY event_type, \"right\") - 1) / 2.0 AS y FROM pairs WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL) GROUP BY 1", "pairs"))
def stat13_spearman(s, d):
    return rounded(T.spearman(A.pairs(s, d), "left", "right", ("event_type",)))


@query("SELECT n1::DOUBLE AS n1, n2::DOUBLE AS n2, round(rs - n1 * (n1 + 1) / 2.0, 3)::DOUBLE AS u FROM (SELECT count(*) FILTER (WHERE g = 'a') AS n1, count(*) FILTER (WHERE g = 'b') AS n2, sum(r) FILTER (WHERE g = 'a') AS rs FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events))")
def stat14_mann_whitney(s, d):
    e = A.table(s, d, "events").withColumn("g", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    return T.mann_whitney(e, "value", "g", "a").select("n1", "n2", F.round("u", 3).alias("u"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - 2 * stddev_samp(value), 6) AS low, round(avg(value) + 2 * stddev_samp(value), 6) AS high FROM events GROUP BY 1")
def stat15_two_sigma(s, d):
    return rounded(T.two_sigma(A.table(s, d, "events"), "value", ("event_type",)))


@query(A.sql("SELECT run, metric, count(value) AS available, count(*) AS rows, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM (SELECT run, 'coupling' AS metric, coupling AS value FROM front UNION ALL SELECT run, 'imbalance', imbalance FROM front) GROUP BY 1, 2", "front"))
def stat18_metric_summary(s, d):
    return rounded(T.metric_summary(A.front(s, d), ("coupling", "imbalance"), ("run",)))


@query(A.sql("SELECT run, budget, solution_id, before, solution_id <> before AS changed FROM (SELECT *, lag(solution_id) OVER (PARTITION BY run ORDER BY budget) AS before FROM b) WHERE before IS NOT NULL", "front", q=BAND.format(t="front"), b=BUDGET))
def stat19_transitions(s, d):
    b = S.select_budgets(A.front(s, d), ("run",)).select("run", "budget", "solution_id")
    return T.transitions(b, "solution_id", "budget", ("run",))


@query(A.sql('SELECT event_type, bucket, round(CASE WHEN "left" = 0 THEN "right" - "left" ELSE ("right" - "left") / abs("left") END, 5) AS delta FROM pairs', "pairs"))
def stat20_relative_delta(s, d):
    return A.pairs(s, d).select("event_type", "bucket", F.round(T.relative_delta(F.col("left"), F.col("right")), 5).alias("delta"))


@query()
def stat24_random_baseline(s, d):
    size = A.labels(s, d).groupBy("cluster_id").agg(F.count("*").alias("k"))
    n, good = size.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0))).first()
    return T.random_baseline(s, T.LabelSizes(n, good), semantic(s, d).count())


@query()
def res08_bootstrap(s, d):
    return rounded(T.bootstrap_mean(A.pairs(s, d), "left"))


# Vectors, text, hashes


def _topk_sql() -> str:
    return A.sql("SELECT class_id, rank, target, round(c, 6) AS weight FROM t", "vec", t="SELECT * FROM (SELECT x.class_id, y.class_id AS target, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY x.class_id ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 12) DESC, y.class_id) AS rank FROM vec x, vec y WHERE x.class_id <> y.class_id) WHERE rank <= 3")


@query(_topk_sql())
def vec03_top_k(s, d):
    return rounded(E.top_k(A.vectors(s, d)))


@query(A.sql("SELECT least(class_id, target) AS class_id_a, greatest(class_id, target) AS class_id_b, round(max(weight), 6) AS weight, CASE WHEN bool_or(class_id < target) AND bool_or(class_id > target) THEN 'both' WHEN bool_or(class_id < target) THEN 'a' ELSE 'b' END AS selected_by FROM d GROUP BY 1, 2", d=_topk_sql()))
def vec04_semantic_graph(s, d):
    return rounded(E.semantic_graph(A.vectors(s, d)))


@query(A.sql("SELECT x.class_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM vec x JOIN vec y ON CAST(y.class_id AS INTEGER) = CAST(x.class_id AS INTEGER) + 1", "vec"))
def res07_paired_shift(s, d):
    v = A.vectors(s, d)
    return rounded(E.paired_shift(v, v.withColumn("class_id", (F.col("class_id").cast("int") - 1).cast("string"))))


@query(A.sql("SELECT sha256(text) AS input_hash, count(*) AS rows FROM texts GROUP BY 1 HAVING count(*) > 1", "texts"))
def res07_duplicate_texts(s, d):
    return E.duplicate_groups(A.texts(s, d))


@query()
def txt04_method_bodies(s, d):
    m = A.texts(s, d).select("class_id", F.col("source").alias("method_name"), F.col("lang").alias("method_signature"), F.lit(True).alias("concrete"), F.lit(False).alias("synthetic"), F.col("text").alias("body_text"))
    return Z.class_tokens(Z.method_tokens(m))


IDENT = "'get' || replace(replace(p_name, ' ', '_'), 'a', 'HTTPA') || '.' || p_type"


@query(f"SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace({IDENT}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_.\\-]+', ' ', 'g')), '\\s+'), lambda x: x <> ''), ' ') AS parts FROM part")
def txt01_split_identifier(s, d):
    name = F.concat(F.lit("get"), F.regexp_replace(F.regexp_replace("p_name", " ", "_"), "a", "HTTPA"), F.lit("."), "p_type")
    return A.table(s, d, "part").select("p_partkey", F.array_join(Z.split_identifier(name), " ").alias("parts"))


def _parts_sql(v):
    v = f"regexp_replace(regexp_replace({v}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower(regexp_replace({v}, '[_.\\-]+', ' ', 'g')), '\\s+'), lambda x: x <> '')"


def _clean_sql(parts, accessors=True):
    """SQL of clean_identifier over a list of parts."""
    words = ", ".join(f"'{w}'" for w in (*Z.KEYWORDS, *Z.STOPWORDS))
    rest = f"CASE WHEN {parts}[1] IN ('get', 'set', 'is') THEN {parts}[2:] ELSE {parts} END" if accessors else parts
    keep = f"list_filter({rest}, lambda x: x NOT IN ({words}) AND length(x) >= 2 AND regexp_full_match(x, '[a-z][a-z0-9]*') AND NOT regexp_full_match(x, '{Z.SYNTHETIC}'))"
    return f"CASE WHEN {parts}[1] IN ({', '.join(repr(g) for g in Z.GENERIC)}) THEN [] ELSE {keep} END"


@query(f"SELECT p_partkey, array_to_string({_clean_sql('parts')}, ' ') AS tokens FROM (SELECT p_partkey, {_parts_sql(chr(39) + 'get_' + chr(39) + ' || p_name')} AS parts FROM part)")
def txt02_clean_identifier(s, d):
    return A.table(s, d, "part").select("p_partkey", F.array_join(Z.clean_identifier(F.concat(F.lit("get_"), "p_name")), " ").alias("tokens"))


#: Values of many kinds made from the events.
LITERAL = "CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'see http://a.b/' || event_id WHEN 3 THEN 'urn:x:' || user_id WHEN 4 THEN '/var/' || event_type WHEN 5 THEN '2024-01-0' || event_id % 9 WHEN 6 THEN 'deadbeef0123456789' WHEN 7 THEN 'warning' WHEN 8 THEN '%d: {}' WHEN 9 THEN 'the of' WHEN 10 THEN props ELSE 'open ' || event_type END"


@query("SELECT event_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) < 2 OR length(s) > 80 THEN 'length' " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in Z.LITERALS) + f" WHEN len({_clean_sql('parts', False)}) = 0 THEN 'no_meaningful_tokens' ELSE 'accepted' END AS reason FROM (SELECT event_id, s, {_parts_sql('s')} AS parts FROM (SELECT event_id, trim({LITERAL}) AS s FROM events))")
def txt03_literal_class(s, d):
    return A.table(s, d, "events").select("event_id", Z.literal_class(F.expr(LITERAL)).alias("reason"))


@query(A.sql("SELECT class_id, CAST(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) > 256 AS truncated FROM texts", "texts"))
def txt07_token_lengths(s, d):
    return Z.token_lengths(A.texts(s, d), 256)


TOK = "SELECT class_id, i, t FROM (SELECT class_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM (SELECT class_id, string_split(text, ' ') AS w FROM texts))"


@query(A.sql("SELECT class_id, string_agg(t, ' ' ORDER BY j) FILTER (WHERE j <= 256) AS text, count(*) AS tokens_before_budget, greatest(count(*) - 256, 0) AS tokens_truncated FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY i) AS j FROM (SELECT *, row_number() OVER (PARTITION BY class_id, t ORDER BY i) AS k FROM tok) WHERE k <= 2) GROUP BY 1", "texts", tok=TOK))
def txt05_class_tokens(s, d):
    return Z.class_tokens(A.texts(s, d).select("class_id", F.lit("m").alias("method_name"), F.lit("s").alias("method_signature"), F.split("text", " ").alias("tokens")))


@query(A.sql("SELECT class_id, replace(text, chr(13), '') || chr(10) AS declaration FROM texts", "texts"))
def txt06_declaration(s, d):
    t = A.texts(s, d).withColumn("text", F.concat(F.regexp_replace("text", "\r", ""), F.lit("\n")))
    return t.select("class_id", Z.declaration_of(Z.compose(F.col("text"), F.lit("body"))).alias("declaration"))


@query(A.sql("SELECT source, sha256(string_agg(class_id || chr(9) || sha256(text) || chr(10), '' ORDER BY class_id)) AS aggregate_sha256 FROM texts GROUP BY 1", "texts"))
def hsh02_aggregate(s, d):
    return Z.aggregate_hash(A.texts(s, d).withColumn("h", F.sha2("text", 256)), "class_id", "h", ("source",))


@query()
def hsh01_vector_hash(s, d):
    return A.vectors(s, d).select("class_id", Z.vector_hash("embedding").alias("sha256"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS class_id, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 1 THEN 'N' || s_nationkey || ' (p' || s_suppkey % 3 || ')' ELSE 'N' || s_nationkey END AS label FROM supplier")
def viz04_labels(s, d):
    n = A.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("class_id"), F.concat(F.lit("org.x.N"), "s_nationkey").alias("class_name"), F.concat(F.lit("org.p"), F.col("s_suppkey") % 3).alias("package"))
    return Z.display_labels(n)


@query(A.sql("SELECT source, target, round(1 + 4 * (sqrt(raw_weight) - sqrt(lo)) / (sqrt(hi) - sqrt(lo)), 6) AS width FROM raw, (SELECT min(raw_weight) AS lo, max(raw_weight) AS hi FROM raw)", *RAW))
def viz03_edge_widths(s, d):
    e = raw(s, d)
    ends = e.agg(F.min("raw_weight").alias("lo"), F.max("raw_weight").alias("hi"))
    return rounded(e.crossJoin(F.broadcast(ends)).select("source", "target", Z.scaled(F.col("raw_weight"), F.col("lo"), F.col("hi"), "sqrt", (1.0, 5.0)).alias("width")))


# Search


@query()
def clu01_leiden(s, d):
    params = s.createDataFrame([(1.0, 42), (1.0, 1), (0.8, 42), (1.2, 42)], "resolution double, seed long")
    return Y.leiden_runs(A.nodes(s, d), raw(s, d), "raw_weight", params, unique=True)


@query()
def evo08_nsga2(s, d):
    params = s.createDataFrame([(k,) for k in range(30)], "seed long")
    return X.nsga2_runs(A.nodes(s, d), raw(s, d), "raw_weight", params).withColumn("label_vector", F.to_json("label_vector"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met03_partition_metrics(spark, sf_dir)


def queries() -> dict:
    from tessera.plans import catalog_large, catalog_more, catalog_steps, catalog_studies  # noqa: F401  register further queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera.plans import catalog_large, catalog_more, catalog_steps, catalog_studies  # noqa: F401

    return dict(_SQL)

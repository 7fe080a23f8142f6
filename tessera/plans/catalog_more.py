"""Further registered queries: extraction, combined rows, predicates, seeds and sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import community as Y
from tessera.operators import extract as L
from tessera.operators import fronts as P
from tessera.operators import graph as G
from tessera.operators import pair_counts as N
from tessera.operators import partition as M
from tessera.operators import reports as R
from tessera.operators import search as X
from tessera.operators import selection as S
from tessera.operators import similarity as C
from tessera.operators import stats as T
from tessera.operators import text as Z
from tessera.operators import validate as V
from tessera.operators import vectors as E
from tessera.plans import adapters as A
from tessera.plans.catalog import CONT, DEG, FRONT3, LAB, LOSS, MOVED, ND, OBJ, PART, PLACED, RAW, ROW, SEM, SSA, query, raw, rounded, semantic, ssa, with_loss  # noqa: F401

APP = "SELECT CAST(s_suppkey AS VARCHAR) AS class_name FROM supplier WHERE s_suppkey % 3 <> 0"
STM = "SELECT CAST(l_orderkey AS VARCHAR) AS method, l_linenumber AS place, CASE WHEN l_returnflag = 'N' THEN 'assign' ELSE 'invoke' END AS kind, CAST(l_suppkey AS VARCHAR) AS method_class, CAST(l_partkey % 100 AS VARCHAR) AS callee_class, CASE WHEN l_linestatus = 'O' THEN 'r' || l_partkey % 3 END AS local, CASE WHEN l_returnflag <> 'N' THEN 'r' || l_suppkey % 3 END AS argument, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS argument_type FROM lineitem"


def application(s, d):
    return A.nodes(s, d).where("CAST(class_id AS INT) % 3 <> 0").select(F.col("class_id").alias("class_name"))


def statements(s, d):
    t, c = A.table(s, d, "lineitem"), F.col
    r = lambda x: F.concat(F.lit("r"), c(x) % 3)
    return t.select(
        c("l_orderkey").cast("string").alias("method"), c("l_linenumber").alias("place"), F.when(c("l_returnflag") == "N", "assign").otherwise("invoke").alias("kind"), c("l_suppkey").cast("string").alias("method_class"),
        (c("l_partkey") % 100).cast("string").alias("callee_class"), F.when(c("l_linestatus") == "O", r("l_partkey")).alias("local"), F.when(c("l_returnflag") != "N", r("l_suppkey")).alias("argument"), F.when(c("l_suppkey") % 2 == 0, c("l_suppkey").cast("string")).alias("argument_type"),
    )


@query("SELECT p_partkey, 'a' || p_size % 5 || '.b' || p_partkey AS class_name FROM part WHERE (p_size % 5 = 1 OR 'a' || p_size % 5 || '.b' || p_partkey = 'a2.b7') AND p_partkey <> 20")
def ext01_application_classes(s, d):
    c = A.table(s, d, "part").select("p_partkey", F.concat(F.lit("a"), F.col("p_size") % 5, F.lit(".b"), "p_partkey").alias("class_name"))
    return L.application_classes(c, ["a1", "a2.b7"], ["a1.b20"])


@query(A.sql("SELECT DISTINCT source, target, 'type' AS dependency_type, 1.0::DOUBLE AS weight, 'field_type_reference' AS evidence_kind, location AS evidence_location FROM (SELECT source, target, source AS location FROM deps) WHERE source <> target AND source IN (SELECT class_name FROM app) AND target IN (SELECT class_name FROM app)", "deps", app=APP))
def ext02_type_rows(s, d):
    r = A.dependencies(s, d).select("source", F.concat("target", F.lit("[][]")).alias("target"), F.lit("field_type_reference").alias("evidence_kind"), F.col("source").alias("evidence_location"))
    return L.type_rows(r, application(s, d))


@query(A.sql("SELECT DISTINCT method_class AS source, callee_class AS target, 'call' AS dependency_type, 2.0::DOUBLE AS weight, 'method_call' AS evidence_kind, method || '#' || place AS evidence_location FROM stm WHERE kind = 'invoke' AND method_class <> callee_class AND callee_class IN (SELECT class_name FROM app)", app=APP, stm=STM))
def ext03_call_rows(s, d):
    return L.call_rows(statements(s, d), application(s, d))


@query(A.sql("SELECT DISTINCT d.callee_class AS source, u.callee_class AS target, 'return_value_flow' AS flow_type, 3.0::DOUBLE AS weight, u.method AS evidence_method, CAST(u.place AS VARCHAR) AS evidence_statement FROM stm u JOIN stm d ON u.method = d.method AND u.argument = d.local WHERE u.kind = 'invoke' AND d.callee_class <> u.callee_class", stm=STM))
def ext04_return_flows(s, d):
    return L.return_flows(statements(s, d))


@query(A.sql("SELECT DISTINCT coalesce(c, argument_type) AS source, callee_class AS target, 'argument_passing_flow' AS flow_type, 3.0::DOUBLE AS weight, u.method AS evidence_method, CAST(place AS VARCHAR) AS evidence_statement FROM stm u LEFT JOIN (SELECT method, local, min(callee_class) AS c FROM stm WHERE local IS NOT NULL GROUP BY 1, 2) d ON u.method = d.method AND u.argument = d.local WHERE kind = 'invoke' AND argument IS NOT NULL AND coalesce(c, argument_type) <> callee_class", stm=STM))
def ext05_argument_flows(s, d):
    return L.argument_flows(statements(s, d))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS class_id, 'class R' || n_regionkey || ' extends Base implements I' || n_regionkey || ' methods ' || string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS declaration FROM nation GROUP BY n_regionkey")
def ext08_declarations(s, d):
    n = A.table(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("methods"))
    key = F.col("n_regionkey").cast("string")
    c = n.select(key.alias("class_id"), F.lit("class").alias("kind"), F.concat(F.lit("R"), key).alias("class_name"), F.lit("Base").alias("superclass"), F.array(F.concat(F.lit("I"), key)).alias("interfaces"), "methods")
    return L.declaration_text(c)


@query("SELECT p_partkey, regexp_extract(p_type || '.' || p_brand || '$In', '([^.$]*)$', 1) AS simple, p_type AS package, p_brand AS unwrapped FROM part")
def ext10_names(s, d):
    n = F.concat("p_type", F.lit("."), "p_brand", F.lit("$In"))
    return A.table(s, d, "part").select("p_partkey", Z.simple_name(n).alias("simple"), Z.package_of(n).alias("package"), Z.normal_type(F.concat("p_brand", F.lit("[][]"))).alias("unwrapped"))


@query(A.sql("SELECT solution_id FROM cand WHERE solution_id IN ('k4', 'k9') GROUP BY 1", "cand"))
def val14_objective_mismatch(s, d):
    o = P.structural_objectives(raw(s, d), A.candidates(s, d), "raw_weight")
    saved = o.withColumn("imbalance", F.when(F.col("solution_id").isin("k4", "k9"), F.col("imbalance") + 1e-6).otherwise(F.col("imbalance")))
    return V.objective_mismatch(saved, o, ("solution_id",), ("coupling", "cohesion", "imbalance"))


@query(A.sql("SELECT count(*) AS rows, 0::BIGINT AS dominated FROM nd", "front", nd=ND))
def val15_front_is_clean(s, d):
    front = P.nondominated(A.front(s, d).select("run", "solution_id", *FRONT3), FRONT3, ("run",))
    left = P.nondominated(front, FRONT3, ("run",))
    return front.agg(F.count("*").alias("rows")).crossJoin(left.agg(F.count("*").alias("n"))).select("rows", (F.col("rows") - F.col("n")).alias("dominated"))


@query(A.sql("SELECT (SELECT sum(raw_weight) FROM lab) AS clusters_weight, (SELECT sum(raw_weight) FROM lab) AS split_weight, (SELECT count(*) FROM lab) AS edges, true AS equal", *LAB))
def val16_totals(s, d):
    c = G.cluster_graph(raw(s, d), A.labels(s, d)).agg(F.sum("raw_weight").alias("clusters_weight"), F.sum("edge_count").alias("edges"))
    w = M.weight_split(raw(s, d), A.labels(s, d), "raw_weight").select((F.col("internal_weight") + F.col("external_weight")).alias("split_weight"))
    return c.crossJoin(w).withColumn("equal", F.col("clusters_weight") == F.col("split_weight"))


@query(A.sql("SELECT 'raw' AS graph, count(*) AS edges, sum(raw_weight) AS total FROM raw UNION ALL SELECT 'ssa', count(*), sum(g_ssa_weight) FROM ssa", *SSA))
def met05_graph_totals(s, d):
    one = lambda df, name, w: df.agg(F.lit(name).alias("graph"), F.count("*").alias("edges"), F.sum(w).alias("total"))
    return one(raw(s, d), "raw", "raw_weight").union(one(ssa(s, d), "ssa", "g_ssa_weight"))


@query()
def met05_smoke_row(s, d):
    return rounded(R.smoke_metrics(A.nodes(s, d), raw(s, d), ssa(s, d), A.labels(s, d), A.labels_mod(s, d)))


SOL = "SELECT z.solution_id, z.class_count, z.cluster_count, z.largest, z.singletons, z.size_cv, internal_weight, total - internal_weight AS external_weight, (total - internal_weight) / total AS coupling, internal_weight / total AS internal_share, internal_weight / total - squares / (4 * total * total) AS weighted_modularity FROM (SELECT solution_id, CAST(sum(size) AS BIGINT) AS class_count, count(*) AS cluster_count, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS singletons, stddev_pop(size) / avg(size) AS size_cv FROM (SELECT solution_id, cluster_id, count(*) AS size FROM cand GROUP BY 1, 2) GROUP BY 1) z JOIN (SELECT solution_id, sum(i) AS internal_weight, sum(deg) / 2 AS total, sum(deg * deg) AS squares FROM (SELECT solution_id, c, sum(i) AS i, sum(w) AS deg FROM (SELECT solution_id, sc AS c, CASE WHEN sc = tc THEN w ELSE 0 END AS i, w FROM placed UNION ALL SELECT solution_id, tc, 0, w FROM placed) GROUP BY 1, 2) GROUP BY 1) m ON z.solution_id = m.solution_id"


@query(A.sql("SELECT solution_id, class_count, cluster_count, largest, singletons, round(size_cv, 6) AS size_cv, internal_weight, external_weight, round(coupling, 6) AS coupling, round(internal_share, 6) AS internal_share, round(weighted_modularity, 6) AS weighted_modularity FROM sol", *RAW, "cand", placed=PLACED, sol=SOL))
def met15_solution_rows(s, d):
    return rounded(R.solution_metrics(raw(s, d), A.candidates(s, d), "raw_weight"))


@query(A.sql("SELECT metric, raw, ssa, round(ssa - raw, 6) AS delta FROM (SELECT 'edges' AS metric, (SELECT count(*) FROM raw)::DOUBLE AS raw, (SELECT count(*) FROM ssa)::DOUBLE AS ssa UNION ALL SELECT 'total', (SELECT sum(raw_weight) FROM raw), (SELECT sum(g_ssa_weight) FROM ssa))", *SSA))
def met18_deltas(s, d):
    one = lambda df, w: df.agg(F.count("*").alias("edges"), F.sum(w).alias("total"))
    return rounded(R.metric_deltas(one(raw(s, d), "raw_weight"), one(ssa(s, d), "g_ssa_weight"), ("edges", "total")))


@query(A.sql("SELECT round(count(*) FILTER (WHERE x IS DISTINCT FROM y) * 1.0::DOUBLE / count(*), 6) AS change_fraction FROM (SELECT n.class_id, coalesce(a.v, '') AS x, coalesce(b.v, '') AS y FROM nodes n LEFT JOIN (SELECT node, string_agg(o, ';' ORDER BY o) AS v FROM (SELECT source AS node, target AS o FROM raw UNION ALL SELECT target, source FROM raw) GROUP BY 1) a ON n.class_id = a.node LEFT JOIN (SELECT node, string_agg(o, ';' ORDER BY o) AS v FROM (SELECT source AS node, target AS o FROM ssa UNION ALL SELECT target, source FROM ssa) GROUP BY 1) b ON n.class_id = b.node)", *SSA, "nodes"))
def sim09_change_fraction(s, d):
    n = A.nodes(s, d)
    return rounded(M.change_fraction(M.edge_neighbours(n, raw(s, d)), M.edge_neighbours(n, ssa(s, d))))


@query()
def ref02_reference_row(s, d):
    return rounded(R.reference_metrics(A.labels(s, d), A.labels_mod(s, d)))


@query("SELECT round(coupling, 6) AS coupling, round(imbalance, 6) AS imbalance, name FROM (SELECT 0.0::DOUBLE AS coupling, 0.0::DOUBLE AS imbalance, 'one' AS name UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE, 'single')")
def obj07_fixed_partitions(s, d):
    n = A.nodes(s, d)
    one = n.select(F.lit("one").alias("solution_id"), "class_id", F.lit(0).alias("cluster_id"))
    single = n.select(F.lit("single"), "class_id", F.col("class_id").cast("int"))
    return rounded(P.structural_objectives(raw(s, d), one.union(single), "raw_weight").select("coupling", "imbalance", F.col("solution_id").alias("name")))


@query(A.sql("SELECT o.solution_id, round(o.coupling, 6) AS coupling, round(o.cohesion, 6) AS cohesion, round(o.imbalance, 6) AS imbalance, round(1 - coalesce(w, 0) / (SELECT sum(weight) FROM sem), 6) AS f_semantic FROM o LEFT JOIN (SELECT a.solution_id, sum(weight) AS w FROM sem JOIN cand a ON class_id_a = a.class_id JOIN cand b ON class_id_b = b.class_id AND a.solution_id = b.solution_id AND a.cluster_id = b.cluster_id GROUP BY 1) q ON o.solution_id = q.solution_id", *RAW, "flows", "flow", "cand", placed=PLACED, o=OBJ, sem=SEM))
def obj06_four_objectives(s, d):
    c = A.candidates(s, d)
    return rounded(P.structural_objectives(raw(s, d), c, "raw_weight").join(P.semantic_objective(semantic(s, d), c), "solution_id"))


@query(A.sql("SELECT sum(weight) AS total_weight FROM sem", "flows", "flow", sem=SEM))
def obj04_semantic_total(s, d):
    return P.semantic_total(semantic(s, d))


@query(A.sql("SELECT run, count(*) AS pairs, count(*) FILTER (WHERE ac <= bc AND ai <= bi AND (ac < bc OR ai < bi)) AS exact, count(*) FILTER (WHERE ac <= bc + 5 AND ai <= bi + 5 AND (ac < bc - 5 OR ai < bi - 5)) AS tolerant FROM (SELECT a.run, a.coupling AS ac, a.imbalance AS ai, b.coupling AS bc, b.imbalance AS bi FROM front a JOIN front b ON a.run = b.run AND b.solution_id < a.solution_id) GROUP BY 1", "front"))
def dom03_predicates(s, d):
    return N.dominance_counts(A.front(s, d), "run", "solution_id", FRONT3[:2], {"exact": 0.0, "tolerant": 5.0})


@query("SELECT p_partkey, p_size - 30 <= 0 AND p_retailprice - 1500 <= 0 AS feasible FROM part")
def dom04_feasible_mask(s, d):
    g = F.array(F.col("p_size") - 30.0, F.col("p_retailprice") - 1500.0)
    return A.table(s, d, "part").select("p_partkey", F.forall(g, lambda x: x <= 0).alias("feasible"))


@query(A.sql("SELECT run, count(DISTINCT (coupling, imbalance)) AS vectors, count(DISTINCT solution_id) AS solutions FROM front GROUP BY 1", "front"))
def dom07_distinct_vectors(s, d):
    return A.front(s, d).groupBy("run").agg(F.countDistinct("coupling", "imbalance").alias("vectors"), F.countDistinct("solution_id").alias("solutions"))


@query(A.sql("SELECT run, solution_id, round((b - coupling) / abs(b), 6) AS gain FROM (SELECT *, max(coupling) OVER (PARTITION BY run) AS b FROM front)", "front"))
def sel11_relative_gain(s, d):
    from pyspark.sql import Window

    f = A.front(s, d).withColumn("b", F.max("coupling").over(Window.partitionBy("run")))
    return rounded(f.select("run", "solution_id", S.relative_gain(F.col("b"), F.col("coupling")).alias("gain")))


@query(A.sql("SELECT f.run, f.solution_id, round(f.coupling - b.coupling, 6) AS delta_coupling, round(f.imbalance - b.imbalance, 6) AS delta_imbalance FROM front f LEFT JOIN (SELECT run, avg(coupling) AS coupling, avg(imbalance) AS imbalance FROM front GROUP BY 1) b ON f.run = b.run", "front"))
def sel14_against_baseline(s, d):
    f = A.front(s, d).select("run", "solution_id", "coupling", "imbalance")
    base = f.groupBy("run").agg(F.avg("coupling").alias("coupling"), F.avg("imbalance").alias("imbalance"))
    return rounded(R.against_baseline(f, base, ("coupling", "imbalance"), "run").drop("coupling", "imbalance"))


@query(A.sql("SELECT stage, round(mean, 6) AS mean, round(median, 6) AS median, event_type FROM (SELECT event_type, 'stage_a' AS stage, avg(\"left\") AS mean, median(\"left\") AS median FROM pairs GROUP BY 1 UNION ALL SELECT event_type, 'stage_b', avg(\"right\"), median(\"right\") FROM pairs GROUP BY 1)", "pairs"))
def stat10_stage_rows(s, d):
    wide = A.pairs(s, d).groupBy("event_type").agg(*(f(c).alias(f"{p}_{n}") for c, p in (("left", "a"), ("right", "b")) for n, f in (("mean", F.avg), ("median", F.median))))
    return rounded(T.stage_rows(wide, ("event_type",), {"stage_a": "a", "stage_b": "b"}))


@query(A.sql("SELECT event_type, bucket, CASE WHEN same THEN 0 ELSE round(d, 6) END::DOUBLE AS delta, CASE WHEN same THEN 'same_partition' WHEN abs(d) <= 1e-12 THEN 'tiny' ELSE 'changed' END AS reason FROM (SELECT *, bucket % 4 = 0 AS same, CASE WHEN bucket % 4 = 0 THEN 0 ELSE \"right\" - \"left\" END AS d FROM pairs WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL)", "pairs"))
def stat21_snapped_delta(s, d):
    same = F.col("bucket") % 4 == 0
    p = A.pairs(s, d).where("left IS NOT NULL AND right IS NOT NULL").withColumn("d", F.when(same, 0.0).otherwise(F.col("right") - F.col("left")))
    value, reason = T.snapped_delta(F.col("d"), same)
    return rounded(p.select("event_type", "bucket", value.alias("delta"), reason.alias("reason")))


@query(A.sql("SELECT count(*) AS eligible, round(avg(CASE WHEN a.cluster_id = b.cluster_id THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS mapped_ratio FROM sem JOIN half a ON class_id_a = a.class_id JOIN half b ON class_id_b = b.class_id", "flows", "flow", "l", sem=SEM, half="SELECT * FROM l WHERE CAST(class_id AS INTEGER) % 4 <> 0"))
def stat25_mapped_ratio(s, d):
    return rounded(R.mapped_ratio(semantic(s, d), A.labels(s, d).where("CAST(class_id AS INT) % 4 <> 0")))


@query()
def stat26_pass_rule(s, d):
    k = np.array([r[0] for r in A.labels(s, d).orderBy("class_id").select("cluster_id").toLocalIterator()])
    edges = semantic(s, d)
    p95 = T.quantile_higher(T.random_baseline(s, k, edges.count()), "mapped_ratio", 0.95)
    return R.mapped_ratio(edges, A.labels(s, d)).crossJoin(p95).withColumn("passes", F.col("mapped_ratio") > F.col("quantile"))


@query(A.sql("SELECT lang, count(*) AS classes, count(*) FILTER (WHERE n > 300) AS capped, CAST(sum(greatest(n - 300, 0)) AS BIGINT) AS removed, coalesce(string_agg(class_id, ';' ORDER BY class_id) FILTER (WHERE n > 300), '') AS capped_ids FROM (SELECT class_id, lang, len(string_split(text, ' ')) AS n FROM texts) GROUP BY 1", "texts"))
def txt09_control_summary(s, d):
    n = F.size(F.split("text", " "))
    return Z.control_summary(A.texts(s, d).select("class_id", "lang", F.greatest(n - 300, F.lit(0)).cast("long").alias("tokens_truncated")), ("lang",))


@query(A.sql("SELECT sha256(string_agg(source || ',' || target || chr(9) || CAST(CAST(raw_weight AS BIGINT) AS VARCHAR) || chr(10), '' ORDER BY source || ',' || target)) AS aggregate_sha256 FROM raw", *RAW))
def hsh03_graph_hash(s, d):
    e = raw(s, d).select(F.concat_ws(",", "source", "target").alias("pair"), F.col("raw_weight").cast("long").cast("string").alias("weight"))
    return Z.aggregate_hash(e, "pair", "weight")


@query(A.sql("SELECT run, count(*) AS n, round(corr(x, y), 6) AS rho, NULL::VARCHAR AS reason FROM (SELECT run, rank() OVER (PARTITION BY run ORDER BY coupling) + (count(*) OVER (PARTITION BY run, coupling) - 1) / 2.0 AS x, rank() OVER (PARTITION BY run ORDER BY imbalance) + (count(*) OVER (PARTITION BY run, imbalance) - 1) / 2.0 AS y FROM front) GROUP BY 1", "front"))
def res02_front_spearman(s, d):
    return rounded(T.spearman(A.front(s, d), "coupling", "imbalance", ("run",)))


@query(A.sql("SELECT event_type, count(*) AS pairs, count(*) FILTER (WHERE d > 0) AS better, count(*) FILTER (WHERE d = 0) AS tie, count(*) FILTER (WHERE d < 0) AS worse FROM (SELECT event_type, \"right\" - \"left\" AS d FROM pairs) WHERE d IS NOT NULL GROUP BY 1", "pairs"))
def res05_wins(s, d):
    return T.better_tie_worse(A.pairs(s, d), ("event_type",), False)


@query(A.sql("SELECT e.*, mean_degree, max_degree, isolated, overlap, structural, round(overlap * 1.0::DOUBLE / (edges + structural - overlap), 6) AS edge_jaccard FROM (SELECT count(*) AS edges, round(avg(weight), 6) AS mean_weight, round(median(weight), 6) AS median_weight FROM sem) e, (SELECT round(avg(n), 6) AS mean_degree, max(n) AS max_degree, count(*) FILTER (WHERE n = 0) AS isolated FROM (SELECT class_id, count(node) AS n FROM nodes LEFT JOIN (SELECT class_id_a AS node FROM sem UNION ALL SELECT class_id_b FROM sem) ON class_id = node GROUP BY 1)), (SELECT count(*) AS overlap FROM sem JOIN raw ON class_id_a = source AND class_id_b = target), (SELECT count(*) AS structural FROM raw)", *RAW, "flows", "flow", "nodes", sem=SEM))
def res06_graph_quality(s, d):
    return rounded(R.graph_quality(A.nodes(s, d), semantic(s, d), raw(s, d)))


@query(A.sql("SELECT x.class_id AS a, y.class_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM vec x JOIN vec y ON x.class_id <> y.class_id AND CAST(x.class_id AS BIGINT) % 100 = 0", "vec"))
def vec02_cosine(s, d):
    v = A.vectors(s, d).select("class_id", "embedding")
    return rounded(E.cosines(v.where("CAST(class_id AS BIGINT) % 100 = 0"), v))


@query()
def vec06_canonical_weights(s, d):
    return E.canonical_weights(E.semantic_graph(A.vectors(s, d))).select("class_id_a", "class_id_b", "weight_text")


@query()
def clu03_strongest_edges(s, d):
    params = s.createDataFrame([(4,), (8,), (12,)], "groups long")

    def run(ids, g, p):
        return pd.DataFrame({"groups": int(p["groups"]), "class_id": ids, "cluster_id": X.grouping_labels(g, int(p["groups"])).astype("int32")})

    return X.per_run(A.nodes(s, d), raw(s, d), "raw_weight", params, ["groups"], run, "groups long, class_id string, cluster_id int", by_ends=False)


@query()
def clu04_sweep(s, d):
    """Modularity of Leiden over a grid of resolutions and seeds."""
    params = s.createDataFrame([(r / 10, seed) for r in (6, 10, 14) for seed in (0, 1)], "resolution double, seed long")
    found = Y.leiden_runs(A.nodes(s, d), ssa(s, d), "g_ssa_weight", params, unique=True)
    named = found.withColumn("solution_id", F.concat_ws(":", "resolution", "seed"))
    return rounded(R.solution_metrics(ssa(s, d), named, "g_ssa_weight"))


@query()
def clu05_seed_stability(s, d):
    params = s.createDataFrame([(1.0, k) for k in range(30)], "resolution double, seed long")

    def of(graph, edges, weight):
        return C.stability(C.all_pairs(Y.leiden_runs(A.nodes(s, d), edges, weight, params, unique=True), "seed")).withColumn("graph", F.lit(graph))

    return rounded(of("raw", raw(s, d), "raw_weight").union(of("ssa", ssa(s, d), "g_ssa_weight")))


@query()
def evo13_seeds(s, d):
    params = s.createDataFrame([(0,), (1,)], "seed long")

    def run(ids, g, p):
        rows = X.seeds(g, X.leiden(g, seed=int(p["seed"])), int(p["seed"]))
        return pd.DataFrame({"seed": int(p["seed"]), "name": [n for n, _ in rows], "clusters": [int(x.max()) + 1 for _, x in rows]})

    return X.per_run(A.nodes(s, d), raw(s, d), "raw_weight", params, ["seed"], run, "seed long, name string, clusters long")

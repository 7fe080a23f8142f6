"""Registered queries: comparisons of stages, profiles and runs; sources and sinks by round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import community as Y
from tessera.operators import fronts as P
from tessera.operators import partition as M
from tessera.operators import reports as R
from tessera.operators import search as X
from tessera.operators import selection as S
from tessera.operators import similarity as C
from tessera.operators import stats as T
from tessera.operators import studies as U
from tessera.operators import validate as V
from tessera.plans import adapters as A
from tessera.plans.catalog import ALL, CONT, DEG, LAB, NMI, OBJ, PAIRS, PART, PLACED, RAW, ROW, SEM, VEC, _profile_sql, query, raw, rounded, semantic
from tessera.plans.catalog_more import SOL
from tessera.sources import tables as I
from tessera.sources.shared import scratch_path

TWO = "SELECT 'stage1' AS solution_id, class_id, cluster_id FROM l UNION ALL SELECT 'stage2', class_id, cluster_id FROM r"
ARI = "(sn - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0))"
STAGE_COLUMNS = ", ".join(f"round({x}.{m}, 6)::{'DOUBLE' if m in ('coupling', 'internal_share', 'weighted_modularity') else 'BIGINT'} AS stage{k}_{m}" for k, x in ((1, "a"), (2, "b")) for m in U.STAGE_METRICS)


@query(A.sql(f"SELECT {STAGE_COLUMNS}, (SELECT round({ARI}, 6)::DOUBLE FROM w) AS ari, (SELECT round(({NMI}) / sqrt((ln(t) - la / t) * (ln(t) - lb / t)), 6) FROM w) AS nmi_geometric, (SELECT round(1 - coalesce(sum(n) FILTER (WHERE n = a AND n = b), 0) / sum(n), 6)::DOUBLE FROM cont) AS changed_ratio FROM sol a, sol b WHERE a.solution_id = 'stage1' AND b.solution_id = 'stage2'", *RAW, *CONT, cand=TWO, placed=PLACED, sol=SOL, w=ROW))
def met19_stage_summary(s, d):
    return rounded(U.stage_summary(raw(s, d), A.labels(s, d), A.labels_mod(s, d), "raw_weight"))


@query(A.sql("SELECT run, 'stage2' AS stage, solution_id, solution_id AS source_solution_id, row_number() OVER (PARTITION BY run ORDER BY solution_id) - 1 AS source_row, NULL::BIGINT AS four_row, weighted_modularity, coupling, imbalance, f_semantic, feasible FROM front UNION ALL SELECT run, 'stage3', 'p' || solution_id, solution_id, row_number() OVER (PARTITION BY run ORDER BY solution_id) - 1, four_row, weighted_modularity / 2, coupling, imbalance, f_semantic, feasible FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY solution_id) - 1 AS four_row FROM front) WHERE feasible", "front"))
def sel12_candidate_pool(s, d):
    f = A.front(s, d)
    own = f.withColumn("original_solution_id", F.col("solution_id")).withColumn("solution_id", F.concat(F.lit("p"), "solution_id"))
    projected = own.where("feasible").drop("weighted_modularity")
    return U.candidate_pool(f, f, projected, f, own.withColumn("weighted_modularity", F.col("weighted_modularity") / 2), ("run",))


@query()
def stat09_confirmatory_family(s, d):
    p = A.pairs(s, d).withColumnRenamed("event_type", "subject")
    back = p.select("subject", F.col("right").alias("left"), F.col("left").alias("right"))
    return rounded(U.confirmatory_family({"projected_hypervolume": (p, False), "selected_f_semantic": (back, True)}), 9)


@query(A.sql("SELECT least(ka % 4, kb % 4) AS left_profile, greatest(ka % 4, kb % 4) AS right_profile, count(*) AS n_pairs, count(*) FILTER (WHERE ari >= 1 - 1e-12) AS same_partitions, round(median(ari), 6)::DOUBLE AS median_ari, round(median(nmi_arithmetic), 6) AS median_nmi FROM (SELECT *, CAST(substr(i, 2) AS BIGINT) AS ka, CAST(substr(j, 2) AS BIGINT) AS kb FROM p) WHERE ka // 4 = kb // 4 GROUP BY 1, 2", "cand", all_=ALL, p=PAIRS))
def stat22_preference_similarity(s, d):
    k = F.expr("CAST(substr(solution_id, 2) AS BIGINT)")
    return rounded(U.preference_similarity(A.candidates(s, d).select((k % 4).alias("profile"), F.floor(k / 4).alias("seed"), "class_id", "cluster_id")))


QMAX = "SELECT *, max(weighted_modularity) OVER (PARTITION BY run) AS qm FROM front WHERE feasible"
PICKED = "SELECT pr.run, pr.profile_id, f.* EXCLUDE (run) FROM pr JOIN front f ON pr.run = f.run AND pr.solution_id = f.solution_id"


def _snapped(m):
    return f"round(median(CASE WHEN x.solution_id = b.solution_id OR abs(x.{m} - b.{m}) <= 1e-12 THEN 0 ELSE x.{m} - b.{m} END), 6)::DOUBLE AS median_delta_{m}"


@query(A.sql(f"SELECT x.profile_id, count(*) AS n_pairs, {', '.join(map(_snapped, ('weighted_modularity', 'coupling', 'imbalance')))} FROM picked x JOIN picked b ON x.run = b.run AND b.profile_id = 'P1' AND x.profile_id <> 'P1' GROUP BY 1", "front", q=QMAX, pr=_profile_sql(), picked=PICKED))
def stat22_preference_deltas(s, d):
    return rounded(U.preference_deltas(S.operating_profiles(A.front(s, d), ("run",)), ("weighted_modularity", "coupling", "imbalance"), "P1", ("run",)))


@query("SELECT field, count(*) FILTER (WHERE v IS NOT NULL AND v <> '') AS present, count(*) FILTER (WHERE v IS NULL OR v = '') AS missing, count(*) AS total FROM (SELECT 'text' AS field, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1")
def stat23_availability(s, d):
    return U.ordered_rows(U.availability(A.table(s, d, "documents"), ("text", "lang", "source")), ("field",))


BASE = "SELECT i, j, n, sum(n) OVER (PARTITION BY i, l) AS a, sum(n) OVER (PARTITION BY i, r) AS b FROM (SELECT x.solution_id AS i, 'base' AS j, x.cluster_id AS l, y.cluster_id AS r, count(*) AS n FROM cand x JOIN l y ON x.class_id = y.class_id GROUP BY 1, 2, 3, 4)"


@query(A.sql("SELECT o.solution_id, round(o.coupling, 6) AS coupling, round(o.cohesion, 6) AS cohesion, round(-o.cohesion, 6) AS negative_cohesion, round(o.imbalance, 6) AS imbalance, class_count, cluster_count, round(weighted_modularity, 6) AS weighted_modularity, round(ari, 6)::DOUBLE AS ari FROM o JOIN sol ON o.solution_id = sol.solution_id JOIN p ON o.solution_id = p.i", *RAW, "cand", "l", placed=PLACED, o=OBJ, sol=SOL, all_=BASE, p=PAIRS))
def dom10_front_tables(s, d):
    return rounded(U.front_tables(A.candidates(s, d), raw(s, d), "raw_weight", A.labels(s, d)))


@query(A.sql("SELECT o.solution_id, array_to_string(v, ',') AS x, round(coupling, 6) AS f0, round(-cohesion, 6) AS f1, round(imbalance, 6) AS f2, round(g0, 6)::DOUBLE AS g0, g1::DOUBLE AS g1 FROM o JOIN vec ON o.solution_id = vec.solution_id JOIN (SELECT solution_id, max(size) / sum(size) - 0.4 AS g0, 2 - count(*) AS g1 FROM (SELECT solution_id, cluster_id, count(*) AS size FROM cand GROUP BY 1, 2) GROUP BY 1) g ON o.solution_id = g.solution_id", *RAW, "cand", placed=PLACED, o=OBJ, vec=VEC))
def dom11_population_arrays(s, d):
    p = U.population_arrays(A.candidates(s, d), raw(s, d), "raw_weight")
    return rounded(p.select("solution_id", F.array_join("X", ",").alias("x"), *(F.col("F")[k].alias(f"f{k}") for k in range(3)), *(F.col("G")[k].alias(f"g{k}") for k in range(2))))


@query(A.sql("SELECT run, count(*) AS rows, count(*) AS kept, true AS same FROM front a WHERE NOT EXISTS (SELECT 1 FROM front b WHERE a.run = b.run AND b.coupling <= a.coupling AND b.imbalance <= a.imbalance AND (b.coupling < a.coupling OR b.imbalance < a.imbalance)) GROUP BY 1", "front"))
def hv06_front_check(s, d):
    saved = P.nondominated(A.front(s, d), ("coupling", "imbalance"), ("run",))
    volume = P.hypervolume_2d(saved, "coupling", "imbalance", (60.0, 2500.0), ("run",)).withColumnRenamed("hypervolume", "saved_hypervolume")
    return U.front_check(saved.join(volume, "run"), "coupling", "imbalance", (60.0, 2500.0), ("run",))


@query(A.sql("SELECT dependency_type AS channel, count(*) AS rows, '[' || CASE dependency_type WHEN 'type' THEN '1.0' ELSE '2.0' END || ']' AS observed, dependency_type = 'type' AS valid FROM deps GROUP BY 1", "deps"))
def val07_config_weights(s, d):
    return V.channel_weights(A.dependencies(s, d), "dependency_type", U.expected_weights({"expected_extracted_evidence_weights": {"call": 2.5}}))


@query(A.sql("SELECT false AS low_wrong, false AS coupling_high_wrong, false AS cohesion_high_wrong, false AS imbalance_high_wrong"))
def bnd04_schema(s, d):
    return U.bounds_faults(P.theoretical_bounds(A.nodes(s, d), raw(s, d)), raw(s, d))


@query("SELECT doc_id, lang AS representation_id, source AS experiment_id, CASE WHEN source IS NOT NULL AND source <> 'web' THEN 'experiment' ELSE 'representation' END AS fault FROM documents WHERE (source IS NOT NULL AND source <> 'web') OR lang IS DISTINCT FROM 'en'")
def hsh06_identity(s, d):
    t = A.table(s, d, "documents").select("doc_id", F.col("lang").alias("representation_id"), F.col("source").alias("experiment_id"))
    return U.identity_faults(t, "en", "web")


@query(A.sql("SELECT 'seed_variation' AS kind, i || '_vs_' || j AS comparison, round(ari, 6)::DOUBLE AS ari, round(1 - ari, 6)::DOUBLE AS distance FROM p", "cand", all_=ALL, p=PAIRS))
def viz06_robustness(s, d):
    return rounded(U.robustness_observations(C.all_pairs(A.candidates(s, d), "solution_id"), "seed_variation"))


@query(A.sql("SELECT profile_id, count(*) AS n, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM (SELECT profile_id, (m.qm - weighted_modularity) / m.qm AS v FROM picked JOIN (SELECT DISTINCT run, qm FROM q) m USING (run)) GROUP BY 1", "front", q=QMAX, pr=_profile_sql(), picked=PICKED))
def viz07_profile_sensitivity(s, d):
    picked = S.operating_profiles(A.front(s, d), ("run",))
    return rounded(U.profile_sensitivity(picked, (F.col("q_max") - F.col("weighted_modularity")) / F.col("q_max")))


@query()
def evo07_four_objectives(s, d):
    params = s.createDataFrame([(k,) for k in range(30)], "seed long")
    return X.nsga2_runs(A.nodes(s, d), raw(s, d), "raw_weight", params, semantic=semantic(s, d)).withColumn("label_vector", F.to_json("label_vector"))


@query("SELECT b.p_brand AS subject, k AS seed FROM (SELECT DISTINCT p_brand FROM part) b, range(0, 30) t(k) WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_brand = b.p_brand AND x.p_size = k)")
def evo14_pending_runs(s, d):
    p = A.table(s, d, "part").select(F.col("p_brand").alias("subject"), F.col("p_size").cast("long").alias("seed"))
    return X.pending_runs(p.select("subject").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29)))), p, ("subject", "seed"))


@query(A.sql("SELECT CAST(count(*) * 2 * 3 AS BIGINT) AS rows, 0::BIGINT AS differences FROM supplier"))
def evo15_same_seed(s, d):
    params = s.createDataFrame([(1.0, k) for k in range(3)], "resolution double, seed long")
    once = lambda: Y.leiden_runs(A.nodes(s, d), raw(s, d), "raw_weight", params, unique=True)
    return X.run_differences(once(), once())


# Sources and sinks


def _written(s, name, df):
    path = scratch_path(s, name)
    I.write_table(df, path, "csv")
    return path


def _nodes(s, d):
    return I.class_nodes(s, _written(s, "nodes", A.nodes(s, d).withColumn("class_file_path", F.concat("class_name", F.lit(".class")))))


@query(A.sql("SELECT *, class_name || '.class' AS class_file_path FROM nodes", "nodes"))
def src01_class_nodes(s, d):
    return _nodes(s, d)


@query(A.sql("SELECT source, target, dependency_type, count(*) AS rows, sum(weight) AS weight FROM deps GROUP BY 1, 2, 3", "deps"))
def src02_dependencies(s, d):
    path = _written(s, "dependencies", A.dependencies(s, d).withColumn("evidence_location", F.lit("a, \"b\"")))
    return I.structural_dependencies(s, path, _nodes(s, d)).groupBy("source", "target", "dependency_type").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))


@query(A.sql("SELECT source, target, flow_type, count(*) AS rows, sum(weight) AS weight FROM flows GROUP BY 1, 2, 3", "flows"))
def src03_flows(s, d):
    path = _written(s, "flows", A.flows(s, d).withColumn("evidence_statement", F.lit("r0 = r1")))
    return I.flow_edges(s, path, _nodes(s, d)).groupBy("source", "target", "flow_type").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))


@query(A.sql("SELECT 'nodes' AS part, count(*) AS rows FROM nodes UNION ALL SELECT 'dependencies', count(*) FROM deps UNION ALL SELECT 'flows', count(*) FROM flows", "nodes", "deps", "flows"))
def src04_subject(s, d):
    folder = scratch_path(s, "subject")
    I.write_table(A.nodes(s, d).withColumn("class_file_path", F.lit("x")), f"{folder}/class_nodes.csv", "csv")
    I.write_table(A.dependencies(s, d).withColumn("evidence_location", F.lit("x")), f"{folder}/structural_dependencies.csv", "csv")
    I.write_table(A.flows(s, d).withColumn("evidence_statement", F.lit("x")), f"{folder}/ssa_flow_edges.csv", "csv")
    out = None
    for name, df in I.extracted_subject(s, folder).items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT s_name AS class_name, 'service ' || s_nationkey AS reference_service FROM supplier")
def src08_reference_mapping(s, d):
    t = A.table(s, d, "supplier").select(F.concat(F.lit(" "), "s_name").alias("class_name"), F.concat(F.lit("service "), "s_nationkey", F.lit(" ")).alias("reference_service"))
    return I.reference_mapping(s, _written(s, "reference", t))


@query(A.sql("SELECT * FROM sem", "flows", "flow", sem=SEM))
def src09_semantic_edges(s, d):
    return I.semantic_edges(s, _written(s, "semantic", semantic(s, d).withColumn("selected_by", F.lit("both"))))


@query("SELECT p_partkey, p_retailprice / 7 AS price FROM part")
def src13_round_trip_floats(s, d):
    t = A.table(s, d, "part").select("p_partkey", (F.col("p_retailprice") / 7).alias("price"))
    return I.read_columns(s, _written(s, "floats", t), "p_partkey string, price string").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("price").cast("double").alias("price"))


def _local(path):
    """The sinks of single files write through the driver, to a folder of the file system that it shares."""
    return path.removeprefix("file:").replace("///", "/").replace("//", "/")


@query(A.sql("SELECT source, target, raw_weight FROM raw", *RAW))
def snk02_graphml(s, d):
    path = _local(scratch_path(s, "graph") + ".graphml")
    I.write_graphml(A.nodes(s, d), raw(s, d), path, "raw_weight")
    return I.read_graphml(s, path, "raw_weight")[1]


@query(A.sql("SELECT solution_id, class_id, cluster_id FROM cand", "cand"))
def snk03_xz_labels(s, d):
    path = scratch_path(s, "labels") + ".csv.xz"
    I.write_xz_csv(A.candidates(s, d).select("solution_id", "class_id", "cluster_id"), _local(path))
    return I.xz_csv(s, path, "solution_id string, class_id string, cluster_id bigint")


@query(A.sql("SELECT (SELECT cluster_id FROM part_ ORDER BY contribution DESC, cluster_id DESC LIMIT 1) AS highest, (SELECT cluster_id FROM part_ ORDER BY contribution, cluster_id LIMIT 1) AS lowest, (SELECT round(sum(contribution), 6) FROM part_) AS weighted_modularity", *LAB, deg=DEG, part_=PART))
def met17_extremes(s, d):
    return rounded(M.modularity_extremes(raw(s, d), A.labels(s, d), "raw_weight"))


@query("SELECT event_type, CASE WHEN low > 0 OR high < 0 THEN printf('difference %.3f stands out of the noise', mean) ELSE printf('difference %.3f is within the noise', mean) END AS verdict FROM (SELECT event_type, avg(value) AS mean, avg(value) - 2 * stddev_samp(value) AS low, avg(value) + 2 * stddev_samp(value) AS high FROM events GROUP BY 1)")
def stat16_verdict(s, d):
    return T.two_sigma(A.table(s, d, "events"), "value", ("event_type",)).select("event_type", R.verdict(F.col("mean"), F.col("low"), F.col("high")).alias("verdict"))


@query("SELECT 'names' AS name, 1::BIGINT AS files, true AS hashed, sum(length(s_name) + 1)::BIGINT AS bytes FROM supplier UNION ALL SELECT 'keys', 1, true, sum(length(CAST(s_suppkey AS VARCHAR)) + 1)::BIGINT FROM supplier")
def hsh05_inventory(s, d):
    """Two text tables of one file each, hashed where they lie."""
    folder, t = scratch_path(s, "inventory"), A.table(s, d, "supplier")
    for name, column in (("names", "s_name"), ("keys", "s_suppkey")):
        t.select(F.col(column).cast("string")).coalesce(1).write.text(f"{folder}/{name}")
    found = I.file_inventory(s, folder).where("path LIKE '%.txt'").withColumn("name", F.regexp_extract("path", "/(names|keys)/[^/]*$", 1))
    return found.groupBy("name").agg(F.count("*").alias("files"), F.bool_and(F.length("sha256") == 64).alias("hashed"), F.sum("bytes").alias("bytes"))

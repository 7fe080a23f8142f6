"""Operators on the six-class fixture, error contracts, brute force and properties."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import fronts as P
from tessera.operators import graph as G
from tessera.operators import partition as M
from tessera.operators import search as X
from tessera.operators import similarity as C
from tessera.operators import stats as T
from tessera.operators import text as Z
from tessera.operators import validate as V
from tests import local_matching as L
from tessera.sources import tables as S

NODES = "class_id,class_name,package,class_file_path\n" + "".join(f"{c},demo.{c},demo,{c}.class\n" for c in "ABCDEF")
DEPS = """source,target,dependency_type,weight,evidence_kind,evidence_location
A,B,type,1,field_type_reference,demo.A.fieldB
A,C,call,2,method_call,demo.A.callC
B,C,type,1,method_parameter_type_reference,demo.B.method
C,D,call,2,method_call,demo.C.callD
D,E,type,1,method_return_type_reference,demo.D.method
"""
FLOWS = """source,target,flow_type,weight,evidence_method,evidence_statement
B,D,return_value_flow,3,demo.A.method,r1
C,E,argument_passing_flow,3,demo.C.method,arg
"""


@pytest.fixture()
def folder(tmp_path):
    for name, text in (("class_nodes", NODES), ("structural_dependencies", DEPS), ("ssa_flow_edges", FLOWS)):
        (tmp_path / f"{name}.csv").write_text(text)
    return tmp_path


def test_fixture_sums(spark, folder):
    t = S.extracted_subject(spark, str(folder))
    raw = G.raw_edges(t["dependencies"])
    ssa = G.ssa_edges(raw, t["flows"])
    total = lambda df, c: df.agg({c: "sum"}).first()[0]
    assert (raw.count(), total(raw, "raw_weight"), ssa.count(), total(ssa, "g_ssa_weight")) == (5, 7.0, 7, 13.0)
    assert G.ssa_edges(raw, t["flows"], 0.0).count() == 5
    degrees = {r.class_id: r.degree for r in G.graph_nodes(t["nodes"], raw, "raw_weight").collect()}
    assert degrees["F"] == 0 and degrees["C"] == 3


@pytest.mark.parametrize(
    "name,old,new,message",
    [
        ("structural_dependencies", "A,B,type,1", "A,Z,type,1", "unknown classes"),
        ("structural_dependencies", "A,B,type,1", "A,B,type,-1", "not negative"),
        ("structural_dependencies", "A,B,type,1", "A,B,type,x", "numeric"),
        ("structural_dependencies", "A,C,call", "A,C,type", "differ"),
        ("structural_dependencies", "field_type_reference", "guess", "unknown evidence_kind"),
        ("structural_dependencies", "weight,evidence_kind", "w,evidence_kind", "missing columns"),
        ("ssa_flow_edges", "return_value_flow", "other_flow", "unknown flow_type"),
        ("class_nodes", "A,demo.A", ",demo.A", "missing values"),
    ],
)
def test_loader_errors(spark, folder, name, old, new, message):
    p = folder / f"{name}.csv"
    p.write_text(p.read_text().replace(old, new, 1))
    with pytest.raises(V.ValidationError, match=message):
        S.extracted_subject(spark, str(folder))


def test_raw_loader_needs_no_flows(spark, folder):
    (folder / "ssa_flow_edges.csv").unlink()
    assert set(S.extracted_subject(spark, str(folder), flows=False)) == {"nodes", "dependencies"}


def test_round_trips(spark, folder, tmp_path):
    t = S.extracted_subject(spark, str(folder))
    raw = G.raw_edges(t["dependencies"])
    S.write_graphml(t["nodes"], raw, str(tmp_path / "g.xml"), "raw_weight")
    n, e = S.read_graphml(spark, str(tmp_path / "g.xml"), "raw_weight")
    assert n.count() == 6 and sorted(map(tuple, e.collect())) == sorted(map(tuple, raw.select("source", "target", "raw_weight").collect()))
    S.write_xz_csv(raw, str(tmp_path / "e.csv.xz"))
    back = S.xz_csv(spark, str(tmp_path / "e.csv.xz"), "source string, target string, raw_weight double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    S.atomic_json(str(tmp_path / "a.json"), {"b": 1})
    with pytest.raises(V.ValidationError):
        S.write_or_check(str(tmp_path / "a.json"), b"other", check=True)
    assert S.replace_block("x<!-- BEGIN t -->old<!-- END t -->y", "t", "new") == "x<!-- BEGIN t -->\nnew\n<!-- END t -->y"
    assert S.lossless(0.1) == "0.10000000000000001"


def partitions(items):
    if not items:
        yield []
        return
    first, *rest = items
    for p in partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


def table(a, b):
    return np.array([[len(set(x) & set(y)) for y in b] for x in a])


def brute_mojo(a, b):
    """Fewest moves and joins from a to b by breadth-first search over partitions."""
    norm = lambda p: frozenset(frozenset(x) for x in p if x)
    goal, seen, now, steps = norm(b), {norm(a)}, {norm(a)}, 0
    while goal not in now:
        steps += 1
        nxt = set()
        for p in now:
            groups = [set(x) for x in p]
            for i, j in itertools.combinations(range(len(groups)), 2):
                nxt.add(norm([*(g for k, g in enumerate(groups) if k not in (i, j)), groups[i] | groups[j]]))
            for i, g in enumerate(groups):
                for x in g:
                    rest = [set(h) for h in groups]
                    rest[i].discard(x)
                    nxt.add(norm([*rest, {x}]))
                    for j in range(len(groups)):
                        if j != i:
                            moved = [set(h) for h in rest]
                            moved[j].add(x)
                            nxt.add(norm(moved))
        now = nxt - seen
        seen |= now
    return steps


def test_mojo_against_search():
    every = list(partitions(list("abcd")))
    assert len(every) == 15
    for a in every:
        for b in every:
            assert L.mojo_distance(table(a, b)) == brute_mojo(a, b), (a, b)
    for b in every:
        assert L.largest_mojo(np.array([len(x) for x in b])) == max(brute_mojo(a, b) for a in every)


def test_matching_and_assignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 5, 2))
        w = rng.integers(0, 9, (n, m))
        rows, cols = (range(n), range(m))
        best = max(sum(w[i, j] for i, j in zip(r, c, strict=True)) for k in [min(n, m)] for r in itertools.combinations(rows, k) for c in itertools.permutations(cols, k))
        assert sum(w[i, j] for i, j in C.assignment(w)) == best
        edges = [(i, j) for i in rows for j in cols if w[i, j] > 5]
        size = max(k for k in range(min(n, m) + 1) if any(all((i, j) in edges for i, j in zip(r, c, strict=True)) for r in itertools.combinations(rows, k) for c in itertools.permutations(cols, k)))
        assert L.largest_matching(edges) == size


def test_hypervolume_and_skyline():
    rng = np.random.default_rng(1)
    for d in (2, 3, 4):
        p = rng.integers(0, 6, (12, d)).astype(float)
        grid = np.array(list(itertools.product(*[np.arange(6) + 0.5] * d)))
        assert P.hypervolume(p, [6.0] * d) == pytest.approx((p[:, None] <= grid[None]).all(2).any(0).sum())
        keep = [not any((q <= x).all() and (q < x).any() for q in p) for x in p]
        assert P.local_skyline(p).tolist() == keep
    assert P.hypervolume(np.zeros((0, 3)), [1, 1, 1]) == 0


def test_imbalance_bound(spark):
    from pyspark.sql import functions as F

    for n in range(2, 13):
        top = max(1, math.floor(0.4 * n))
        best = 0.0
        def parts(left, most):
            if left == 0:
                yield []
            for k in range(min(left, most), 0, -1):
                for rest in parts(left - k, k):
                    yield [k, *rest]

        for sizes in parts(n, top):
            if len(sizes) >= 2:
                best = max(best, float(np.std(sizes) / np.mean(sizes)))
        got = spark.range(1).select(P.imbalance_bound(F.lit(n), F.lit(0.4))).first()[0]
        assert got == pytest.approx(best), n


def ring(k=4, size=8, seed=0):
    rng = np.random.default_rng(seed)
    s, t = [], []
    for c in range(k):
        for i, j in itertools.combinations(range(size), 2):
            if rng.random() < 0.7:
                s.append(c * size + i)
                t.append(c * size + j)
        s.append(c * size)
        t.append((c + 1) % k * size + 1)
    return X.Graph(k * size, np.array(s), np.array(t), np.ones(len(s)))


def test_leiden_properties():
    g = ring()
    a = X.leiden(g, seed=3)
    assert (a == X.leiden(g, seed=3)).all() and X.quality(g, a) > 0.6 and a.max() == 3
    assert X.quality(g, a) >= X.quality(g, np.arange(g.n))
    assert (X.canonical(X.connected_parts(g, a)) == a).all()
    assert X.leiden(X.Graph(3, np.array([], int), np.array([], int), np.array([])), seed=1).tolist() == [0, 1, 2]


def test_search_properties():
    g = ring(3, 6)
    start = [x for _, x in X.seeds(g, X.leiden(g, seed=0), 0)]
    xs, f = X.nsga2(g, start, 0, 20, 8)
    ys, h = X.nsga2(g, start, 0, 20, 8)
    assert (xs == ys).all() and (f == h).all()
    assert P.local_skyline(f).all() and len({x.tobytes() for x in xs}) == len(xs)
    for x in xs:
        assert np.bincount(x).max() <= 0.4 * g.n and x.max() >= 1 and (X.canonical(x) == x).all()
    assert np.bincount(X.strongest_edge_groups(g, 3, 6)).max() <= 6 and X.strongest_edge_groups(g, 3, 18).max() == 2


def test_modularity_closed_form(spark):
    g = ring(3, 5)
    labels = np.arange(g.n) % 4
    edges = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", 1.0) for a, b in zip(g.s.tolist(), g.t.tolist(), strict=True)], "source string, target string, raw_weight double")
    rows = spark.createDataFrame([(f"{i:02d}", f"n{i}", int(c)) for i, c in enumerate(labels)], "class_id string, class_name string, cluster_id int")
    assert M.modularity(edges, rows, "raw_weight").first()[0] == pytest.approx(X.quality(g, labels))
    one = C.similarity(rows, rows).first()
    assert one.ari == 1 and one.nmi_geometric == pytest.approx(1) and one.nmi_arithmetic == pytest.approx(1)
    flat = rows.limit(1)
    assert C.similarity(flat, flat).first().ari == 1
    assert M.modularity(edges.limit(0), rows, "raw_weight").first()[0] == 0


def test_wilcoxon_exact():
    rng = np.random.default_rng(2)
    for n in range(1, 9):
        w = float(rng.integers(0, n * (n + 1) // 2 + 1))
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        low = min(w, n * (n + 1) / 2 - w)
        want = min(1.0, 2 * sum(s <= low for s in sums) / 2**n)
        assert T.wilcoxon_p(n, w, n * (n + 1) / 2 - w, 0) == pytest.approx(want)
    assert T.wilcoxon_p(0, 0, 0, 0) == 1.0


def test_degenerate_rules(spark):
    pairs = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 3.0), ("b", None, 1.0)], "k string, left double, right double")
    r = T.signed_ranks(pairs, ("k",))
    got = {x.k: x for x in T.rank_biserial(r, 0.0).collect()}
    assert got["a"].rank_biserial == 0.0 and got["b"].rank_biserial == 1.0 and got["b"].pairs == 1
    assert {x.k: x.rank_biserial for x in T.rank_biserial(r, None).collect()}["a"] is None
    w = {x.k: x for x in T.wilcoxon(r).collect()}
    assert (w["a"].statistic, w["a"].p_value) == (0.0, 1.0)
    assert {x.k: x for x in T.wilcoxon(r, (math.nan, math.nan), 2).collect()}["b"].p_value is None


def test_text_rules(spark):
    from pyspark.sql import functions as F

    names = ["getHTTPServerName", "toString", "set_value", "isA", "r12", "parseXMLDoc2", "FOO_BAR.baz", "$tmp", "ünï"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.t for r in df.select("n", Z.clean_identifier(F.col("n")).alias("t")).collect()}
    assert got["getHTTPServerName"] == ["http", "server", "name"]
    assert [got[n] for n in names[1:]] == [["string"], ["value"], [], [], ["parse", "xml", "doc2"], ["foo", "bar", "baz"], [], []]
    lits = {"http://x.y": "url", "b": "length", " \t": "empty", "x" * 81: "length", "ab": "accepted", "urn:a": "namespace_uri", "/usr/bin": "path", "0123456789abcdef00": "hash", "12.5": "numeric_or_timestamp", "%%: {12}": "format_only", "warning": "boilerplate", "open the file": "accepted", "of the": "no_meaningful_tokens"}
    df = spark.createDataFrame([(k,) for k in lits], "v string")
    assert {r.v: r.c for r in df.select("v", Z.literal_class(F.col("v")).alias("c")).collect()} == lits


def test_method_bodies(spark):
    say = lambda name, body, concrete=True, synthetic=False: ("c", name, f"<com.example.Sample: void {name}()>", concrete, synthetic, body)

    def tokens(*methods):
        df = spark.createDataFrame(list(methods), "class_id string, method_name string, method_signature string, concrete boolean, synthetic boolean, body_text string")
        return Z.method_tokens(df).orderBy("method_name").collect()

    def one(name, body):
        (row,) = tokens(say(name, body))
        return list(row.tokens)

    call = "r0 = virtualinvoke r1.<com.shop.payment.PaymentService: java.lang.String authorize(java.lang.String)>(r2); r3 = (java.lang.String) r0; r4 = new com.shop.payment.PaymentService;"
    # name and called methods, then operations (new and return are keywords or their words are), then the rest
    assert one("authorizePayment", call) == ["authorize", "payment", "invoke", "create"]
    field = "r0 = r1.<com.shop.Order: java.lang.String paymentStatus>; if r0 == null goto label1; throw new java.io.IOException; label1: return;"
    assert one("validateOrder", field) == ["validate", "order", "branch", "jump", "create", "payment", "status", "io", "exception"]
    assert one("getCustomer", "$r0 = virtualinvoke $r1.<x.Y: void setValue(java.lang.String)>($r2);") == ["customer", "value", "invoke"]
    assert one("toString", "total = unitPrice + Tax") == ["string", "total", "unit", "price"]
    said = 'r0 = "validate cart"; r1 = "https://example.com"; r2 = "/Users/local/file"; r3 = "550e8400-e29b-41d4-a716-446655440000"; r4 = "2024-01-02"; r5 = "debug"; r6 = "AQIDBAUGBwgJCgsMDQ4PEA=="; r7 = "a &amp; big\\nsale";'
    assert one("parseCart", said) == ["parse", "cart", "validate", "big", "sale"]
    assert one("<init>", "r0 = new java.lang.StringBuilder;") == ["create"]
    assert one("<clinit>", "r0 = staticinvoke <x.Y: void initialize()>()") == ["initialize", "invoke"]
    assert one("toString", "<example.C: short type>\n$i1 = (int) $s0\ntableswitch($i1) { case 1: goto return 1; }") == ["string", "jump", "type", "s0"]
    assert tokens(say("a", "x = y", concrete=False), say("b", "x = y", synthetic=True)) == [] and one("run", None) == []
    twice = [say("zetaAction", "r0 = virtualinvoke r1.<x.Y: void saveOrder()>()" * 10), say("alphaAction", "r0 = virtualinvoke r1.<x.Y: void saveOrder()>()"), say("betaAction", "save(order)")]
    df = spark.createDataFrame(twice, "class_id string, method_name string, method_signature string, concrete boolean, synthetic boolean, body_text string")
    assert Z.class_tokens(Z.method_tokens(df)).first().text.split() == ["alpha", "action", "save", "order", "invoke", "beta", "action", "save", "order", "zeta", "invoke"]


def test_sections(spark):
    from pyspark.sql import functions as F

    declaration = "public class Sample {\n    void validate();\n}\n"
    df = spark.createDataFrame([(declaration, "validate cart"), (declaration, ""), (declaration, None)], "d string, b string")
    rows = df.select(Z.compose(F.col("d"), F.col("b")).alias("t")).withColumn("d", Z.declaration_of(F.col("t"))).collect()
    assert [r.t for r in rows] == [f"[DECLARATION]\n{declaration}[METHOD_BODY]\n{b}\n" for b in ("validate cart", "<EMPTY>", "<EMPTY>")]
    assert all(r.d == declaration for r in rows)
    for bad in ("x", "x\r\n", "[METHOD_BODY]\n"):
        with pytest.raises(Exception, match="line feed"):
            spark.createDataFrame([(bad,)], "d string").select(Z.compose(F.col("d"), F.lit("b"))).collect()


def test_mojo_of_nothing():
    import pandas as pd

    from tests.local_matching import mojo_fm

    assert mojo_fm(pd.DataFrame({"l": [], "r": [], "n": []})).mojofm[0] == 0.0
    assert mojo_fm(pd.DataFrame({"l": ["a"], "r": ["x"], "n": [1]})).mojofm[0] == 100.0


def test_groups_are_repaired():
    g = X.Graph(5, np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4]), np.array([5.0, 4.0, 3.0, 2.0]))
    for groups in (1, 2, 3):
        size = np.bincount(X.grouping_labels(g, groups))
        assert size.max() <= 2 and len(size) >= 2


def test_bootstrap_of_equal_rows(spark):
    """Equal rows are drawn apart: the interval of a mean of 400 coin flips is about 2 x 1.96 x 0.025 wide."""
    df = spark.createDataFrame([(float(i % 2),) for i in range(400)], "v double")
    low, high = T.bootstrap_mean(df, "v", 4000).select("low", "high").first()
    assert 0.07 < high - low < 0.13 and abs((low + high) / 2 - 0.5) < 0.02


def test_random_edges():
    e = T.random_edges(9, 20, 3)
    assert len({tuple(x) for x in e}) == 20 and (e[:, 0] < e[:, 1]).all() and e.max() < 9 and e.min() >= 0
    assert (e == T.random_edges(9, 20, 3)).all()
    full = T.random_edges(6, 15, 0)
    assert {tuple(x) for x in full} == set(itertools.combinations(range(6), 2))


def test_confirmatory_family(spark):
    from tessera.operators import studies as U

    rng = np.random.default_rng(5)
    rows = [(f"s{k}", float(a), float(a + rng.normal(k / 2, 1))) for k in range(3) for a in rng.normal(size=12)]
    df = spark.createDataFrame(rows, "subject string, left double, right double")
    back = df.selectExpr("subject", "right AS left", "left AS right")
    got = U.confirmatory_family({"up": (df, False), "down": (back, True)}).collect()
    assert len(got) == 6 and len({(r.subject, r.metric) for r in got}) == 6
    order = sorted(got, key=lambda r: (r.p_value, r.subject, r.metric))
    top = 0.0
    for i, r in enumerate(order):
        top = max(top, min(1.0, (6 - i) * r.p_value))
        assert abs(r.holm - top) < 1e-12 and r.significant == (top <= 0.05)
    by = {(r.subject, r.metric): r for r in got}
    for k in range(3):  # the same pairs the other way round
        a, b = by[f"s{k}", "up"], by[f"s{k}", "down"]
        assert (a.better, a.worse, a.p_value, a.rank_biserial) == (b.better, b.worse, b.p_value, -b.rank_biserial)


def test_four_objectives_and_reruns(spark):
    nodes = spark.createDataFrame([(f"c{i:02d}",) for i in range(12)], "class_id string")
    edges = spark.createDataFrame([(f"c{i:02d}", f"c{j:02d}", 1.0 + (i + j) % 3) for i in range(12) for j in range(i + 1, 12) if (i % 4 == j % 4) or j == i + 1], "source string, target string, w double")
    semantic = edges.where("w > 1").selectExpr("source AS class_id_a", "target AS class_id_b", "w AS weight")
    params = spark.createDataFrame([(0,), (1,)], "seed long")
    run = lambda: X.nsga2_runs(nodes, edges, "w", params, 12, 6, semantic)
    front = run().collect()
    assert X.run_differences(run(), run()).first().differences == 0
    sem = [(int(r.class_id_a[1:]), int(r.class_id_b[1:]), r.weight) for r in semantic.collect()]
    total = sum(w for *_, w in sem)
    for r in front:
        assert abs(r.f_semantic - (1 - sum(w for a, b, w in sem if r.label_vector[a] == r.label_vector[b]) / total)) < 1e-9
        better = [q for q in front if q.seed == r.seed and all(x <= y for x, y in zip((q.coupling, -q.cohesion, q.imbalance, q.f_semantic), (r.coupling, -r.cohesion, r.imbalance, r.f_semantic), strict=True)) and q.label_vector != r.label_vector]
        assert not any((q.coupling, q.cohesion, q.imbalance, q.f_semantic) != (r.coupling, r.cohesion, r.imbalance, r.f_semantic) for q in better)
    assert sorted(r.seed for r in X.pending_runs(params, spark.createDataFrame([(1,)], "seed long")).collect()) == [0]


def test_study_checks(spark):
    from tessera.operators import studies as U
    from tessera.operators.validate import ValidationError

    assert U.expected_weights({}) == U.ROW_WEIGHTS and U.expected_weights({"expected_extracted_evidence_weights": {"call": 5}})["call"] == 5.0
    for bad in ({"calls": 1}, {"call": -1}, {"call": True}, {"call": "2"}, {"call": float("nan")}, [1]):
        with pytest.raises(ValidationError):
            U.expected_weights({"expected_extracted_evidence_weights": bad})
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", None), (None, "x"), ("a", "y")], "representation_id string, experiment_id string")
    assert sorted(r.fault for r in U.identity_faults(rows, "a", "x").collect()) == ["experiment", "representation", "representation"]
    bounds = spark.createDataFrame([(0.0, 1.0, -3.0, 0.0, 0.0, 2.0), (0.0, 2.0, -4.0, 1.0, 0.0, 0.0)], "coupling_low double, coupling_high double, cohesion_low double, cohesion_high double, imbalance_low double, imbalance_high double")
    faults = U.bounds_faults(bounds, spark.createDataFrame([(3.0,)], "raw_weight double")).collect()
    assert not any(faults[0]) and all(faults[1])
    front = spark.createDataFrame([("r", "a", 1.0, 5.0, 7.0), ("r", "b", 2.0, 6.0, 7.0)], "run string, solution_id string, x double, y double, saved_hypervolume double")
    assert tuple(U.front_check(front, "x", "y", (10.0, 10.0), ("run",)).first()) == ("r", 2, 1, False)
    f = spark.createDataFrame([("r", "a", 0.5, 1.0, 1.0, 0.2, True)], "run string, solution_id string, weighted_modularity double, coupling double, imbalance double, f_semantic double, feasible boolean")
    lost = f.withColumnRenamed("solution_id", "original_solution_id").selectExpr("*", "'p' AS solution_id").drop("weighted_modularity")
    with pytest.raises(Exception, match="unmapped"):
        U.candidate_pool(f, f, lost, f, f, ("run",)).collect()


def test_provenance_helpers(spark, tmp_path):
    import hashlib

    from tessera.operators.validate import ValidationError
    from tessera.sources import tables as I

    assert I.contract_digest({"b": 1, "a": [2]}, ("a",)) == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()
    with pytest.raises(ValidationError, match="missing fields: c"):
        I.contract_digest({"a": 1}, ("a", "c"))
    assert I.same_manifest({"head": 1, "x": {"branch": "a", "y": 2}}, {"head": 2, "x": {"branch": "b", "y": 2}})
    assert not I.same_manifest({"x": 1}, {"x": 2})
    text = I.dot_graph([("b", "c", 2.5), ("a", "b", 1)], {"b": 'say "b"', "a": "A\\"})
    assert text == 'graph g {\n  "a" [label="A\\\\"];\n  "b" [label="say \\"b\\""];\n  "a" -- "b" [weight=1];\n  "b" -- "c" [weight=2.5];\n}\n'
    (tmp_path / "x.txt").write_bytes(b"abc")
    (row,) = I.file_inventory(spark, f"file://{tmp_path}").collect()
    assert (row.bytes, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_quotes_and_npy(spark, tmp_path):
    (tmp_path / "t.csv").write_text('b,a\n"x, ""y""",1\n"two\nlines",2\n')
    rows = S.read_columns(spark, str(tmp_path / "t.csv"), "a string, b string", lines=True).collect()
    assert sorted(tuple(r) for r in rows) == [("1", 'x, "y"'), ("2", "two\nlines")]
    m = np.arange(35, dtype=np.float32).reshape(7, 5)
    np.save(tmp_path / "m.npy", m)
    got = S.embeddings(spark, str(tmp_path / "m.npy"), 7, 5, block=3).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(7)) and [r["embedding"] for r in got] == m.tolist()
    with pytest.raises(V.ValidationError):
        S.embeddings(spark, str(tmp_path / "m.npy"), 8, 5)


def test_extraction_arguments():
    config = {"subject": "s", "project_root": "/p", "classes_dir": "c", "extracted_output_path": "o", "app_packages": ["a", "b"], "classpath_entries": ["x.jar"], "exclude_packages": ["a.t"]}
    assert S.extraction_arguments(config, "s") == ["--subject", "s", "--classes-dir", "/p/c", "--classpath", "/p/x.jar", "--app-packages", "a,b", "--exclude-packages", "a.t", "--out-dir", "o"]
    for bad in ({"subject": "t"}, {"app_packages": []}, {"classes_dir": " "}, {"classpath_entries": "x.jar"}):
        with pytest.raises(V.ValidationError):
            S.extraction_arguments(config | bad, "s")


def test_label_vector_of_another_length(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "class_id string")
    with pytest.raises(Exception, match="one label for each class"):
        M.cluster_by_class(nodes, spark.createDataFrame([("[0]",)], "label_vector string")).collect()

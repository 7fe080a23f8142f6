"""GraphML by tasks: values survive, and the driver holds no edge."""

from tessera.sources import tables as S


def test_round_trip_of_awkward_ids(spark, tmp_path):
    ids = ["a&b", 'q"<x>', " blank ", "null", "é", "tab\tline\nend", "&amp;"]
    nodes = spark.createDataFrame([(x,) for x in ids], "class_id string").repartition(3)
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in zip(zip(ids, ids[1:]), (0.1, 1e-300, 3.0, 1e22, 2.5, 1 / 3))], "source string, target string, w double").repartition(3)
    path = str(tmp_path / "g.graphml")
    S.write_graphml(nodes, edges, path, "w")
    n, e = S.read_graphml(spark, path, "w")
    assert sorted(n.collect()) == sorted(nodes.collect())
    assert sorted(e.collect()) == sorted(edges.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["g.graphml"]
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "FileScan xml" in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_is_xml_that_others_read(spark, tmp_path):
    import xml.etree.ElementTree as ET

    path = str(tmp_path / "g.graphml")
    S.write_graphml(spark.createDataFrame([("b&",), ("a",)], "class_id string"), spark.createDataFrame([("a", "b&", 2.0)], "source string, target string, w double"), path, "w")
    root = ET.parse(path).getroot()
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert [x.get("id") for x in root.iter(f"{ns}node")] == ["a", "b&"]
    assert [(x.get("source"), x.get("target"), x.find(f"{ns}data").text) for x in root.iter(f"{ns}edge")] == [("a", "b&", "2.0")]

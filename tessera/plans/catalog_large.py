"""Queries whose operators spread one run, one group or one order over many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import community as Y
from tessera.operators import fronts as P
from tessera.plans import adapters as A
from tessera.plans.catalog import query, rounded


def brand_stars(s, d):
    """Parts as a planted graph: each part hangs on the first part of its brand, and weakly on the part before it."""
    p = A.table(s, d, "part").select("p_partkey", "p_brand")
    hubs = p.groupBy("p_brand").agg(F.min("p_partkey").alias("hub"))
    strong = p.join(hubs, "p_brand").where("p_partkey <> hub").select(F.col("hub").alias("a"), F.col("p_partkey").alias("b"), F.lit(1.0).alias("weight"))
    weak = p.join(p.select((F.col("p_partkey") - 1).alias("b")), F.col("p_partkey") == F.col("b")).select(F.col("p_partkey").alias("a"), (F.col("b") + 1).alias("b"), F.lit(0.001).alias("weight"))
    edges = strong.union(weak).select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), "weight")
    return p.select(F.col("p_partkey").cast("string").alias("class_id")), edges


@query("SELECT CAST(p_partkey AS VARCHAR) AS class_id, dense_rank() OVER (ORDER BY lead) - 1 AS cluster_id FROM (SELECT p_partkey, min(CAST(p_partkey AS VARCHAR)) OVER (PARTITION BY p_brand) AS lead FROM part)")
def clu01_planted(s, d):
    nodes, edges = brand_stars(s, d)
    params = s.createDataFrame([(1.0, 42)], "resolution double, seed long")
    # by supersteps at every size
    return Y.leiden_runs(nodes, edges, "weight", params, at_once=0).select("class_id", F.col("cluster_id").cast("long").alias("cluster_id"))


WHOLE, CORNER = ("coupling", "cohesion", "f_semantic"), (60, 110, 80)
#: Volume of whole-number objectives: for each unit square of the first two, the height above the lowest third one that reaches it.
_CELLS = f"""
SELECT run, sum(height)::DOUBLE AS hypervolume FROM (
  SELECT f.run, i, j, {CORNER[2]} - min(f_semantic) AS height FROM front f, range(0, {CORNER[0]}) a(i), range(0, {CORNER[1]}) b(j)
  WHERE coupling <= i AND cohesion <= j AND f_semantic < {CORNER[2]} GROUP BY ALL
) GROUP BY 1
"""


@query(A.sql(_CELLS, "front"))
def hv01_whole_numbers(s, d):
    return rounded(P.hypervolumes(A.front(s, d), WHOLE, CORNER, "run"))


@query(A.sql(_CELLS, "front"))
def hv01_front_only(s, d):
    """The volume of a run's front is that of all its rows."""
    return rounded(P.hypervolumes(P.nondominated(A.front(s, d).select("run", *WHOLE), WHOLE, ("run",)), WHOLE, CORNER, "run"))

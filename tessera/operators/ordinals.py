"""Order over a whole table without one task for all of it: ordinals, running carries and nearest values by ranges.

Rows are range-partitioned and sorted; what a range needs from those before it (its first ordinal, the last value seen) comes from
one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Tables


def _ranged(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows in order of their ranges, with `_range` and the place `_at` in it; ranges are in the order of their numbers.

    A hash of the row comes last in the order, so that rows of one value, however many, spread over several ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [*order, F.xxhash64(*rows.columns)]
    dealt = rows.repartitionByRange(parts, *whole).sortWithinPartitions(*whole)
    # the id of a row is its partition above 33 bits of its place in it
    placed = dealt.withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def with_ordinal(rows: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """rows with their place in the whole order; equal rows of the order take places in no set order."""
    tables = Tables(rows.sparkSession, "ordinals")
    placed = tables.cut(_ranged(rows, order), "ranges")
    # a row a range, so as many as shuffle partitions
    counts = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=start)
    first = rows.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(counts, before, strict=False)], "_range int, _before long").coalesce(1)
    return placed.join(F.broadcast(first), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def with_carry(rows: DataFrame, order: Sequence[Column], value: str, below: str, above: str) -> DataFrame:
    """rows with the last non-null `value` at or before them, and the first at or after them, in the order.

    A range carries its own; where it has none yet, the nearest range before (or after) that has one gives its last (or first).
    """
    tables = Tables(rows.sparkSession, "carry")
    placed = tables.cut(_ranged(rows, order), "ranges")
    back = Window.partitionBy("_range").orderBy("_at")
    ahead = Window.partitionBy("_range").orderBy(F.desc("_at"))
    own = placed.withColumns({below: F.last(value, ignorenulls=True).over(back), above: F.last(value, ignorenulls=True).over(ahead)})
    # a row a range; max_by and min_by go over the rows that have a value
    has = F.when(F.col(value).isNotNull(), F.col("_at"))
    kind = placed.schema[value].dataType.simpleString()
    ends = placed.groupBy("_range").agg(F.max_by(value, has).alias("last"), F.min_by(value, has).alias("first")).orderBy("_range").collect()
    carried, last = {r["_range"]: [None, None] for r in ends}, None
    for r in ends:
        carried[r["_range"]][0] = last
        last = r["last"] if r["last"] is not None else last
    first = None
    for r in reversed(ends):
        carried[r["_range"]][1] = first
        first = r["first"] if r["first"] is not None else first
    side = rows.sparkSession.createDataFrame([(k, *v) for k, v in carried.items()], f"_range int, _below {kind}, _above {kind}").coalesce(1)
    joined = own.join(F.broadcast(side), "_range")
    return joined.withColumns({below: F.coalesce(below, "_below"), above: F.coalesce(above, "_above")}).drop("_range", "_at", "_below", "_above")


def with_prefix_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the same keys that stand before them in the order.

    Sums add up within ranges; a range takes what the keys' rows in earlier ranges sum to, of which there is a row a key and range.
    """
    keys = list(keys)
    tables = Tables(rows.sparkSession, "prefix")
    placed = tables.cut(_ranged(rows, [*(F.col(k) for k in keys), *order]), "ranges")
    within = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    totals = tables.cut(placed.groupBy("_range", *keys).agg(F.sum(value).alias("_total")), "totals")
    # a group's rows here are the ranges that it reaches into
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if keys else None
    if keys:
        before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
        before = before.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before")
        on = F.col("_range") == F.col("_r")
        for i, k in enumerate(keys):
            on = on & own[k].eqNullSafe(F.col(f"_k{i}"))
        joined = own.join(before, on).drop("_r", *(f"_k{i}" for i in range(len(keys))))
    else:
        sums = sorted((r["_range"], r["_total"]) for r in totals.collect())  # a row a range
        before = rows.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sums, accumulate((t for _, t in sums), initial=0), strict=False)], "_range int, _before long").coalesce(1)
        joined = own.join(F.broadcast(before), "_range")
    return joined.withColumn(name, F.col("_within") + F.col("_before")).drop("_range", "_at", "_within", "_before")

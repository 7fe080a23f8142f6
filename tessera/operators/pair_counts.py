"""How many pairs of a run's rows dominate one another, without a row a pair.

Rows take places in order and are packed into blocks. A block's task keeps, for each objective, the set of its rows below every rank as bits. A row of
an earlier block finds its bounds by binary search, and the rows that it is dominated by are the set bits of a few ANDs and ORs: 512 bytes for 4,096 pairs.
Blocks still meet in pairs, so work grows with the square of a run, at a small fraction of a nanosecond a pair, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_ordinal
from tessera.sources.shared import Tables

#: Bits of a place within a block.
BITS = 12


def _below(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values in order, and for each k the rows of the k smallest as bits."""
    order = np.argsort(values, kind="stable")
    sets = np.zeros((len(values) + 1, -(-len(values) // 64)), np.uint64)
    sets[np.arange(1, len(values) + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
    return values[order], np.bitwise_or.accumulate(sets, axis=0)


def block_counts(a_place: np.ndarray, a: np.ndarray, b_place: np.ndarray, b: np.ndarray, tolerances: Sequence[float]) -> list[int]:
    """For each tolerance, pairs of a row of a and an earlier row of b that it dominates; a and b: an objective a row of the array."""
    found = [_below(x) for x in a]
    places, up_to = _below(a_place)
    later = up_to[-1] & ~up_to[np.searchsorted(places, b_place, side="right")]
    out = []
    for t in tolerances:
        every, some = later, np.zeros_like(later)
        for (values, sets), x in zip(found, b, strict=True):
            every = every & sets[np.searchsorted(values, x + t, side="right")]
            some |= sets[np.searchsorted(values, x - t, side="left")]
        out.append(int(np.bitwise_count(every & some).sum()))
    return out


def dominance_counts(rows: DataFrame, key: str, order: str, objectives: Sequence[str], tolerances: dict[str, float]) -> DataFrame:
    """key, pairs, and for each named tolerance how many of the pairs (a row, one of smaller `order`) have the first dominate the second (`fronts.dominates`).

    Rows without a key or order are in no pair; those with a null objective are in pairs, but dominate nothing. Keys without a pair have no row.
    """
    tables = Tables(rows.sparkSession, "pair-counts")
    t = tables.cut(rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(objectives))), "rows")
    n = F.col("n").cast("decimal(38,0)")
    same = t.groupBy("k", "o").agg(F.count("*").alias("n"))
    pairs = same.groupBy("k").agg(((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).cast("long").alias("pairs")).where("pairs > 0")
    values = [f"v{i}" for i in range(len(objectives))]
    placed = with_ordinal(same.select("k", "o"), [F.col("k"), F.col("o")], "place").join(t.where(" AND ".join(f"{c} IS NOT NULL" for c in values)), ["k", "o"])
    # a place has a row for each repeat of its order, so blocks are cut by rows' own places
    seated = with_ordinal(placed.select("k", "place", *values), [F.col("k"), F.col("place")], "seat").withColumn("block", F.shiftright("seat", BITS))
    blocks = tables.cut(seated.groupBy("k", "block").agg(F.collect_list(F.struct("place", *values)).alias("rows")).select("k", "block", *(F.col("rows")[c].alias(c) for c in ("place", *values))), "blocks")
    last = blocks.groupBy("k").agg(F.max("block").alias("last"))
    sent = blocks.join(last, "k").select("k", F.explode(F.sequence("block", "last")).alias("block"), *(F.col(c).alias(f"b_{c}") for c in ("place", *values)))
    names = list(tolerances)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda r, side: (np.asarray(r[f"{side}place"]), np.array([r[f"{side}{c}"] for c in values], float))
        for p in batches:
            found = [block_counts(*of(r, ""), *of(r, "b_"), list(tolerances.values())) for r in p.to_dict("records")]
            yield pd.DataFrame(found, columns=names).assign(k=p["k"].to_numpy())

    kind = t.schema["k"].dataType.simpleString()
    counted = blocks.join(sent, ["k", "block"]).mapInPandas(run, ", ".join([*(f"`{x}` long" for x in names), f"k {kind}"]))
    sums = counted.groupBy("k").agg(*(F.sum(x).alias(x) for x in names))
    return pairs.join(sums, "k", "left").select(F.col("k").alias(key), "pairs", *(F.coalesce(x, F.lit(0)).alias(x) for x in names))

"""Quantiles and ranks of groups of any size: distinct values with their counts, and prefix sums of those by ranges.

Equal values fold into a row before anything is shuffled. A group's values then lie in as many ranges as they fill, and their
ranks follow from the sums of the ranges before, so no task holds a group or its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_prefix_sum


def matched(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left and right by their group columns, nulls being equal; without any, right has one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), *(c for c in right.columns if c not in by))
    on = F.lit(True)
    for i, b in enumerate(by):
        on = on & left[b].eqNullSafe(renamed[f"_b{i}"])
    return left.join(renamed, on, how).drop(*(f"_b{i}" for i in range(len(by))))


def ranked_values(rows: DataFrame, value: str, by: Sequence[str], *more: Column) -> DataFrame:
    """by, value, _n, _below, _total and further aggregates: each distinct value with its count, the count of smaller ones and the group's."""
    folded = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), *more)
    placed = with_prefix_sum(folded, by, [F.col(value)], "_n", "_below")
    return matched(placed, placed.groupBy(*by).agg(F.sum("_n").alias("_total")), by)


def average_ranks(ranked: DataFrame) -> DataFrame:
    """`_rank`: ties share the mean of their places."""
    return ranked.withColumn("_rank", F.col("_below") + (F.col("_n") + 1) / 2.0)


def held_at(place: Column) -> Column:
    """Does the distinct value of this row hold the place (from 0)?"""
    return (F.col("_below") <= place) & (place < F.col("_below") + F.col("_n"))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by and one column a share: exact, with linear interpolation between the two nearest places."""
    ranked = ranked_values(rows, value, by)
    columns = []
    for name, p in shares.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.max(F.when(held_at(F.floor(at)), F.col(value).cast("double"))), F.max(F.when(held_at(F.ceil(at)), F.col(value).cast("double")))
        share = F.max(at - F.floor(at))
        columns.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(name))
    return ranked.groupBy(*by).agg(*columns)


def element_at(rows: DataFrame, value: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """by and `quantile`: the element at ceil(p (n - 1)) in ascending order."""
    ranked = ranked_values(rows, value, by)
    return ranked.where(held_at(F.ceil(F.lit(float(p)) * (F.col("_total") - 1)))).select(*by, F.col(value).alias("quantile"))

"""Paired statistics, ranks, corrections and summaries. P-values come from Arrow UDFs on one row a test."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.order_stats import average_ranks, element_at, matched, quantiles, ranked_values


def describe(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, sample deviation and quartiles with linear interpolation."""
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    places = quantiles(df, value, {"median": 0.5, "q1": 0.25, "q3": 0.75}, by)
    return matched(sums, places, by, "left").select(*by, "n", "mean", "median", "std", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "min", "max")


def quantile_higher(df: DataFrame, value: str, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The element at ceil(p (n - 1)) in ascending order."""
    return element_at(df, value, p, by)


def average_rank(order: Column | str, by: tuple[str, ...] = ()) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by)
    peers = F.count("*").over(Window.partitionBy(*by, order))
    return F.rank().over(w.orderBy(order)) + (peers - 1) / 2.0


def signed_ranks(pairs: DataFrame, by: tuple[str, ...], close: float = 0.0) -> DataFrame:
    """n, sums of positive and negative ranks of non-zero differences, tie term; close: differences up to it count as zero."""
    d = pairs.withColumn("_d", F.col("right") - F.col("left")).where(F.col("_d").isNotNull() & (F.abs("_d") > close)).withColumn("_a", F.abs("_d"))
    r = average_ranks(ranked_values(d, "_a", by, F.count_if(F.col("_d") > 0).alias("_up")))
    t = F.col("_n").cast("double")
    found = r.groupBy(*by).agg(F.sum("_n").alias("nonzero"), F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum((F.col("_n") - F.col("_up")) * F.col("_rank")).alias("w_minus"), F.sum(t * (t * t - 1.0)).alias("ties"))
    every = pairs.groupBy(*by).agg(F.count_if(F.col("left").isNotNull() & F.col("right").isNotNull()).alias("pairs"))
    keep = matched(every, found, by, "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return keep.select(*by, "pairs", zero("nonzero", 0), zero("w_plus", 0.0), zero("w_minus", 0.0), zero("ties", 0.0))


def rank_biserial(ranks: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """(w_plus - w_minus) / their sum; without non-zero differences the given value (0, null or NaN)."""
    total = F.col("w_plus") + F.col("w_minus")
    return ranks.withColumn("rank_biserial", F.when(total == 0, F.lit(empty).cast("double")).otherwise((F.col("w_plus") - F.col("w_minus")) / F.when(total == 0, 1.0).otherwise(total)))


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def wilcoxon_p(n: int, w_plus: float, w_minus: float, ties: float) -> float:
    """Two-sided: exact up to 50 differences without ties, else normal with tie correction."""
    if n == 0:
        return 1.0
    low = min(w_plus, w_minus)
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(min(1.0, 2 * normal_tail(abs(low - n * (n + 1) / 4) / math.sqrt(var)))) if var > 0 else 1.0


def wilcoxon(ranks: DataFrame, degenerate: tuple[float, float] = (0.0, 1.0), least: int = 1) -> DataFrame:
    """statistic and p_value; fewer than `least` non-zero differences give the degenerate pair (NaN comes back as null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = [degenerate if n < least else (min(a, b), wilcoxon_p(int(n), a, b, s)) for n, a, b, s in zip(t.nonzero, t.w_plus, t.w_minus, t.ties, strict=True)]
            yield t.assign(statistic=[float(x[0]) for x in out], p_value=[float(x[1]) for x in out])

    return ranks.mapInPandas(run, ranks.withColumns({"statistic": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")}).schema)


def holm(tests: DataFrame, p: str = "p_value", by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Step-down adjustment: running maximum of (m - i) p, at most 1."""
    w = Window.partitionBy(*by)
    o = w.orderBy(p, *order)
    scaled = tests.withColumn("_s", (F.count("*").over(w) - F.row_number().over(o) + 1) * F.col(p))
    return scaled.withColumn("holm", F.least(F.lit(1.0), F.max("_s").over(o.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def bonferroni(tests: DataFrame, families: DataFrame, p: str = "p_value") -> DataFrame:
    return tests.join(families, "family").withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("size")))


def better_tie_worse(pairs: DataFrame, by: tuple[str, ...], lower_is_better: bool, tolerance: float = 0.0) -> DataFrame:
    d = F.col("right") - F.col("left")
    gain = -d if lower_is_better else d
    return pairs.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(gain > tolerance).alias("better"), F.count_if(F.abs(d) <= tolerance).alias("tie"), F.count_if(gain < -tolerance).alias("worse"))


def paired_summary(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    d = (F.col("right") - F.col("left")).alias("d")
    return pairs.select(*by, d).where("d IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.min("d").alias("min"), F.max("d").alias("max"))


def conditional_summary(df: DataFrame, value: str, condition: Column, by: tuple[str, ...]) -> DataFrame:
    v = F.when(condition, F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """rho with the reason where it is null."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(*by, x, y).agg(F.count("*").alias("_m"))
    places = lambda c, name: average_ranks(ranked_values(both, c, by)).select(*by, c, (F.col("_rank") - (F.col("_total") + 1) / 2.0).alias(name))  # noqa: E731  from the mean rank
    r = matched(matched(pairs, places(x, "_x"), [*by, x]), places(y, "_y"), [*by, y])
    mean = lambda e: F.sum(F.col("_m") * e) / F.sum("_m")
    s = r.groupBy(*by).agg(F.sum("_m").alias("n"), mean(F.col("_x") * F.col("_x")).alias("vx"), mean(F.col("_y") * F.col("_y")).alias("vy"), mean(F.col("_x") * F.col("_y")).alias("c"))
    flat = (F.col("vx") == 0) | (F.col("vy") == 0)
    return s.select(*by, "n", F.when((F.col("n") >= 2) & ~flat, F.col("c") / F.sqrt(F.when(flat, 1.0).otherwise(F.col("vx") * F.col("vy")))).alias("rho"), F.when(F.col("n") < 2, "too_few").when(flat, "constant").alias("reason"))


def mann_whitney(df: DataFrame, value: str, group: str, first: str, by: tuple[str, ...] = (), ranges: int = 64) -> DataFrame:
    """U of the first group and what its normal approximation needs (tie and continuity corrected z).

    Equal values fold into one row; ranks add up within value ranges, so that no task sorts a whole series.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    cuts = sorted(set(known.approxQuantile("_v", [k / ranges for k in range(1, ranges)], 0.005)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    folded = known.groupBy(*by, "_v").agg(F.count_if(F.col(group) == first).alias("_n"), F.count("*").alias("_t")).withColumn("_b", place)
    before = lambda c, *keys, order: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = folded.groupBy(*by, "_b").agg(F.sum("_t").alias("_s")).withColumn("_below", before("_s", *by, order="_b")).drop("_s")  # one row a range
    r = folded.withColumn("_within", before("_t", *by, "_b", order="_v")).join(whole, [*by, "_b"])
    rank = F.col("_below") + F.col("_within") + (F.col("_t") + 1) / 2
    t = F.col("_t").cast("double")
    s = r.groupBy(*by).agg(F.sum("_n").cast("double").alias("n1"), F.sum(F.col("_t") - F.col("_n")).cast("double").alias("n2"), F.sum(F.col("_n") * rank).alias("ranks"), F.sum(t * (t * t - 1.0)).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / F.greatest(n * (n - 1), F.lit(1.0)))
    z = F.when(var > 0, (F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5) / F.sqrt(F.when(var > 0, var).otherwise(1.0))).otherwise(0.0)
    return s.select(*by, "n1", "n2", u.alias("u"), z.alias("z"))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: min(1.0, 2 * normal_tail(abs(v))))


def transitions(df: DataFrame, value: str, order: str, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"before": F.lag(value).over(w), "changed": ~F.col(value).eqNullSafe(F.lag(value).over(w))}).where("before IS NOT NULL")


def relative_delta(base: Column, value: Column) -> Column:
    """Delta over the baseline's size; the plain delta where that is 0."""
    return F.when(base == 0, value - base).otherwise((value - base) / F.abs(F.when(base == 0, 1.0).otherwise(base)))


def snapped_delta(delta: Column, same: Column, tolerance: float = 1e-12) -> tuple[Column, Column]:
    """(delta, reason): 0 for the same partition or a tiny delta; a large one on the same partition is an error."""
    value = F.when(same & (F.abs(delta) > 1e-9), F.raise_error(F.lit("delta on an unchanged partition")).cast("double")).when(same | (F.abs(delta) <= tolerance), 0.0).otherwise(delta)
    return value, F.when(same, "same_partition").when(F.abs(delta) <= tolerance, "tiny").otherwise("changed")


def metric_summary(df: DataFrame, metrics: Sequence[str], by: tuple[str, ...]) -> DataFrame:
    long = df.unpivot(list(by), list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.count("value").alias("available"), F.count("*").alias("rows"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def stage_rows(summary: DataFrame, by: tuple[str, ...], stages: dict[str, str]) -> DataFrame:
    """Wide columns <prefix>_mean, <prefix>_median -> one row a stage."""
    parts = ", ".join(f"'{name}', {p}_mean, {p}_median" for name, p in stages.items())
    return summary.selectExpr(*by, f"stack({len(stages)}, {parts}) AS (stage, mean, median)")


def two_sigma(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    s = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - 2 * s).alias("low"), (F.avg(value) + 2 * s).alias("high"))


def random_edges(classes: int, edges: int, repetition: int, base: int = 0) -> np.ndarray:
    """Distinct pairs of a uniform G(n, m) graph, as row numbers (a < b)."""
    total = classes * (classes - 1) // 2
    pick = np.sort(np.random.default_rng(base + repetition).choice(total, size=edges, replace=False))
    a = (classes - 2 - np.floor(np.sqrt(-8.0 * pick + 4.0 * classes * (classes - 1) - 7) / 2.0 - 0.5)).astype(np.int64)
    b = pick + a + 1 - total + (classes - a) * ((classes - a) - 1) // 2
    return np.stack([a, b], 1)


def hypergeometric_cdf(total: int, good: int, draws: int) -> tuple[int, np.ndarray]:
    """(first k, P(X <= k) from there on) of the good ones among draws without replacement, for counts of any size.

    Values further from the mode than 15 standard deviations and 100 are left out; they have less than 1e-40 of the mass, far below the step of a double near 1.
    """
    low, high = max(0, draws - (total - good)), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    reach = math.ceil(15 * math.sqrt(draws * p * (1 - p) * (total - draws) / max(1, total - 1))) + 100
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high).astype(float)
    # log of P(k + 1) / P(k)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(float(total - good - draws) + k + 1)
    at = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.exp(at - at[mode - low])
    return low, np.cumsum(mass) / mass.sum()


class LabelSizes:
    """Labels of n classes, known by their sizes only: good pairs of classes share theirs."""

    def __init__(self, n: int, good: int):
        self.n, self.good = n, good

    def __len__(self) -> int:
        return self.n


def random_baseline(spark, labels: np.ndarray | LabelSizes, edges: int, repetitions: int = 1000, base: int = 0) -> DataFrame:
    """`random_shares` of the labels given."""
    if isinstance(labels, LabelSizes):
        return random_shares(spark, labels.n, labels.good, edges, repetitions, base)
    sizes = np.unique(np.asarray(labels), return_counts=True)[1]
    return random_shares(spark, len(labels), int((sizes * (sizes - 1) // 2).sum()), edges, repetitions, base)


def random_shares(spark, n: int, good: int, edges: int, repetitions: int = 1000, base: int = 0) -> DataFrame:
    """Share of edges within one label over random graphs of n classes, good pairs of which share theirs: one row a repetition.

    Of all pairs of classes, a uniform G(n, m) graph (`random_edges`) draws m without replacement, so its edges within a label are hypergeometric. A
    repetition draws that number by its distribution function, and no edge: memory and time don't grow with the edges of all graphs.
    """
    total = n * (n - 1) // 2
    if edges > total:
        raise ValueError(f"{edges} edges of {total} pairs")
    low, cdf = hypergeometric_cdf(total, good, edges) if edges else (0, np.ones(1))
    shared = spark.sparkContext.broadcast(cdf)  # a number for each likely count: 30 standard deviations of it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            u = np.array([np.random.default_rng(base + int(r)).random() for r in t["id"]])
            inside = low + np.minimum(np.searchsorted(shared.value, u, side="right"), len(shared.value) - 1)
            yield pd.DataFrame({"repetition": t["id"], "mapped_ratio": inside / edges if edges else None})

    return spark.range(repetitions).mapInPandas(run, "repetition long, mapped_ratio double")


def bootstrap_mean(df: DataFrame, value: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: one pass, partial sums for each resample.

    Equal values fold into one row with their number c first: their weights add up to a Poisson draw of mean c.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for t in batches:
            for h, v, c in zip(t["_h"], t["_v"], t["_c"], strict=True):
                k = np.random.default_rng([seed, int(h) & (2**64 - 1)]).poisson(float(c), resamples)
                total += k * v
                weight += k
        yield pd.DataFrame({"resample": np.arange(resamples), "total": total, "weight": weight})

    folded = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")).withColumn("_h", F.xxhash64("_v"))
    parts = folded.mapInPandas(run, "resample long, total double, weight double")
    means = parts.groupBy("resample").agg((F.sum("total") / F.greatest(F.sum("weight"), F.lit(1e-9))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.median("mean").alias("middle"), F.percentile("mean", F.lit(0.975)).alias("high"))

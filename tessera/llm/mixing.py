"""Mixing sources to target weights by cube-method balanced sampling.

Every document is taken floor(r) times, r being its source's target over its source's size, and once
more with probability r - floor(r). The extra copies are one balanced sample for each source: the
flight phase moves the inclusion probabilities through the null space of two constraints
(tokens and documents), three open units at a time, until at most two units of a block stay open.
Blocks hold a bounded number of documents, so a hot source is many blocks; the open units of all
blocks fly again in fewer blocks, level by level, until a source's rest fits one block. The landing then drops
the document constraint, and a last unit is rounded with its own probability.

Null or empty text has size 0 (its inclusion still counts as a document; it takes 0 words). Null source is a source of its own,
ordered last. Rows that are equal in doc_id, source and size are one unit with a multiplicity: its whole expected copies are sure,
the rest is one draw; so a doc_id that many rows repeat, or null, is no hot unit. Ties in a block go by size and unit name. Random numbers come
from a hash of source, level and block, so reruns agree. Very long texts count their words as a whole. An empty table gives an empty result. Only doc_id, source and text are read, so
other columns may have any names. Sources are ranked and their targets found on the executors; a table of one row a source is broadcast
only while it is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import slices, text_buffer, word_bounds
from tessera.llm.shared import Scratch, side

#: Weights by rank of the source, repeating.
CYCLE = (1, 2, 3)
#: A target is at most so many times its source's size.
CAP = 3.0
BLOCK = 4000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, at = text_buffer(batch.column(2))
            _, _, first = word_bounds(raw, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first).astype(np.int64))], ["doc_id", "source", "size"])


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text)."""
    return docs.select("doc_id", "source", "text").mapInArrow(_sizes, "doc_id long, source string, size long")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> with the number of their task and their place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], ["source", "source_size", "part", "place"])
        at += n


def source_targets(scratch: Scratch, sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight; what a capped source can't use goes to the rest by weight."""
    spark = scratch.spark
    per = scratch.cut(sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")), "sources")
    order = F.col("source").asc_nulls_last()
    placed = scratch.cut(per.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).mapInArrow(_place, "source string, source_size long, part int, place long"), "placed")
    starts, at = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):  # one row a task
        starts.append((r["part"], at))
        at += r["count"]
    rank = F.col("place") + F.col("start")
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (rank % len(CYCLE) + 1).cast("int"))
    weighted = scratch.cut(placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").select("source", "source_size", weight.alias("weight")), "weights")
    whole = weighted.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    unit, before = 0.0, None
    while whole["w"]:
        full = weighted.where(F.lit(unit) * F.col("weight") > F.lit(cap) * F.col("source_size")).agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first() if unit else {"n": 0, "w": 0}
        n, w = full["n"] or 0, full["w"] or 0
        if before == w or w == whole["w"]:
            break
        before, unit = w, (whole["n"] - cap * n) / (whole["w"] - w)  # grows, and so do the capped sources, until none is added
    share = F.lit(unit) * F.col("weight")
    return scratch.cut(weighted.select("source", "source_size", F.least(share, F.lit(cap) * F.col("source_size")).alias("target")), "targets")


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Cube method on one block: probabilities 0 or 1 but for two units at most (none with land)."""
    p = prob.astype(float).tolist()
    x = (size / max(1.0, float(size.mean()) if len(size) else 1.0)).tolist()
    u = rng.random(2 * len(p) + 8).tolist()
    open_: list[int] = []
    eps, k = 1e-9, 0
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # null vector of [[1, 1, 1], [xa, xb, xc]]
        v = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if v == (0.0, 0.0, 0.0):
            v = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) if d > 0 else p[i]) / abs(d) for i, d in zip(open_, v, strict=True) if d)
        down = min((p[i] if d > 0 else (1 - p[i])) / abs(d) for i, d in zip(open_, v, strict=True) if d)
        step = up if u[k] < down / (up + down) else -down
        k += 1
        for i, d in zip(open_, v, strict=True):
            p[i] += step * d
        open_ = [i for i in open_ if eps < p[i] < 1 - eps or p.__setitem__(i, float(round(p[i])))]
    if land:
        # tokens first: the pair moves along the token constraint alone
        while len(open_) > 1:
            a, b = open_[:2]
            v = (x[b], -x[a]) if x[a] and x[b] else (1.0, -1.0)
            up = min((1 - p[a]) / v[0], p[b] / -v[1])
            down = min(p[a] / v[0], (1 - p[b]) / -v[1])
            step = up if u[k] < down / (up + down) else -down
            k += 1
            p[a] += step * v[0]
            p[b] += step * v[1]
            open_ = [i for i in open_ if eps < p[i] < 1 - eps or p.__setitem__(i, float(round(p[i])))]
        for i in open_:
            p[i] = 1.0 if u[k] < p[i] else 0.0
            k += 1
    return np.array(p)


def _block(level: int, land: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "size", "unit"], kind="stable", na_position="last").reset_index(drop=True)
        seed = np.frombuffer(f"{key[0]}\x00{level}\x00{key[1]}\x00{len(rows)}".encode(), np.uint8).astype(np.uint32)
        rows["prob"] = flight(rows["prob"].to_numpy(), rows["size"].to_numpy(), np.random.default_rng(seed), land)
        return rows[["unit", "doc_id", "source", "size", "prob"]]

    return run


def _fly(df: DataFrame, n: DataFrame, level: int, land: bool) -> DataFrame:
    """One level: n has the number of blocks of each source."""
    keyed = df.join(side(n), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("unit", F.lit(level)), F.col("blocks")))
    return keyed.select("unit", "doc_id", "source", "size", "prob", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("k"), "block").groupBy("k", "block").applyInPandas(_block(level, land), "unit string, doc_id long, source string, size long, prob double")


def mix_sources(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    scratch = Scratch(spark, "mixing")
    sizes = scratch.cut(word_sizes(docs), "sizes")
    targets = source_targets(scratch, sizes).withColumnRenamed("source", "s")
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    whole = rows.join(side(targets), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(0.0)
    whole = whole.withColumn("r", r).withColumn("floor", F.floor(F.col("r") + 1e-12).cast("long")).withColumn("left", F.col("rows") * F.greatest(F.lit(0.0), F.col("r") - F.col("floor")))
    whole = whole.withColumn("sure", F.floor(F.col("left") + 1e-12).cast("long")).withColumn("prob", F.greatest(F.lit(0.0), F.col("left") - F.col("sure")))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    units = scratch.cut(whole.withColumn("unit", name).select("unit", "doc_id", "source", "size", "rows", "source_size", "target", "floor", "sure", "prob"), "units")
    scratch.drop(sizes)
    now, level, taken = units.select("unit", "doc_id", "source", "size", "prob"), 0, []
    while True:
        counts = scratch.cut(now.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
        last = (counts.agg(F.max("blocks")).first()[0] or 0) <= 1
        flown = scratch.cut(_fly(now, counts, level, last), f"level{level}")
        taken.append(flown.where("prob >= 1").select("unit", F.lit(1).alias("drawn")))
        if last:
            break
        now, level = flown.where("prob > 0 AND prob < 1"), level + 1
    drawn = taken[0]
    for x in taken[1:]:
        drawn = drawn.union(x)
    # a unit of several rows gives its extra copies to the first of them; equal rows are interchangeable
    each = units.join(drawn, "unit", "left").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    out = each.withColumn("copies", F.col("floor") + F.when(F.col("i") <= F.col("sure") + F.coalesce("drawn", F.lit(0)), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

"""Pareto fronts of runs of any size: local fronts, a grid of cells per run, and cells compared with those that aren't comparable.

1. Each task drops rows that its own rows dominate, batch by batch, with a window of bounded size.
2. What is left is cut into cells by quantiles of each objective. From the occupied cells of a run, a bounded number, follows which cells are dominated as a
   whole, and which other cells may hold a dominator of a cell's points.
3. A cell's points, in order of their sum (a dominator comes first), become blocks of a local front. A block of points is a unit of work: the blocks of
   its cell and of the cells that may dominate it stream past it. No task holds a run, and no cell meets a cell that is comparable to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Tables

#: Cells of a run's grid at most, slices of an objective, points of a block, and rows that a task's window of local fronts holds.
CELLS, SLICES, BLOCK, WINDOW = 1 << 15, 128, 1 << 13, 1 << 13
#: Largest local front of a run for which the rows of a run are compared in one join.
AT_ONCE = 1 << 12


def local_skyline(f: np.ndarray) -> np.ndarray:
    """Nondominated rows of a matrix; equal rows all stay."""
    u, back = np.unique(f, axis=0, return_inverse=True)  # in order of the first objective, so a dominator stands before
    keep, front, n = np.zeros(len(u), bool), np.empty((64, f.shape[1])), 0
    for i, x in enumerate(u):
        if not ((front[:n] <= x).all(1) & (front[:n] < x).any(1)).any():
            keep[i] = True
            if n == len(front):
                front = np.concatenate((front, np.empty_like(front)))
            front[n] = x
            n += 1
    return keep[back.reshape(-1)]


def dominated(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points does one of the others dominate?"""
    out = np.zeros(len(points), bool)
    others = others[(others <= points.max(0)).all(1)] if len(points) else others
    step = max(1, (1 << 21) // max(1, len(points)))
    for i in range(0, len(others), step):
        left = np.flatnonzero(~out)
        x, y = points[left, None], others[None, i : i + step]
        out[left] = ((y <= x).all(2) & (y < x).any(2)).any(1)
    return out


def pruned(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """rows without those that rows of the same task dominate, as far as its window goes."""
    columns, names = rows.columns, list(names)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for i in range(0, len(batch), WINDOW):
                part = batch.iloc[i : i + WINDOW]
                t = part if held is None else pd.concat([held, part], ignore_index=True)
                t = t.reset_index(drop=True)
                mask = np.zeros(len(t), bool)
                for at in t.groupby(list(keys), dropna=False, sort=False).indices.values() if keys else [np.arange(len(t))]:
                    mask[at] = local_skyline(t.iloc[at][names].to_numpy(float))
                held = t[mask][columns]
                if len(held) > WINDOW:  # fronts that don't shrink go on as they are
                    yield held
                    held = None
        if held is not None and len(held):
            yield held

    return rows.mapInPandas(prune, rows.schema)


def kept_cells(index: np.ndarray, low: np.ndarray, high: np.ndarray, grid: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Occupied cells (grid places, and the bounds of their points) that no cell dominates as a whole, and for each the kept cells that may hold dominators."""
    d = index.shape[1]
    taken = np.zeros((grid + 1,) * d, bool)
    taken[tuple(index.T + 1)] = True  # place 0 stays empty, so that a cell looks at those below it in all objectives
    for axis in range(d):
        np.logical_or.accumulate(taken, axis=axis, out=taken)
    keep = np.flatnonzero(~taken[tuple(index.T)])
    low, high = low[keep], high[keep]
    step, whole = max(1, (1 << 22) // max(1, len(keep))), np.zeros(len(keep), bool)
    for i in range(0, len(keep), step):
        x = low[i : i + step, None]
        whole[i : i + step] = ((high[None] <= x).all(2) & (high[None] < x).any(2)).any(1)
    keep, low, high = keep[~whole], low[~whole], high[~whole]
    partners = [np.flatnonzero((low <= h).all(1)) for h in high]
    return keep, partners


def _cell_plan(d: int, grid: int):
    names = [f"i{k}" for k in range(d)]

    def run(_, t: pd.DataFrame) -> pd.DataFrame:
        keep, partners = kept_cells(t[names].to_numpy(np.int64), t[[f"low{k}" for k in range(d)]].to_numpy(float), t[[f"high{k}" for k in range(d)]].to_numpy(float), grid)
        cell = t["cell"].to_numpy()[keep]
        return pd.DataFrame({"run": t["run"].iloc[0], "cell": np.repeat(cell, [len(p) for p in partners]), "other": cell[np.concatenate(partners)] if len(partners) else []})

    return run


def _fronts(d: int):
    """Points, sorted by run, cell and sum -> blocks of the cell's local front."""

    def out(run: str, cell: int, points: np.ndarray) -> pa.RecordBatch:
        blobs = [points[i : i + BLOCK].tobytes() for i in range(0, len(points), BLOCK)]
        cols = [pa.array([run] * len(blobs), pa.string()), pa.array([cell] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["run", "cell", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, front, fresh, first = None, np.empty((0, d)), [], np.empty((0, d))

        def settle() -> None:
            nonlocal front, fresh
            points = np.concatenate(fresh)
            points = points[~dominated(points, first)]  # the front's first block, which has the smallest sums
            front, fresh = np.concatenate((front, points[local_skyline(points)])), []

        for batch in batches:
            runs, cells = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            points = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(d)], 1)
            change = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1] or cells[i] != cells[i - 1]), len(runs)]
            for a, b in zip(change, change[1:], strict=False):
                if a == b:
                    continue
                key = (runs[a], int(cells[a]))
                if key != now:
                    if fresh:
                        settle()
                    if len(front):
                        yield out(*now, front)
                    now, front, fresh, first = key, np.empty((0, d)), [], np.empty((0, d))
                fresh.append(points[a:b])
                if sum(map(len, fresh)) >= BLOCK:
                    settle()
                    if not len(first):
                        first = front[:BLOCK]
                    if len(front) >= BLOCK:
                        yield out(*now, front)
                        front = np.empty((0, d))
        if fresh:
            settle()
        if len(front):
            yield out(*now, front)

    return run


def _compare(d: int):
    """Units, sorted by block and kind: the block itself, then blocks of possible dominators -> points that stay."""
    names = ["run", *(f"o{k}" for k in range(d))]

    def out(run: str, points: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([run] * len(points), pa.string()), *(pa.array(np.ascontiguousarray(points[:, k])) for k in range(d))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, of = None, None, None
        for batch in batches:
            for run_, block, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    if points is not None and len(points):
                        yield out(of, points)
                    now, of, points = block, run_, None
                given = np.frombuffer(blob, float).reshape(-1, d)
                if kind == 0:
                    points = given
                elif len(points):
                    points = points[~dominated(points, given)]
        if points is not None and len(points):
            yield out(of, points)

    return run


def grid_front(tables: Tables, vectors: DataFrame, d: int) -> DataFrame:
    """vectors (run string, o0, o1, ...), each once -> those that no vector of the same run dominates."""
    o = [f"o{k}" for k in range(d)]
    grid = min(SLICES, max(2, int(CELLS ** (1 / d))))
    cut = [k / grid for k in range(1, grid)]
    bounds = tables.cut(vectors.groupBy("run").agg(*(F.percentile_approx(c, cut, 10_000).alias(f"b_{c}") for c in o)), "bounds")
    place = [F.expr(f"CAST(size(filter(b_{c}, b -> b <= {c})) AS bigint)").alias(f"i{k}") for k, c in enumerate(o)]
    cell = sum((F.col(f"i{k}") * grid**k for k in range(d)), F.lit(0).cast("long"))
    placed = tables.cut(vectors.join(bounds, "run").select("run", *o, *place).withColumn("cell", cell), "placed")
    ends = [x for k, c in enumerate(o) for x in (F.min(c).alias(f"low{k}"), F.max(c).alias(f"high{k}"), F.first(f"i{k}").alias(f"i{k}"))]
    # at most CELLS rows a run
    plan = tables.cut(placed.groupBy("run", "cell").agg(*ends).groupBy("run").applyInPandas(_cell_plan(d, grid), "run string, cell long, other long"), "plan")
    total = sum((F.col(c) for c in o[1:]), F.col(o[0]))
    mine = placed.join(plan.select("run", "cell").distinct(), ["run", "cell"]).select("run", "cell", *o, total.alias("total"))
    sorted_ = mine.repartition("run", "cell").sortWithinPartitions("run", "cell", "total").drop("total")
    fronts = tables.cut(sorted_.mapInArrow(_fronts(d), "run string, cell long, blob binary").withColumn("block", F.monotonically_increasing_id()), "fronts")
    others = fronts.select("run", F.col("cell").alias("other"), F.col("blob").alias("theirs"))
    blocks = fronts.select("run", "cell", "block")
    met = blocks.join(plan, ["run", "cell"]).join(others.hint("merge"), ["run", "other"]).select("run", "block", F.lit(1).alias("kind"), F.col("theirs").alias("blob"))
    units = fronts.select("run", "block", F.lit(0).alias("kind"), "blob").union(met)
    return units.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_compare(d), ", ".join(["run string", *(f"{c} double" for c in o)]))


def skyline(rows: DataFrame, objectives: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows that no other row of the same run (keys) dominates, all objectives being minimised; equal rows all stay.

    A row with a null or NaN objective neither dominates nor is dominated.
    """
    names, keys, columns = list(objectives), list(keys), rows.columns
    tables = Tables(rows.sparkSession, "skyline")
    number = [F.col(c).cast("double") for c in names]
    whole = F.lit(True)
    for c in number:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    whole = F.coalesce(whole, F.lit(False))
    left = tables.cut(pruned(rows.where(whole), names, keys), "local")
    run = F.to_json(F.struct(*keys)) if keys else F.lit("")
    vectors = left.select(run.alias("run"), *((c + F.lit(0.0)).alias(f"o{k}") for k, c in enumerate(number))).distinct()
    largest = vectors.groupBy("run").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    o = [f"o{k}" for k in range(len(names))]
    if largest <= AT_ONCE:
        a, b = vectors.alias("a"), vectors.alias("b")
        on, less = F.col("a.run") == F.col("b.run"), F.lit(False)
        for c in o:
            on, less = on & (F.col(f"b.{c}") <= F.col(f"a.{c}")), less | (F.col(f"b.{c}") < F.col(f"a.{c}"))
        front = a.join(b, on & less, "left_anti")
    else:
        front = tables.cut(grid_front(tables, tables.cut(vectors, "vectors"), len(names)), "front")
    tagged = left.select("*", run.alias("_run"), *((c + F.lit(0.0)).alias(f"_{x}") for x, c in zip(o, number, strict=True)))
    on = F.col("_run") == front["run"]
    for x in o:
        on = on & (F.col(f"_{x}") == front[x])
    return tagged.join(front, on, "left_semi").select(*columns).union(rows.where(~whole))

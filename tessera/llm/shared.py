"""Tables in the folder that driver and executors share, and components of a graph."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local master gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder; each survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str = "part") -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "part", codec: str = "zstd") -> DataFrame:
        """Write df and read it back: the lineage ends here, and the size is known.

        zstd, not lz4_raw, whose pages Spark's own reader failed to decode on some data.
        """
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of plans that are done and no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows up to which a written table is broadcast; beyond, it is joined by merge.
BROADCAST_ROWS = 1 << 17


def side(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table as the small side of a join: with a broadcast hint only if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(blob, np.int64)
            sums[block] = sums[block] + got if block in sums else got
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "sums"])


def vector_rows(total: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A task's vector of whole numbers, cut in blocks, as rows for add_vectors."""
    rows = np.array_split(total.astype(np.int64), blocks)
    return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "sums"])


def add_vectors(parts: DataFrame, size: int, blocks: int, salts: int) -> np.ndarray:
    """Sum of the tasks' vectors of fixed size, added on the executors in two steps, so that no task reads all of them."""
    for salt in (salts, 1):
        parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salt))).repartition(blocks * salt, "block", "salt").select("block", "sums").mapInArrow(_add, "block int, sums binary")
    out = np.array_split(np.zeros(size, np.int64), blocks)
    for r in parts.collect():  # one row a block
        out[r["block"]] = np.frombuffer(bytes(r["sums"]), np.int64)
    return np.concatenate(out)


#: Edges that one task contracts at once.
CONTRACT = 1 << 21


def smallest_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) of an edge list that fits a task: hooking and pointer jumps."""
    nodes, back = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = back[: len(u)].copy(), back[len(u) :].copy()
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return nodes, nodes[label]


def pack_edges(node: np.ndarray, low: np.ndarray, most: int = 1 << 18) -> Iterator[bytes]:
    """Edges (node, low) but for loops, as blobs of at most so many."""
    keep = node != low
    pairs = np.stack([node[keep], low[keep]], 1)
    for i in range(0, len(pairs), most):
        yield pairs[i : i + most].tobytes()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, plain or packed -> stars of the forest that the rows of this task span; holds CONTRACT edges at a time."""

    def stars() -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        node, low = smallest_labels(u, v)
        keep = node != low
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        if batch.num_columns == 1:
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(b, np.int64).reshape(-1, 2) for b in batch.column(0).to_pylist())])
            held.append((pairs[:, 0], pairs[:, 1]))
        else:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        size += len(held[-1][0])
        if size >= 2 * CONTRACT:
            yield from stars()
            held, size = [], 0
    if held:
        yield from stars()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges, (u, v) or blobs of pack_edges; component is the smallest node reached.

    Tasks first contract their edges to stars. Edges of one task are then done; others go on with alternating large-star
    and small-star steps, whose minima are pre-aggregated and written before the join, so that AQE can split a hub's rows.
    """
    if edges.columns == ["blob"]:
        first = edges if hasattr(edges, "_scratch_path") else scratch.cut(edges, "edges")
        size = first.agg(F.sum(F.length("blob"))).first()[0] or 0
        size //= 16
    else:
        first = scratch.cut(edges.where("u <> v").select("u", "v"), "edges")
        size = first.count()
    tasks = max(1, -(-size // CONTRACT))
    now = scratch.cut(first.coalesce(tasks).mapInArrow(_contract, "u long, v long"), "stars")
    scratch.drop(first)
    seen = None
    while tasks > 1:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = scratch.cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        scratch.drop(now, low)
        low = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        kept = large.join(low, "u")
        step = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(kept.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.cut(step, "edges")
        scratch.drop(large, low)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Line dedup: range-partitioned line hashes, secondary sort, streamed runs, keep bitmaps.

Lines are keyed by the line stripped of `[\\x20\\x09-\\x0D]` and with A-Z lowered. The 128-bit hash
of a key with its document and position is range-partitioned on all three and sorted, so
even one very common line spreads over many tasks. Each task streams its sorted rows once: runs that
end inside an Arrow batch are decided there; the first and the last run of a batch go to
a boundary table of at most two rows a batch, which settles runs that cross batches and tasks.
What comes back is a zlib bitmap a document (bit = 1: the line goes), never text.

Null or empty text is one empty line. Null doc_id: its lines neither count nor go.
Rows that repeat a doc_id count as one document for the threshold. A row is known by its doc_id and the hash of its text,
so each row loses its own lines only, and equal rows lose the same. Ties: a line counts once a document, wherever it stands.
Very long texts are split as whole texts; their lines travel as hashes. An empty table gives an empty result. Only doc_id and text are read,
so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

#: White space stripped from both ends of a line.
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # bytes.lower() changes A-Z only


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h1", "h2", "doc_id", "row", "pos"]
    for batch in batches:
        hashes, docs, rows, places = bytearray(), [], [], []
        for doc, text, row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if doc is None or not text:
                continue
            for pos, line in enumerate(text.split(b"\n")):
                if key := line_key(line):
                    hashes += xxhash.xxh3_128_digest(key)
                    docs.append(doc)
                    rows.append(row)
                    places.append(pos)
        if docs:
            h = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], names)


_RUNS = "kind int, part long, piece int, h1 long, h2 long, doc_id long, row long, pos int, last_doc long, n_docs long"


def _emit(kind, part, piece, h1, h2, doc, row, pos, last, n) -> pa.RecordBatch:
    size = len(h1)
    cols = [np.full(size, kind, np.int32), np.full(size, part, np.int64), piece.astype(np.int32), h1, h2, doc, row, pos.astype(np.int32), last, n.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in _RUNS.split(", ")])


def _stream(min_docs: int):
    """Sorted rows -> lines to drop (kind 0), lines of runs at a batch's edge (1), records of those runs (2: a piece each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            h1, h2, doc, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(h1):
                continue
            new_key = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            begin = np.concatenate(([0], np.flatnonzero(new_key) + 1))
            end = np.concatenate((begin[1:], [len(h1)]))
            fresh = np.concatenate(([True], new_key | (doc[1:] != doc[:-1])))
            n_docs = np.add.reduceat(fresh.astype(np.int64), begin)
            edge = np.zeros(len(begin), bool)
            edge[[0, -1]] = True
            piece = np.repeat(np.cumsum(edge) - 1, end - begin)
            for kind, runs in ((0, ~edge & (n_docs >= min_docs)), (1, edge)):
                if (rows := np.repeat(runs, end - begin)).any():
                    yield _emit(kind, part, piece[rows], h1[rows], h2[rows], doc[rows], row[rows], pos[rows], doc[rows], np.zeros(int(rows.sum())))
            at = begin[edge]
            yield _emit(2, part, np.arange(len(at)), h1[at], h2[at], doc[at], row[at], pos[at], doc[end[edge] - 1], n_docs[edge])
            part += 1

    return run


def drop_marks(scratch: Scratch, docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, row, pos) of every line whose key stands in at least min_docs documents; row is the xxhash64 of the text."""
    lines = scratch.cut(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(_lines, "h1 long, h2 long, doc_id long, row long, pos int"), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc_id", "row", "pos"]
    runs = scratch.cut(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _RUNS), "runs")
    scratch.drop(lines)
    # a document that goes on from one piece to the next counts once
    pieces = runs.where("kind = 2").withColumn("before", F.lag("last_doc").over(Window.partitionBy("h1", "h2").orderBy("part", "piece")))
    common = pieces.groupBy("h1", "h2").agg(F.sum(F.col("n_docs") - F.when(F.col("before") == F.col("doc_id"), 1).otherwise(0)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    settled = scratch.cut(runs.where("kind = 2").select("h1", "h2", "part", "piece").join(common, ["h1", "h2"]).select("part", "piece"), "settled")
    # lines meet their piece, which holds a batch at most, not their key
    late = runs.where("kind = 1").select("part", "piece", "doc_id", "row", "pos").join(settled, ["part", "piece"])
    return runs.where("kind = 0").select("doc_id", "row", "pos").union(late.select("doc_id", "row", "pos"))


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions, sorted by document -> a row a document and batch: the bitmap of lines that go."""
    for batch in batches:
        doc, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(doc):
            continue
        begin = np.concatenate(([0], np.flatnonzero((doc[1:] != doc[:-1]) | (row[1:] != row[:-1])) + 1))
        blobs = []
        for a, b in zip(begin, np.concatenate((begin[1:], [len(doc)])), strict=True):
            bits = np.zeros(int(pos[a:b].max()) + 1, np.uint8)
            bits[pos[a:b]] = 1
            blobs.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(row[begin]), pa.array(blobs, pa.binary())], ["doc_id", "row", "gone"])


def keep_bitmaps(scratch: Scratch, docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, row, gone): for documents that lose lines, zlib-compressed bitmaps of those lines; row is the xxhash64 of the text.

    A document may have several bitmaps (one a batch); a reader ORs them. Bits beyond a
    bitmap's end are 0. Documents without a row keep every line.
    """
    marks = drop_marks(scratch, docs, min_docs)
    return marks.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(_bitmap, "doc_id long, row long, gone binary")


def gone_lines(blobs, n: int) -> np.ndarray:
    """Bitmaps of one document -> a bool for each of its n lines."""
    out = np.zeros(n, bool)
    for blob in blobs or ():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))[:n]
        out[: len(bits)] |= bits.astype(bool)
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, blobs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            gone = gone_lines(blobs, len(lines))
            kept = b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if blobs else text or b""
            out.append((len(lines), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        n, d, h = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup_digest(spark: SparkSession, docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    scratch = Scratch(spark, "line-dedup")
    maps = scratch.cut(keep_bitmaps(scratch, docs, min_docs).groupBy("doc_id", "row").agg(F.collect_list("gone").alias("gone")), "bitmaps")
    # the same plan at every size: text is shuffled once, never beside a broadcast of the bitmaps
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(maps.hint("merge"), ["doc_id", "row"], "left")
    return known.select("doc_id", "text", "gone").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

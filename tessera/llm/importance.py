"""Importance resampling towards a target corpus: array-scored weights, Gumbel keys, merged runs.

1. Every word and every pair of neighbouring words is a feature, hashed to a bucket by crc32. Tasks count buckets of documents
   and of the target as arrays, which are added on the executors; the gains of all buckets are one array of fixed size.
2. A second pass scores each document by a look-up in that array: the floored mean of its features' gains, plus Gumbel noise from
   its doc_id, so that the highest scores are a draw without replacement with those weights.
3. Scores are whole numbers of a range that the arithmetic bounds, so their histogram has a bounded size; it gives the score at
   which the draw ends, and cuts the scores above into ranges of even row counts. Each task sorts its eligible rows into runs, cut at the ranges; rows under the
   last score go nowhere. A range is merged by a tournament tree over its runs, which stops at the exact draw count
   and numbers the rows from the count of the ranges above. A score that alone exceeds a range is cut by doc_id.

The crc32 of a pair comes from those of its words (crc32 is linear), so no pair is built as a string.

Null or empty text has no features, weight 0 and too few words to be drawn. Null doc_id: weighs and counts as part of the
corpus, has null score and rank, and isn't one of the N documents. Rows that repeat a doc_id are documents of their own; they share the noise.
Ties: the smaller doc_id, then more features, then the larger weight; equal rows take neighbouring ranks. Very long texts are whole
texts like others. An empty table gives an empty result; an empty target has only smoothed gains. Only doc_id and text (text of
the target) are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import slices, text_buffer, word_bounds
from tessera.llm.shared import Scratch, add_vectors, vector_rows

BUCKETS = 10_000
#: Share drawn, in percent, of the documents with at least MIN_WORDS words; SEED of the noise.
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Rows of a range and of a task's run at most.
RANGE_ROWS, RUN_ROWS = 1 << 20, 1 << 20
#: Bytes up to which a word's crc32 is made by whole-array steps.
SHORT = 48

_byte = np.arange(256)
#: Words are runs of 0-9, A-Z, a-z and everything beyond ASCII.
GAP = ~(((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80))
_LOWER = _byte.astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[k, i, b]: the crc of byte value b at byte i of a crc32, moved on by k zero bytes, for k up to SHORT + 1."""
    out = np.zeros((SHORT + 2, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for k in range(1, SHORT + 2):
        out[k] = _CRC[out[k - 1] & 0xFF] ^ (out[k - 1] >> np.uint32(8))
    return out


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Each crc32 moved on by k zero bytes, k at most SHORT + 1."""
    return _SHIFT[k, 0, crc & 0xFF] ^ _SHIFT[k, 1, (crc >> np.uint32(8)) & 0xFF] ^ _SHIFT[k, 2, (crc >> np.uint32(16)) & 0xFF] ^ _SHIFT[k, 3, crc >> np.uint32(24)]


def features(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, then of all pairs; row of each; and the number of words of each row."""
    raw = _LOWER[raw]
    starts, ends, first = word_bounds(raw, at, GAP)
    n = len(starts)
    size = ends - starts
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    some = order[np.searchsorted(-size[order], -SHORT, "left") :]  # short words, the longest first
    left = np.searchsorted(-size[some], -np.arange(1, SHORT + 1), "right")
    for j in range(SHORT):
        now = some[: left[j]]
        if not len(now):
            break
        crc[now] = _CRC[(crc[now] ^ raw[starts[now] + j]) & 0xFF] ^ (crc[now] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    long = np.flatnonzero(size > SHORT)
    for i in long.tolist():
        crc[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    head = np.flatnonzero(row[1:] == row[:-1]) if n else np.zeros(0, np.int64)
    k = np.minimum(size[head + 1], SHORT)
    space = _SHIFT[np.arange(SHORT + 1), 0, zlib.crc32(b" ") & 0xFF]
    for i in range(1, 4):
        space = space ^ _SHIFT[np.arange(SHORT + 1), i, (zlib.crc32(b" ") >> (8 * i)) & 0xFF]
    pair = shifted(crc[head], k + 1) ^ space[k] ^ crc[head + 1]
    for i in np.flatnonzero(size[head + 1] > SHORT).tolist():
        a = int(head[i])
        pair[i] = zlib.crc32(raw[starts[a + 1] : ends[a + 1]].tobytes(), zlib.crc32(b" ", int(crc[a])))
    every = (np.concatenate((crc, pair)) % np.uint32(buckets)).astype(np.int64)
    return every, np.concatenate((row, row[head])), words


#: Rows that a task's counts come in.
BLOCKS = 8


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                total += np.bincount(features(*text_buffer(batch.column(0)), buckets)[0], minlength=buckets)
        if total.any():
            yield vector_rows(total, BLOCKS)

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return add_vectors(texts.select("text").mapInArrow(_count(buckets), "block int, sums binary"), buckets, BLOCKS, max(1, math.isqrt(parts)))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the smoothed ratio of shares, target over source, floored."""
    k = float(len(source))
    S, T = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + k) / ((s + 1.0) * (T + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """1000 times a Gumbel value from the doc_id, floored."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: np.ndarray, least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row, words = features(*text_buffer(batch.column(1)), len(gains))
                count = np.bincount(row, minlength=batch.num_rows)
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row, gains[bucket])
                weight = total // np.maximum(count, 1)  # floors go down
                ids = batch.column(0)
                score = [None if d is None else w + noise(d, seed) for d, w in zip(ids.to_pylist(), weight.tolist(), strict=True)]
                eligible = (words >= least) & ~np.asarray(ids.is_null())
                yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(weight), pa.array(score, pa.int64()), pa.array(eligible)], ["doc_id", "n_features", "weight", "score", "eligible"])

    return run


def scored(docs: DataFrame, gains: np.ndarray, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, and whether the row is one to draw from."""
    return docs.select("doc_id", "text").mapInArrow(_score(gains, least, seed), "doc_id long, n_features long, weight long, score long, eligible boolean")


def plan_ranges(histogram: list[tuple[int, int]], draw: int, most: int) -> tuple[list[int], list[int]]:
    """(score, rows) -> lowest score and rows of each range, from the highest score down to the one at which the draw ends."""
    low, rows, total = [], [], 0
    for score, n in sorted(histogram, reverse=True):
        if total >= draw:
            break
        if low and rows[-1] + n <= most:
            low[-1] = score
            rows[-1] += n
        else:
            low.append(score)
            rows.append(n)
        total += n
    return low, rows


def order_of(score: np.ndarray, doc: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.lexsort((-weight, -n, doc, -score))


def _runs(low: np.ndarray, cuts: dict[int, np.ndarray], first: np.ndarray):
    """Rows at or above the last range's lowest score -> sorted runs: a row (range, blob) for each range of a run."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        score, doc, n, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        order = order_of(score, doc, n, weight)
        score, doc, n, weight = score[order], doc[order], n[order], weight[order]
        place = np.searchsorted(-low, -score)  # the first range whose lowest score isn't above
        at = first[place].copy()
        for k, ids in cuts.items():
            mine = place == k
            at[mine] += np.searchsorted(ids, doc[mine], "left")
        new = np.concatenate(([True], (score[1:] != score[:-1]) | (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]) | (weight[1:] != weight[:-1])))
        begin = np.flatnonzero(new)
        entries = np.stack([-score[begin], doc[begin], -n[begin], -weight[begin], np.diff(np.append(begin, len(score)))], 1)
        at = at[begin]
        edge = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        blobs = [entries[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at[edge], pa.int64()), pa.array(blobs, pa.binary())], ["range", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
            size += batch.num_rows
            if size >= RUN_ROWS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


class Tournament:
    """A tree of losers over sorted runs: `entries` yields all entries in order, with a replay of one path an entry."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k

    def key(self, i: int):
        return self.runs[i][self.at[i]] if i >= 0 and self.at[i] < len(self.runs[i]) else None

    def wins(self, i: int, j: int) -> bool:
        a, b = self.key(i), self.key(j)
        return b is None or (a is not None and a <= b)

    def left(self) -> Iterator[list]:
        """Entries that aren't out yet, run by run."""
        for run, at in zip(self.runs, self.at, strict=True):
            yield from run[at:]

    def entries(self) -> Iterator[list]:
        k = self.k
        winner, loser = [-1] * k + list(range(k)), [-1] * k
        for p in range(k - 1, 0, -1):
            a, b = winner[2 * p], winner[2 * p + 1]
            winner[p], loser[p] = (a, b) if self.wins(a, b) else (b, a)
        best = winner[1]
        while (entry := self.key(best)) is not None:
            self.at[best] += 1
            yield entry
            p = (best + k) // 2
            while p >= 1:
                if not self.wins(best, loser[p]):
                    best, loser[p] = loser[p], best
                p //= 2


#: Entries of an output batch.
OUT_ROWS = 1 << 16


def _merge(above: dict[int, int], draw: int):
    """(range, blob), sorted by range -> entries with their first rank and how many are drawn, in order."""

    def merged(rank: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs = [np.frombuffer(b, np.int64).reshape(-1, 5).tolist() for b in blobs]
        tree, out = Tournament(runs), []
        entries = tree.entries()
        while rank < draw and (entry := next(entries, None)) is not None:
            score, doc, n, weight, copies = entry
            out.append((doc, -n, -weight, -score, rank + 1, min(copies, draw - rank), copies))
            rank += copies
            if len(out) == OUT_ROWS:
                yield batch_of(out)
                out = []
        if rank >= draw:  # the draw is done: what is left in the runs goes on without an order
            entries.close()
            out += [(doc, -n, -weight, -score, 0, 0, copies) for score, doc, n, weight, copies in tree.left()]
        if out:
            yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "n_features", "weight", "score", "first", "drawn", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != now and blobs:
                    yield from merged(above[now], blobs)
                    blobs = []
                now = r
                blobs.append(blob)
        if blobs:
            yield from merged(above[now], blobs)

    return run


def importance_sample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) for every row of docs."""
    scratch = Scratch(spark, "importance")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    every = scratch.cut(scored(docs, gains, least, seed), "scores")
    # scores are sums of a floored log of a ratio of counts and of noise from 32 bits: under 2^18 different values at any size
    histogram = [(r["score"], r["n"]) for r in every.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()]
    draw = percent * sum(n for _, n in histogram) // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = every.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not draw:
        return rest
    most = max(1, min(RANGE_ROWS, -(-draw // parts)))
    low, rows = plan_ranges(histogram, draw, most)
    inside = (F.col("eligible")) & (F.col("score") >= low[-1])
    # a score with more rows than a range, which then is a range alone, is cut by doc_id
    cuts = {}
    if heavy := {s: k for k, (s, n) in enumerate(zip(low, rows, strict=True)) if n > most}:
        slices_ = -(-max(rows) // most)
        found = every.where(inside & F.col("score").isin(list(heavy))).groupBy("score").agg(F.percentile_approx("doc_id", [i / slices_ for i in range(1, slices_)], 10_000).alias("at")).collect()
        cuts = {heavy[r["score"]]: np.unique(np.array(r["at"], np.int64)) for r in found}
    first = np.concatenate(([0], np.cumsum([len(cuts.get(k, ())) + 1 for k in range(len(low))])))[:-1]
    runs = scratch.cut(every.where(inside).select("score", "doc_id", "n_features", "weight").mapInArrow(_runs(np.array(low), cuts, first), "range long, blob binary"), "runs")
    if cuts:
        each = runs.mapInArrow(_sizes, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()  # a row a range
        size = {r["range"]: r["n"] for r in each}
    else:
        size = dict(enumerate(rows))
    above, total = {}, 0
    for k in sorted(size):
        above[k] = total
        total += size[k]
    merged = runs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_merge(above, draw), "doc_id long, n_features long, weight long, score long, first long, drawn long, copies long")
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda i: F.when(i < F.col("drawn"), F.col("first") + i))
    return rest.where(~F.coalesce(inside, F.lit(False))).union(merged.select(*columns, F.explode(ranks).alias("rank")))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(b, np.int64).reshape(-1, 5)[:, 4].sum()) for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["range", "n"])

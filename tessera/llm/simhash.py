"""SimHash near-duplicates by anchor points of a covering code.

1. A document's fingerprint has a bit where over half of its 3-word shingles' XXH64 values have one. Documents of equal
   fingerprints fold into one node before anything is compared, so a group of copies costs one row.
2. Two of the 64 bits are left aside, the rest are two halves of 31 bits. Fingerprints that differ in t bits at most differ in t // 2 at most in one
   half. The anchors of a half are the words of the Hamming code [31, 26]: it is perfect with covering radius 1, so each half is 0 or 1 bits
   away from its home anchor. A half x within 1 bit of y is at home at an anchor that is at most 2 = covering radius + threshold bits
   from y. So each fingerprint goes to every anchor within that distance: its home, and, if it isn't a code word itself, the 15
   code words at distance 2. No pair is lost.
3. At each anchor the fingerprints at home are compared with all fingerprints there, on all 64 bits. Anchors with
   many fingerprints are cut into blocks, and each pair of blocks is a unit of work of its own.
4. Tasks contract the links to stars; components of those give each fingerprint its component, and the smallest doc_id there its name.

Null or empty text and text without words have fingerprint zero, which links like any other. With fewer words than n, the whole sequence is
the only shingle. Null doc_id: the row has a fingerprint, makes no links, and its component is null. Rows that repeat a doc_id are
documents of their own. A bit that exactly half of the shingles have is 0. Ties: the smallest doc_id names a component. Very
long texts are whole texts like others. An empty table gives an empty result. Only doc_id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import mix, ragged, slices
from tessera.llm.shared import Scratch, components, pack_edges, smallest_labels

WORDS, BITS, SEED = 3, 3, 42
#: Fingerprints that a task gathers before it writes them to the anchors' buckets.
GATHER = 1 << 16
#: Fingerprints at an anchor up to which they are compared in their bucket's task; beyond, in blocks.
AT_ONCE, BLOCK = 1 << 15, 1 << 14
#: Pairs compared by one array step, and links that a task holds before it contracts them.
PAIRS, HELD = 1 << 19, 1 << 18

HALF = 31
#: Position j of a half counts as j + 1: the xor of the positions of a word's bits is 0 for code words, else the bit to its home anchor.
_SYNDROME = np.zeros((4, 256), np.uint8)
for _i in range(4):
    for _j in range(8):
        if 8 * _i + _j < HALF:
            _SYNDROME[_i] ^= np.where((np.arange(256) >> _j) & 1, np.uint8(8 * _i + _j + 1), np.uint8(0)).astype(np.uint8)
#: The 15 pairs of bits whose positions have this xor; row 0 is unused.
_TWO = np.array([[0] * 15] + [[1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 32) if p < p ^ s] for s in range(1, 32)], np.uint32)


def fingerprint(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """64 bits, as an unsigned whole number."""
    words = text.lower().split()  # bytes: A-Z only, and the white space of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n, len(words))
    count, total = len(words) - k + 1, np.zeros(64, np.int64)
    spans = list(zip(starts[:count].tolist(), ends[k - 1 :].tolist(), strict=True))
    of = xxhash.xxh64_intdigest
    for i in range(0, count, 1 << 16):
        h = np.fromiter((of(joined[a:b], seed) for a, b in spans[i : i + (1 << 16)]), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                made = [fingerprint(t or b"", n, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed whole number."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(n, seed), "doc_id long, fp long")


def halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits 0..30 and 31..61; the upper two bits are compared, but have no anchors."""
    low = np.uint64((1 << HALF) - 1)
    return (fp & low).astype(np.uint32), ((fp >> np.uint64(HALF)) & low).astype(np.uint32)


def syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint8)
    for i in range(4):
        out ^= _SYNDROME[i][(half >> np.uint32(8 * i)) & np.uint32(0xFF)]
    return out


def home(half: np.ndarray, s: np.ndarray) -> np.ndarray:
    return half ^ np.where(s, np.uint32(1) << (s.astype(np.uint32) - np.uint32(1)), np.uint32(0)).astype(np.uint32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): all code words within the covering radius plus one bit that can hold a neighbour's home."""
    s = syndrome(half)
    off = np.flatnonzero(s)
    far = half[off, None] ^ _TWO[s[off]]
    return np.concatenate((np.arange(len(half)), np.repeat(off, 15))), np.concatenate((home(half, s), far.reshape(-1)))


_UNITS = "kind int, bucket int, blob binary, other binary"


def _batch(kind: int, bucket: list, blob: list, other: list | None = None) -> pa.RecordBatch:
    size = len(blob)
    cols = [pa.array([kind] * size, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), pa.array(other or [None] * size, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "bucket", "blob", "other"])


def _cover(buckets: int):
    """Distinct fingerprints -> (bucket, blob of fingerprints and their anchors)."""

    def flush(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, key = [], []
        for k, half in enumerate(halves(fp)):
            i, a = anchors(half)
            at.append(i)
            key.append(a | np.uint32(k << HALF))
        i, key = np.concatenate(at), np.concatenate(key)
        b = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        i, key, b = i[order], key[order], b[order]
        edge = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        blobs = [fp[i[x:y]].tobytes() + key[x:y].tobytes() for x, y in zip(edge, np.append(edge[1:], len(b)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(b[edge]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= GATHER:
                yield from flush(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from flush(np.concatenate(held))

    return run


class Links:
    """Gathers links and gives them out as packed stars."""

    def __init__(self):
        self.held, self.size, self.full = [], 0, False

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            self.held.append((x.view(np.int64), y.view(np.int64)))
            self.size += len(x)
            if self.size >= HELD:
                self.held = [self._stars()]
                self.size = len(self.held[0][0])
                self.full = 2 * self.size >= HELD  # a forest that doesn't shrink is given out

    def _stars(self) -> tuple[np.ndarray, np.ndarray]:
        node, low = smallest_labels(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        return node[node != low], low[node != low]

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            for blob in pack_edges(*self._stars()):
                yield _batch(0, [-1], [blob])
        self.held, self.size, self.full = [], 0, False


def within(x: np.ndarray, y: np.ndarray, bits: int, links: Links) -> None:
    """Links between each of x and each of y, block by block."""
    step = max(1, PAIRS // max(1, len(y)))
    for i in range(0, len(x), step):
        a, b = np.nonzero(np.bitwise_count(x[i : i + step, None] ^ y[None]) <= bits)
        other = x[i + a] != y[b]
        links.add(x[i + a[other]], y[b[other]])


def at_home(fp: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Is this anchor the nearest one of the fingerprint's half?"""
    low, high = halves(fp)
    half = np.where(key >> np.uint32(HALF), high, low)
    return np.bitwise_count(half ^ (key & np.uint32((1 << HALF) - 1))) <= 1


def _compare(bits: int):
    """Blobs, sorted by bucket -> stars of links (kind 0), and pairs of blocks of anchors with many fingerprints (kind 1)."""

    def bucket_links(blobs: list[bytes], links: Links) -> Iterator[pa.RecordBatch]:
        n = [len(b) // 12 for b in blobs]
        fp = np.concatenate([np.frombuffer(b, np.uint64, k) for b, k in zip(blobs, n, strict=True)])
        key = np.concatenate([np.frombuffer(b, np.uint32, k, 8 * k) for b, k in zip(blobs, n, strict=True)])
        mine = at_home(fp, key)
        order = np.lexsort((~mine, key))
        fp, key, mine = fp[order], key[order], mine[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        homes = np.add.reduceat(mine.astype(np.int64), begin)
        some = (homes > 0) & (size > 1)
        for g in np.flatnonzero(some & (size > 256)).tolist():
            a, h, m = int(begin[g]), int(homes[g]), int(size[g])
            if m <= AT_ONCE:
                within(fp[a : a + h], fp[a : a + m], bits, links)
            else:
                for i in range(0, h, BLOCK):
                    left = fp[a + i : a + min(i + BLOCK, h)].tobytes()
                    for j in range(0, m, BLOCK):
                        yield _batch(1, [int(mix(np.array([key[a] ^ np.uint32(i * 31 + j)], np.uint64))[0] >> np.uint64(33))], [left], [fp[a + j : a + min(j + BLOCK, m)].tobytes()])
            if links.full:
                yield from links.out()
        # anchors with few fingerprints: each of home with all, many anchors at once
        few = np.flatnonzero(some & (size <= 256))
        cost = np.cumsum(homes[few] * size[few])
        for part in np.split(few, np.searchsorted(cost, np.arange(PAIRS, int(cost[-1]) if len(few) else 0, PAIRS))) if len(few) else ():
            if not len(part):
                continue
            rows = ragged(begin[part], homes[part])
            reach = np.repeat(size[part], homes[part])
            x = np.repeat(rows, reach)
            y = ragged(np.repeat(begin[part], homes[part]), reach)
            near = (np.bitwise_count(fp[x] ^ fp[y]) <= bits) & (fp[x] != fp[y])
            links.add(fp[x[near]], fp[y[near]])
            if links.full:
                yield from links.out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, links = None, [], Links()
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield from bucket_links(blobs, links)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from bucket_links(blobs, links)
        yield from links.out()

    return run


def _blocks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                within(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), bits, links)
                if links.full:
                    yield from links.out()
        yield from links.out()

    return run


def linked_fingerprints(scratch: Scratch, nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component) of distinct fingerprints (fp) that have a link."""
    if bits > 3:
        raise ValueError("anchors cover fingerprints that differ in up to 3 bits")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    covered = nodes.select("fp").mapInArrow(_cover(4 * parts), "bucket int, blob binary")
    found = scratch.cut(covered.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(bits), _UNITS), "compared")
    units = found.where("kind = 1").repartition(parts, "bucket").select("blob", "other").mapInArrow(_blocks(bits), _UNITS)
    edges = found.where("kind = 0").select("blob").union(units.select("blob"))
    return scratch.cut(components(scratch, edges).withColumnRenamed("node", "fp"), "components")


def simhash_components(spark: SparkSession, docs: DataFrame, n: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    scratch = Scratch(spark, "simhash")
    every = scratch.cut(fingerprints(docs, n, seed), "fingerprints")
    nodes = scratch.cut(every.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = linked_fingerprints(scratch, nodes, bits)
    placed = nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lead = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(lead, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return every.join(named, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

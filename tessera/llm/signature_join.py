"""N-gram Jaccard self-join with signature trees.

1. One pass makes each document's set of distinct word n-gram hashes, its size, a 128-bit hash of the
   set, and segment keys: sets of a size class are cut by hash range into segments, and a set sends the keys of its
   largest D + 1 non-empty segments (ties by key), D being the largest symmetric difference that it can have with a set it links
   to. A linked pair differs in at most D segments, so its first equal segment in that order is sent by both. That needs
   more than D non-empty segments in one of the two; a set with fewer also sends its D + 1 smallest n-grams, for
   which the same holds. A set near the next class's lower end makes that class's keys too. No link is lost, and an
   empty segment is never a key.
2. Equal keys give candidate edges to the smallest document of the key. Each task keeps one row a key
   and writes edges for the rest, so a hot key costs one row a task. Components of
   these edges bound where links can be.
3. Within a component, equal sets fold into one representative. A large component is cut into bands of set sizes, of
   which only equal and neighbouring ones can link, and a band into blocks; each pair of blocks that can link is one unit of work. There a
   signature tree is built for each side: a node
   holds the OR of its sets' token bitmaps, its size range and the most tokens that share a bit. The
   dual traversal drops node pairs whose largest possible overlap can't reach the threshold; what is left
   is checked on the whole sets. Where only components are asked for, pairs already connected are left out.
4. Components of the verified links, and the number of linked documents of each document, are the result.

Equal sets are linked too; a class of equal sets counts with its size. The unit of work sums its links by document,
so that a group of copies writes a row a document and block, not a row a pair. A doc_id that repeats with different texts counts with its
smallest set. Null or empty text has an empty set and no link. With fewer
words than n, the whole sequence is the only n-gram. Null doc_id: never linked, component null. Rows that repeat
a doc_id are one node, with a row of the result each. Ties: the smallest doc_id names a component. Very long texts are whole sets like others.
An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names. Hashes have 64 bits for n-grams
and 128 bits for sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import mix, slices, span_hashes, text_buffer, word_bounds
from tessera.llm.shared import CONTRACT, Scratch, components, pack_edges, smallest_labels

#: Keys a task gathers before it folds and writes them.
GATHER = 1 << 20
#: N-grams of one block, and sets of one as long as a band has no more than SPREAD blocks for them.
BLOCK_GRAMS, BLOCK_SETS, SPREAD = 1 << 22, 1024, 16
LEAF, FANOUT = 16, 8
#: Distinct tokens of a leaf up to which overlaps are a matrix product.
DENSE = 1 << 16
#: First salt of the hash of a set.
SALT = 0x1234567


def gram_sets(raw: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row."""
    starts, ends, first = word_bounds(raw, at)
    h = span_hashes(raw, starts, ends, lower=True)
    grams = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = h[k:] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) % 2**64 | 1)
        grams[: len(part)] += part
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for k in range(a, b):
                whole = mix(np.array([whole ^ h[k]], np.uint64) + np.uint64(0xA5A5A5A5))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def difference(size: int, partner: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (size + partner) * (100 - percent) // (100 + percent)


@lru_cache(8)
def size_classes(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, list[int]]:
    """Lower ends of the size classes, and the number of segments of each: half as many again as a linked pair can differ in."""
    low = [1]
    while low[-1] < top:
        low.append(max(low[-1] + 1, low[-1] * 5 // 4))
    return np.array(low), [3 * (difference(end - 1, end - 1, percent) + 1) // 2 for end in low[1:]]


def segment_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set: linked sets share one at least."""
    low, segments = size_classes(percent)
    size = len(grams)
    c = int(np.searchsorted(low, size, "right")) - 1
    classes = [c]
    if 100 * size >= percent * int(low[c + 1]):
        classes.append(c + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0x51ED270B)))))
    out = []
    for k in classes:
        m, most = segments[k], difference(size, min(int(low[k + 1]) - 1, size * 100 // percent), percent)
        cut = np.searchsorted(grams, np.arange(1, m, dtype=np.uint64) * np.uint64((2**64 - 1) // m))
        at = np.concatenate(([0], cut, [size]))
        held = np.diff(at)
        some = np.flatnonzero(held)
        keys = mix((total[at[some + 1]] - total[at[some]]) ^ mix(some.astype(np.uint64) + np.uint64((k << 40) + 1)))
        if len(keys) > most + 1:
            keys = keys[np.lexsort((keys, -held[some]))[: most + 1]]
        out.append(keys)
        if len(some) <= most:
            out.append(mix(grams[: most + 1] ^ mix(np.array([(k << 40) + (1 << 39)], np.uint64))))
    return np.concatenate(out)


_MADE = "bucket int, blob binary, doc_id long, n long, h1 long, h2 long"


def _rows(bucket=None, blob=None, doc=None, n=None, h1=None, h2=None) -> pa.RecordBatch:
    size = len(next(x for x in (bucket, doc) if x is not None))
    types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    cols = [pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip((bucket, blob, doc, n, h1, h2), types, strict=True)]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "blob", "doc_id", "n", "h1", "h2"])


def fold(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One (key, smallest doc) a key, and (doc, smallest doc) of the other rows, once each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    lead = docs[new][np.cumsum(new) - 1] if len(keys) else docs
    other = docs != lead
    edges = np.unique(np.stack([docs[other], lead[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[new], docs[new], edges[:, 0], edges[:, 1]


def pack_keys(keys: np.ndarray, docs: np.ndarray) -> bytes:
    """6 bytes of each key (its bucket holds the rest of its bits) and documents as 4 bytes from the smallest where those do."""
    base = int(docs.min())
    wide = int(docs.max()) - base >= 1 << 32
    head = np.array([base, len(docs) << 1 | wide], np.int64).tobytes()
    return head + (docs - base).astype(np.int64 if wide else np.uint32).tobytes() + keys.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, n = np.frombuffer(blob, np.int64, 2).tolist()
    wide, n = n & 1, n >> 1
    docs = np.frombuffer(blob, np.int64 if wide else np.uint32, n, 16)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, 2:] = np.frombuffer(blob, np.uint8, 6 * n, 16 + docs.nbytes).reshape(n, 6)
    return keys.view(np.uint64).reshape(-1), docs.astype(np.int64) + base


def _sketch(n: int, percent: int, buckets: int):
    def flush(keys: list, docs: list) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        k, d, u, v = fold(np.concatenate(keys), np.concatenate(docs))
        if len(u):
            # documents that this task connects go on as the smallest of them
            node, low = smallest_labels(u, v)
            stars = list(pack_edges(node, low))
            yield _rows(bucket=[-1] * len(stars), blob=stars)
            at = np.minimum(np.searchsorted(node, d), len(node) - 1)
            d = np.where(node[at] == d, low[at], d)
        b = (k % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        k, d, b = k[order], d[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        ends = np.concatenate((at[1:], [len(b)]))
        yield _rows(bucket=b[at], blob=[pack_keys(k[i:j], d[i:j]) for i, j in zip(at, ends, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = gram_sets(*text_buffer(batch.column(1)), n)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                ends = np.cumsum(size)
                hash_ = []
                for salt in (SALT, 0x7654321):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(salt)))))
                    hash_.append((total[ends] - total[ends - size]).view(np.int64))
                ids = batch.column(0)
                yield _rows(doc=ids, n=size, h1=hash_[0], h2=hash_[1])
                for doc, s in zip(ids.to_pylist(), sets, strict=True):
                    if doc is not None and len(s):
                        keys.append(segment_keys(s, percent))
                        docs.append(np.full(len(keys[-1]), doc, np.int64))
                        held += len(keys[-1])
                if held >= GATHER:
                    yield from flush(keys, docs)
                    keys, docs, held = [], [], 0
        yield from flush(keys, docs)

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs, sorted by bucket -> packed edges that connect the documents of each key, contracted to stars."""
    now, blobs, held = None, [], []

    def done() -> None:
        keys, docs = (np.concatenate(x) for x in zip(*map(unpack_keys, blobs), strict=True))
        held.append(fold(keys, docs)[2:])

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return smallest_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def out(node: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        for blob in pack_edges(node, low):
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and blobs:
                done()
                blobs = []
                if sum(len(u) for u, _ in held) >= 2 * CONTRACT:
                    yield from out(*stars())
                    held = []
            now = bucket
            blobs.append(blob)
    if blobs:
        done()
    if held:
        yield from out(*stars())


class SignatureTree:
    """Sets in order of size; leaves of LEAF sets; inner nodes of FANOUT nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0] if len(sets[i]) else 0)))
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(self.maps, self.sets, strict=True):
            flags = np.zeros(bits, np.uint8)
            flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
            row[:] = np.packbits(flags).view(np.uint64)
        self.spare = self.size - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        # levels from the leaves up: bitmap, smallest and largest size, most tokens that share bits
        self.levels = []
        at, maps, low, high, spare = LEAF, self.maps, self.size, self.size, self.spare
        while True:
            cut = np.arange(0, len(maps), at)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            low, high, spare = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)
            self.levels.append((maps, low, high, spare))
            at = FANOUT
            if len(maps) == 1:
                break


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each set of left with each of right."""
    every = np.unique(np.concatenate(left))
    if len(every) > DENSE:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64)

    def flags(sets: list[np.ndarray]) -> np.ndarray:
        flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(every, flat), len(every) - 1)
        known = every[at] == flat
        out = np.zeros((len(sets), len(every)), np.float32)
        out[rows[known], at[known]] = 1
        return out

    return (flags(left) @ flags(right).T).astype(np.int64)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between left and right, or within left if right is None, that connect all of its components."""
    union = Union(len(left) + len(right or []))
    return [(int(i), int(j)) for a, b in tree_pairs(left, right, percent, union) for i, j in zip(a, b, strict=True)]


def tree_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, union: Union | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links (i, j), some at a time; with a union, which then joins them, only those between sets that it doesn't connect."""
    most = max(map(len, left + (right or [])))
    bits = 1 << max(9, min(15, int(4 * most - 1).bit_length()))
    x = SignatureTree(left, bits)
    y = SignatureTree(right, bits) if right is not None else x
    shift = 0 if right is None else len(left)
    need = lambda total: -(-percent * total // (100 + percent))  # noqa: E731  least overlap of sizes with that sum

    def bound(a, b):
        """Largest overlap between any set below node a and any below node b, and the least that a link needs."""
        common = int(np.bitwise_count(a[0] & b[0]).sum()) + min(int(a[3]), int(b[3]))
        return min(common, int(a[2]), int(b[2])), need(int(a[1]) + int(b[1]))

    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        i, a, j, b = todo.pop()
        na, nb = tuple(v[a] for v in x.levels[i]), tuple(v[b] for v in y.levels[j])
        if 100 * na[2] < percent * nb[1] or 100 * nb[2] < percent * na[1]:
            continue
        most_, least = bound(na, nb)
        if most_ < least:
            continue
        if i == 0 and j == 0:
            rows, cols = range(a * LEAF, min((a + 1) * LEAF, len(x.sets))), range(b * LEAF, min((b + 1) * LEAF, len(y.sets)))
            common = np.bitwise_count(x.maps[rows.start : rows.stop, None] & y.maps[None, cols.start : cols.stop]).sum(2).astype(np.int64)
            common += np.minimum(x.spare[rows.start : rows.stop, None], y.spare[None, cols.start : cols.stop])
            total = x.size[rows.start : rows.stop, None] + y.size[None, cols.start : cols.stop]
            if union is None:
                near = (100 + percent) * common >= percent * total
                if y is x:
                    near &= np.arange(rows.start, rows.stop)[:, None] < np.arange(cols.start, cols.stop)
                if near.any():
                    near &= (100 + percent) * overlaps(x.sets[rows.start : rows.stop], y.sets[cols.start : cols.stop]) >= percent * total
                    p, q = np.nonzero(near)
                    if len(p):
                        yield x.order[rows.start + p], y.order[cols.start + q]
                continue
            mine = np.array([union.find(int(x.order[r])) for r in rows])
            theirs = np.array([union.find(shift + int(y.order[c])) for c in cols])
            near = ((100 + percent) * common >= percent * total) & (mine[:, None] != theirs[None])
            for p, q in zip(*np.nonzero(near), strict=True):
                r, c = rows.start + int(p), cols.start + int(q)
                if y is x and r >= c:
                    continue
                u, v = union.find(int(x.order[r])), union.find(shift + int(y.order[c]))
                if u != v and linked(x.sets[r], y.sets[c], percent):
                    union.join(u, v)
                    yield x.order[[r]], y.order[[c]]
            continue
        if j == 0 or i > j:
            todo += [(i - 1, k, j, b) for k in range(a * FANOUT, min((a + 1) * FANOUT, len(x.levels[i - 1][1])))]
        elif y is x and i == j and a == b:
            kids = range(a * FANOUT, min((a + 1) * FANOUT, len(x.levels[i - 1][1])))
            todo += [(i - 1, k, j - 1, m) for k in kids for m in kids if k <= m]
        else:
            todo += [(i, a, j - 1, k) for k in range(b * FANOUT, min((b + 1) * FANOUT, len(y.levels[j - 1][1])))]


def _verify(n: int, percent: int, what: str):
    """Rows (component, i, j, own, doc_id, copies, h1, text), sorted by the first three -> links (u, v), and for what = "counts" (u, n) too.

    what: "span" for links that connect, "counts" for those and the number of documents linked to u by this unit, "all" for all links.
    """

    def links(docs: list[int], own: list[int], copies: list[int], sets: list[np.ndarray], i: int, j: int) -> Iterator[pa.RecordBatch]:
        own_ = np.array(own)
        left = np.flatnonzero(own_ == i)
        right = np.flatnonzero(own_ == j)
        if not len(left) or not len(right) or len(docs) < 2:
            return
        doc, size, total = np.array(docs, np.int64), np.array(copies, np.int64), np.zeros(len(docs), np.int64)
        union, u, v = Union(len(docs)), [], []
        mine, theirs = [sets[k] for k in left], None if i == j else [sets[k] for k in right]
        if what == "span":
            for a, b in tree_links(mine, theirs, percent):
                u.append(int(doc[left[a]]))
                v.append(int(doc[right[b]]))
        else:
            for a, b in tree_pairs(mine, theirs, percent):
                a, b = left[a], right[b]
                if what == "all":
                    yield batch_of(doc[a], doc[b])
                    continue
                np.add.at(total, a, size[b])
                np.add.at(total, b, size[a])
                roots = {int(k): union.find(int(k)) for k in np.unique(np.concatenate((a, b)))}
                new = np.array([roots[k] for k in a.tolist()]) != np.array([roots[k] for k in b.tolist()])
                for p, q in zip(a[new].tolist(), b[new].tolist(), strict=True):
                    r, s = union.find(p), union.find(q)
                    if r != s:
                        union.join(r, s)
                        u.append(int(doc[p]))
                        v.append(int(doc[q]))
            counted = total > 0
            if counted.any():
                yield batch_of(doc[counted], None, total[counted])
        if u:
            yield batch_of(np.array(u, np.int64), np.array(v, np.int64))

    def batch_of(u: np.ndarray, v: np.ndarray | None, n: np.ndarray | None = None) -> pa.RecordBatch:
        cols = [pa.nulls(len(u), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (u, v, n)]
        return pa.RecordBatch.from_arrays(cols, ["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, own, copies, sets, seen = None, [], [], [], [], set()
        for whole in batches:
            for batch in slices(whole, "text"):
                made = gram_sets(*text_buffer(batch.column(7)), n)
                for c, i, j, o, doc, k, h1, s in zip(*(batch.column(k).to_pylist() for k in range(7)), made, strict=True):
                    if now != (c, i, j):
                        if docs:
                            yield from links(docs, own, copies, sets, *now[1:])
                        now, docs, own, copies, sets, seen = (c, i, j), [], [], [], [], set()
                    # of the rows of one doc_id, one with the class's own set counts
                    if doc in seen or int(mix(s + np.uint64(SALT)).sum(dtype=np.uint64).view(np.int64)) != h1:
                        continue
                    seen.add(doc)
                    docs.append(doc)
                    own.append(o)
                    copies.append(k)
                    sets.append(s)
        if docs:
            yield from links(docs, own, copies, sets, *now[1:])

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 3, percent: int = 90, counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) and, with counts, n_links for every row of docs; all links (u, v) between different sets, by their smallest documents."""
    scratch = Scratch(spark, "ngram-join")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    made = scratch.cut(docs.mapInArrow(_sketch(n, percent, 4 * parts), _MADE), "sketch")
    sketch = scratch.cut(made.where("bucket IS NULL").select("doc_id", "n", "h1", "h2"), "sets")
    keys = made.where("bucket >= 0").select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates, "blob binary")
    edges = scratch.cut(keys.union(made.where("bucket = -1").select("blob")), "edges")
    scratch.drop(made)
    scratch.release()
    near = scratch.cut(components(scratch, edges), "candidates")

    # equal sets fold into their smallest document
    members = scratch.cut(sketch.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min(F.struct("n", "h1", "h2")).alias("s")).select("doc_id", "s.*").join(near.withColumnRenamed("node", "doc_id"), "doc_id"), "members")
    classes = scratch.cut(members.groupBy("component", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    copies = members.join(classes.select("component", "h1", "h2", "rep"), ["component", "h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    # small components are one unit; large ones have size bands, and each pair of blocks of equal or neighbouring bands is one
    sized = classes.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).where("sets > 1").select("component", (F.greatest(F.col("grams") / BLOCK_GRAMS, F.col("sets") / BLOCK_SETS) > 1).alias("large"))
    band = F.when(F.col("large"), F.floor(F.log("n") / (1.001 * log(100 / percent)))).otherwise(0).cast("int")
    placed = scratch.cut(classes.join(sized, "component").select(F.col("rep").alias("doc_id"), "component", "large", "copies", "h1", "n", band.alias("band")), "placed")
    by_band = placed.where("large").groupBy("component", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("grams") / BLOCK_GRAMS, F.least(F.col("sets") / BLOCK_SETS, F.lit(SPREAD)))).cast("int")
    # one entry for each size band of a component, some dozens at most
    bands = scratch.cut(by_band.select("component", "band", blocks.alias("blocks")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks")), "bands")
    dealt = placed.join(bands, "component", "left").select("doc_id", "component", "copies", "h1", "band", *(F.coalesce(F.try_element_at("blocks", F.col("band") + k), F.lit(int(k == 0))).alias(f"b{k + 1}") for k in (-1, 0, 1)))
    dealt = dealt.withColumn("own", F.expr("shiftleft(cast(band AS bigint), 32) + pmod(xxhash64(doc_id), b1)"))
    others = F.expr("flatten(transform(array(b0, b1, b2), (b, k) -> if(b = 0, array(), transform(sequence(0, b - 1), x -> shiftleft(cast(band + k - 1 AS bigint), 32) + x))))")
    pairs = docs.join(dealt.hint("merge"), "doc_id").withColumn("other", F.explode(others)).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "copies", "h1", "text")
    order = ["component", "i", "j"]
    units = pairs.repartition(parts, *order).sortWithinPartitions(*order)
    told = scratch.cut(units.mapInArrow(_verify(n, percent, "counts" if counts else "span"), "u long, v long, n long"), "links")
    links = units.mapInArrow(_verify(n, percent, "all"), "u long, v long, n long").select("u", "v")
    scratch.release()
    found = components(scratch, told.where("v IS NOT NULL").select("u", "v").union(copies))
    found = scratch.cut(found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "components")
    out = sketch.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if counts:
        near_ = told.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("near"))
        sized = classes.join(near_, "rep", "left").select("component", "h1", "h2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")).where("n_links > 0")
        degree = members.join(sized, ["component", "h1", "h2"]).select("doc_id", "n_links")
        out = out.join(degree, "doc_id", "left").select(*out.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out, links

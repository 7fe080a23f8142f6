"""Exact removal of repeated byte strings by prefix-free parsing.

A byte goes when a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

Parsing: a rolling hash of every TRIGGER-byte string picks triggers; the trigger of a window of LENGTH bytes is the
leftmost smallest hash in it, so equal windows have their trigger at the same place, in any text. Consecutive windows with one trigger
are a phrase: its bytes overlap the next phrase's by LENGTH - 1, so each window lies in exactly one phrase of its text.
Dictionary and parse: equal phrases (120 bits of hashes) are one dictionary entry, which keeps its smallest document; the parse is the
sequence of (document, place, phrase). A phrase that also stands in a smaller document goes whole. First occurrences that share a trigger and
the bytes on one side of it with another document's phrase stay open: their bytes travel to the trigger's bucket, where a suffix array of the
bucket's part of the dictionary, made by prefix doubling to LENGTH bytes, puts equal windows side by side. As a window
never reaches beyond its phrase, the order of the parse after a phrase can't part equal windows: the suffix array of the parse comes down to the smallest document of each phrase, and isn't
built. Windows are thus compared by their bytes. Each text is read three times; most of the corpus never gets beyond the phrase level.

Rows travel as packed arrays by hash bucket, folded in the task first: of equal phrases in a task only those of the
smallest document are sent, so a common passage costs one row a task. A trigger whose phrases are all different is held by one task.

Null or empty text has no bytes. Null doc_id: not compared, nothing is removed. Rows that repeat a doc_id aren't smaller than each other; where their
texts differ, a hash of the text tells their places apart, so each loses its own. Ties: of equal strings in one document all stay, or all go.
Texts under LENGTH bytes stay; very long ones are parsed in overlapping pieces. An empty table gives an empty result. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import _TABLE, mix, powers, ragged, slices, span_hashes, text_buffer
from tessera.llm.shared import Scratch, side

LENGTH, TRIGGER = 50, 16
#: Texts that share a window around a trigger share so many bytes on one side of it at least.
SIDE = (LENGTH - TRIGGER + 1) // 2
#: Bytes of text whose phrases a task folds at once.
GATHER = 1 << 24
_PLACE = np.uint64(23)


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of each string of `size` bytes."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n] + np.uint64(size))


def phrases(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """trigger hash, phrase hash, row, first window (in its text), number of windows, left and right hash of each phrase."""
    width = LENGTH - TRIGGER + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint16, np.uint16))
    if len(raw) < LENGTH:
        return none
    if len(raw) > 1 << 22:  # a very long text: pieces that overlap by LENGTH - 1, so that places fit
        return _long(raw, at)
    g = rolling(raw, TRIGGER)
    low = g >> _PLACE << _PLACE | np.arange(len(g), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(g) - width + 1], low[width - step : width - step + len(g) - width + 1])
    owner = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.maximum(0, np.diff(at) - LENGTH + 1))
    start = ragged(at[:-1], np.maximum(0, np.diff(at) - LENGTH + 1))
    if not len(start):
        return none
    own = owner[start]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]))))
    count = np.diff(np.concatenate((new, [len(start)])))
    a = start[new]
    p = span_hashes(raw, a, a + count + LENGTH - 1)
    p = mix(p + (own[new] - a).astype(np.uint64))
    # the SIDE bytes before and behind the trigger, where the text has them
    t, low_end, high_end = own[new], at[row[new]], at[row[new] + 1]
    sides = []
    for begin, end in ((t - SIDE, t), (t + TRIGGER, t + TRIGGER + SIDE)):
        there = (begin >= low_end) & (end <= high_end)
        h = p.copy()
        h[there] = span_hashes(raw, begin[there], end[there])
        sides.append((h >> np.uint64(48)).astype(np.uint16))
    return g[t], p, row[new], a - low_end, count, *sides


def _long(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    parts = []
    for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for s in range(a, max(a + 1, b - LENGTH + 1), 1 << 21):
            piece = raw[s : min(b, s + (1 << 21) + LENGTH - 1)]
            k, p, _, first, *rest = phrases(piece, np.array([0, len(piece)]))
            parts.append((k, p, np.full(len(k), r), first + s - a, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fold_first(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each entry: do its keys also have a smaller document here?"""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort((doc, *keys))
    d, new = doc[order], np.zeros(len(doc), bool)
    new[0] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    lead = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    out = np.empty(len(doc), bool)
    out[order] = d > lead
    return out


def in_two(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry: does its key stand in two documents?"""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.concatenate((begin, [len(k)])))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(d[begin] != d[begin + size - 1], size)
    return out


_BLOB = "kind int, bucket int, blob binary"


def _blobs(kind: int, bucket: np.ndarray, arrays: tuple[np.ndarray, ...], pack=lambda *x: b"".join(a.tobytes() for a in x)) -> Iterator[pa.RecordBatch]:
    """Rows (kind, bucket, packed arrays) of entries dealt by bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    arrays = tuple(x[order] for x in arrays)
    at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    end = np.concatenate((at[1:], [len(b)]))
    blobs = [pack(*(x[i:j] for x in arrays)) for i, j in zip(at, end, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(b[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


def _unpack(blobs: list[bytes], types: tuple) -> list[np.ndarray]:
    size = sum(np.dtype(t).itemsize for t in types)
    parts = []
    for blob in blobs:
        n, at, row = len(blob) // size, 0, []
        for t in types:
            row.append(np.frombuffer(blob, t, n, at))
            at += row[-1].nbytes
        parts.append(row)
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types]


def _grouped(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """Calls done(blobs) for each (kind, bucket) of rows sorted by them."""
    now, blobs = None, []
    for batch in batches:
        for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (kind, bucket):
                if blobs:
                    yield from done(now[0], blobs)
                now, blobs = (kind, bucket), []
            blobs.append(blob)
    if blobs:
        yield from done(now[0], blobs)


#: Bytes sent of each field: trigger and phrase hash, first window, number of windows, left and right hash. A phrase
#: is the same when trigger, phrase and side hashes are, 120 bits with the bucket's.
SENT = (5, 6, 4, 1, 2, 2)
#: Entries that a task gathers before it deals them by document.
HELD = 1 << 20


class Outbox:
    """Gathers (doc, variant, first window, number) of a kind over all of a task's input, then deals them by document bucket.

    So a task sends each document bucket a few rows, however many hash buckets it has read.
    """

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, {}, 0

    def add(self, kind: int, doc: np.ndarray, var: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            self.held.setdefault(kind, []).append((doc, var, first.astype(np.int32), n.astype(np.int32)))
            self.size += len(doc)
            if self.size >= HELD:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            doc, var, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, var, doc))
            doc, var, first, n = doc[order], var[order], first[order].astype(np.int64), n[order].astype(np.int64)
            begin = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (var[1:] != var[:-1]) | (first[1:] != first[:-1] + n[:-1]))))
            n = np.add.reduceat(n, begin).astype(np.int32)
            yield from _blobs(kind, _bucket_of(doc[begin], self.buckets), (doc[begin], var[begin], first[begin].astype(np.int32), n))
        self.held, self.size = {}, 0


def pack_phrases(doc: np.ndarray, var: np.ndarray, fields: tuple[np.ndarray, ...]) -> bytes:
    """Documents as 4 bytes from their smallest where those do, variants where there are any, and the SENT bytes of each field."""
    base = int(doc.min())
    wide, many = int(doc.max()) - base >= 1 << 32, bool(var.any())
    out = [np.array([base, len(doc) << 2 | many << 1 | wide], np.int64).tobytes(), (doc - base).astype(np.int64 if wide else np.uint32).tobytes(), var.tobytes() if many else b""]
    for x, size in zip(fields, SENT, strict=True):
        out.append(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
    return b"".join(out)


def unpack_phrases(blobs: list[bytes]) -> list[np.ndarray]:
    """doc, variant and the fields of blobs, as 64-bit arrays."""
    parts = []
    for blob in blobs:
        base, n = np.frombuffer(blob, np.int64, 2).tolist()
        wide, many, n, at = n & 1, n & 2, n >> 2, 16
        doc = np.frombuffer(blob, np.int64 if wide else np.uint32, n, at)
        at += doc.nbytes
        var = np.frombuffer(blob, np.int64, n, at) if many else np.zeros(n, np.int64)
        at += 8 * n if many else 0
        row = [doc.astype(np.int64) + base, var]
        for size in SENT:
            x = np.zeros((n, 8), np.uint8)
            x[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
            at += n * size
            row.append(x.view(np.uint64).reshape(-1))
        parts.append(row)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


#: Document, variant, first window, number of windows.
GONE = (np.int64, np.int64, np.int32, np.int32)


def _boxed(batches, done, box: Outbox) -> Iterator[pa.RecordBatch]:
    box.__init__(box.buckets)
    yield from _grouped(batches, done)
    yield from box.flush()


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parse(buckets: int, by_doc: int):
    """Texts -> phrases by trigger (kind 0), and windows that go (kind 1: doc, first window, number) by document."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        k, p, doc, var, first, n, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        gone = fold_first(doc, p, k)
        yield from box.add(1, doc[gone], var[gone], first[gone], n[gone])
        s = ~gone
        yield from _blobs(0, _bucket_of(k[s], buckets), tuple(x[s] for x in (doc, var, k, p, first, n, left, right)), lambda doc, var, *x: pack_phrases(doc, var, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        box.__init__(by_doc)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = text_buffer(batch.column(1))
                k, p, row, *rest = phrases(raw, at)
                held.append((k, p, batch.column(0).to_numpy(zero_copy_only=False)[row], batch.column(2).to_numpy(zero_copy_only=False)[row], *rest))
                size += len(raw)
                if size >= GATHER:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)
        yield from box.flush()

    box = Outbox(by_doc)
    return run


def _dictionary(by_doc: int):
    """Phrases by trigger -> windows that go (1), and first occurrences whose trigger has other phrases (2), by document."""

    def done(kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == 1:
            yield from box.add(1, *_unpack(blobs, GONE))
            return
        doc, var, k, p, first, n, left, right = unpack_phrases(blobs)
        gone = fold_first(doc, p << np.uint64(16) | right, k << np.uint64(16) | left)
        first, n = first.astype(np.int32), n.astype(np.int32)
        yield from box.add(1, doc[gone], var[gone], first[gone], n[gone])
        k, doc, var, first, n, left, right = (x[~gone] for x in (k, doc, var, first, n, left, right))
        # a shared window needs an equal side as well as the trigger, in two documents at least
        open_ = in_two(mix(k) + left, doc) | in_two(mix(k) + (right | np.uint64(1 << 20)), doc)
        yield from box.add(2, doc[open_], var[open_], first[open_], n[open_])

    box = Outbox(by_doc)
    return lambda batches: _boxed(batches, done, box)


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by document -> (doc_id, var, runs of windows as packed int32 pairs); touching runs are merged."""

    def done(_, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, var, first, n = _unpack(blobs, GONE)
        order = np.lexsort((first, var, doc))
        doc, var, first, n = doc[order], var[order], first[order].astype(np.int64), n[order].astype(np.int64)
        other = (doc[1:] != doc[:-1]) | (var[1:] != var[:-1])
        at = np.flatnonzero(np.concatenate(([True], other | (first[1:] > first[:-1] + n[:-1]))))
        last = np.maximum.reduceat(first + n, at)
        pairs = np.stack([first[at], last - first[at]], 1).astype(np.int32)
        d, v = doc[at], var[at]
        cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))))
        ends = np.concatenate((cut[1:], [len(d)]))
        yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(v[cut]), pa.array([pairs[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())], ["doc_id", "var", "runs"])

    return _grouped(batches, done)


def _runs(blob) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(blob or b"", np.int32).reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


#: Of each open phrase: trigger hash, document, variant, first window, number of windows, and its bytes.
OPEN = (np.uint64, np.int64, np.int64, np.int32, np.uint8)


def pack_open(k: np.ndarray, doc: np.ndarray, var: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray, raw: np.ndarray) -> bytes:
    body = raw[ragged(start, n.astype(np.int64) + LENGTH - 1)]
    return b"".join([np.array([len(k)], np.int64).tobytes(), *(x.astype(t).tobytes() for x, t in zip((k, doc, var, first, n), OPEN, strict=True)), body.tobytes()])


def unpack_open(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """The fields of OPEN, and the bytes of all phrases one after the other."""
    parts = []
    for blob in blobs:
        count, at, row = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
        for t in OPEN:
            row.append(np.frombuffer(blob, t, count, at))
            at += row[-1].nbytes
        parts.append((*row, np.frombuffer(blob, np.uint8, -1, at)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _open_phrases(buckets: int):
    """(doc_id, var, packed text, open windows) -> the bytes of the open phrases, by trigger."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        docs, vars_, firsts, texts = zip(*held, strict=True)
        raw = np.concatenate(texts)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        k, _, row, first, n, *_ = phrases(raw, at)
        doc, var, base = (np.array(x, np.int64)[row] for x in (docs, vars_, firsts))
        yield from _blobs(0, _bucket_of(k, buckets), (k, doc, var, first + base, n, at[row] + first), lambda *x: pack_open(*x, raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            for doc, var, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(unpack(text), np.uint8)
                for first, n in zip(*(x.tolist() for x in _runs(runs)), strict=True):
                    held.append((doc, var, first, raw[first : first + n + LENGTH - 1]))
                    size += n + LENGTH
                    if size >= 1 << 21:
                        yield from flush(held)
                        held, size = [], 0
        yield from flush(held)

    return run


def window_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the LENGTH bytes from each place (zeros beyond the end) in the order of bytes: a suffix array by prefix doubling.

    Ranks of 8 bytes double to 16 and 32; two overlapping ones of 32 make LENGTH. Equal strings have equal ranks.
    """
    padded = np.concatenate((data, np.zeros(2 * LENGTH, np.uint8)))
    word = np.zeros(len(data) + LENGTH, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | padded[j : j + len(word)]
    rank, reach = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while reach < LENGTH:
        step = min(reach, LENGTH - reach)
        pair = rank[:-step] * (len(rank) + 1) + rank[step:]
        rank, reach = np.unique(pair, return_inverse=True)[1].astype(np.int64), reach + step
    return rank[: len(data)]


def _order_windows(by_doc: int):
    """Open phrases by trigger -> windows that go (1), by document: equal windows are neighbours in the order of their bytes."""

    def done(kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, doc, var, first, n, data = unpack_open(blobs)
        n = n.astype(np.int64)
        start = np.concatenate(([0], np.cumsum(n + LENGTH - 1)[:-1]))
        place = ragged(start, n)
        own = np.repeat(np.arange(len(n)), n)
        gone = fold_first(doc[own], window_ranks(data)[place])
        at = own[gone]
        yield from box.add(1, doc[at], var[at], first[at] + (place[gone] - start[at]), np.ones(len(at), np.int32))

    box = Outbox(by_doc)
    return lambda batches: _boxed(batches, done, box)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text, the last column, as zstandard bytes, which makes its shuffle smaller."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([pack(t or b"") for t in texts], pa.binary())], batch.schema.names)


def kept_bytes(text: bytes, first: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and what is left, from runs of windows."""
    n = np.minimum(n, len(text) - LENGTH + 1 - first)
    first, n = first[n > 0], n[n > 0]
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + n + LENGTH - 1, -1)
    gone = np.cumsum(mark[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for text, runs in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            text = unpack(text)
            if runs:
                removed, spans, kept = kept_bytes(text, *(np.concatenate(x) for x in zip(*map(_runs, runs), strict=True)))
            else:
                removed, spans, kept = 0, 0, text
            out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")


def with_variants(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, text, var: var is 0, or the hash of the text where the doc_id has rows with different texts."""
    h = F.xxhash64("text")
    found = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b OR a IS NULL AND b IS NOT NULL").select("doc_id", F.lit(True).alias("several"))
    several = scratch.cut(found, "several")
    if several.isEmpty():
        return docs.select("doc_id", "text", F.lit(0).cast("long").alias("var"))
    return docs.join(side(several), "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), h).otherwise(0).alias("var"))


def repeated_windows(spark: SparkSession, scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, var, runs) of windows that go; docs (doc_id, text, var) has no nulls."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    settled = scratch.cut(dealt(docs.mapInArrow(_parse(buckets, parts), _BLOB), parts).mapInArrow(_dictionary(parts), _BLOB), "dictionary")
    scratch.release()
    by_document = lambda df: dealt(df, parts).mapInArrow(_per_document, "doc_id long, var long, runs binary")
    open_ = scratch.cut(by_document(settled.where("kind = 2")), "open")
    texts = docs.select("doc_id", "var", "text").mapInArrow(_pack, "doc_id long, var long, text binary")
    opened = texts.join(open_.hint("merge"), ["doc_id", "var"]).mapInArrow(_open_phrases(buckets), _BLOB)
    found = scratch.cut(dealt(opened, parts).mapInArrow(_order_windows(parts), _BLOB), "windows")
    scratch.release()
    return by_document(settled.where("kind = 1").union(found))


def repeats_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    scratch = Scratch(spark, "repeats")
    docs = with_variants(scratch, docs.select("doc_id", "text"))
    found = repeated_windows(spark, scratch, docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    runs = scratch.cut(found.groupBy("doc_id", "var").agg(F.collect_list("runs").alias("runs")), "runs")  # a few rows a document
    scratch.release()
    packed = docs.select("doc_id", "var", "text").mapInArrow(_pack, "doc_id long, var long, text binary")
    out = packed.join(runs.hint("merge"), ["doc_id", "var"], "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

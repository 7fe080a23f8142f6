"""Token ids as sorted-string-table shards, one file a range of document ids.

A shard holds documents in ascending key order. The key is the doc_id as 8 big-endian bytes with
the sign bit flipped, so byte order is numeric order. Data blocks keep keys prefix-compressed
(shared length, rest), with a restart every RESTART entries; the value is the document's ids as
little-endian uint16 (uint32 when an id does not fit), and a whole block is compressed with zstandard. Behind the
blocks stand a sparse index (last key, offset, length of each block), a Bloom filter of the keys, counts,
and a fixed footer. A lookup reads footer, filter and index, bisects the index and reads one block.

Rows that repeat a doc_id are entries of their own, in text order. Null doc_id sorts first and has an empty key.
Null or empty text encodes as the end id alone. Ties: equal rows are equal entries, one after the other. Very long texts are encoded as a
whole. An empty table gives no file and an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import SPACE, ragged, slices, span_hashes, text_buffer, word_bounds
from tessera.llm.shared import Scratch

MAGIC = b"TSSTABL1"
BLOCK_BYTES = 1 << 18
RESTART = 16
BLOOM_BITS = 10
#: index offset, bloom offset, meta offset, meta end, magic
FOOTER = struct.Struct("<QQQQ8s")


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def key_value(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Takes (key, value) in key order and writes one shard to a binary file object."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.size, self.in_block, self.last, self.index, self.keys = [], 0, 0, b"", [], []
        self.entries = self.ids = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        shared = 0
        if self.in_block % RESTART:
            shared = len(os.path.commonprefix([key, self.last]))
        wide = len(value) == 4 * n_ids and n_ids > 0
        head = _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(n_ids << 1 | wide)
        self.block += [head, value]
        self.size += len(head) + len(value)
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += n_ids
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data), self.in_block))
            self._write(data)
            self.block, self.size, self.in_block = [], 0, 0

    def close(self) -> None:
        self.flush()
        places = [self.at]
        self._write(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(c) for k, at, n, c in self.index))
        places.append(self.at)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = 1
        self._write(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        places.append(self.at)
        self._write(struct.pack("<QQ", self.entries, self.ids))
        places.append(self.at)
        self._write(FOOTER.pack(*places, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary file object."""

    def __init__(self, src):
        self.src = src
        src.seek(0, 2)
        end = src.tell()
        src.seek(end - FOOTER.size)
        index, bloom, meta, stop, magic = FOOTER.unpack(src.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        src.seek(index)
        rest = src.read(stop - index)
        data, self.index, at = rest[: bloom - index], [], 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            self.index.append((key, offset, size, count))
        filter_ = rest[bloom - index : meta - index]
        self.bits = struct.unpack_from("<Q", filter_)[0]
        self.bloom = filter_[8:]
        self.entries, self.ids = struct.unpack_from("<QQ", rest, meta - index)

    def blocks(self) -> Iterator[list[tuple[bytes, np.ndarray]]]:
        for i in range(len(self.index)):
            yield self.block(i)

    def block(self, i: int) -> list[tuple[bytes, np.ndarray]]:
        _, offset, size, count = self.index[i]
        self.src.seek(offset)
        data, at, key, out = zstandard.ZstdDecompressor().decompress(self.src.read(size)), 0, b"", []
        for _ in range(count):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            at += n
            n, at = _read_varint(data, at)
            kind, n = ("<u4" if n & 1 else "<u2"), n >> 1
            value = np.frombuffer(data, kind, n, at)
            at += value.nbytes
            out.append((key, value))
        return out

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each entry of doc_id; [] if there is none."""
        key, out = key_bytes(doc_id), []
        if not self.may_hold(key):
            return out
        i = bisect_left(self.index, key, key=lambda x: x[0])
        while i < len(self.index):
            found = [v for k, v in self.block(i) if k == key]
            if not found and out or not found and self.index[i][0] > key:
                break
            out += found
            if self.index[i][0] > key:
                break
            i += 1
        return out


def store(uri: str):
    """(file system, path) of a URI: pyarrow's, for executors; local paths need no scheme."""
    import pyarrow.fs as pafs

    if not urlsplit(uri).scheme or uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri).lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class WordEncoder:
    """Encodes texts by their distinct white-space words.

    The vocabulary drops white space and its rules never look across it, so a text's ids are those of
    its words, one after the other. Distinct words of a batch are encoded in one call, with a special token
    between them; words that could hold such a token are encoded alone.
    """

    GAP = "<|startoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.gap = self.tokenizer.token_to_id(self.GAP)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids as one array, with the start and length of each word in it."""
        start, length, flat, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.GAP.join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            gaps = np.flatnonzero(ids == self.gap)
            begin = np.concatenate(([0], gaps + 1))
            start[part], length[part] = at + begin, np.concatenate((gaps, [len(ids)])) - begin
            flat.append(ids)
            at += len(ids)
        for i in sorted(set(range(len(words))) - set(plain)):
            ids = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            start[i], length[i] = at, len(ids)
            flat.append(ids)
            at += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), start, length


class _Cache:
    """Ids by word hash, as flat arrays; bounded, and emptied when full."""

    def __init__(self, encoder: WordEncoder, most: int = 1 << 21):
        self.encoder, self.most = encoder, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) into flat for each word."""
        hashes = span_hashes(raw, starts, ends)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = first[~known]
            data = raw.tobytes()
            ids, start, length = self.encoder.words([data[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            start += len(self.flat)
            self.flat = np.concatenate((self.flat, ids))
            place = at[~known]  # both sides are sorted: a merge by insertion
            self.start, self.length, self.keys = np.insert(self.start, place, start), np.insert(self.length, place, length), np.insert(self.keys, place, keys[~known])
            at = np.searchsorted(self.keys, keys)
        return self.start[at][back], self.length[at][back]


@lru_cache(2)
def _worker_cache(vocabulary: str) -> _Cache:
    """One cache a Python worker, kept from task to task."""
    return _Cache(WordEncoder(vocabulary))


def encode_rows(cache: _Cache, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a text column, and the n + 1 offsets of its rows."""
    raw, at = text_buffer(column)
    starts, ends, first = word_bounds(raw, at, SPACE)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    start, length = cache.find(raw, starts, ends)
    return cache.flat[ragged(start, length)], np.concatenate(([0], np.cumsum(length)))[first]


def _write_shards(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        cache = _worker_cache(vocabulary)
        fs, base = store(folder)
        name = f"shard-{context.partitionId():06d}.sst"
        writing = f"{base}/_{name}-{context.taskAttemptId()}"
        fs.create_dir(base, recursive=True)
        out, writer, low, high = None, None, None, None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 23):
                ids, at = encode_rows(cache, batch.column(1))
                small = not len(ids) or int(ids.max()) < 1 << 16
                end = np.array([end_id], np.uint32)
                for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if writer is None:
                        out = fs.open_output_stream(writing)
                        writer, low = ShardWriter(out), doc
                    high = doc
                    value = np.concatenate((ids[a:b], end))
                    writer.add(key_bytes(doc), value.astype("<u2" if small else "<u4").tobytes(), b - a + 1)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(writing, f"{base}/{name}")  # whole or absent, also when a task runs twice
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (context.partitionId(), name, writer.entries, writer.ids)], ["shard", "file", "entries", "ids"])

    return run


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write docs as shards in ascending doc_id order; the manifest: shard, file, entries, ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(_write_shards(folder, vocabulary, end_id), "shard long, file string, entries long, ids long")


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with fs.open_input_file(f"{base}/{row['file']}") as src:
                    for block in ShardReader(src).blocks():
                        docs, starts, sizes, sums = [], [], [], []
                        for key, ids in block:
                            docs.append(key_value(key))
                            starts.append(start)
                            sizes.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digest(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files. The manifest has one row a shard."""
    rows, start = [], 0
    for m in sorted(manifest, key=lambda m: m["shard"]):
        rows.append((m["file"], start))
        start += m["ids"]
    shards = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)), "file")
    return shards.mapInArrow(_read_shards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def sstable_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the shards below the shared folder (or `folder`), then read them back."""
    folder = folder or Scratch(spark, "sstable").path("shards")
    return read_digest(spark, folder, write_shards(docs, folder, vocabulary, end_id).collect())

"""Phrase collocations: candidates by sketch upper bounds, exact counts by Aho-Corasick automata shard by shard.

1. Texts are lower-cased, cut into pieces and words, and written as shards: a shard is a MB or so of one language, its pieces
   one a line with a blank around each word. Each shard sends the counts of its words, and for its pairs and triples of words the cells (bucket and
   40 bits of a 64-bit hash) with their counts. Cells are summed over all shards; as equal phrases share a cell, a
   cell's sum is an upper bound of the count of each of its phrases. Every shard gets back which of its own cells reach the minimum.
2. A shard's candidates are the pairs and triples of such cells, and runs of 4 and 5 words all of whose triples are. They
   compile, with the blanks as delimiters around them, into automata of a bounded number of patterns. A scan of the shard counts all matches, overlapping ones
   too. Counts are summed in the task, then over all shards; phrases under the minimum go.
3. Parts of a candidate are at least as frequent as it is, so their counts are among those of step 2 or of the words. Each candidate is joined with the
   parts of its cuts; its lowest cut is its score. Candidates inside a longer one of the same count go. The first of each language
   are picked in two steps, so that no task holds a language.

No count is sampled or capped. Null lang is `und`, null text is empty. Empty pieces have no words. Rows that repeat count as often as they
stand. doc_id isn't read, so it may be null or repeat; only text and lang are, so other columns may have any names. Ties in score go to the higher count, then to the
phrase in byte order; ties of cuts go to the first. A very long text makes a shard of its own size. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.kernels import mix, slices, span_hashes
from tessera.llm.shared import Scratch

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: A longer candidate with this percentage of a candidate's count takes its place.
INSIDE = 100
#: Bytes of a shard, patterns of an automaton, and phrases that a task sums before it sends them.
SHARD, PATTERNS, HELD = 1 << 20, 1 << 15, 1 << 17

#: Pieces end at `[.,;:!?\x0A-\x0D]`, words at `[\x20\x09]`.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + bytes(range(65, 91)), b"\n" * 9 + b" " + bytes(range(97, 123)))


def normal(text: bytes) -> bytes:
    """Pieces one a line, with a blank before and after each word; lower case; pieces without words go."""
    out = []
    for piece in text.translate(_PIECES).split(b"\n"):
        words = [w for w in piece.split(b" ") if w]
        if words:
            out.append(b" " + b" ".join(words) + b" \n")
    return b"".join(out)


def _normalized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (shard, lang, body): the texts of a language in a task, SHARD bytes at a time, compressed."""
    from uuid import uuid4

    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        body = zstandard.ZstdCompressor(3).compress(b"".join(held.pop(lang)))  # a row well under half a megabyte
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([uuid4().hex]), pa.array([lang]), pa.array([body], pa.binary())], ["shard", "lang", "body"])

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                lang = "und" if lang is None else lang
                if not (body := normal(text or b"")):
                    continue
                held.setdefault(lang, []).append(body)
                size[lang] = size.get(lang, 0) + len(body)
                if size[lang] >= SHARD:
                    yield out(lang)
            # many languages in one task: the largest go first
            while sum(size.values()) >= 8 * SHARD:
                yield out(max(size, key=size.get))
    for lang in list(held):
        yield out(lang)


class Grams:
    """Words of a shard's body, with the hashes of its runs of words; `valid[k]`: starts of runs of k words within a piece."""

    def __init__(self, body: bytes, lang: str):
        self.raw = np.frombuffer(body, np.uint8)
        blank, line = self.raw == 32, self.raw == 10
        inside = ~(blank | line)
        self.starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        self.ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
        self.piece = np.searchsorted(np.flatnonzero(line), self.starts)
        self.words = span_hashes(self.raw, self.starts, self.ends)
        self.salt = span_hashes(np.frombuffer(lang.encode() or b"\0", np.uint8), np.array([0]), np.array([max(1, len(lang.encode()))]))[0]

    def valid(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :]) if len(self.piece) >= k else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        total = np.full(len(at), self.salt + np.uint64(k), np.uint64)
        for j in range(k):
            total = mix(total ^ self.words[at + j])
        return total

    def spell(self, at: np.ndarray, k: int) -> list[str]:
        """The words themselves, with the blanks around them."""
        body = self.raw.tobytes()
        return [body[a - 1 : b + 1].decode() for a, b in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist(), strict=True)]


#: A cell is a bucket of 24 bits, modulo the number of buckets, and the other 40 bits of the hash.
def cells(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFFFF000000)) | (h & np.uint64(0xFFFFFF)) % np.uint64(buckets)


def pack_cells(cell: np.ndarray, count: np.ndarray) -> bytes:
    """5 bytes a cell and 1 byte a count, or 8 where one doesn't fit."""
    wide = bool(len(count)) and int(count.max()) > 255
    return bytes([wide]) + np.ascontiguousarray(cell.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes() + count.astype(np.int64 if wide else np.uint8).tobytes()


def unpack_cells(blob: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    wide = blob[0]
    n = (len(blob) - 1) // (13 if wide else 6)
    cell = np.zeros((n, 8), np.uint8)
    cell[:, 3:] = np.frombuffer(blob, np.uint8, 5 * n, 1).reshape(n, 5)
    count = np.frombuffer(blob, np.uint8, offset=1 + 5 * n)
    return cell.view(np.uint64).reshape(-1) | np.uint64(bucket), (count.view(np.int64) if wide else count).astype(np.int64)


def each_shard(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one at a time, as their values are large, with the body as it was."""
    at = batch.schema.get_field_index("body")
    for i in range(batch.num_rows):
        yield tuple(zstandard.ZstdDecompressor().decompress(c[i].as_py()) if k == at else c[i].as_py() for k, c in enumerate(batch.columns))


_COUNTS = "bucket int, lang string, phrases array<string>, counts array<long>"
_SENT = "bucket int, shard string, blob binary, lang string, phrases array<string>, counts array<long>, total long"
_SENT_TYPES = [pa.int32(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]


def _sent(size: int, **columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, _SENT_TYPES, strict=True)], names)


def by_bucket(b: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket starts in it (one more at the end)."""
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def _sketch(buckets: int):
    """Shards -> cells of pairs and triples by bucket, counts of words by bucket, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, body in each_shard(batch):
                g = Grams(body, lang)
                yield _sent(1, lang=[lang], total=[len(g.words)])
                word, first, n = np.unique(g.words, return_index=True, return_counts=True)
                order, at = by_bucket(word % np.uint64(buckets), buckets)
                words, counts = [w[1:-1] for w in g.spell(first[order], 1)], n[order].tolist()
                cell, n = np.unique(cells(np.concatenate([g.hashes(g.valid(k), k) for k in (2, 3)]), buckets), return_counts=True)
                order, of = by_bucket(cell & np.uint64(0xFFFFFF), buckets)
                cell, n = cell[order], n[order]
                some = np.flatnonzero((np.diff(at) > 0) | (np.diff(of) > 0)).tolist()  # a row a bucket, with its words and its cells
                yield _sent(
                    len(some), bucket=some, shard=[shard] * len(some), lang=[lang] * len(some),
                    blob=[pack_cells(cell[of[i] : of[i + 1]], n[of[i] : of[i + 1]]) if of[i] < of[i + 1] else None for i in some],
                    phrases=[words[at[i] : at[i + 1]] for i in some], counts=[counts[at[i] : at[i + 1]] for i in some],
                )

    return run


def _passed(least: int):
    """(bucket, shard, blob), sorted by bucket -> (shard, blob): the shard's cells whose sum reaches the minimum."""

    def done(bucket: int, shards: list[str], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cell, n = (np.concatenate(x) for x in zip(*(unpack_cells(b, bucket) for b in blobs), strict=True))
        every, back = np.unique(cell, return_inverse=True)
        total = np.bincount(back, n, len(every))
        passed = every[total >= least]
        if not len(passed):
            return
        names, out = [], []
        for shard, blob in zip(shards, blobs, strict=True):
            mine = unpack_cells(blob, bucket)[0]
            at = np.minimum(np.searchsorted(passed, mine), len(passed) - 1)
            if len(mine := mine[passed[at] == mine]):
                names.append(shard)
                out.append(mine.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shards, blobs = None, [], []
        for batch in batches:
            for bucket, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and blobs:
                    yield from done(now, shards, blobs)
                    shards, blobs = [], []
                now = bucket
                shards.append(shard)
                blobs.append(blob)
        if blobs:
            yield from done(now, shards, blobs)

    return run


def candidates(g: Grams, passed: np.ndarray, buckets: int, longest: int) -> list[str]:
    """The shard's distinct runs of 2 words and more that can reach the minimum, with blanks around."""
    out: list[str] = []
    ok = {}
    for k in range(2, longest + 1):
        at = g.valid(k)
        if k <= 3:
            cell = cells(g.hashes(at, k), buckets)
            place = np.minimum(np.searchsorted(passed, cell), len(passed) - 1)
            good = passed[place] == cell
            if k == 3:
                good &= ok[2][at] & ok[2][at + 1]
        else:
            good = ok[k - 1][at] & ok[k - 1][at + 1]
        flags = np.zeros(len(g.words) + 1, bool)
        flags[at[good]] = True
        ok[k] = flags
        at = at[good]
        if not len(at):
            break
        _, first = np.unique(g.hashes(at, k), return_index=True)
        out += g.spell(at[first], k)
    return out


def matches(body: str, patterns: list[str], most: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Patterns, some at a time, and how often each stands in the body; matches may overlap."""
    for i in range(0, len(patterns), most):
        part = patterns[i : i + most]
        tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for j, p in enumerate(part):
            tree.add_word(p, j)
        tree.make_automaton()
        found = np.fromiter((j for _, j in tree.iter(body)), np.int64)
        yield part, np.bincount(found, minlength=len(part))


def _counts(bucket: list, lang: list, phrases: list, counts: list) -> pa.RecordBatch:
    cols = [pa.array(bucket, pa.int32()), pa.array(lang, pa.string()), pa.array(phrases, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "lang", "phrases", "counts"])


def _scan(buckets: int, longest: int):
    """(lang, body, blobs of cells) -> exact counts of the shards' candidates, summed in the task, a row a language and bucket."""

    def flush(sums: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, found in sums.items():
            by: dict[int, tuple[list, list]] = {}
            for phrase, n in found.items():
                phrases, counts = by.setdefault(zlib.crc32(phrase.encode()) % buckets, ([], []))
                phrases.append(phrase)
                counts.append(n)
            yield _counts(list(by), [lang] * len(by), [p for p, _ in by.values()], [n for _, n in by.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, body, blobs in each_shard(batch):
                passed = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]))
                mine = sums.setdefault(lang, {})
                for part, n in matches(body.decode(), candidates(Grams(body, lang), passed, buckets, longest), PATTERNS):
                    for p, k in zip(part, n.tolist(), strict=True):
                        p = p[1:-1]
                        mine[p] = mine.get(p, 0) + k
                if sum(map(len, sums.values())) >= HELD:
                    yield from flush(sums)
                    sums = {}
        yield from flush(sums)

    return run


def _sum(least: int):
    """Counts, sorted by bucket and language -> (lang, phrase, words, n) of at least so many."""

    def out(lang: str, sums: dict[str, int]) -> pa.RecordBatch:
        found = [(p, n) for p, n in sums.items() if n >= least]
        cols = [pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([p.count(" ") + 1 for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}
        for batch in batches:
            for bucket, lang, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (bucket, lang):
                    if sums:
                        yield out(now[1], sums)
                    now, sums = (bucket, lang), {}
                for p, n in zip(phrases, counts, strict=True):
                    sums[p] = sums.get(p, 0) + n
        if sums:
            yield out(now[1], sums)

    return run


def phrase_counts(spark: SparkSession, scratch: Scratch, docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 words and more with at least so many occurrences (lang, phrase, words, n); words with as many (lang, word, n); words of each language (lang, n)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts  # a bucket at a time is in a task's memory
    shards = scratch.cut(docs.select("lang", "text").mapInArrow(_normalized, "shard string, lang string, body binary"), "shards")
    sent = scratch.cut(shards.mapInArrow(_sketch(buckets), _SENT), "cells")
    summed = lambda counts: counts.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_sum(least), "lang string, phrase string, words int, n long")
    words = scratch.cut(summed(sent.where("phrases IS NOT NULL").select("bucket", "lang", "phrases", "counts")).select("lang", F.col("phrase").alias("word"), "n"), "words")
    totals = scratch.cut(sent.where("total IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    passed = scratch.cut(sent.where("blob IS NOT NULL").select("bucket", "shard", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_passed(least), "shard string, blob binary"), "passed")
    scratch.drop(sent)
    # what a shard gets back are cells of its own text, so a row's list is no longer than that
    back = passed.groupBy("shard").agg(F.collect_list("blob").alias("blobs"))
    counted = shards.join(back.hint("merge"), "shard").select("lang", "body", "blobs").mapInArrow(_scan(buckets, longest), _COUNTS)
    phrases = scratch.cut(summed(counted), "phrases")
    scratch.drop(shards, passed)
    return phrases, words, totals


def collocations(spark: SparkSession, docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    scratch = Scratch(spark, "collocations")
    phrases, words, totals = phrase_counts(spark, scratch, docs, least, longest)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.split("phrase", " ")
    # parts that a longer candidate with as many occurrences covers
    subs = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> concat_ws(' ', slice(w, i, k)))))")
    covered = phrases.where("words > 2").withColumn("w", split).select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(subs)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = phrases.join(covered.hint("merge"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("n"))).select("lang", "phrase", "words", F.col("n").alias("a"))
    # every cut of a candidate meets the counts of its two parts
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count")).union(words.select("lang", F.col("word").alias("part"), F.col("n").alias("count")))
    cuts = left.withColumn("w", split).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("concat_ws(' ', slice(w, 1, k))").alias("head"), F.expr("concat_ws(' ', slice(w, k + 1, words - k))").alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("count").alias("l")).hint("merge"), ["lang", "head"]).join(known.select("lang", F.col("part").alias("tail"), F.col("count").alias("r")).hint("merge"), ["lang", "tail"])
    # a row a language: too few to be worth a shuffle of the cuts, and checked by count
    few = totals if totals.count() > 1 << 17 else F.broadcast(totals)
    score = F.expr("(CAST(1000 * a AS decimal(18, 0)) * CAST(n AS decimal(19, 0))) div (CAST(l AS decimal(18, 0)) * CAST(r AS decimal(19, 0)))")
    scored = cuts.join(few, "lang").withColumn("score", score.cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM cut, range(1, 6) t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM runs GROUP BY ALL
), total AS (
  SELECT lang, sum(n)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY 1
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 100
), parts AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, range(2, 5) s(m), range(1, 5) t(i) WHERE m < k AND i + m - 1 <= k
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN parts p ON c.lang = p.lang AND c.phrase = p.phrase WHERE 100 * p.a >= 100 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM c ANTI JOIN gone g ON c.lang = g.lang AND c.phrase = g.phrase, range(1, 5) t(j) WHERE j < k
), scored AS (
  SELECT x.lang, x.phrase, x.a, h.n AS l, t.n AS r, total.n AS n, 1000 * x.a * total.n // (h.n * t.n) AS score, j
  FROM cuts x JOIN f h ON x.lang = h.lang AND x.head = h.phrase JOIN f t ON x.lang = t.lang AND x.tail = t.phrase JOIN total ON x.lang = total.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""

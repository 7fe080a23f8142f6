"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lowered. A first pass counts the benchmark's words over the whole corpus; the tasks' counts are added on
the executors. A benchmark n-gram is rare when its words, taken as independent at those counts, would make it fewer than RARE times a million
positions; copies of an item of more than 12 words can't make its seeds common that way.
A second pass looks up the corpus' n-grams among the items'; seeds on about the same diagonal of a document and an item give one passage.
Passages with a rare seed, with SHARE of the item's seeds and WHOLE of them at least, or with all its different seeds, are aligned with their item in the same task
(match 2, mismatch -1, gap -1), so edited and paraphrased copies score too; other passages are never written.
A document and item are reported when the best alignment has SHARE of the item's full score, and at least MIN_SCORE or, for shorter items,
that full score; or when it has RUN, whatever the item's length. So exact copies of an item are found however common its words are.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words, as counted here, and items (or one item), two corpus passes a block.
Null or empty texts have no words. Items with fewer than n words match nothing. Null doc_id or item_id: a match is
reported with the null id. Rows that repeat a doc_id report once; rows that repeat an item count once, and items that share an item_id report the best
of them. Ties: of equally good passages the later end is given. Very long texts are searched as a whole. An empty corpus or benchmark gives an empty result.
Only doc_id and text, item_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import ragged, slices, span_hashes, text_buffer, word_bounds
from tessera.llm.shared import Scratch, add_vectors, vector_rows

GRAM, DRIFT, MARGIN = 3, 8, 12
RARE = 20.0
SHARE, MIN_SCORE, RUN = 0.35, 14, 26
WHOLE = 5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1 << 20
#: Words of passages that a task gathers, and cells of one table of alignments.
CELLS = 1 << 20
COUNT_BLOCKS, COUNT_SALTS = 4, 8

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = False
_BREAK[128:] = False
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


class Index:
    """Words and n-grams of a block of items."""

    def __init__(self, items: list[tuple]):
        self.names = [i for i, _ in items]
        raw, at = text_buffer(pa.array([t or "" for _, t in items], pa.string()))
        starts, ends, first = word_bounds(raw, at, _BREAK)
        hashes = span_hashes(raw, starts, ends, lower=True)
        self.words = np.unique(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.words & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        ids = np.searchsorted(self.words, hashes).astype(np.int32)
        self.items = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        item = np.repeat(np.arange(len(items)), np.diff(first))
        place = np.arange(len(ids)) - first[item] if len(ids) else np.zeros(0, np.int64)
        code, whole = self.codes(ids, item)
        code, item, place = code[whole], item[: len(whole)][whole], place[: len(whole)][whole]
        order = np.argsort(code, kind="stable")
        self.grams, self.begin = np.unique(code[order], return_index=True)
        self.count = np.diff(np.concatenate((self.begin, [len(order)])))
        self.item, self.place = item[order], place[order]
        kinds = np.unique(np.stack((self.item, np.repeat(np.arange(len(self.grams)), self.count))), axis=1)
        self.kinds = np.bincount(kinds[0].astype(np.int64), minlength=len(items))

    def codes(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-gram code at each position, and where all its words are known and of one text."""
        n = max(0, len(ids) - GRAM + 1)
        code, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(GRAM):
            code = code * len(self.words) + ids[k : k + n]
            whole &= ids[k : k + n] >= 0
        return code, whole & (doc[:n] == doc[GRAM - 1 : GRAM - 1 + n])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), max(0, len(self.words) - 1))
        good = self.words[at] == hashes[maybe] if len(self.words) else np.zeros(0, bool)
        out[maybe[good]] = at[good]
        return out


def _word_counts(shared):
    """Texts -> the task's counts of the benchmark's words, and of all words as the last number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        counts = np.zeros(len(index.words) + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = text_buffer(batch.column(0))
                starts, ends, _ = word_bounds(raw, at, _BREAK)
                ids = index.ids(span_hashes(raw, starts, ends, lower=True))
                counts[:-1] += np.bincount(ids[ids >= 0], minlength=len(index.words))
                counts[-1] += len(starts)
        yield vector_rows(counts, COUNT_BLOCKS)

    return run


def rare_grams(index: Index, counts: np.ndarray) -> np.ndarray:
    """For each n-gram of the index: is it rare at these word counts?"""
    p = (counts[:-1] + 1) / (counts[-1] + len(counts))
    expected, code = np.ones(len(index.grams)), index.grams.copy()
    for _ in range(GRAM):
        expected *= p[code % max(1, len(p))]
        code //= max(1, len(p))
    return expected * 1e6 < RARE


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of an item with each passage, and the passage place where it ends."""
    width = max(map(len, passages))
    table = np.full((len(passages), width), -1, np.int32)
    for row, p in zip(table, passages, strict=True):
        row[: len(p)] = p
    h = np.zeros((len(passages), width + 1), np.int32)
    best, where = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int64)
    drop = GAP * np.arange(width + 1, dtype=np.int32)
    for word in item:
        now = np.zeros_like(h)
        now[:, 1:] = np.maximum(h[:, :-1] + np.where(table == word, MATCH, MISMATCH), h[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now - drop, axis=1) + drop  # gaps along the passage
        h = now
        top = h.argmax(1)
        value = h[np.arange(len(h)), top]
        better = value > best
        best[better], where[better] = value[better], top[better]
    return best, where


def stacks(passages: list[np.ndarray], cells: int = CELLS) -> Iterator[list[int]]:
    """Passages of similar length, some at a time, whose table has a bounded number of cells (or is one passage)."""
    order = sorted(range(len(passages)), key=lambda i: len(passages[i]))
    part: list[int] = []
    for i in order:
        if part and (len(part) + 1) * len(passages[i]) > cells:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _found(shared, rare_shared, share: float, least: int):
    """Texts -> (doc_id, item, score, full, end_word) of the passages that align."""

    def flush(index: Index, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for item, rows in held.items():
            full = MATCH * len(index.items[item])
            for part in stacks([words for _, _, words in rows]):
                score, end = align(index.items[item], [rows[i][2] for i in part])
                good = np.flatnonzero((score >= min(least, full)) & (score >= share * full) | (score >= RUN))
                if len(good):
                    hit = [rows[part[k]] for k in good]
                    cols = [[d for d, _, _ in hit], [item] * len(hit), score[good], [full] * len(hit), [s + int(e) for (_, s, _), e in zip(hit, end[good], strict=True)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item", "score", "full", "end_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rare = shared.value, rare_shared.value
        length = np.array([len(w) for w in index.items])
        needed = np.minimum(index.kinds, np.maximum(WHOLE, share * np.maximum(0, length - GRAM + 1)))
        held, size = {}, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = text_buffer(batch.column(1))
                starts, ends, first = word_bounds(raw, at, _BREAK)
                if not len(starts) or not len(index.grams):
                    continue
                ids = index.ids(span_hashes(raw, starts, ends, lower=True))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                code, ok = index.codes(ids, doc)
                pos = np.flatnonzero(ok)
                g = np.minimum(np.searchsorted(index.grams, code[pos]), len(index.grams) - 1)
                hit = index.grams[g] == code[pos]
                pos, g = pos[hit], g[hit]
                if not len(pos):
                    continue
                n = index.count[g]
                post = ragged(index.begin[g], n)
                pos, g, item = np.repeat(pos, n), np.repeat(g, n), index.item[post]
                diagonal = pos - index.place[post]
                d = doc[pos]
                order = np.lexsort((diagonal, item, d))
                d, item, diagonal, g = d[order], item[order], diagonal[order], g[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > DRIFT)))
                begin = np.flatnonzero(new)
                end = np.concatenate((begin[1:], [len(d)]))
                # different seeds of each passage
                group = np.repeat(np.arange(len(begin)), end - begin)
                by = np.lexsort((g, group))
                fresh = np.concatenate(([True], (group[by][1:] != group[by][:-1]) | (g[by][1:] != g[by][:-1])))
                seeds = np.bincount(group[by][fresh], minlength=len(begin))
                for k in np.flatnonzero(np.logical_or.reduceat(rare[g], begin) | (seeds >= needed[item[begin]])).tolist():
                    dd, ii = int(d[begin[k]]), int(item[begin[k]])
                    low, high = max(int(first[dd]), int(diagonal[begin[k]]) - MARGIN), min(int(first[dd + 1]), int(diagonal[end[k] - 1] + length[ii]) + MARGIN)
                    held.setdefault(ii, []).append((batch.column(0)[dd].as_py(), low - int(first[dd]), ids[low:high].copy()))
                    size += high - low
                if size >= CELLS:
                    yield from flush(index, held)
                    held, size = {}, 0
        yield from flush(index, held)

    return run


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Different items in blocks of bounded size, streamed through the driver."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = 1 + len(_WORD.findall(r["text"] or ""))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score (share of the item's full score), n_copies, end_word: a row for each document and item that align."""
    scratch, sc, out = Scratch(spark, "decontamination"), spark.sparkContext, None
    docs = docs.select("doc_id", "text")
    for items in blocks(benchmark):
        index = Index(items)
        shared = sc.broadcast(index)  # at most BLOCK_WORDS words and items
        counts = add_vectors(docs.select("text").mapInArrow(_word_counts(shared), "block int, sums binary"), len(index.words) + 1, COUNT_BLOCKS, COUNT_SALTS)
        rare = sc.broadcast(rare_grams(index, counts))
        found = docs.mapInArrow(_found(shared, rare, share, least), "doc_id long, item int, score long, full long, end_word long")
        names = spark.createDataFrame([(i, n) for i, n in enumerate(index.names)], "item int, item_id long")
        named = found.join(F.broadcast(names), "item").withColumn("score", F.col("score") / F.col("full"))
        best = scratch.cut(named.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("m"), F.count("*").alias("n_copies")), "found")
        out = best if out is None else out.union(best)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, n_copies long, end_word long")
    out = out.groupBy("doc_id", "item_id").agg(F.max("m").alias("m"), F.sum("n_copies").alias("n_copies"))
    return out.select("doc_id", "item_id", F.col("m.score").alias("score"), "n_copies", F.col("m.end_word").alias("end_word"))

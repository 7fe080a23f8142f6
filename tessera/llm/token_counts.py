"""Token counts of a unigram model, with one trie of distinct pre-tokens for each batch.

A pre-token is a white-space word with a space before it. The vocabulary is a public rank file of
byte tokens, all of which count, however long; the score of rank r is -ln(r + 2), a Zipf prior that nothing trains.
The best segmentation of a prefix serves every word that starts with it: distinct words are
sorted, their trie is filled level by level, and the forward score of a node is the best over the
tokens that end there. Terminal nodes hold the number of tokens. Ties go to fewer tokens.
The trie is local to a task's batch, so nothing is shuffled and memory has a bound.

Null or empty text: no pre-tokens, 0 tokens. Null doc_id and rows that repeat are counted like any other. Very long texts are cut into words as a
whole. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names. Every byte is a token, so every text has a segmentation.
Levels beyond LONG bytes, which only a few words reach, go on word by word with the same rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.kernels import _TABLE, mix, powers, ragged, slices, span_hashes, text_buffer, word_bounds
from tessera.sources.shipping import ship

LONG = 96


class Vocabulary:
    """Tokens by length and hash, with a bit table that answers most misses."""

    BITS = 22

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.scores = {t: -float(np.log(r + 2.0)) for t, r in ranks.items()}
        self.lengths = sorted(set(map(len, self.scores)))
        self.longest = self.lengths[-1]
        data = b"".join(self.scores)
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, self.scores), np.int64, len(self.scores)))
        keys = span_hashes(raw, ends - np.fromiter(map(len, self.scores), np.int64, len(self.scores)), ends)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(self.scores.values(), np.float64, len(keys))[order]
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are tokens, and the scores of those."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        good = self.keys[at] == hashes[maybe]
        return maybe[good], self.values[at[good]]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_one(word: bytes, v: Vocabulary, score: list[float] | None = None, count: list[int] | None = None) -> int:
    """The same rule on one word, from given forward scores of a prefix on."""
    score, count = list(score or [0.0]), list(count or [0])
    for end in range(len(score), len(word) + 1):
        best, n = -np.inf, 0
        for size in v.lengths:
            if size > end:
                break
            s = v.scores.get(word[end - size : end])
            if s is not None:
                t, c = score[end - size] + s, count[end - size] + 1
                if t > best or t == best and c < n:
                    best, n = t, c
        score.append(best)
        count.append(n)
    return count[-1]


def trie_counts(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Tokens of each distinct word."""
    if not words:
        return np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=words.__getitem__)
    ranked = [words[i] for i in order]
    size = np.fromiter(map(len, ranked), np.int64, len(ranked))
    depth = int(min(size.max(), LONG))
    # bytes of the first LONG places; rows are sorted, so equal prefixes stand together
    table = np.zeros((len(ranked), depth), np.uint8)
    raw = np.frombuffer(b"".join(ranked), np.uint8)
    start = np.cumsum(size) - size
    n = np.minimum(size, depth)
    rows = np.repeat(np.arange(len(ranked)), n)
    table[rows, ragged(np.zeros(len(n), np.int64), n)] = raw[ragged(start, n)]
    up, down = powers(depth + 1)
    result = np.zeros(len(ranked), np.int64)
    alive = np.arange(len(ranked))  # words that reach the level
    node = np.zeros(len(ranked), np.int64)  # node of each living word at the level above
    sums, best, count, parent = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    long_rows = np.flatnonzero(size > depth)
    sizes = set(v.lengths)
    for d in range(1, depth + 1):
        keep = size[alive] >= d
        alive, node = alive[keep], node[keep]
        byte = table[alive, d - 1]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        up_to, own = node[new], np.cumsum(new) - 1
        total = sums[-1][up_to] + _TABLE[byte[new]] * up[d - 1]
        score, tokens = np.full(len(up_to), -np.inf), np.zeros(len(up_to), np.int64)
        above = up_to
        for k in range(1, min(v.longest, d) + 1):
            begin = d - k
            if k in sizes:
                hit, s = v.find(mix((total - sums[begin][above]) * down[begin] + np.uint64(k)))
                if len(hit):
                    t, c = best[begin][above[hit]] + s, count[begin][above[hit]] + 1
                    better = (t > score[hit]) | (t == score[hit]) & (c < tokens[hit])
                    score[hit[better]], tokens[hit[better]] = t[better], c[better]
            if begin:
                above = parent[begin][above]
        sums.append(total)
        best.append(score)
        count.append(tokens)
        parent.append(up_to)
        if d - v.longest > 0:  # levels that no token reaches any more
            if not len(long_rows):
                sums[d - v.longest] = best[d - v.longest] = None
        node = own
        done = size[alive] == d
        result[alive[done]] = tokens[node[done]]
    if len(long_rows):
        where = np.searchsorted(alive, long_rows)
        for r, i in zip(long_rows.tolist(), node[where].tolist(), strict=True):
            path = []
            for d in range(depth, -1, -1):
                path.append((float(best[d][i]), int(count[d][i])))
                i = parent[d][i]
            path.reverse()
            result[r] = count_one(ranked[r], v, [p[0] for p in path], [p[1] for p in path])
    out = np.empty(len(words), np.int64)
    out[order] = result
    return out


def _counts(path: str, limit: int = 1 << 24):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, "text", limit):
                raw, at = text_buffer(batch.column(1))
                hashes, words, keys, firsts = [], [], [], []
                starts, ends, first = word_bounds(raw, at)
                n = np.zeros(len(starts), np.int64)
                if len(starts):
                    h = np.empty(len(starts), np.uint64)
                    step = 1 << 21
                    a = 0
                    while a < len(starts):  # hashes of a piece at a time, for memory
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + step)))
                        h[a:b] = span_hashes(raw[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
                        a = b
                    _, i, back = np.unique(h, return_index=True, return_inverse=True)
                    data = raw.tobytes()
                    n = trie_counts([b" " + data[s:e] for s, e in zip(starts[i].tolist(), ends[i].tolist(), strict=True)], v)[back]
                total = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(total[first[1:]] - total[first[:-1]])], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of docs."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_counts(path), "doc_id long, n_pretokens long, n_tokens long")

"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of one character class (lower case and non-ASCII, upper case, digits, other); a run of two or more
capitals counts by its length alone. A token's hash picks one of VOCABULARY rows. Each row has a fixed sparse index
vector of signs; a row's context vector is the sum of its neighbours' index vectors (two on each side) over all
documents. Tasks add up whole numbers, so the sum is exact in any order and its size is fixed: VOCABULARY x WIDTH.
A document's features are the mean and the standard deviation of its tokens' unit context vectors.
A two-layer network is fitted in numpy to labelled rows that are not held out, on a sample of at most SAMPLE
rows (the smallest hashes of doc_id and features); a temperature fitted on a fifth of them calibrates its probabilities.

Null or empty text has features of 0 and is scored. Null doc_id: not held out, never a label. Labels that are null
are left out; the lowest counts where a document has several. Without labels of both classes every score is the share of
label 1 (0.5 without labels). Labels, lang, source and doc_id are never inputs of a score. Rows that repeat are scored each and
learned from once; a doc_id that repeats with other texts has its label for each. Ties of the sample's hashes go by doc_id. Very long
texts count as a whole. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import SPACE, mix, slices, span_hashes, text_buffer
from tessera.llm.shared import Scratch, add_vectors, vector_rows

VOCABULARY, WIDTH, SIGNS, REACH = 1 << 14, 32, 4, 2
#: Labelled rows that the network is fitted to at most.
SAMPLE = 20_000
THRESHOLD = 0.7
BLOCKS, SALTS = 16, 8

_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[SPACE] = 0


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, WIDTH, (VOCABULARY, SIGNS)), rng.choice([-1, 1], (VOCABULARY, SIGNS))


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the vocabulary of each token, and the n + 1 offsets of the documents."""
    kind = _CLASS[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    bound = np.flatnonzero(change)
    starts, ends = bound[:-1], bound[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = span_hashes(raw, starts, ends)
    size = ends - starts
    capitals = (kind[starts] == 2) & (size > 1)
    h[capitals] = mix(np.minimum(size[capitals], 6).astype(np.uint64))
    return (h >> np.uint64(50)).astype(np.int64), np.searchsorted(starts, at)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(VOCABULARY * WIDTH)
    for whole in batches:
        for batch in slices(whole, "text"):
            t, first = tokens(*text_buffer(batch.column(0)))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for k in range(1, REACH + 1):
                same = doc[k:] == doc[:-k]
                a, b = t[:-k][same], t[k:][same]
                for to, of in ((a, b), (b, a)):
                    for s in range(SIGNS):
                        total += np.bincount(to * WIDTH + place[of, s], sign[of, s], VOCABULARY * WIDTH)
    yield vector_rows(total, BLOCKS)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors, VOCABULARY x WIDTH: a fixed size, whatever the corpus."""
    parts = docs.select("text").mapInArrow(_contexts, "block int, sums binary")
    out = add_vectors(parts, VOCABULARY * WIDTH, BLOCKS, SALTS)
    c = out.reshape(VOCABULARY, WIDTH).astype(np.float64)
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                t, first = tokens(*text_buffer(batch.column(1)))
                n = np.diff(first)
                out = np.zeros((len(n), 2 * WIDTH), np.float32)
                some = np.flatnonzero(n)
                if len(some):
                    v = vectors[t]
                    mean = np.add.reduceat(v, first[:-1][some], axis=0, dtype=np.float64) / n[some, None]
                    v *= v
                    square = np.add.reduceat(v, first[:-1][some], axis=0, dtype=np.float64) / n[some, None]
                    out[some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "x"])

    return run


class Network:
    """Two layers; standardised inputs; a temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 1):
        self.share = float(y.mean()) if len(y) else 0.5
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        check, use = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.std
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            rng.shuffle(use)
            for a in range(0, len(use), 256):
                i = use[a : a + 256]
                h = np.tanh(z[i] @ self.p[0] + self.p[1])
                q = 1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30)))
                d = (q - y[i, None]) / len(i)
                back = d @ self.p[2].T * (1 - h * h)
                step += 1
                for k, g in enumerate((z[i].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= 0.003 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        logit, yc = self.logit(x[check]), y[check]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logit / t) - yc * logit / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(check) else 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, 2 * WIDTH).astype(np.float64)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            s = network.score(_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return run


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scratch, sc = Scratch(spark, "quality-classifier"), spark.sparkContext
    docs = docs.select("doc_id", "text")
    vectors = sc.broadcast(context_vectors(docs))  # a fixed size
    made = scratch.cut(docs.mapInArrow(_features(vectors), "doc_id long, x binary"), "features")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held)
    labelled = scratch.cut(made.join(one.hint("merge"), "doc_id").dropDuplicates(["doc_id", "x"]).withColumn("h", F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30))), "labelled")
    # a hash range that holds about the sample, so that no task sends the driver more than its share of it
    top = int((1 << 30) * min(1.0, sample / max(1, labelled.count())))
    rows = labelled.where(F.col("h") <= top).select("h", "doc_id", "x", "quality").toPandas().sort_values(["h", "doc_id", "x"], kind="stable").head(sample)
    network = Network(_matrix(rows["x"]), rows["quality"].to_numpy(float))
    scored = made.mapInArrow(_score(sc.broadcast(network)), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

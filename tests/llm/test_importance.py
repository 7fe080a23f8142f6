"""Operator 11 against a plain-Python version."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = {c: c + 32 for c in range(65, 91)}


def feats(text):
    w = WORD.findall((text or "").translate(UP))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f, k=10_000):
    return zlib.crc32(f.encode()) % k


def brute(rows, target, percent=25, least=20, k=10_000):
    """Rows (doc_id, n_features, weight, score, rank) of (doc_id, text) rows, in order of the draw where drawn."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucket(f, k) for f in feats(text)[1])
    for text in target:
        t.update(bucket(f, k) for f in feats(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + k) / ((s[b] + 1) * (T + k)))) for b in range(k)]
    out = []
    for doc, text in rows:
        words, f = feats(text)
        weight = sum(gain[bucket(x, k)] for x in f) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None, len(words) >= least and doc is not None])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], -r[1], -r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {d for _, d in df.dtypes} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_buckets_of_words_and_pairs():
    import pyarrow as pa

    from tessera.llm.kernels import text_buffer

    rng = random.Random(3)
    words = ["a", "Zed", "é", "日本語", "x" * 47, "y" * 48, "z" * 49, "Q" * 300, "42", "don", "t"]
    texts = ["", None, "one", " ", *(rng.choice([" ", ". ", "\n", "'"]).join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(50))]
    every, row, n = importance.features(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        w, f = feats(t)
        assert n[i] == len(w)
        assert Counter(every[row == i].tolist()) == Counter(map(bucket, f))


def test_tournament():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7, 8, 20):
        runs = [sorted(rng.integers(0, 50, (int(rng.integers(0, 30)), 2)).tolist()) for _ in range(k)]
        tree = importance.Tournament(runs)
        assert list(tree.entries()) == sorted(sum(runs, []))
        tree, some = importance.Tournament(runs), []
        entries = tree.entries()
        for _ in range(min(5, sum(map(len, runs)))):
            some.append(next(entries))
        assert some == sorted(sum(runs, []))[: len(some)]
        assert sorted([*some, *tree.left()]) == sorted(sum(runs, []))


@pytest.mark.parametrize(("range_rows", "run_rows"), [(1 << 20, 1 << 20), (3, 4), (1, 2)])
def test_sample(spark, rows, docs, clashing, monkeypatch, range_rows, run_rows):
    monkeypatch.setattr(importance, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(importance, "RUN_ROWS", run_rows)
    target = ["alpha beta the of one two", None, "", "w1 w2 w3 naïve 日本 common line here"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, score string")
    want = brute([(r[0], r[1]) for r in rows], target)
    assert sum(r[4] is not None for r in want) >= 8
    assert got(importance.importance_sample(spark, docs, bench)) == want
    assert got(importance.importance_sample(spark, clashing, bench)) == want


def test_ties_and_copies(spark, monkeypatch):
    """One doc_id with a third of all rows, and more rows at one score than a range holds."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 5)
    monkeypatch.setattr(importance, "noise", lambda d, seed=7: 0)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 60 + [(i, text) for i in range(100, 220)] + [(300 + i, text + " extra" * i) for i in range(5)]
    found = importance.importance_sample(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([("w1 w2",)], "text string")).collect()
    assert len(found) == len(rows)
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 25 * len(rows) // 100 + 1))
    order = sorted(found, key=lambda r: (-r["score"], r["doc_id"], -r["n_features"]))
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(r["score"], r["doc_id"]) for r in order[: len(drawn)]]


def test_empty(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.importance_sample(spark, empty, none).collect() == []
    few = docs.where("doc_id < 5")
    assert all(r["rank"] is None for r in importance.importance_sample(spark, few, none).collect())
    assert importance.importance_sample(spark, docs, none).where("rank IS NOT NULL").count() > 5

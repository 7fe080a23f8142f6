"""Operator 12 against a plain-Python version."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

UP = {c: c + 32 for c in range(65, 91)}


def brute_print(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """(doc_id, fingerprint) rows -> smallest doc_id of each row's component."""
    distinct = sorted({f for d, f in prints if d is not None})
    up = {f: f for f in distinct}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(b)] = find(a)
    lead = {}
    for d, f in prints:
        if d is not None:
            lead[find(f)] = min(d, lead.get(find(f), d))
    return [None if d is None else lead[find(f)] for d, f in prints]


def test_anchors():
    """Two halves within a bit of each other meet at the home anchor of either, for any half."""
    rng = np.random.default_rng(5)
    half = rng.integers(0, 1 << 31, 400).astype(np.uint32)
    at, key = simhash.anchors(half)
    s = simhash.syndrome(half)
    lead = simhash.home(half, s)
    assert not simhash.syndrome(key).any()
    assert (np.bitwise_count(half[at] ^ key) <= 2).all()
    assert len(at) == len(half) + 15 * int((s > 0).sum())
    there = {i: set(key[at == i].tolist()) for i in range(len(half))}
    for i in range(len(half)):
        for j in range(31):
            other = np.array([half[i] ^ np.uint32(1 << j)], np.uint32)
            assert int(simhash.home(other, simhash.syndrome(other))[0]) in there[i]
        assert int(lead[i]) in there[i]


def test_fingerprints(spark, rows, docs, clashing):
    want = sorted(((r[0], f"{brute_print(r[1]):016x}") for r in rows), key=repr)
    for df in (docs, clashing):
        got = simhash.simhash_components(spark, df)
        assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
        assert sorted(((r.doc_id, r.fingerprint) for r in got.collect()), key=repr) == want


def test_components_of_documents(spark, rows, docs):
    got = simhash.simhash_components(spark, docs).collect()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [r.component_id for r in got] == brute_components(prints)
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}  # no words: zero, and linked


def clusters():
    rng = random.Random(9)
    out = [rng.getrandbits(64) for _ in range(200)]
    for centre in (0, (1 << 64) - 1, rng.getrandbits(64)):
        out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(120)]
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), rng.choice((3, 3, 4))))
        out.append(chain)
    for b in (61, 62, 63):  # bits that have no anchors
        out.append(out[0] ^ 1 << b)
    out.append(out[1] ^ 0b111 << 61)
    return out


@pytest.mark.parametrize(("at_once", "block", "pairs", "gather", "held"), [(1 << 15, 1 << 14, 1 << 19, 1 << 16, 1 << 18), (20, 7, 50, 30, 10), (400, 100, 1000, 100, 50)])
def test_linked_fingerprints(spark, monkeypatch, at_once, block, pairs, gather, held):
    from tessera.llm.shared import Scratch

    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "GATHER", gather)
    monkeypatch.setattr(simhash, "HELD", held)
    prints = sorted(set(clusters()))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    found = {r.fp: r.component for r in simhash.linked_fingerprints(Scratch(spark, "t"), nodes).collect()}
    want = brute_components(list(zip(signed, prints, strict=True)))
    assert [found.get(f, f) for f in signed] == want


def test_many_at_one_anchor():
    """The path for more than 256 fingerprints at an anchor, in one task and in blocks."""
    rng = random.Random(2)
    prints = sorted({0x5555 << 40 ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(3000)})
    fp = np.array(prints, np.uint64)
    import pyarrow as pa

    blobs = list(simhash._cover(1)(iter([pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], ["fp"])])))
    want = set()
    for i, a in enumerate(prints):
        near = fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ np.uint64(a)) <= 3]
        want |= {(a, int(b)) for b in near[:1]}
    stars = np.concatenate([np.frombuffer(b, np.int64) for out in simhash._compare(3)(iter(blobs)) for b in out.column(2).to_pylist()]).reshape(-1, 2)
    up = {int(f): int(f) for f in fp.view(np.int64)}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in stars.tolist():
        up[find(a)] = find(b)
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    assert all(find(signed(a)) == find(signed(b)) for a, b in want)


def test_empty(spark, empty):
    assert simhash.simhash_components(spark, empty).collect() == []
    only = empty.sparkSession.createDataFrame([(None, "a b c d"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(spark, only).collect() if r.doc_id) == [(4, 4)]

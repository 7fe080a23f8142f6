"""Operator 1 against brute force."""

import random
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n=3, percent=90):
    """(doc_id, set size, component) of each row; a doc_id with several texts has its smallest set."""
    sets = {}
    for d, t in rows:
        s = shingles(t, n)
        if d is not None and s and (d not in sets or len(s) < len(sets[d])):
            sets[d] = s
    ids, up = sorted(sets), {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(a), find(b)))
                up[v] = u
    return Counter((d, len(shingles(t, n)), find(d) if d in sets else d) for d, t in rows)


def near_rows():
    rng = random.Random(11)
    word = lambda: rng.choice("a b c d e f g h i j k l m n o p q r s t".split()) + str(rng.randrange(40))
    rows, i = [], 0
    for size in (1, 2, 3, 4, 9, 12, 13, 25, 60, 130, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for _ in range(12):
                w = list(base)
                for _ in range(rng.randrange(0, 1 + max(1, size // 25))):
                    k = rng.randrange(3)
                    at = rng.randrange(len(w))
                    if k == 0:
                        w[at] = word()
                    elif k == 1:
                        w.insert(at, word())
                    elif len(w) > 1:
                        del w[at]
                rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
                i += 1
    rng.shuffle(rows)
    return [(d * 3 + 1, t) for (d, _), (_, t) in zip(sorted(rows), rows, strict=True)]


def run(spark, df, **kw):
    from tessera.llm.signature_join import jaccard_components

    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark, df, **kw)[0].collect())


def test_near_copies(spark, monkeypatch):
    from tessera.llm import signature_join

    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 100
    assert run(spark, df) == want
    monkeypatch.setattr(signature_join, "BLOCK_GRAMS", 700)  # many blocks
    assert run(spark, df) == want
    assert run(spark, df, n=5, percent=80) == brute(rows, 5, 80)


def test_contract_rows(spark, rows, clashing, empty):
    assert run(spark, clashing) == brute([(r[0], r[1]) for r in rows])
    assert not run(spark, empty)


def test_tree_prunes_nothing_linked():
    from tessera.llm.signature_join import Union, linked, tree_links

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64))
        for _ in range(8):
            gone = rng.random(len(base)) < rng.choice([0, 0.03, 0.06, 0.12])
            sets.append(np.unique(np.concatenate((base[~gone], rng.integers(0, 2**63, int(gone.sum())).astype(np.uint64)))))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], 90)]

    def classes(links):
        u = Union(len(sets))
        for i, j in links:
            a, b = u.find(i), u.find(j)
            if a != b:
                u.join(a, b)
        return [u.find(i) for i in range(len(sets))]

    assert classes(pairs) == classes(tree_links(sets, None, 90))
    half = [(i, j) for i, j in pairs if (i < 100) != (j < 100)]
    assert classes(half) == classes([(a, 100 + b) for a, b in tree_links(sets[:100], sets[100:], 90)])


def test_linked_sets_share_a_key():
    from tessera.llm.signature_join import linked, segment_keys

    rng = np.random.default_rng(3)
    for n, percent in ((3, 90), (5, 80), (5, 95)):
        for _ in range(4000):
            base = np.unique(rng.integers(0, 2**64, int(rng.choice([1, 2, 4, 5, 6, 8, 9, 12, 20, 37, 90, 300])), dtype=np.uint64))
            gone = rng.random(len(base)) < rng.choice([0, 0.05, 0.1, 0.2, 0.25])
            fresh = rng.integers(0, 2**64, int(rng.integers(0, 1 + len(base) // 4)), dtype=np.uint64)
            other = np.unique(np.concatenate((base[~gone], fresh)))
            if len(other) and linked(base, other, percent):
                assert len(np.intersect1d(segment_keys(base, percent), segment_keys(other, percent))), (len(base), len(other), percent)


def test_empty_segments_are_no_keys():
    from tessera.llm.signature_join import segment_keys

    rng = np.random.default_rng(4)
    for size in (3, 5, 8, 9, 20, 50):
        keys = [segment_keys(np.sort(rng.integers(0, 2**64, size, dtype=np.uint64)), 80) for _ in range(400)]
        flat = np.concatenate([np.unique(k) for k in keys])
        assert len(np.unique(flat)) == len(flat)  # sets with nothing in common make no candidate edge


def test_bands_of_a_large_component(spark, monkeypatch):
    from tessera.llm import signature_join

    rng = random.Random(2)
    words, rows = [f"w{i}" for i in range(40)], []
    for i in range(160):  # a chain of texts, each with a few words more than the one before
        words.append(f"v{i}")
        if rng.random() < 0.5:
            words.append(f"u{i}")
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(signature_join, "BLOCK_SETS", 7)
    for n, percent in ((3, 90), (5, 80)):
        monkeypatch.setattr(signature_join, "SPREAD", 3)
        monkeypatch.setattr(signature_join, "BLOCK_GRAMS", 1500)
        assert run(spark, df, n=n, percent=percent) == brute(rows, n, percent)


def test_more_edges_than_a_task_contracts(spark, monkeypatch):
    from tessera.llm import shared, signature_join

    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for module in (shared, signature_join):
        monkeypatch.setattr(module, "CONTRACT", 40)
    monkeypatch.setattr(signature_join, "GATHER", 300)
    assert run(spark, df) == brute(rows)

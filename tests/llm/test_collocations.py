"""Operator 13 against a plain-Python version, its SQL, and the edges of its parts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import collocations

UP = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top=2000, longest=5):
    """Rows of the result for (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UP)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, a in some.items():
        w = p[1:]
        gone |= {(p[0], *w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and a >= f[(p[0], *w[i:j])]}
    out = []
    for p, a in some.items():
        if p not in gone:
            lang, w = p[0], p[1:]
            score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for lang, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], *rest))
    return ranked


def prose(seed=4, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "a", "of", "é", "naïve", "日本", "x-1", "don't", "(see", "\x01z"] + [f"w{i}" for i in range(25)]
    fixed = ["all Rights reserved by the board", "the the the the the the", "one two. three four", "a of", "\tof\tthe\x0bboard"]
    rows = []
    for i in range(n):
        say = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\t", "; "]) for w in say)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return [*rows, *rows[:20], ("en", None), ("en", ""), (None, " \t ..,"), ("xx", "only once")]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("shard", "patterns", "least", "top"), [(1 << 20, 1 << 15, 5, 2000), (300, 7, 4, 30), (1, 1 << 15, 12, 3)])
def test_collocations(spark, monkeypatch, shard, patterns, least, top):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "PATTERNS", patterns)
    monkeypatch.setattr(collocations, "HELD", 1 << 18 if patterns > 10 else 20)
    rows = prose()
    want = sorted(brute(rows, least, top))
    assert len(want) > 10
    df = spark.createDataFrame([(None, i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, score long, text string, lang string, words string").repartition(3)
    assert got(collocations.collocations(spark, df, least=least, top=top)) == want


def test_cells_only_bound_from_above(spark, monkeypatch):
    """A sketch of very few cells lets false candidates in, and changes no result."""
    whole = collocations.cells
    monkeypatch.setattr(collocations, "cells", lambda h, b: whole(h & np.uint64(0x3F000003), b))
    rows = prose(seed=8, n=120)
    texts = [(lang, t) for lang, t in rows]
    body = collocations.normal(texts[0][1].encode())
    g = collocations.Grams(body, "en")
    every = np.unique(np.concatenate([collocations.cells(g.hashes(g.valid(k), k), 4) for k in (2, 3)]))
    assert len(collocations.candidates(g, every, 4, 5)) >= len({tuple(x) for x in zip(*[g.words[i:] for i in range(2)], strict=False)}) - 20
    counts = {p[1:-1]: int(n) for part, found in collocations.matches(body.decode(), collocations.candidates(g, every, 4, 5), 50) for p, n in zip(part, found, strict=True)}
    assert all(body.decode().count(f" {p} ") <= n for p, n in counts.items())


def test_overlapping_matches():
    [(part, n)] = collocations.matches(" a a a a \n a a b \n", [" a a ", " a a a ", " a b "], 10)
    assert dict(zip(part, n.tolist(), strict=True)) == {" a a ": 4, " a a a ": 2, " a b ": 1}


def test_packed_cells():
    for top in (200, 70000):
        cell = np.sort(np.random.default_rng(top).integers(0, 2**63, 50).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF000000) | np.uint64(9)
        n = np.arange(50) * top // 50 + 1
        back, m = collocations.unpack_cells(collocations.pack_cells(cell, n), 9)
        assert (back == cell).all() and (m == n).all()


def test_fixture_rows_against_sql(spark, rows, docs, clashing, empty):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    more = [(100 + i, t, lang, "x", 1) for i, (lang, t) in enumerate(prose(seed=1, n=700))]
    con.register("documents", pd.DataFrame([*rows, *more], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"text": "string", "lang": "string"}))
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.ORACLE})").fetchall())
    extra = spark.createDataFrame(more, docs.schema)
    assert len(want) > 20
    assert got(collocations.collocations(spark, docs.union(extra))) == want
    assert want == sorted(brute([(r[2], r[1]) for r in [*rows, *more]], 100))
    assert got(collocations.collocations(spark, clashing)) == sorted(brute([(r[2], r[1]) for r in rows], 100))
    assert got(collocations.collocations(spark, empty)) == []


def test_products_over_64_bits(spark, monkeypatch):
    """Counts as of a very large corpus: the score stays exact."""
    phrases = spark.createDataFrame([("en", "a b", 2, 9 * 10**12 + 7)], "lang string, phrase string, words int, n long")
    words = spark.createDataFrame([("en", "a", 10**13 + 1), ("en", "b", 10**13 + 9)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", 10**16 + 61)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (phrases, words, totals))
    [row] = collocations.collocations(spark, totals).collect()
    assert row.score == 1000 * (9 * 10**12 + 7) * (10**16 + 61) // ((10**13 + 1) * (10**13 + 9))

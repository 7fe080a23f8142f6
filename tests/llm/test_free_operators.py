"""Operators 2, 3, 6 and 10 against brute force."""

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.entry import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(rows, least=10):
    strip = "\x20\t\n\x0b\x0c\r"
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(strip))
    seen = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n") if d is not None else ():
            seen[key(line)].add(d)
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not key(x) or len(seen[key(x)]) < least]
        out[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark, docs, rows, clashing, empty):
    from tessera.llm.line_dedup import line_dedup_digest

    for df in (docs, clashing):
        got = Counter(tuple(r) for r in line_dedup_digest(spark, df).collect())
        assert got == brute_lines(rows)
    assert sum(v[2] for v in got) > 30
    assert line_dedup_digest(spark, empty).count() == 0


def test_line_dedup_sql(docs, rows):
    import duckdb
    import pandas as pd

    from tessera.llm.entry import OP10_SQL

    documents = pd.DataFrame([(d, t) for d, t, *_ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    assert Counter(con.sql(OP10_SQL).fetchall()) == brute_lines(rows)


def test_line_dedup_small_batches(spark, docs, rows):
    from tessera.llm.line_dedup import line_dedup_digest

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = Counter(tuple(r) for r in line_dedup_digest(spark, docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_lines(rows)


def water(sizes, weights, cap=3.0):
    """Targets by bisection of the water level, apart from the operator's own way."""
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(cap * n, level * w) for n, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(cap * n, high * w) for n, w in zip(sizes, weights, strict=True)]


def test_mixing(spark, docs, rows, clashing, empty):
    from tessera.llm.mixing import mix_sources

    got = mix_sources(spark, docs, block=8).collect()
    again = mix_sources(spark, clashing, block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, size(t)) for d, t, _, s, _ in rows)
    total = defaultdict(int)
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, water([total[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert sum(targets.values()) == pytest.approx(sum(total.values()))
    for s in total:  # a source is off by its landing, at most about its largest document
        assert abs(taken[s] - targets[s]) <= max(130, most[s]), s
    assert mix_sources(spark, empty).count() == 0


def test_mixing_of_many_sources_and_repeated_rows(spark):
    from tessera.llm.mixing import mix_sources

    rows = [(i, "w " * (1 + i % 40), f"s{i % 97:03d}") for i in range(1500)]
    rows += [(None, "a b c d e", "s004")] * 3000  # rows that are all alike
    got = mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), block=50).collect()
    total, taken = Counter(), Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    order = sorted(total)
    targets = dict(zip(order, water([total[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 45 for s in order)
    hot = [r.copies for r in got if r.doc_id is None]
    assert max(hot) - min(hot) <= 1


def test_flight_balances_and_is_unbiased():
    from tessera.llm.mixing import flight

    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 400), np.full(400, 0.3)
    mean = np.zeros(400)
    for i in range(200):
        s = flight(p, size, np.random.default_rng(i), land=True)
        assert set(np.unique(s)) <= {0.0, 1.0}
        assert abs(s @ size - p @ size) < 1500 and abs(s.sum() - p.sum()) <= 2
        mean += s / 200
    assert abs(mean.mean() - 0.3) < 0.01 and mean.min() > 0.1 and mean.max() < 0.55


def token_rows(rows, tokenizer):
    start, want = 0, Counter()
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    return want


def test_token_ids(spark, docs, rows, clashing, empty):
    from tokenizers import Tokenizer

    from tessera.llm.sstable import sstable_digest

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = token_rows(rows, tokenizer)
    for df in (docs, clashing):
        got = Counter(tuple(r) for r in sstable_digest(spark, df, path).collect())
        assert {(d, n, c) for d, _, n, c in got} == {(d, n, c) for d, _, n, c in want}
        assert sorted(d for d, *_ in got.elements() if d is not None) == sorted(d for d, *_ in rows if d is not None)
        at = 0
        for d, start, n, _ in sorted(got.elements(), key=lambda r: r[1]):  # rows of one doc_id in any order
            assert start == at
            at += n
        order = [d for d, *_ in sorted(got.elements(), key=lambda r: r[1])]
        assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert sstable_digest(spark, empty, path).count() == 0


def test_shard_lookup(monkeypatch):
    from tessera.llm import sstable
    from tessera.llm.sstable import ShardReader, ShardWriter, key_bytes, key_value

    monkeypatch.setattr(sstable, "BLOCK_BYTES", 1 << 14)

    out, rng = io.BytesIO(), np.random.default_rng(1)
    writer, want = ShardWriter(out), defaultdict(list)
    for d in sorted([None, -5, 3, 3, *range(10, 40000, 7)], key=lambda d: (d is not None, d)):
        ids = rng.integers(0, 60000, rng.integers(0, 40))
        want[d].append(ids.tolist())
        writer.add(key_bytes(d), ids.astype("<u2").tobytes(), len(ids))
    writer.close()
    reader = ShardReader(out)
    assert reader.entries == sum(map(len, want.values())) and len(reader.index) > 1
    for d in [None, -5, 3, 10, 17, 39988, *range(10, 40000, 700)]:
        assert [v.tolist() for v in reader.lookup(d)] == want.get(d, []), d
    assert reader.lookup(11) == [] and reader.lookup(99999999) == []
    assert [key_value(k) for b in reader.blocks() for k, _ in b] == [d for d in want for _ in want[d]]


def test_token_counts(spark, docs, rows, clashing, empty):
    from tessera.llm.token_counts import count_one, token_counts, vocabulary as load

    path = vocabulary("byte_bpe_50k.tiktoken")
    v, memo = load(path), {}

    def one(w):
        if w not in memo:
            memo[w] = count_one(b" " + w.encode(), v)
        return memo[w]

    want = Counter((d, len(w), sum(map(one, w))) for d, w in ((d, WORD.findall(t or "")) for d, t, *_ in rows))
    for df in (docs, clashing):
        assert Counter(tuple(r) for r in token_counts(df, path).collect()) == want
    assert token_counts(empty, path).count() == 0

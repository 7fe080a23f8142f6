"""Operator 7 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm.pfp_dedup import LENGTH


def brute(rows):
    least, known = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, t in known:
        for i in range(len(t) - LENGTH + 1) if d is not None else ():
            w = t[i : i + LENGTH]
            least[w] = min(d, least.get(w, d))
    out = Counter()
    for d, t in known:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - LENGTH + 1) if d is not None else ():
            if least[t[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def run(spark, df):
    from tessera.llm.pfp_dedup import repeats_digest

    return Counter(tuple(r) for r in repeats_digest(spark, df).collect())


def test_contract_rows(spark, clashing, rows, empty):
    rows = [(r[0], r[1]) for r in rows]
    assert run(spark, clashing) == brute(rows)
    assert not run(spark, empty)


def test_repeats_of_every_kind(spark, monkeypatch):
    rng = random.Random(8)
    for letters in ("ab", "abcdefghij é日"):
        say = lambda n: "".join(rng.choice(letters) for _ in range(n))
        common = [say(n) for n in (49, 50, 51, 52, 70, 90, 300)]
        rows = [(0, ""), (1, "a" * 400), (2, "a" * 90), (3, "b" + "a" * 60), (4, None), (5, "ab" * 100), (6, "ba" * 100)]
        for d in range(7, 90):
            parts = [say(rng.randrange(0, 120)) for _ in range(3)]
            for _ in range(rng.randrange(0, 4)):
                c = rng.choice(common)
                if rng.random() < 0.3:
                    at = rng.randrange(len(c))
                    c = c[:at] + "X" + c[at + 1 :]
                parts.insert(rng.randrange(len(parts) + 1), c)
            rows.append((d, "".join(parts)))
        rows.append((200, rows[20][1]))
        rows.append((201, rows[20][1]))
        # one doc_id with several texts, one of them twice: each row loses what a smaller document has, in its own places
        rows += [(40, say(200) + common[-1]), (40, common[-1] + say(99)), (40, common[-1] + say(99)), (40, ""), (40, None), (300, say(300)), (300, say(60) + rows[9][1]), (300, rows[-1][1])]
        rows += [(None, common[-1] * 2), (-7, common[4] + say(30)), *rows[30:33]]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = brute(rows)
        assert sum(v[2] for v in want) > 3000
        assert run(spark, df) == want


def test_long_text_in_pieces():
    from tessera.llm import pfp_dedup as P

    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, (1 << 22) + 5000).astype(np.uint8)
    k, p, row, first, n, *_ = P.phrases(raw, np.array([0, len(raw)]))
    assert int(n.sum()) == len(raw) - LENGTH + 1
    assert (np.sort(first)[1:] == (np.sort(first) + n[np.argsort(first)])[:-1]).all()
    assert n.max() <= 255


def test_packed_phrases():
    from tessera.llm import pfp_dedup as P

    rng = np.random.default_rng(2)
    for top in (1 << 20, 1 << 50):
        for var in (np.zeros(50, np.int64), rng.integers(-top, top, 50)):
            doc = rng.integers(-top, top, 50)
            fields = tuple(rng.integers(0, 1 << 8 * s, 50).astype(np.uint64) for s in P.SENT)
            for a, b in zip((doc, var, *fields), P.unpack_phrases([P.pack_phrases(doc, var, fields)]), strict=True):
                assert (a == b).all()


def test_window_ranks_are_the_order_of_bytes():
    from tessera.llm import pfp_dedup as P

    rng = np.random.default_rng(3)
    for top in (2, 256):
        data = rng.integers(0, top, 3000).astype(np.uint8)
        data[1000:1400] = data[200:600]
        text = data.tobytes() + bytes(LENGTH)
        windows = [text[i : i + LENGTH] for i in range(len(data))]
        order = {w: i for i, w in enumerate(sorted(set(windows)))}
        assert (np.array([order[w] for w in windows]) == np.unique(P.window_ranks(data), return_inverse=True)[1]).all()

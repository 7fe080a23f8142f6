"""Operator 3 with tokens of every length, against brute force on the rank file itself."""

import base64
import math

from tessera.llm.entry import vocabulary


def test_long_runs(spark):
    from tessera.llm.token_counts import token_counts

    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    longest = max(map(len, ranks))
    assert longest > 24

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = ((best[a], ranks.get(word[a:end])) for a in range(max(0, end - longest), end))
            best.append(min((cost + math.log(r + 2.0), n + 1) for (cost, n), r in ways if r is not None))
        return best[-1][1]

    long = [t.decode() for t in ranks if len(t) > 24 and t.isascii() and not any(c.isspace() for c in t.decode())]
    words = [*long, *(c * n for c in "=-_.*#" for n in (25, 32, 48, 64, 65, 95, 96, 97, 130, 200)), "ab" + "=" * 64 + "c", "x" * 90 + "-" * 64]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), path).collect()}
    assert got == {i: (1, brute(b" " + w.encode())) for i, w in enumerate(words)}

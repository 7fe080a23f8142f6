"""Operator 1's number of links of a document, and all links, against brute force."""

from tests.llm.test_signature_join import near_rows, shingles


def brute(rows, n=3, percent=90):
    """Linked pairs of documents, equal sets among them."""
    sets = {d: shingles(t, n) for d, t in rows}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}, sets


def test_link_counts(spark, monkeypatch):
    from tessera.llm import signature_join

    rows = near_rows()
    long = [f"w{i}" for i in range(200)]
    rows += [(5000 + k, " ".join([*long[:k], "odd", *long[k:]])) for k in range(40)]  # one group of different near copies
    rows += [(6000 + k, t) for k, (_, t) in enumerate(rows[:60])] + [(7000, ""), (7001, None)]
    pairs, sets = brute(rows)
    want = {d: sum(d in p for p in pairs) for d in sets}
    assert max(want.values()) >= 39
    df = spark.createDataFrame([*rows, *rows[:20], (None, rows[0][1])], "doc_id long, text string").repartition(3)  # some rows twice
    for grams, dense in ((1 << 22, 1 << 16), (700, 1 << 16), (1 << 22, 10)):
        monkeypatch.setattr(signature_join, "BLOCK_GRAMS", grams)
        monkeypatch.setattr(signature_join, "DENSE", dense)
        out, links = signature_join.jaccard_components(spark, df)
        got = [(r.doc_id, r.n_links) for r in out.collect()]
        assert len(got) == len(rows) + 21
        assert set(got) == {*want.items(), (None, 0)}
    lead = {}
    for d in sorted(sets):
        lead.setdefault(sets[d], d)
    found = [tuple(sorted(r)) for r in links.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, b in pairs if lead[sets[a]] == a and lead[sets[b]] == b}

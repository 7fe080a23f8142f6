"""Operators 4 and 9: planted copies, brute-force alignment, held-out accuracy."""

import random
import zlib

import numpy as np


def say(rng, n):
    return [rng.choice(["the", "of", "and", "in", "to"]) if rng.random() < 0.4 else rng.choice("kltmnr") + rng.choice("aeiou") + rng.choice("bdgpt") + rng.choice("aeiouy") + rng.choice("lmnst") for _ in range(n)]


def test_decontamination(spark, empty):
    from tessera.llm.decontamination import contaminated

    rng = random.Random(3)
    items = [(i, " ".join(say(rng, rng.randrange(15, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "two words"), (None, " ".join(say(rng, 30)))]
    rows, want = [(9000, None), (9001, ""), (9002, "the of and in to " * 200)], set()
    for k in range(200):
        text = say(rng, rng.randrange(50, 400))
        if k % 4 == 0:
            item = items[rng.randrange(30)]
            w = item[1].split(" ")
            if k % 8 == 0:  # an edited copy: about one word in six changed, dropped or added
                for _ in range(len(w) // 6):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([say(rng, 1), [], [w[at], *say(rng, 1)]])
            at = rng.randrange(len(text))
            text[at:at] = [x.upper() + "," for x in w]
            want.add((k, item[0]))
        rows.append((k, " ".join(text)))
    rows.append((500, "intro " + items[-1][1]))
    want.add((500, None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score > 0.99 for r in got if r.doc_id % 8 == 4)
    # rows that repeat an item or a document change nothing but the number of copies; clashing columns don't matter
    odd = df.union(df.where("doc_id < 50")).selectExpr("*", "text AS item", "1 AS item_id", "2 AS score", "3 AS words", "text AS found")
    again = contaminated(spark, odd, bench.union(bench).selectExpr("*", "item_id AS doc_id", "text AS item")).collect()
    assert sorted((r.doc_id, r.item_id or -1, r.score, r.end_word) for r in again) == sorted((r.doc_id, r.item_id or -1, r.score, r.end_word) for r in got)
    # the end of a very long text counts; items without white space fill blocks by their words
    from tessera.llm.decontamination import blocks

    long = spark.createDataFrame([(1, " ".join(say(rng, 300000)) + " " + items[3][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(spark, long, bench).collect()] == [(1, 3)]
    assert len(list(blocks(spark.createDataFrame([(i, ",".join(["ab"] * 50)) for i in range(6)], "item_id long, text string"), 110))) == 3
    assert contaminated(spark, empty, bench).count() == 0
    assert contaminated(spark, df, bench.limit(0)).count() == 0


def test_alignment_against_brute_force():
    from tessera.llm.decontamination import GAP, MATCH, MISMATCH, align

    rng = np.random.default_rng(0)
    for _ in range(40):
        item, passages = rng.integers(0, 6, rng.integers(1, 15)), [rng.integers(-1, 6, rng.integers(1, 25)).astype(np.int32) for _ in range(4)]
        got, _ = align(item, passages)
        for p, g in zip(passages, got, strict=True):
            h = np.zeros((len(item) + 1, len(p) + 1), int)
            for i, a in enumerate(item, 1):
                for j, b in enumerate(p, 1):
                    h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a == b else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
            assert h.max() == g


def test_quality_classifier(spark, clashing, rows, empty):
    from pyspark.sql import functions as F

    from tessera.llm.quality_classifier import quality_scores

    rng = random.Random(6)
    made = []
    for i in range(900):
        w = say(rng, rng.randrange(20, 120))
        if i % 4 == 0:
            w = [x + rng.choice(["%%%", "$$$", "###"]) for x in w] if i % 8 else [x.upper() + "!!" for x in w[:5]] * 12
        made.append((1000 + i, " ".join(w)))
    df = clashing.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(d, int((d - 1000) % 4 != 0), 0) for d, _ in made] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_scores(spark, df, labels).collect()
    got = {r.doc_id: r for r in out}
    assert set(got) == {r[0] for r in rows} | {d for d, _ in made}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [(r.predicted, int((r.doc_id - 1000) % 4 != 0)) for r in out if r.held_out and r.doc_id >= 1000]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.93
    assert {r.doc_id: r.score for r in quality_scores(spark, df, labels).collect()} == {r.doc_id: r.score for r in out}
    assert quality_scores(spark, empty, labels).count() == 0
    assert {r.score for r in quality_scores(spark, df, labels.limit(0)).collect()} == {0.5}


def test_features_against_brute_force(spark):
    """Context vectors and pooled features of op 9, token by token in plain Python."""
    from tessera.llm import quality_classifier as Q
    from tessera.llm.kernels import text_buffer

    import pyarrow as pa

    rng = random.Random(13)
    texts = [" ".join(rng.choice(["ab", "Cd", "XYZ", "12", "é", "--", "a1b"]) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + ["", "one"]

    def kind(c):
        return 0 if c in " \t\n\x0b\x0c\r" else 1 if c.islower() or ord(c) > 127 else 2 if "A" <= c <= "Z" else 3 if c.isdigit() else 4

    def rows_of(text):
        runs, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and kind(text[end]) == kind(text[at]):
                end += 1
            if kind(text[at]):
                runs.append(text[at:end])
            at = end
        return [int(Q.tokens(*text_buffer(pa.array([r])))[0][0]) for r in runs]

    place, sign = Q.index_vectors()
    context = np.zeros((Q.VOCABULARY, Q.WIDTH))
    docs = [rows_of(t) for t in texts]
    for d in docs:
        for i, a in enumerate(d):
            for j in range(max(0, i - Q.REACH), min(len(d), i + Q.REACH + 1)):
                if i != j:
                    for k in range(Q.SIGNS):
                        context[a, place[d[j], k]] += sign[d[j], k]
    unit = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = Q.context_vectors(df)
    assert np.abs(got - unit).max() < 1e-6
    shared = spark.sparkContext.broadcast(got)
    for r in df.select("doc_id", "text").mapInArrow(Q._features(shared), "doc_id long, x binary").collect():
        d = unit[docs[r.doc_id]]
        want = np.concatenate([d.mean(0), d.std(0)]) if len(d) else np.zeros(2 * Q.WIDTH)
        assert np.abs(np.frombuffer(r.x, np.float32) - want).max() < 1e-3, r.doc_id

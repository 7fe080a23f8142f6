"""The pipeline on a small corpus: each stage against its brute-force decision."""

import random
import re
import zlib

import numpy as np

from tests.llm.test_models import say
from tests.llm.test_native_operators import counts
from tests.llm.test_signature_join import brute


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    items = [(i, " ".join(say(rng, 40))) for i in range(5)]
    rows = [(0, None, "en", "a", None), (1, "", None, None, 0), (2, "short text", "de", "b", 10)]
    for i in range(3, 200):
        w = say(rng, rng.randrange(60, 200))
        if i % 10 == 3:
            w = rows[-1][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
        if i % 17 == 5:
            w[10:10] = items[i % 5][1].split(" ")
        if i % 23 == 7:
            w = w[:6] * 20
        rows.append((i, " ".join(w), "en", "abc"[i % 3] if i % 5 else None, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept, texts = docs, {r[0] for r in rows}, {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        if k < 4:
            assert now.columns == docs.columns
        if name == "quality rules":
            kept = {d for d in kept if counts(texts[d])[0] >= 50 and 100 * counts(texts[d])[4] <= 50 * counts(texts[d])[0]}
            assert len(kept) < 195
        elif name == "n-gram Jaccard join":
            kept = {d for d, _, c in brute([(d, texts[d]) for d in kept], 5, 80) if c == d}
        elif name == "benchmark decontamination":
            kept = {d for d in kept if not any(i in texts[d] for _, i in items)}
        elif name == "mixing sources":
            assert set(ids) <= kept and max(np.bincount(ids)) <= 3
            words = sum(len(re.findall(r"\S+", texts[d])) for d in kept)
            assert abs(sum(len(re.findall(r"\S+", texts[d])) for d in ids) - words) < 0.15 * words
            mixed = sorted(ids)
        if k < 3:
            assert sorted(ids) == sorted(kept), name
    assert sorted(ids) == mixed
    start = 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.vocabulary("word_bpe_49k.json"))
    for r in now.orderBy("start").collect():
        want = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += r.n_tokens
    assert P.run(spark, str(tmp_path)).count() == len(ids)


def test_stages_on_odd_rows(spark, tmp_path, rows, clashing, empty):
    """Repeated and null ids, very long texts, clashing extra columns, and empty tables."""
    import corpus_pipeline as P

    spark.createDataFrame([(5, 1, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, rows[15][1]), (0, rows[15][1]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, start in (("odd", clashing), ("none", empty)):
        now = start
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            made = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or made.columns == start.columns
            now = made
        assert (now.count() > 0) == (name == "odd")


def test_mix_of_repeated_rows(spark, docs):
    """Rows that repeat a doc_id, with equal or other texts, are taken as often as the mix says, and no source lies above what it takes."""
    import re

    import corpus_pipeline
    from pyspark.sql import functions as F
    from tessera.llm.mixing import mix_sources

    more = spark.createDataFrame([(900, " ".join(["x"] * 40), "en", "a", 1)] * 7 + [(901, f"y{i} " * 25, "en", None, 1) for i in range(5)], docs.schema)
    every = docs.union(more)
    got = corpus_pipeline.mix(spark, every, "").collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = {(r.doc_id, r.source, r["size"]): r.copies for r in mix_sources(spark, every).where("doc_id IS NOT NULL").groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies")).where("copies > 0").collect()}
    found = {}
    for r in got:
        key = (r.doc_id, r.source, size(r.text))
        found[key] = found.get(key, 0) + 1
    assert found == want
    each = {}
    for r in got:
        if r.doc_id == 901:
            each[r.text] = each.get(r.text, 0) + 1
    assert not each or max(each.values()) - min([each.get(f"y{i} " * 25, 0) for i in range(5)]) <= 1

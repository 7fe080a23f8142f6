"""Operator 4 on short items, excerpts of long ones, and an item that a large share of the corpus copies."""

import random


def test_short_items_and_excerpts(spark):
    from tessera.llm.decontamination import contaminated

    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    items = {0: say(3), 1: say(4), 2: say(6), 3: say(59), 4: say(300), 5: say(10)}
    held = {0: (0, items[0]), 1: (1, items[1]), 2: (2, items[2]), 3: (3, items[3][20:40]), 4: (4, items[4][100:200]), 5: (4, items[4][50:63])}
    rows = [(k, " ".join([*say(80), *w, *say(80)])) for k, (_, w) in held.items()]
    rows += [(100 + k, " ".join([*say(20), *items[5]])) for k in range(300)]
    rows += [(600, " ".join([*say(60), *items[4][10:20], *say(60)])), *((700 + k, " ".join(say(100))) for k in range(20))]
    got = contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, i) for k, (i, _) in held.items()} | {(100 + k, 5) for k in range(300)}


def test_short_items_of_common_words(spark):
    """Items of 3 to 6 words, and one of a single word, whose copies make most of the corpus: every exact copy is found, nothing else."""
    from tessera.llm.decontamination import contaminated

    items = {0: "red green blue", 1: "north south east west", 2: "one two three four five six", 3: "la la la la la la la la"}
    rows = [(10 * k + i, f"{i} {t} {k}") for k in range(60) for i, t in items.items()]
    rows += [(1000, "red green"), (1001, "blue green red"), (1002, "north south east"), (1003, "one two three four five"), (1004, "la la la"), (1005, None)]
    got = contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(10 * k + i, i) for k in range(60) for i in items}

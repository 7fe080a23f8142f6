import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies and odd characters."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "the", "of", "é", "naïve", "日本", "x1", "42", "a.b", "Zed", "über", "<|endoftext|>", "don't"] + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(0, None, "en", "a", None), (1, "", None, "b", 0), (2, "   \t\n\n ", "en", None, 3), (3, "one", "de", "a", 3), (4, "one two", "de", "a", 7)]
    base = say(120).split(" ")
    for i in range(5, 15):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "en", "hot", 1))
    for i in range(15, 35):
        rows.append((i, "\n".join([say(8), "  Common LINE here \t", say(rng.randrange(1, 60)), "common line here"]), "fr", "hot", 1))
    for i in range(35, 40):
        rows.append((i, say(30) + "\n" + "mail me a.b_c@d-e.com.x@y.z or +1 (784) 555-8120, 4111 1111 1111 1111 1.2.3.4 999.1.1.1", "en", "c", 1))
    rows.append((40, say(30000), "en", "c", 1))
    rows.append((41, "z" * 40000, "en", "c", 1))
    rows.append((42, rows[40][1], "en", "c", 1))
    rows.append((43, "One Two three one TWO three", "es", None, 1))
    # repeated doc_ids with equal and with other texts, and rows without a doc_id
    rows += [rows[20], rows[20], rows[5]]
    rows.append((16, "\n".join([say(70), say(9), "  Common LINE here \t", say(11)]), "fr", "hot", 1))
    rows.append((17, rows[30][1] + "\n" + say(20), "fr", "hot", 1))
    rows.append((3, rows[25][1], "de", "a", 1))
    rows += [(None, rows[22][1], "en", "a", 1), (None, None, "en", "a", None), (None, rows[22][1], "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("size", "block", "unit", "h1", "pos", "kind", "n", "words", "component", "key", "rep", "u", "v", "n_words", "start", "source_size", "score"):
        out = out.withColumn(name, F.lit("clash"))
    return out

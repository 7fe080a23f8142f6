"""Operators 5 and 8 against brute force."""

import hashlib
import random
import re
from collections import Counter
from math import comb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, r, ok in rules for m in r.finditer(t or "") if ok(m.group())]


def check_pii(df, rows):
    from tessera.llm.pii import EVERY, KINDS, personal_data_digest

    found = personal_data_digest(df.sparkSession, df).collect()
    want = Counter()
    for d, t in rows:
        spans = base_spans(t)
        n = Counter(k for k, _, _ in spans)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[d, *(n[k] for k in KINDS), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, *(r[f"n_{k}"] for k in KINDS), r.base_sha256) for r in found) == want
    for r in found:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (EVERY.index(x[0]), x[1])) and len(spans) == r.n_spans and len(spans) >= sum(r[f"n_{k}"] for k in KINDS)
    return {r.doc_id: r for r in found}


def test_pii_contract_rows(spark, clashing, rows, empty):
    from tessera.llm.pii import personal_data_digest

    check_pii(clashing, [(r[0], r[1]) for r in rows])
    assert personal_data_digest(spark, empty).count() == 0


def test_pii_odd_texts(spark):
    rng = random.Random(2)
    pieces = ["a@b.c", "@", ".", "+", "1", "12", "-", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "255", "256", "1.2.3.4", "x_y%z", "日", "\n", "a.b", "+1 (784) 555-8120", "@d.e", "00004"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += ["a@b.c_x@d.e.f@g.h", "1.2.3.4.5.6.7.8", "9" * 50000, "a" * 50000, "1 " * 30000, "a@" + "b." * 30000, "+" + "1-" * 20000 + "1", "+1" * 9000]
    rows = list(enumerate(texts))
    check_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_pii_adds_loose_forms(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["river", "stone", "green", "walk", "seven"]) for _ in range(8))
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [(i, f"{say()} please call +1 {number()} {say()}") for i in range(60)]
    rows += [(100 + i, f"{say()} please call {number()} {say()}") for i in range(30)]
    rows += [(200 + i, f"{say()} invoice 0000-000-000{i % 10}/77 {say()}") for i in range(30)]
    got = check_pii(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert all(got[100 + i].spans.startswith("phone:") for i in range(30))
    assert not any(got[200 + i].spans for i in range(30))


def counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, clashing, rows, empty):
    from tessera.llm.quality_rules import quality_rules

    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (6, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    more = [(100 + i, t) for i, t in enumerate(("a b c a b c a b c", "a b c d\n\na b c d\n a b c d", "x " * 500, "# $% | <b> *", "a a a a a"))]
    df = clashing.select("doc_id", "text", "lang", "n_words").union(spark.createDataFrame([(d, t, "en", "") for d, t in more], "doc_id long, text string, lang string, n_words string"))
    want = Counter()
    for d, t in [(r[0], r[1]) for r in rows] + more:
        c = counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[d, *c, failed, not failed] += 1  # too few labels to certify a cutoff
    assert Counter(tuple(r) for r in quality_rules(spark, df, labels).collect()) == want
    assert quality_rules(spark, empty, labels).count() == 0


def test_binomial_tail(spark):
    from tessera.llm.quality_rules import binomial_tail

    for n, k, p in ((100, 0, 0.01), (100, 1, 0.02), (900, 9, 0.01), (3000, 28, 0.01)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.sql(f"SELECT {binomial_tail('n', 'k', p)} AS p FROM VALUES (bigint({n}), bigint({k})) t(n, k)").first()[0]
        assert abs(got - want) < 1e-9


def certified(rows, labels):
    """Cutoffs of each language by the docstring's rules, in plain Python with whole-number binomials."""
    import hashlib
    from fractions import Fraction

    from tessera.llm.quality_rules import ALPHA, DELTA, LEVELS, RULES

    def values(t):
        n, chars, symbols, dup, again = counts(t)
        lines = sum(1 for x in (t or "").split("\n") if WORD.search(x))
        return {"symbols": 1000 * symbols // max(n, 1), "repeats": 1000 * again // max(n, 1), "lines": 1000 * dup // max(lines, 1), "length": 100 * chars // max(n, 1)}, n < 50 or 100 * again > 50 * n

    known = [(d, lang, *values(t)) for d, t, lang in rows]
    good = [r for r in known if labels.get(r[0]) == 1 and not r[3]]
    picks = {d: hashlib.md5(str(d).encode()).hexdigest()[0] < "4" for d, *_ in good}
    index, tested = {}, {}
    for lang in {r[1] for r in good if picks[r[0]]}:
        part = [r for r in good if r[1] == lang and picks[r[0]]]
        index[lang] = {rule: next((i for i, c in enumerate(grid) if sum(r[2][rule] >= c for r in part) <= ALPHA / 8 * len(part)), len(grid)) for rule, (_, grid) in RULES.items()}
    cuts = lambda lang, k: {rule: grid[index[lang][rule] + k] for rule, (_, grid) in RULES.items() if index[lang][rule] + k < len(grid)}
    bad = lambda v, cut: any(v[rule] >= c for rule, c in cut.items())
    for lang in index:
        part = [r for r in good if r[1] == lang and not picks[r[0]]]
        if part:
            tested[lang] = (len(part), [sum(bad(r[2], cuts(lang, k)) for r in part) for k in range(LEVELS)])
    p = Fraction(str(ALPHA))
    tail = lambda n, k: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    chosen = {}
    for lang, (n, rejected) in tested.items():
        for k, x in enumerate(rejected):
            if x <= ALPHA * n and tail(n, x) <= Fraction(str(DELTA)) / (len(tested) * LEVELS):
                chosen[lang] = cuts(lang, k)
                break
    return {(d, not failed and not bad(v, chosen.get(lang, {}))) for d, lang, v, failed in known}, chosen


def test_cutoffs_control_risk(spark):
    """Enough labels in two strata, one of them null, too few in a third: against plain Python and against the SQL."""
    import duckdb

    from tessera.llm.quality_rules import ORACLE, quality_rules

    rng = random.Random(9)

    def text(junk, lang):
        w = [rng.choice("abcdefgh") * 2 + str(rng.randrange(999)) for _ in range(60)]
        for i in range(60):
            if junk == 1 or (lang is None and rng.random() < 0.1):  # symbols are usual in the null stratum
                w[i] += "%%%"
            elif junk == 2:
                w[i] *= 3
        return " ".join(w[:20]) + ("\n" + " ".join(w[20:26])) * (6 if junk == 3 else 1) + "\n" + " ".join(w[26:])

    rows, labels = [], {}
    for i in range(4200):
        lang = "en" if i % 2 else None if i % 20 else "de"
        junk = 0 if i % 5 or i % 20 == 0 else 1 + i // 5 % 3
        rows.append((i, text(junk, lang), lang))
        labels[i] = int(junk == 0)
    want, chosen = certified(rows, labels)
    assert set(chosen) == {"en", None} and len(chosen["en"]) == 4 and chosen["en"] != chosen[None]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    table = spark.createDataFrame([(d, q, 0) for d, q in labels.items()], "doc_id long, quality int, toxic int")
    got = quality_rules(spark, documents, table).collect()
    assert {(r.doc_id, r.kept) for r in got} == want
    assert sum(not k for _, k in want) > 500
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("labels", table.toPandas())
    assert Counter(con.sql(ORACLE).fetchall()) == Counter(tuple(r) for r in got)


def test_pii_finds_secrets(spark):
    rng = random.Random(6)
    say = lambda: " ".join(rng.choice(["river", "stone", "green", "token", "password", "secret"]) for _ in range(12))
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'{say()}\ntoken = "{key(40)}" {say()}') for i in range(40)] + [(100 + i, f"{say()} commit {key(40)} {say()}") for i in range(40)]
    got = check_pii(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    for i in range(40):
        at = rows[i][1].index('"') + 1
        assert got[i].spans == f"secret:{at}:{at + 40}" and not got[100 + i].spans
    # loose forms have no limits of length
    from tessera.llm.pii import spans

    long = "jane " * 3 + "x" * 300 + " [at] " + " [dot] ".join(["ab"] * 12 + ["com"])
    (found,) = spans(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().found
    assert (found.kind, found.s, found.e, found.base) == ("email", 15, len(long), False)


def test_pii_leaves_prose_alone(spark):
    rng = random.Random(5)
    words = ["look", "at", "the", "dot", "door.Then", "ran", "at", "noon.", "over", "12", "1994", "call", "3.5"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)) + (" mail me at a.b@mail7.example.com now" if i % 3 == 0 else "")) for i in range(300)]
    rows += [(1000, "write to jane.doe [at] example [dot] com please"), (1001, "write to jane.doe at example dot com please")]
    got = check_pii(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert all(len((got[i].spans or "").split(",")) == 1 and bool(got[i].spans) == (i % 3 == 0) for i in range(300))
    assert got[1000].spans.startswith("email:9:") and got[1001].spans.startswith("email:9:")

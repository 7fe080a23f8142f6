r"""Quality rules with risk-controlled cutoffs, in SQL expressions only.

Counts of each text: words, their code points, symbols, repeated lines, words in repeated 3-word
windows. A window's 64-bit hash carries its position in the low bits; one array sort brings equal windows
together, and neighbours with equal hash bits are compared word by word, so nothing is exploded or shuffled.

Cutoffs: the labelled good documents that pass the base rules are dealt by a hash of doc_id into a part that picks and a
part that certifies. In the first, each stratum (language; null is one of its own) picks for each rule the strictest grid cutoff
that rejects at most ALPHA / (2 x rules) of it. The candidates of a stratum are those cutoffs together, and all of them one to LEVELS - 1
grid steps laxer. In the second part, k of n documents are rejected by any of a candidate's rules; the candidate is certified when the exact binomial tail
P(Bin(n, ALPHA) <= k) is at most DELTA / (strata x LEVELS), that is, when the Clopper-Pearson upper bound of the verdict's
false rejection rate is at most ALPHA after Bonferroni correction. The strictest certified candidate holds; without one, the rules
reject nothing in that stratum. So with probability 1 - DELTA, kept = false hits at most ALPHA of the good documents of each stratum beyond the base rules.

Null or empty text has counts of 0 and fails the base rule. Null labels are left out; the lowest
label counts where a document has several. Rows that repeat keep their own result, and count as often for the cutoffs. Ties: equal values
fall on the same side of a cutoff. Very long texts are counted as a whole, in arrays of one row. Without labels, or with an empty table, there are no cutoffs, and the result
has the rows of docs. Only doc_id, text and lang are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, side

ALPHA, DELTA, LEVELS = 0.01, 0.05, 4
#: Rules: a value of the counts (whole number), and cutoffs from strict to lax; at or above goes.
RULES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", (100, 200, 300, 400, 600, 800)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (200, 300, 400)),
    "lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (300, 400, 500, 600, 800)),
    "length": ("100 * word_chars div greatest(n_words, 1)", (650, 700, 750, 800, 900, 1000)),
}
SPACE = r"[\\x20\\x09-\\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    words = docs.selectExpr("doc_id", "lang", "coalesce(text, '') AS text").selectExpr(
        "doc_id", "lang", f"array_remove(split(text, '{SPACE}+'), '') AS words",
        f"filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines",
        "length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS n_symbols",
    )
    keyed = words.selectExpr(
        "doc_id", "lang", "words", "size(words) AS n_words", "length(array_join(words, '')) AS word_chars", "n_symbols",
        "size(lines) - size(array_distinct(lines)) AS n_dup_lines", "size(lines) AS n_lines",
        "cast(ceil(log2(size(words) + 2)) AS int) AS bits",
    )
    sorted_ = keyed.selectExpr(
        "*",
        "if(n_words < 3, cast(array() AS array<bigint>), sort_array(transform(sequence(0, n_words - 3), i -> "
        "shiftleft(shiftright(xxhash64(words[i], words[i + 1], words[i + 2]), bits), bits) | cast(i AS bigint)))) AS keys",
    )
    place = lambda x: f"cast({x} & (shiftleft(1L, bits) - 1) AS int)"
    same = lambda x, y: f"shiftright({x}, bits) = shiftright({y}, bits)" + "".join(f" AND words[{place(x)} + {k}] = words[{place(y)} + {k}]" for k in range(3))
    repeated = sorted_.selectExpr(
        "*",
        f"sort_array(transform(filter(keys, (x, i) -> (i > 0 AND {same('x', 'keys[i - 1]')}) OR (i < size(keys) - 1 AND {same('x', 'keys[i + 1]')})), x -> {place('x')})) AS places",
    )
    return repeated.selectExpr(
        "doc_id", "lang", *(f"cast({c} AS bigint) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")),
        "cast(aggregate(places, named_struct('last', -3, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n) AS bigint) AS n_repeat_words",
    )


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k), summed in logarithms; only called for k <= p n."""
    first = f"{n} * ln(1 - {p!r}D)"
    step = f"a.term + ln((cast({n} AS double) - i + 1) / i) + ln({p!r}D / (1 - {p!r}D))"
    return (
        f"if({k} = 0, exp({first}), aggregate(sequence(1L, greatest({k}, 1L)), named_struct('term', {first}, 'total', {first}), "
        f"(a, i) -> named_struct('term', {step}, 'total', greatest(a.total, {step}) + ln(1 + exp(-abs(a.total - ({step}))))), a -> exp(a.total)))"
    )


#: SQL: labelled documents that pick cutoffs (a quarter); the others certify them.
PICKS = "substr(md5(cast(doc_id AS {string})), 1, 1) < '4'"


def picked(rule: str, grid: tuple) -> str:
    """SQL for the index of the strictest cutoff that rejects few enough of n documents; past the grid without one."""
    return "CASE " + " ".join(f"WHEN n > 0 AND k_{rule}_{c} <= {{most}} * n THEN {i}" for i, c in enumerate(grid)) + f" ELSE {len(grid)} END"


def cutoff(rule: str, grid: tuple, level: str) -> str:
    """SQL for the rule's cutoff so many steps laxer than its pick; null past the grid."""
    return f"CASE i_{rule} + {level} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(grid)) + " END"


def rejected(cut) -> str:
    """SQL: does any rule reject, cut(rule, grid) being the SQL of its cutoff?"""
    return " OR ".join(f"coalesce({value} >= {cut(rule, grid)}, false)" for rule, (value, grid) in RULES.items())


def cutoffs(scratch: Scratch, metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and the certified cutoff of each rule, for strata that have them."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = ("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    good = scratch.cut(metrics.where(f"NOT ({BASE_FAILED})").join(one.where("quality = 1").select("doc_id"), "doc_id").select(*values, F.expr(PICKS.format(string="string")).alias("picks")), "good")
    sums = [F.sum(F.when(F.expr(f"{value} >= {c}"), 1).otherwise(0)).alias(f"k_{rule}_{c}") for rule, (value, grid) in RULES.items() for c in grid]
    most = f"{alpha / (2 * len(RULES))!r}D"
    tried = good.where("picks").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"), *sums)
    picks = scratch.cut(tried.selectExpr("stratum", *(f"{picked(r, grid).format(most=most)} AS i_{r}" for r, (_, grid) in RULES.items())).coalesce(1), "picks")
    again = good.where("NOT picks").join(side(picks), F.col("lang").eqNullSafe(F.col("stratum")))
    levels = [F.count_if(F.expr(rejected(lambda r, grid: cutoff(r, grid, level)))).alias(f"k_{level}") for level in map(str, range(LEVELS))]
    tested = scratch.cut(again.groupBy("stratum", *(f"i_{r}" for r in RULES)).agg(F.count("*").alias("n"), *levels), "tested")
    level = "CASE " + " ".join(f"WHEN k_{k} <= {alpha!r}D * n AND {binomial_tail('n', f'k_{k}', alpha)} <= {delta!r}D / ({{strata}} * {LEVELS}) THEN {k}" for k in range(LEVELS)) + " END"
    strata = max(1, tested.count())
    certified = tested.selectExpr("*", f"{level.format(strata=strata)} AS level").where("level IS NOT NULL")
    return certified.selectExpr("stratum", *(f"{cutoff(r, grid, 'level')} AS cut_{r}" for r, (_, grid) in RULES.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts, base_failed and kept for every row of docs."""
    scratch = Scratch(spark, "quality-rules")
    metrics = scratch.cut(counts(docs), "counts")
    cut = scratch.cut(cutoffs(scratch, metrics, labels, alpha, delta).coalesce(1), "cutoffs")  # one row a language
    joined = metrics.join(side(cut), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return joined.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"({BASE_FAILED}) AS base_failed", f"NOT ({BASE_FAILED}) AND NOT ({rejected(lambda r, _: f'cut_{r}')}) AS kept")


def _oracle() -> str:
    div = lambda v: v.replace(" div ", " // ")
    sums = ", ".join(f"count(*) FILTER (WHERE {div(v)} >= {c}) AS k_{r}_{c}" for r, (v, grid) in RULES.items() for c in grid)
    tail = lambda k: f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))"
    index = ", ".join(f"{picked(r, grid).format(most=ALPHA / (2 * len(RULES)))} AS i_{r}" for r, (_, grid) in RULES.items())
    levels = ", ".join(f"count(*) FILTER (WHERE {div(rejected(lambda r, grid: cutoff(r, grid, k)))}) AS k_{k}" for k in map(str, range(LEVELS)))
    level = "CASE " + " ".join(f"WHEN k_{k} <= {ALPHA} * n AND {tail(f'k_{k}')} <= {DELTA} / (strata * {LEVELS}) THEN {k}" for k in range(LEVELS)) + " END"
    cuts = ", ".join(f"{cutoff(r, grid, 'level')} AS cut_{r}" for r, (_, grid) in RULES.items())
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT row_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), r AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, a, b, c) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) t(o) GROUP BY row_id
), m AS (
  SELECT doc_id, lang AS stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (row_id)
), b AS (SELECT *, {BASE_FAILED} AS base_failed FROM m
), one AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), good AS (SELECT b.*, {PICKS.format(string='VARCHAR')} AS picks FROM b JOIN one USING (doc_id) WHERE quality = 1 AND NOT base_failed
), tried AS (SELECT stratum, count(*) AS n, {sums} FROM good WHERE picks GROUP BY stratum
), index_ AS (SELECT stratum, {index} FROM tried
), tested AS (
  SELECT i.*, t.* EXCLUDE (s) FROM index_ i JOIN (SELECT g.stratum AS s, count(*) AS n, {levels} FROM good g JOIN index_ j ON g.stratum IS NOT DISTINCT FROM j.stratum WHERE NOT picks GROUP BY 1) t
    ON i.stratum IS NOT DISTINCT FROM t.s
), leveled AS (SELECT *, {level} AS level FROM tested, (SELECT count(*) AS strata FROM tested)
), cut AS (SELECT stratum, {cuts} FROM leveled WHERE level IS NOT NULL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({div(rejected(lambda r, _: f'cut_{r}'))}) AS kept
FROM b LEFT JOIN cut ON b.stratum IS NOT DISTINCT FROM cut.stratum
"""


ORACLE = _oracle()

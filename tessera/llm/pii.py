r"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans: one strict pattern for each kind, leftmost and non-overlapping, with a check of the match
(parts, Luhn, number of digits). They always stay.
Candidates: base spans, and looser forms of the same kinds that no base span covers (phone numbers without
a plus sign, cards with other separators, defanged addresses, spelled-out mail addresses); and of a further kind, secret: the value behind a
word such as token or password.
Labelers vote 1, 0 or -1 on each candidate: the strict regex, a gazetteer (top-level domains, first digits of card
issuers, reserved numbers, prefixes of keys), context words before the span, and the characters around it.
Expectation-maximisation estimates, for each kind, each labeler's reliability (how often it says yes to true and to false spans) and the share of true spans among the looser ones, from the counts of
vote patterns; base spans count as true there.
For each kind a logistic model is then fitted to the posteriors and decides on the candidates. Besides the votes it sees the span's length, digit
groups, separators, share of digits, the words and signs before it, and brackets.
Only counts of (kind, votes, features) are gathered; features are levels, so there is a bounded number of patterns, however many rows there are.

Null or empty text has no spans. Patterns use possessive loops and start at the first character of a run, so time stays linear on
very long runs and texts, which are searched as a whole; the matches are those of the plain patterns. Rows that repeat keep their own result, and count as often for the
models. Ties: of candidates that overlap, base spans win; looser ones of two kinds may both stay. An empty table gives an empty result. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

#: Kinds in order, with their strict patterns.
KINDS = ("email", "ip", "card", "phone")
#: Kinds with those that the method adds, in the order of the spans.
EVERY = (*KINDS, "secret")
LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text can hold a match at all.
GUARD = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9]{4}[._/\x20-]{1,2}[0-9]{4}[._/\x20-]{1,2}[0-9]{4}[._/\x20-]{1,2}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3,4}[\x20./-])[0-9]{3}[\x20./-][0-9]{4}(?![0-9])",
    "secret": r"""(?i)(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|bearer|credential)s?+["']?\x20?+[:=]?+\x20?+["']?[A-Za-z0-9+/_.~-]{16,}+""",
}
LOOSE_GUARD = {"secret": "(?i)(?:key|secret|token|passw|bearer|credential)", "email": r"(?:\(at\)|\[at\]|\{at\}|\x20dot\x20)", "ip": r"[0-9](?:\[\.\]|\(\.\))[0-9]", "card": "[0-9]{4}[._/\\x20-]", "phone": "[0-9]{3}[\\x20./-][0-9]{4}"}
#: Fixed values of the gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "us", "eu")
CONTEXT = {"email": "mail|contact|write|reach", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|master|credit|payment|account", "phone": "phone|call|tel|mobile|cell|fax|contact", "secret": r"[:=]\s*[\x22\x27]?$"}
AGAINST = r"(?:order|invoice|isbn|issn|version|no\.|nr\.|ref|id|serial|[$€£#])\s*$"
SPANS = "array<struct<s:int,e:int,t:string>>"
N_FEATURES = 11
EM_ROUNDS, FIT_ROUNDS, RATE, ACCEPT = 20, 500, 0.7, 0.9


def _found(name: str) -> str:
    """SQL: spans of the matches m_<name> between the gaps g_<name>."""
    start = f"a.p + length(g_{name}[i])"
    return (
        f"if(size(m_{name}) = 0, cast(array() AS {SPANS}), aggregate(sequence(0, size(m_{name}) - 1), named_struct('p', 0, 'o', cast(array() AS {SPANS})), "
        f"(a, i) -> named_struct('p', {start} + length(m_{name}[i]), 'o', concat(a.o, array(named_struct('s', {start}, 'e', {start} + length(m_{name}[i]), 't', m_{name}[i])))), a -> a.o))"
    )


def _matched(df: DataFrame, patterns: dict, guards: dict) -> DataFrame:
    text = F.col("text")
    cols: list[Column] = []
    for k, (pattern, guard) in {k: (patterns[k], guards[k]) for k in patterns}.items():
        cols.append(F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{k}"))
        cols.append(F.when(guard, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"g_{k}"))
    return df.select("*", *cols)


LUHN = "(aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, cast(substr({d}, -i, 1) AS int), 2 * cast(substr({d}, -i, 1) AS int) - if(substr({d}, -i, 1) > '4', 9, 0))) % 10 = 0)"
DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
CHECK = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> p rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN.format(d=DIGITS)}",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base_<kind> spans, and the candidates: struct(kind, s, e, base, votes, x)."""
    digits = F.col("text").rlike("[0-9]")
    guards = {k: F.col("text").contains(g) & (digits if k == "ip" or k == "phone" else F.lit(True)) if g else digits for k, g in GUARD.items()}
    df = _matched(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), STRICT, guards)
    df = df.selectExpr("doc_id", "text", *(f"filter({_found(k)}, x -> {CHECK[k]}) AS base_{k}" for k in KINDS))
    df = _matched(df, LOOSE, {k: F.col("text").rlike(g) for k, g in LOOSE_GUARD.items()})
    free = " AND ".join(f"NOT exists(base_{k}, b -> b.s < x.e AND b.e > x.s)" for k in KINDS)
    df = df.selectExpr("doc_id", "text", *(f"base_{k}" for k in KINDS), *(f"{_found(k)} AS loose_{k}" for k in EVERY))
    # of a secret only the value counts
    value = "regexp_extract(x.t, '[A-Za-z0-9+/_.~-]+$', 0)"
    values = f"filter(transform(loose_secret, x -> named_struct('s', x.e - length({value}), 'e', x.e, 't', {value})), x -> x.t rlike '[0-9]')"
    df = df.selectExpr("doc_id", "text", *(f"base_{k}" for k in KINDS), *(f"filter({values if k == 'secret' else f'loose_{k}'}, x -> {free}) AS loose_{k}" for k in EVERY))
    before = "lower(substring(text, greatest(x.s - 32, 0) + 1, x.s - greatest(x.s - 32, 0)))"
    around = "concat(if(x.s = 0, ' ', substring(text, x.s, 1)), if(x.e >= length(text), ' ', substring(text, x.e + 1, 1)))"
    shown = (
        "least(floor(log2(x.e - x.s)), 16D) / 8",  # length
        "least(size(regexp_extract_all(x.t, '[0-9]+', 0)), 8) / 8D",  # digit groups
        "least(length(translate(regexp_replace(x.t, '[0-9A-Za-z]+', ''), ' ', '_')), 8) / 8D",  # separators
        f"round(4 * length({DIGITS}) / (x.e - x.s)) / 4D",  # share of digits
        f"if({before} rlike r'[a-z]{{3,}}[^0-9a-z]*$', 1D, 0D)",  # a word before
        f"if({before} rlike r'[:=#]\\s*.?$', 1D, 0D)",  # a sign before
        "if(x.t rlike r'[(\\[]', 1D, 0D)",  # brackets
    )
    made = []
    for k in EVERY:
        gazetteer = {
            "email": f"if(lower(regexp_extract(x.t, '([A-Za-z]+)$', 1)) IN ({', '.join(map(repr, DOMAINS))}), 1, -1)",
            "ip": "if(x.t rlike '^(0|127|255)[^0-9]', -1, 1)",
            "card": f"if({DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|6)' AND {LUHN.format(d=DIGITS)}, 1, -1)",
            "phone": f"if({DIGITS} rlike '^0*([0-9])\\\\1+$', -1, if({DIGITS} rlike '555', 1, 0))",
            "secret": "if(x.t rlike '^(AKIA|gh[opsu]_|sk-|xox|eyJ)' OR x.t rlike '^[0-9a-fA-F]{32,}$', 1, 0)",
        }[k]
        context = f"if({before} rlike r'{AGAINST if k != 'secret' else '(?:example|sample|dummy|test)[^a-z]*$'}', -1, if({before} rlike r'{CONTEXT[k]}', 1, 0))"
        edges = f"if({around} rlike r'[0-9A-Za-z_/=-]', -1, 1)" if k != "secret" else f"if({around} rlike r'[0-9A-Za-z_/-]', -1, 1)"
        for base, source in ((1, f"base_{k}"), (0, f"loose_{k}"))[k not in KINDS :]:
            form = 1 if base else f"if({CHECK['ip'].replace('x.t', 'regexp_replace(x.t, r' + chr(39) + '[^0-9.]' + chr(39) + ', ' + chr(39) * 2 + ')') if k == 'ip' else 'true' if k in ('email', 'secret') else CHECK['card'] if k == 'card' else f'length({DIGITS}) BETWEEN 9 AND 11'}, 0, -1)"
            features = f"array(1D, if({gazetteer} > 0, 1D, 0D), if({context} > 0, 1D, if({context} < 0, -1D, 0D)), if({edges} > 0, 1D, 0D), {', '.join(shown)})"
            made.append(f"transform({source}, x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e, 'base', {base} = 1, 'votes', array({form}, {gazetteer}, {context}, {edges}), 'x', {features}))")
    return df.selectExpr("doc_id", *(f"transform(base_{k}, x -> named_struct('s', x.s, 'e', x.e)) AS base_{k}" for k in KINDS), f"concat({', '.join(made)}) AS found")


def fit(found: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each kind: share of true spans among the looser ones with the labelers' rates of yes for true and for false ones, and weights of the span classifier."""
    patterns = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.x").agg(F.count("*").cast("double").alias("n"))
    one = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "x", "n"))).alias("p"))  # bounded: votes and levels of features
    # m: share, then how often each labeler says yes to true spans and to false ones, when it votes
    logit = "ln(m[0] / (1 - m[0])) + aggregate(sequence(1, 4), 0D, (s, j) -> s + CASE r.votes[j - 1] WHEN 1 THEN ln(m[j] / m[j + 4]) WHEN -1 THEN ln((1 - m[j]) / (1 - m[j + 4])) ELSE 0D END)"
    chance = f"if(r.votes[0] = 1, 1D, 1 / (1 + exp(-({logit}))))"  # base spans anchor the labelers
    post = f"transform(p, r -> named_struct('v', r.votes, 'n', r.n, 'q', {chance}))"
    clip = lambda v: f"least(0.99D, greatest(0.01D, {v}))"
    share = clip("aggregate(z, 0.5D, (s, r) -> s + if(r.v[0] = 1, 0D, r.n * r.q)) / aggregate(z, 1D, (s, r) -> s + if(r.v[0] = 1, 0D, r.n))")
    rate = lambda q, yes: f"transform(sequence(0, 3), j -> {clip(f'aggregate(z, {yes}D, (s, r) -> s + if(r.v[j] = 1, r.n * {q}, 0D)) / aggregate(z, 2D, (s, r) -> s + if(r.v[j] = 0, 0D, r.n * {q}))')})"
    step = f"transform(array({post}), z -> concat(array({share}), {rate('r.q', 1.6)}, {rate('(1 - r.q)', 0.6)}))[0]"
    first = "array(0.5D, 0.8D, 0.8D, 0.8D, 0.8D, 0.3D, 0.3D, 0.3D, 0.3D)"
    em = one.selectExpr("kind", "p", f"aggregate(sequence(1, {EM_ROUNDS}), {first}, (m, i) -> {step}) AS m").selectExpr("kind", "p", "m", f"transform(p, r -> {chance}) AS q")
    total = "aggregate(p, 0D, (s, r) -> s + r.n)"
    error = f"(q[k] - 1 / (1 + exp(-aggregate(sequence(0, {N_FEATURES - 1}), 0D, (s, j) -> s + w[j] * p[k].x[j])))) * p[k].n / t"
    gradient = f"transform(array(transform(sequence(0, size(p) - 1), k -> {error})), g -> transform(sequence(0, {N_FEATURES - 1}), j -> 0.9998D * w[j] + {RATE}D * aggregate(sequence(0, size(p) - 1), 0D, (s, k) -> s + g[k] * p[k].x[j])))[0]"
    fitted = em.selectExpr("kind", "p", "m", "q", f"{total} AS t").selectExpr("kind", "m", f"aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, {N_FEATURES}), (w, i) -> {gradient}) AS w")
    return {r["kind"]: (list(r["m"]), list(r["w"])) for r in fitted.collect()}  # one row a kind


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, s, e, base, p) in order of kind and start, for every row of docs."""
    scratch = Scratch(spark, "personal-data")
    found = scratch.cut(spans(docs), "spans")
    score = lambda w: "1 / (1 + exp(-(" + " + ".join(f"({v!r}D) * f.x[{i}]" for i, v in enumerate(w)) + ")))"
    p = " ".join(["CASE f.kind", *(f"WHEN '{k}' THEN {score(w)}" for k, (_, w) in sorted(fit(found).items())), "WHEN '' THEN 0D END"])
    rank = f"array_position(array({', '.join(map(repr, EVERY))}), f.kind)"
    kept = f"filter(transform(found, f -> named_struct('rank', {rank}, 's', f.s, 'e', f.e, 'kind', f.kind, 'base', f.base, 'p', {p})), f -> f.base OR f.p >= {ACCEPT}D)"
    return found.selectExpr("doc_id", *(f"base_{k}" for k in KINDS), f"array_sort({kept}) AS spans")


def personal_data_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = lambda a, kind: f"transform({a}, f -> concat({kind}, ':', f.s, ':', f.e))"
    quote = lambda k: f"'{k}'"
    base = f"concat({', '.join(text(f'base_{k}', quote(k)) for k in KINDS)})"
    return personal_data(spark, docs).selectExpr(
        "doc_id", *(f"cast(size(base_{k}) AS bigint) AS n_{k}" for k in KINDS),
        f"sha2(array_join({base}, ','), 256) AS base_sha256", f"array_join({text('spans', 'f.kind')}, ',') AS spans",
        "cast(size(spans) AS bigint) AS n_spans",
    )

"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base patterns give spans that always stay.  Wider patterns propose further
candidates; labelers of three sorts (strict patterns, gazetteers, words before
the span) vote on every candidate, base spans included.  Expectation
maximisation estimates each labeler's reliability from the counts of vote
patterns, without labels.  Its posteriors train the final span classifier, a
logistic regression over shape features, which decides on the candidates.

Votes and features are small integers, so what comes to the driver is one row
per combination of them (at most a few thousand), however large the corpus.

Positions come from ``split``: the pieces between matches and the matches have
known lengths.  Patterns are possessive and start only where a run starts, so a
long run costs linear time and no recursion.  Running sums and maxima go by chunks,
overlaps by binary search and text pieces by pages, so that a text of very many
spans costs hardly more than in proportion.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import scratch

_LOCAL = "A-Za-z0-9._%+-"

#: kind: (pattern, cheap condition on ``t`` that every match implies, condition on a match ``x.v``)
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true"),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "contains(t, '.') and rlike(t, '[0-9][.][0-9]')",
        "forall(split(x.v, '[.]', -1), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    ),
    "card": (
        r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
        "rlike(t, '[0-9][ -]?[0-9]')",
        "length(translate(x.v, ' -', '')) between 14 and 19 and luhn_check(translate(x.v, ' -', ''))",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", "length(regexp_replace(x.v, '[^0-9]', '')) between 10 and 15"),
}

EXTRA = {
    "secret": (r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,128}+(?![A-Za-z0-9_/+-])", "rlike(t, '[0-9]')", "rlike(x.v, '[0-9]') and rlike(x.v, '[A-Za-z]')"),
    "national": (r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "rlike(t, '[0-9]{3}[)]?[ .-][0-9]')", "true"),
    "personal_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "rlike(t, '[0-9]{3}-[0-9]{2}-')", "true"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "rlike(t, '[A-Z]{2}[0-9]{2}')", "true"),
}

KINDS = [*BASE, *EXTRA]

#: Strict patterns, one per kind: whole match says yes.
STRICT = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"(?!0\.|127\.|255\.)[0-9]{1,3}(\.[0-9]{1,3}){3}",
    "card": r"[0-9]{4}([\x20-]?)[0-9]{4,6}\1[0-9]{4,5}(\1[0-9]{1,7})?|[0-9]{14,19}",
    "phone": r"\+[1-9][0-9]{0,2}[\x20.-]?(\([0-9]+\)|[0-9]+)[\x20.-][0-9\x20.-]*[0-9]",
    "secret": r"[0-9a-f]{16,}|[A-Z0-9]{16,}|(AKIA|ASIA|ghp_|sk_|xox)[A-Za-z0-9_-]+",
    "national": r"\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}([.-])[0-9]{3}\1[0-9]{4}",
    "personal_id": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11,}",
}

#: Gazetteers: endings of host names, card issuers, calling codes, key prefixes, countries of accounts.
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|ch|at|us|ca|nl|pl|se)$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|64|65|35|62)",
    "phone": r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|eyJ)",
    "national": r"^\(?(20[1-9]|21[0-9]|30[1-9]|31[0-9]|40[1-9]|41[0-9]|50[1-9]|51[0-9]|60[1-9]|61[0-9]|70[1-9]|71[0-9]|80[1-8]|81[0-9])",
    "personal_id": r"^[0-8]",
    "iban": r"^(DE|FR|ES|IT|GB|NL|BE|AT|CH|PL|PT|IE|LU|SE|DK|NO|FI)",
}

CUES = r"(?i)(e-?mail|mail|contact|write to|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|address|host|server|from|login|user|password|passwd|pwd|token|secret|api.?key|key|bearer)[^A-Za-z0-9]{0,6}$"
AGAINST = r"(?i)(version|isbn|issn|page|order|item|commit|sha|md5|build|chapter|section|figure|http|https|www|serial)[^A-Za-z0-9]{0,6}$"

CHUNK, PAGE = 64, 1024

_SPANS = "array<struct<s:int,e:int,v:string,b:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, combine: str) -> str:
    """SQL for what ``combine`` (of ``a`` and ``x``) makes of all earlier integers, at each place; 0 at the first."""
    chunks = f"transform(sequence(0, cast(greatest(size(vs) - 1, 0) div {CHUNK} as int)), c -> slice(vs, c * {CHUNK} + 1, {CHUNK}))"
    push = f"(q, x) -> struct({_let('a', 'q.at', combine)} as at, concat(q.out, array(q.at)) as out)"
    tops = f"aggregate(transform(cs, c -> aggregate(c, 0, (a, x) -> {combine})), struct(0 as at, cast(array() as array<int>) as out), {push}).out"
    inner = f"flatten(zip_with(cs, {tops}, (c, t) -> aggregate(c, struct(t as at, cast(array() as array<int>) as out), {push}).out))"
    return _let("vs", values, _let("cs", chunks, inner))


def _matches(pattern: str, when: str, valid: str) -> str:
    """SQL for the valid matches in ``t``: start, end, value, and 32 characters before."""
    q = _quoted(pattern)
    found = f"filter(zip_with(regexp_extract_all(t, {q}, 0), split(t, {q}, -1), (v, p) -> struct(v, p)), x -> x.v is not null)"
    begun = _before("transform(ms, x -> length(x.p) + length(x.v))", "a + x")
    spans = f"zip_with(ms, {begun}, (x, at) -> struct(at + length(x.p) as s, at + length(x.p) + length(x.v) as e, x.v as v, right(x.p, 32) as b))"
    return f"case when {when} then {_let('ms', found, f'filter({spans}, x -> {valid})')} else cast(array() as {_SPANS}) end"


def _overlaps(spans: str) -> str:
    """SQL: does ``x`` overlap one of ``spans``, which are in order and apart?  Binary
    search for the last one that starts before the end of x."""
    mid = "shiftright(a.lo + a.hi + 1, 1)"
    step = f"case when a.lo >= a.hi then a when element_at({spans}, {mid}).s < x.e then struct({mid} as lo, a.hi as hi) else struct(a.lo as lo, {mid} - 1 as hi) end"
    last = f"aggregate(sequence(0, cast(log2(size({spans}) + 1) as int) + 1), struct(0 as lo, size({spans}) as hi), (a, i) -> {step}).lo"
    return f"(size({spans}) > 0 and {_let('n', last, f'n > 0 and element_at({spans}, greatest(n, 1)).e > x.s')})"


def _described(kind: str, base: bool) -> str:
    """SQL turning a match ``x`` into a candidate with votes and features."""
    vote_context = f"case when rlike(x.b, {_quoted(CUES)}) then 1 when rlike(x.b, {_quoted(AGAINST)}) then 0 end"
    n = KINDS.index(kind)
    distinct = "size(array_distinct(split(x.v, '')))"
    return f"""struct(x.s as s, {n} as k, x.e as e, {str(base).lower()} as base,
        cast(coalesce(case when rlike(x.v, {_quoted("^(?:" + STRICT[kind] + ")$")}) then 1 else 0 end, -1) as int) as v1,
        cast(case when rlike(x.v, {_quoted(GAZETTEER[kind])}) then 1 else -1 end as int) as v2,
        cast(coalesce({vote_context}, -1) as int) as v3,
        cast(case when {distinct} <= 3 then 0 when rlike(x.v, '[0-9]{{2}}') then 1 else -1 end as int) as v4,
        cast(least(length(x.v) div 8, 5) as int) as f_length,
        cast(length(regexp_replace(x.v, '[^0-9]', '')) * 4 div length(x.v) as int) as f_digits,
        cast(least({distinct} * 4 div length(x.v), 3) as int) as f_variety,
        cast(case when x.b = '' then 0 when rlike(x.b, r'[=:]\\s*["\\x27]?$') then 1 when rlike(x.b, r'\\s$') then 2 else 3 end as int) as f_before)"""


VOTES = ["v1", "v2", "v3", "v4"]
FEATURES = {"k": len(KINDS), "f_length": 6, "f_digits": 5, "f_variety": 4, "f_before": 4}


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_found``: all base spans and all other candidates that
    overlap none of them, by start and kind.  Other columns stay."""
    t = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    parts = {}
    for group in (BASE, EXTRA):
        for kind, (pattern, when, valid) in group.items():
            parts[kind] = f"_m_{kind}"
            t = t.withColumn(f"_m_{kind}", F.expr(_matches(pattern, when, valid)))
    apart = " and ".join(f"not {_overlaps(parts[k])}" for k in BASE)
    described = {kind: f"transform({parts[kind]}, x -> {_described(kind, True)})" for kind in BASE}
    described |= {kind: f"transform(filter({parts[kind]}, x -> {apart}), x -> {_described(kind, False)})" for kind in EXTRA}
    return t.select("_doc.*", F.expr(f"array_sort(concat({', '.join(described[k] for k in KINDS)}))").alias("_found"))


@dataclass(frozen=True)
class Model:
    """Reliabilities (of each labeler: P(yes) given personal, given not, when it
    votes), the prior, and the classifier's weights by feature and value."""

    reliability: dict[str, tuple[float, float]]
    prior: float
    weights: dict[str, list[float]]
    bias: float


def fit(counts: list[tuple[tuple[int, ...], tuple[int, ...], int]], rounds: int = 60, steps: int = 300) -> Model:
    """Estimate a model from (votes, features, number of candidates).

    Votes: 1 personal, 0 not, -1 no vote.  Without candidates nothing is kept.
    """
    by_votes: dict[tuple[int, ...], int] = defaultdict(int)
    for votes, _, n in counts:
        by_votes[votes] += n
    total = sum(by_votes.values())
    rel = {v: (0.8, 0.2) for v in VOTES}
    prior = 0.5

    def posterior(votes: tuple[int, ...]) -> float:
        yes, no = math.log(prior), math.log(1 - prior)
        for name, v in zip(VOTES, votes, strict=True):
            if v >= 0:
                p, q = rel[name]
                yes += math.log(p if v else 1 - p)
                no += math.log(q if v else 1 - q)
        return 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))

    for _ in range(rounds if total else 0):
        post = {votes: posterior(votes) for votes in by_votes}
        prior = min(0.99, max(0.01, (sum(n * post[v] for v, n in by_votes.items()) + 1) / (total + 2)))
        for i, name in enumerate(VOTES):
            sums = [[1.6, 0.4], [0.4, 1.6]]  # pseudo-counts: a labeler is better than chance until shown otherwise
            for votes, n in by_votes.items():
                if votes[i] >= 0:
                    sums[0][1 - votes[i]] += n * post[votes]
                    sums[1][1 - votes[i]] += n * (1 - post[votes])
            rel[name] = (sums[0][0] / sum(sums[0]), sums[1][0] / sum(sums[1]))
    weights = {f: [0.0] * size for f, size in FEATURES.items()}
    bias = 0.0 if total else -1.0
    rows: dict[tuple[int, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for votes, features, n in counts:
        rows[features][0] += n
        rows[features][1] += n * posterior(votes)
    for _ in range(steps if total else 0):
        grad = {f: [0.0] * size for f, size in FEATURES.items()}
        grad_bias = 0.0
        for features, (n, yes) in rows.items():
            z = bias + sum(weights[f][x] for f, x in zip(FEATURES, features, strict=True))
            error = (n / (1 + math.exp(-max(-60.0, min(60.0, z)))) - yes) / total
            grad_bias += error
            for f, x in zip(FEATURES, features, strict=True):
                grad[f][x] += error
        bias -= grad_bias
        for f, g in grad.items():
            weights[f] = [w - 2.0 * (d + 1e-4 * w) for w, d in zip(weights[f], g, strict=True)]
    return Model(rel, prior, weights, bias)


def learn(found: DataFrame) -> Model:
    """Fit on all candidates of a table with ``_found``."""
    c = found.select(F.explode("_found").alias("c")).select("c.*")
    rows = c.groupBy(*VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted((tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES), r["n"]) for r in rows))


def classified(model: Model) -> Column:
    """All spans that stay: base ones, and candidates that the classifier accepts."""
    terms = [f"element_at(array({', '.join(f'{w!r}D' for w in model.weights[f])}), x.{f} + 1)" for f in FEATURES]
    return F.expr(f"filter(_found, x -> x.base or {model.bias!r}D + {' + '.join(terms)} > 0)")


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Model]:
    """``docs`` with ``spans``: array of (s, k, e, base, ...), k an index in
    ``KINDS``, positions in code points with exclusive ends; and the model.

    A null text is empty and has no spans.  All rows stay, repeated ones too, and
    all columns but ones named ``_doc``, ``_found`` or ``spans``, which are this
    operator's.  Base matches that fail their check are dropped and not tried again
    further in.  An empty table gives an empty one.
    """
    found = scratch.table(candidates(docs, text_col), "pii")
    model = learn(found)
    return found.withColumn("spans", classified(model)).drop("_found"), model


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: str, spans: str) -> Column:
    """Column ``text`` with every span of column ``spans`` replaced by its kind in
    angle brackets; of overlapping spans the first stands for all."""
    names = f"array({', '.join(repr(f'<{k}>') for k in KINDS)})"

    def piece(a: str, b: str) -> str:
        first = f"cast({a} div {PAGE} as int)"
        pages = f"slice(pages, {first} + 1, cast(({b} - 1) div {PAGE} as int) - {first} + 1)"
        return f"case when {a} >= {b} then '' else substring(array_join({pages}, ''), {a} % {PAGE} + 1, {b} - {a}) end"

    done = _before(f"transform({spans}, x -> x.e)", "greatest(a, x)")
    parts = f"zip_with({spans}, {done}, (x, at) -> case when x.s >= at then concat({piece('at', 'x.s')}, element_at({names}, x.k + 1)) else '' end)"
    rest = piece("last", f"length({text})")
    whole = f"concat(array_join({parts}, ''), {_let('last', f'array_max(transform({spans}, x -> x.e))', rest)})"
    paged = _let("pages", f"regexp_extract_all({text}, '(?s).{{1,{PAGE}}}', 0)", whole)
    return F.expr(f"case when size({spans}) = 0 then {text} else {paged} end")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, counts and digest of base spans, and all spans."""
    out, _ = find(docs.select(F.col(id_col), F.col(text_col)), text_col)
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.k = {KINDS.index(kind)})) as bigint) as n_{kind}") for kind in BASE]
    return out.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Personal data: fixed patterns, and further spans found by weak supervision, in DataFrame and SQL functions only.

Base spans are the leftmost non-overlapping matches of four patterns, each checked afterwards. The patterns are written
possessively and anchored behind the characters they start with, which finds the same matches in linear time.

Further candidates are long tokens with digits and long numbers that overlap no base span. Labelers vote on each (yes,
no, abstain): shape patterns, a checksum or the token's character mix, gazetteers of cue words before it, and the
characters around it. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability
and a probability per pattern; with these probabilities as soft labels, a naive Bayes classifier over features of the
span and its context is trained, and it decides. Counts cover every candidate of every document, yet only the counts
reach the driver: at most 3 ** labelers vote patterns a type, and a bounded set of feature values.

One pass over the texts stores base spans and candidates; training and the result read that table.

Nulls and edge cases: a null text counts as empty and has no spans; repeated rows give repeated rows; without
candidates there is nothing to train and no span is added; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone", "secret", "number")

#: Patterns of the base spans: kind, what a text must contain, the pattern, and the check of a match m.
_PART = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = "aggregate(sequence(1, length(r)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(r, i, 1)), 2 * int(substr(r, i, 1)) - if(int(substr(r, i, 1)) > 4, 9, 0))) % 10 = 0"
BASE = (
    ("email", "contains(t, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    ("ip", "contains(t, '.') and d", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"forall(split(m, '[.]'), x -> x rlike '{_PART}')"),
    ("card", "d", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", f"length({_DIGITS}) between 16 and 19 and transform(array(reverse({_DIGITS})), r -> {_LUHN})[0]"),
    ("phone", "contains(t, '+') and d", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15"),
)

#: Candidates for further spans: type, pattern.
CANDIDATES = (
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"),
    ("number", r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,}+(?![0-9A-Za-z])"),
)

#: Cue words before a span, by type of candidate.
CUES = {
    "secret": "token|secret|password|passwd|pwd|api|apikey|key|auth|bearer|credential|signature|hash",
    "number": "tel|telephone|phone|call|fax|mobile|ssn|passport|account|iban|konto|telefon|appel|llamar|card|carte|tarjeta|karte",
}

#: Votes of the labelers on a candidate c (kind, text) with b, a: up to 24 characters before and 2 after it. 1 yes, -1 no, 0 abstain.
LABELERS = {
    "shape": r"case when c.kind = 'secret' then if(c.text rlike '^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:sk|pk|ghp|xox[a-z])[_-].*)$', 1, 0)"
    r" else if(c.text rlike '^(?:\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$', 1, if(c.text rlike '^[0-9]+$', -1, 0)) end",
    "mix": r"case when c.kind = 'secret' then if(c.text rlike '[A-Za-z].*[0-9].*[A-Za-z].*[0-9].*[A-Za-z].*[0-9]', 1, -1)"
    " else if(length(c.digits) between 9 and 11, 1, -1) end",
    "gazetteer": "case when b rlike concat('(?i)(?:^|[^A-Za-z])(?:', if(c.kind = 'secret', '{secret}', '{number}'), ')[^A-Za-z]{0,6}$') then 1 else -1 end",
    "assignment": r"case when b rlike '[=:]\\s*[\"\x27]?$' then 1 when b rlike '[A-Za-z]\\s$' then if(c.kind = 'secret', 0, -1) else 0 end",
    "edges": r"case when b rlike '[\"\x27]$' and a rlike '^[\"\x27]' then 1 when b rlike '[A-Za-z_]$' or a rlike '^[A-Za-z_]' then -1 else 0 end",
}

#: Features of the final classifier, as bounded categories.
FEATURES = {
    "length": "string(least(int(length(c.text) / 4), 20))",
    "digits": "string(int(10 * length(c.digits) / length(c.text)))",
    "before": r"case when b = '' then 'none' when b rlike '[\"\x27]$' then 'quote' when b rlike '[=:]\\s*$' then 'assign' when b rlike '\\s$' then 'space' when b rlike '[A-Za-z]$' then 'letter' else 'other' end",
    "after": r"case when a = '' then 'none' when a rlike '^[\"\x27]' then 'quote' when a rlike '^\\s' then 'space' when a rlike '^[A-Za-z]' then 'letter' else 'other' end",
    "cue": "case when b rlike concat('(?i)(?:^|[^A-Za-z])(?:', if(c.kind = 'secret', '{secret}', '{number}'), ')[^A-Za-z]') then 'cue' else 'none' end",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


_SPAN = "array<struct<kind:string,start:bigint,stop:bigint,text:string>>"


STRIDE = 64  # matches whose places are counted on from a known one: arrays grow by copying, so long ones are built of short ones


def _matches(kind: str, guard: str, pattern: str, check: str) -> str:
    """SQL for the spans of one pattern in t: what lies between the matches gives their places."""
    p = _quoted(pattern)
    span = f"named_struct('kind', '{kind}', 'start', z.at + length(s[i]), 'stop', z.at + length(s[i]) + length(f[i]), 'text', f[i])"
    step = f"named_struct('at', z.at + length(s[i]) + length(f[i]), 'out', array_append(z.out, {span}))"
    own = f"sequence({STRIDE} * k, least({STRIDE} * k + {STRIDE - 1}, size(f) - 1))"  # the matches of stride k
    passed = f"aggregate({own}, 0L, (q, i) -> q + length(s[i]) + length(f[i]))"
    begins = f"aggregate(sequence(0, int((size(f) - 1) / {STRIDE})), named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (g, k) -> named_struct('at', g.at + {passed}, 'out', array_append(g.out, g.at)), g -> g.out)"
    placed = f"flatten(transform({begins}, (o, k) -> aggregate({own}, named_struct('at', o, 'out', cast(array() as {_SPAN})), (z, i) -> {step}, z -> z.out)))"
    placed = _let("s", f"split(t, {p}, -1)", placed)
    found = f"if({guard}, regexp_extract_all(t, {p}, 0), cast(array() as array<string>))"
    return _let("f", found, f"if(size(f) = 0, cast(array() as {_SPAN}), filter({placed}, q -> {_let('m', 'q.text', check)}))")


def _extraction() -> str:
    """SQL: base spans and candidates (with votes and features) of t."""
    base = "concat(" + ", ".join(_matches(k, g, p, c.replace("\\", "\\\\")) for k, g, p, c in BASE) + ")"
    found = "concat(" + ", ".join(_matches(k, "d", p, "true") for k, p in CANDIDATES) + ")"
    clear = f"filter({found}, q -> not exists(base, x -> q.start < x.stop and x.start < q.stop))"

    def filled(x: str) -> str:
        return x.replace("{secret}", CUES["secret"]).replace("{number}", CUES["number"])

    votes = ", ".join(f"'{n}', int({filled(x)})" for n, x in LABELERS.items())
    features = ", ".join(f"'{n}', {filled(x)}" for n, x in FEATURES.items())
    seen = f"named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop, 'votes', named_struct({votes}), 'features', named_struct({features}))"
    around = _let("b", "substr(t, int(greatest(c.start - 24, 0)) + 1, int(least(c.start, 24)))", _let("a", "substr(t, int(c.stop) + 1, 2)", seen))
    with_digits = "named_struct('kind', q.kind, 'start', q.start, 'stop', q.stop, 'text', q.text, 'digits', regexp_replace(q.text, '[^0-9]', ''))"
    candidates = f"transform(transform({clear}, q -> {with_digits}), c -> {around})"
    return _let("d", "t rlike '[0-9]'", _let("base", base, f"named_struct('base', transform(base, q -> named_struct('kind', q.kind, 'start', q.start, 'stop', q.stop)), 'candidates', {candidates})"))


def extracted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with base and candidates."""
    kept = [c for c in docs.columns if c not in (text, "base", "candidates")]
    # inline() keeps the optimiser from copying the expression into later filters
    return docs.withColumn("t", F.coalesce(F.col(text), F.lit(""))).select(*kept, F.expr(f"inline(array({_extraction()}))"))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], dict[tuple[int, ...], float]]:
    """Of (votes, count): each labeler's reliability, and the probability of yes per pattern. Two classes, one reliability a labeler."""
    if not patterns:
        return [], {}
    k, total = len(patterns[0][0]), sum(n for _, n in patterns)
    sure, prior, posterior = [0.8] * k, 0.5, {}
    for _ in range(rounds):
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, sure, strict=True))
            posterior[votes] = 1 / (1 + math.exp(-odds))
        prior = min(0.95, max(0.05, sum(n * posterior[v] for v, n in patterns) / total))
        for j in range(k):
            cast = sum(n for v, n in patterns if v[j])
            right = sum(n * (posterior[v] if v[j] > 0 else 1 - posterior[v]) for v, n in patterns if v[j])
            sure[j] = min(0.99, max(0.51, (right + 4) / (cast + 5)))
    return sure, posterior


def train(found: DataFrame) -> str:
    """SQL for the log odds of a candidate c; trained on all candidates of found."""
    every = found.select(F.explode("candidates").alias("c"))
    keys = ["c.kind", *(f"c.votes.{n}" for n in LABELERS), *(f"c.features.{n}" for n in FEATURES)]
    names = ["kind", *(f"v_{n}" for n in LABELERS), *(f"f_{n}" for n in FEATURES)]
    every = every.select(*(F.col(a).alias(b) for a, b in zip(keys, names, strict=True)))
    votes = names[: 1 + len(LABELERS)]
    counted = every.groupBy(*votes).count().collect()
    posterior: dict[tuple, float] = {}
    for kind, _ in CANDIDATES:
        own = [(tuple(r[v] for v in votes[1:]), r["count"]) for r in counted if r["kind"] == kind]
        posterior |= {(kind, *v): p for v, p in expectation_maximisation(own)[1].items()}
    if not posterior:
        return "-1d"
    label = "element_at(map(" + ", ".join(f"'{'|'.join(map(str, k))}', {p!r}d" for k, p in posterior.items()) + f"), concat_ws('|', {', '.join(votes)}))"
    soft = every.withColumn("yes", F.expr(label))
    values = F.explode(F.array(F.struct(F.lit("all").alias("f"), F.lit("").alias("v")), *(F.struct(F.lit(n).alias("f"), F.col(f"f_{n}").alias("v")) for n in FEATURES)))
    sums = soft.select("kind", "yes", values.alias("x")).groupBy("kind", "x.f", "x.v").agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no")).collect()
    whole = {r["kind"]: (r["yes"], r["no"]) for r in sums if r["f"] == "all"}
    parts = []
    prior = ", ".join(f"'{k}', {math.log((y + 0.1) / (n + 0.1))!r}d" for k, (y, n) in sorted(whole.items()))
    parts.append(f"element_at(map({prior}), c.kind)")
    for name in FEATURES:
        known = {}
        for r in sums:
            if r["f"] == name:
                y, n = whole[r["kind"]]
                known[f"{r['kind']}|{r['v']}"] = math.log((r["yes"] + 0.5) / (y + 1)) - math.log((r["no"] + 0.5) / (n + 1))
        entries = ", ".join(f"'{k}', {x!r}d" for k, x in sorted(known.items()))
        parts.append(f"coalesce(element_at(map({entries}), concat(c.kind, '|', c.features.{name})), 0d)")
    return " + ".join(parts)


def _ordered(spans: str) -> str:
    """SQL: spans by kind as listed, then start."""
    listed = "map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS)) + ")"
    key = f"named_struct('o', element_at({listed}, x.kind), 'start', x.start, 'stop', x.stop, 'kind', x.kind)"
    return f"sort_array(transform({spans}, x -> {key}))"


def _joined(spans: str) -> str:
    return f"array_join(transform({_ordered(spans)}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"


def with_spans(found: DataFrame, odds: str) -> DataFrame:
    """found with spans: the base spans and the candidates the classifier takes."""
    added = f"transform(filter(candidates, c -> {odds} > 0), c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop))"
    return found.withColumn("spans", F.expr(f"concat(base, {added})"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = stored(extracted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    spans = with_spans(found, train(found))
    counts = {f"n_{k}": F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))") for k in KINDS[:4]}
    return spans.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets, n_chars to match; columns unchanged."""
    odds = train(stored(extracted(docs.select("text"))))
    both = with_spans(extracted(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), "_text"), odds)
    # overlapping spans are masked as one, under the first one's kind
    row = "sort_array(transform(spans, x -> named_struct('start', x.start, 'stop', x.stop, 'kind', x.kind)))"
    step = (
        "if(x.start < z.at, named_struct('at', greatest(z.at, x.stop), 'out', z.out),"
        " named_struct('at', x.stop, 'out', array_append(array_append(z.out, substr(_row.text, int(z.at) + 1, int(x.start - z.at))), concat('<', upper(x.kind), '>'))))"
    )
    built = f"aggregate({row}, named_struct('at', 0L, 'out', cast(array() as array<string>)), (z, x) -> {step}, z -> concat(array_join(z.out, ''), substr(_row.text, int(z.at) + 1)))"
    text = F.expr(f"if(size(spans) = 0, _row.text, {built})")
    out = both.select("_row", F.inline(F.array(F.struct(text.alias("_masked")))))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns))


QUERIES = {"op4_pii": op4_pii}
ORACLE_SQL: dict = {}

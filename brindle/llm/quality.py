"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Base signals per document come from one pass over the text. Rules score a document by ratios of these signals, higher
is worse. STEPS is one fixed sequence of ever stricter rule sets: each step adds a rule with a cutoff, and a document is
rejected by a step if any rule up to it is above its cutoff. Labelled documents (quality 1 is good) are the holdout. Per
stratum, the steps are tested in their order: of the good documents that the base rule leaves, the share that a step
rejects by all its rules together must, by its exact binomial (Clopper-Pearson) upper bound, stay within RISK. The first
step that fails ends the sequence, so one error probability serves all steps of a stratum (fixed-sequence testing); it
is divided over the strata that are tested (Bonferroni): those with labels enough that a step without any false
rejection could pass. So with the stated confidence no stratum loses more than RISK of its good documents. All proven
steps hold together, so any may be taken: the one with the most bad less good labelled documents rejected, the loosest
of equals. A stratum without a proven step loses nothing but what the base rule rejects.

The holdout is every labelled document. Every stratum has its own counts and step, in a table that is joined back by
stratum (broadcast if counted at most FEW); only the number of tested strata reaches the driver.

Nulls and edge cases: a null stratum is one of its own; a null text has no words and fails the base rule; null labels
and null doc_ids are left out of the holdout; a document labelled twice counts once, as good if any of its labels is;
without labels no step is proven; repeated rows give repeated rows; columns of docs with the signals' names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stored, table

RISK = 0.02  # allowed share of good documents rejected, per stratum
CONFIDENCE = 0.95
FEW = 50_000  # strata whose cutoffs may be broadcast
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Scores, higher is worse.
SCORES = {"symbols": "n_symbols / n_words", "repeats": "n_repeat_words / n_words", "lines": "n_dup_lines / n_lines", "long words": "word_chars / n_words"}

#: The fixed sequence: score and cutoff that each step adds, coarse ones of all scores first.
STEPS = (
    ("symbols", 2.0), ("symbols", 1.0), ("repeats", 0.4), ("lines", 0.5), ("long words", 20.0),
    ("symbols", 0.5), ("symbols", 0.3), ("symbols", 0.1), ("repeats", 0.3), ("lines", 0.3), ("long words", 15.0), ("long words", 12.0),
    ("repeats", 0.2), ("lines", 0.2), ("long words", 10.0), ("repeats", 0.1), ("long words", 8.0),
)
LEFT_OUT = 20  # terms of a binomial tail that are summed, in standard deviations; what follows is bounded

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    A repeat word is covered by a 3-word window found twice or more in the text. Windows are sorted by hash with their
    positions in the low bits; equal neighbours are then compared word by word.
    """
    blank = "' \\t\\n\\u000b\\u000c\\r'"
    bits = "int(ceil(log2(greatest(size(w), 2) + 1)))"  # a window's hash stands above its position, which takes as many bits as the text needs
    hashes = "if(size(w) < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~m) | i)))"
    same = " and ".join(["(x & ~m) = (h[j] & ~m)", *(f"w[int(x & m) + {k}] = w[int(h[j] & m) + {k}]" for k in range(3))])
    twice = f"filter(h, (x, i) -> (i > 0 and {same.replace('[j]', '[i - 1]')}) or (i < size(h) - 1 and {same.replace('[j]', '[i + 1]')}))"
    covered = "aggregate(p, named_struct('n', 0L, 'last', -3L), (a, x) -> named_struct('n', a.n + least(3L, x - a.last), 'last', x), a -> a.n)"
    repeats = _let("m", f"shiftleft(1L, {bits}) - 1", _let("h", hashes, _let("p", f"sort_array(transform({twice}, x -> x & m))", covered)))
    all_of_it = _let(
        "t",
        f"coalesce({text}, '')",
        _let(
            "w",
            f"filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+', -1), x -> x <> '')",
            _let(
                "l",
                f"filter(split(t, '\\\\n', -1), x -> btrim(x, {blank}) <> '')",
                "named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))),"
                " 'n_symbols', bigint(length(t) - length(translate(t, '#*$%&|<>', ''))), 'n_lines', bigint(size(l)),"
                f" 'n_dup_lines', bigint(size(l) - size(array_distinct(l))), 'n_repeat_words', {repeats})",
            ),
        ),
    )
    kept = [c for c in docs.columns if c not in (text, *SIGNALS)]
    # inline() rather than a projection: the optimiser would copy the whole expression into each filter on a signal
    return docs.select(*kept, F.inline(F.array(F.expr(all_of_it))))


def _let(name: str, value: str, body: str) -> str:
    """SQL in which value is computed once and called name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def first_step() -> Column:
    """The first of STEPS that rejects a document, null if none does."""
    cases = " ".join(f"when {SCORES[score]} > {cutoff} then {k}" for k, (score, cutoff) in enumerate(STEPS))
    return F.expr(f"case {cases} end")


def _log_gamma(x: str) -> str:
    """SQL: the logarithm of the gamma function of x >= 1, by Stirling's series at x + 10."""
    y = f"({x} + 10d)"
    series = f"({y} - 0.5d) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}d + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7))"
    return f"({series} - ({' + '.join(f'ln({x} + {i}d)' for i in range(10))}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL: P(X <= k) for X binomial (n, p) and k < n p; exact, or above it by a bound of what LEFT_OUT leaves out."""
    k, n = f"double({k})", f"double({n})"
    log_term = f"{_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')} + {k} * {math.log(p)!r}d + ({n} - {k}) * {math.log1p(-p)!r}d"
    ratio = f"({k} - j) / ({n} - {k} + j + 1) * {(1 - p) / p!r}d"  # of the term of k - j - 1 to that of k - j
    many = f"least({k}, ceil({LEFT_OUT} * sqrt({n} * {p * (1 - p)!r}d)) + 100)"
    step = f"named_struct('term', a.term * {ratio}, 'sum', a.sum + a.term * {ratio}, 'ratio', {ratio})"
    rest = f"if({many} < {k}, a.term * a.ratio / (1 - a.ratio), 0d)"
    sums = f"aggregate(if({k} > 0, sequence(0, int({many}) - 1), cast(array() as array<int>)), named_struct('term', 1d, 'sum', 1d, 'ratio', 0d), (a, j) -> {step}, a -> a.sum + {rest})"
    return f"least(1d, exp({log_term}) * {sums})"


def proven(scored: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(_stratum, _step): per stratum with labels the step of STEPS that is taken, null if none is proven."""
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") >= 1).alias("_good"))
    held = scored.where(~base_failed()).join(judged, "doc_id").withColumn("_first", first_step())
    last = range(len(STEPS))
    counts = [F.count_if("_good").alias("n")]
    counts += [F.array(*(F.count_if((F.col("_good") == good) & (F.col("_first") <= k)) for k in last)).alias(name) for name, good in (("k", True), ("bad", False))]
    by = stored(held.groupBy(F.col("stratum").alias("_stratum")).agg(*counts))
    tested = by.where(f"n * {math.log1p(-risk)!r}d <= {math.log(1 - confidence)!r}d").count()
    delta = (1 - confidence) / max(1, tested)
    passes = f"k[i] < n * {risk!r}d and {binomial_tail('k[i]', 'n', risk)} <= {delta!r}d"
    # how many steps pass before the first that doesn't
    by = by.withColumn("steps", F.expr(f"aggregate(sequence(0, {len(STEPS) - 1}), 0, (a, i) -> if(a = i and {passes}, a + 1, a))"))
    best = "array_max(transform(sequence(0, steps - 1), i -> named_struct('gain', bad[i] - k[i], 'loose', -i)))"
    return by.select("_stratum", F.expr(f"if(steps > 0, -{best}.loose, null)").alias("_step"))


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> dict:
    """The steps of proven() on the driver, for a look at them: {stratum: {score: cutoff}}."""
    steps = {r["_stratum"]: r["_step"] for r in proven(scored, labels, risk, confidence).collect()}
    return {stratum: dict(STEPS[: step + 1]) if step is not None else {} for stratum, step in steps.items()}


def with_steps(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """scored with _step, the step of each row's stratum."""
    found = stored(proven(scored, labels))
    found = F.broadcast(found) if found.count() <= FEW else found
    return scored.join(found, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")


def verdict() -> Column:
    """Whether the step of the document's stratum leaves it (rows of with_steps)."""
    return ~F.coalesce(first_step() <= F.col("_step"), F.lit(False))


def rated(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, stratum, signals, base_failed, kept) per row of docs; one pass over the texts, whose signals are stored."""
    scored = stored(signals(docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))))
    found = with_steps(scored, labels).withColumn("base_failed", base_failed())
    return found.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict())).select(*scored.columns, "base_failed", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document."""
    found = rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, columns unchanged. What passes the base rule is stored with its signals, as they cost more than the writing."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("lang").alias("stratum"), F.col("text").alias("_text"))
    scored = stored(signals(row, "_text").where(~base_failed()))
    return with_steps(scored, labels).where(verdict()).select("_row.*")


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict = {}

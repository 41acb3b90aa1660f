"""The document operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import components, decontaminate, pii, quality, simhash, substring_dedup, suffix_dedup

PASSAGE = " ".join(f"word{i} of the passage" for i in range(30))
LONG = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))


def sample(spark, sf_dir, n=120):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    extra = [None, "", " \t\n", "one", PASSAGE, f"x {PASSAGE} y", f"{PASSAGE} {PASSAGE}", LONG, LONG + "!", "é" + LONG[:450], LONG[:399], LONG[:400], "ab " * 500, "日本 " * 40, "0" * 3000, f"{LONG}\n{LONG}"]
    return rows + [(10_000 + i, t) for i, t in enumerate(extra)] + rows[:3]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return sample(spark, sf_dir)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, 7, "en", "s", 1) for r in texts], "doc_id bigint, text string, n_words int, lang string, source string, n_chars bigint")


def empty(docs):
    return docs.where("false")


# --- decontamination


def plain_contamination(texts, items, window=10):
    """Brute force: (words, hit words, sorted items) per text."""
    fold = lambda t: tuple(re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split(" "))
    words_of = lambda t: tuple(w for w in fold(t) if w)
    patterns = {}
    for item, text in items:
        words, name = words_of(text), "" if item is None else str(item)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(words[i : i + window], set()).add(name)
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(words) - m + 1):
                if words[i : i + m] in patterns:
                    hit.update(range(i, i + m))
                    found |= patterns[words[i : i + m]]
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_decontamination(spark, docs, texts, sf_dir, monkeypatch):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(900, PASSAGE), (900, PASSAGE), (901, "word3 of"), (902, None), (903, "--"), (None, "ab ab ab"), (904, "passage")]
    bench.append((905, " ".join(t for _, t in texts[5:25] if t)))  # a large item
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    want = plain_contamination([t for _, t in texts], bench)
    expected = sorted((d, *want[k]) for k, (d, _) in enumerate(texts))

    def found():
        return sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, table).collect())

    assert found() == expected
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    for few in (decontaminate.FEW, 0):  # several passes, hits broadcast and shuffled
        monkeypatch.setattr(decontaminate, "PASS_BYTES", 20_000)
        monkeypatch.setattr(decontaminate, "FEW", few)
        assert found() == expected
    assert decontaminate.clean_documents(docs, table).columns == docs.columns
    assert decontaminate.contamination(docs, table.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(docs), table).count() == 0


def test_a_large_benchmark_takes_few_passes(spark, monkeypatch):
    """20 MB of one item; a scan for each 8 MB, and every planted window found."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 3_400_000).tolist()]
    picks = rng.integers(0, len(words) - 12, 50).tolist()
    docs = [(k, "x y z " + " ".join(words[at : at + 12]) + " q") for k, at in enumerate(picks)] + [(100, "x y z q " * 5)]
    built = []
    made = decontaminate.WuManber.__init__
    monkeypatch.setattr(decontaminate.WuManber, "__init__", lambda self, *a: built.append(1) or made(self, *a))
    rows = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in rows) == [*((k, 12, ["7"]) for k in range(50)), (100, 0, [])]
    assert len(built) == 3


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_wu_manber_finds_every_occurrence(patterns, text):
    words = [w.encode() for w in text]
    hit, found = bytearray(len(words)), set()
    decontaminate.WuManber((str(i), tuple(w.encode() for w in p)) for i, p in enumerate(patterns)).search(words, hit, found)
    want_hit, want = bytearray(len(words)), set()
    for i, p in enumerate(patterns):
        for s in range(len(text) - len(p) + 1):
            if text[s : s + len(p)] == p:
                want.add(str(i))
                want_hit[s : s + len(p)] = b"\x01" * len(p)
    assert (hit, found) == (want_hit, want)


# --- SimHash


def plain_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {x: find(x) for x in nodes}


def test_simhash(docs, texts):
    found = simhash.near_duplicates(docs, n=3, radius=2).collect()
    prints = {}
    for d, t in texts:
        prints[d] = plain_fingerprint(t, 3)
    want = closure(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == sorted((d, prints[d], want[d]) for d, _ in texts)
    assert simhash.near_duplicates(empty(docs), n=3, radius=2).count() == 0


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.one_of_each_group(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **simhash.STAGE).collect()}
    assert set(ids) == set(found.values())


@pytest.mark.parametrize("radius, m, check", [(2, 4, None), (4, 7, None), (6, 9, 16)])
def test_bucket_links_span_large_and_small_buckets(spark, radius, m, check):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    near = {(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False)), int(rng.integers(0, 2)) * (2**20 - 1)) for b in base for _ in range(60)}
    fps = sorted((x - 2**64 if x >> 63 else x, *([y] if check else [])) for x, y in near)
    fps = sorted(set(fps))
    table = spark.createDataFrame(fps, "fp bigint, other bigint" if check else "fp bigint")
    roots = {tuple(r.node): r.root for r in components.components(simhash.links(table, radius, m, check), "a", "b").collect()}

    def linked(a, b):
        return ((a[0] ^ b[0]) % 2**64).bit_count() <= radius and (not check or (a[1] ^ b[1]).bit_count() <= check)

    want = closure(fps, linked)
    assert all(tuple(roots.get(x, x)) == want[x] for x in fps)


def test_pigeonring_never_loses_a_pair_within_the_radius():
    rng = np.random.default_rng(1)
    x = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(3000)], np.uint64)
    for radius, m in ((2, 6), (2, 4), (4, 7), (3, 5), (6, 9)):
        assert (simhash.linked(x, m, radius) == (np.bitwise_count(x) <= radius)).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, k) for k in range(200, 240)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert set(found.values()) == {100, 5} and len(found) == 72


# --- quality


def plain_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_signals(spark, docs, texts):
    odd = [(20_000, "a b c a b c\n\n\x0b\x0c\r x0b\n x0b\na"), (20_001, "    a\u0085b"), (20_002, "a a a a"), (20_003, "b0x\nb0x\n|<>")]
    every = texts + odd
    rows = quality.signals(spark.createDataFrame(every, "doc_id bigint, text string")).collect()
    found = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == sorted((d, *plain_signals(t)) for d, t in every)


def test_quality_verdicts(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id bigint, quality int")
    rated = quality.rated(docs, labels)
    assert rated.where("base_failed and kept").count() == 0
    assert rated.where("kept is null or base_failed is null").count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert sorted(r.doc_id for r in quality.good_documents(docs, labels).collect()) == sorted(r.doc_id for r in rated.where("kept").collect())
    assert quality.rated(empty(docs), labels.where("false")).count() == 0


def scored_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def exact_tail(k, n, p):
    """P(X <= k) in exact fractions."""
    p = Fraction(p)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plain_steps(rows, labels):
    """Brute force of the fixed-sequence tests: {stratum: (proven steps, the step that is taken)}."""
    quality_of = {}
    for doc, q in labels:
        if doc is not None and q is not None:
            quality_of[doc] = max(q, quality_of.get(doc, 0))

    def rejected(r, step):
        ratios = {"symbols": r[4] / r[2], "repeats": r[7] / r[2], "lines": r[6] / r[5], "long words": r[3] / r[2]}
        return any(ratios[score] > cutoff for score, cutoff in quality.STEPS[: step + 1])

    held = {}
    for r in rows:
        if r[0] in quality_of and not (r[2] < 50 or 100 * r[7] > 50 * r[2]):
            held.setdefault(r[1], []).append((r, quality_of[r[0]]))
    good = {s: [r for r, q in own if q] for s, own in held.items()}
    tested = sum(0.98 ** len(own) <= 0.05 for own in good.values())
    out = {}
    for s, own in held.items():
        proven, n = [], len(good[s])
        for step in range(len(quality.STEPS)):
            k = sum(rejected(r, step) for r in good[s])
            if not (k < 0.02 * n and exact_tail(k, n, "0.02") <= Fraction(5, 100) / tested):
                break
            proven.append((sum(rejected(r, step) for r, q in own if not q) - k, -step))
        out[s] = len(proven), -max(proven)[1] if proven else None
    return out


def test_steps_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for stratum, n, odd in (("many", 4000, 0.012), ("some", 400, 0.0), ("few", 230, 0.0), ("too few", 148, 0.0), ("mixed", 1500, 0.022), (None, 600, 0.006), ("bad only", 0, 0.0)):
        for i in range(n + 60):
            is_good = i < n
            strange = rng.random() < (odd if is_good else 0.7)
            words = int(rng.integers(40, 400))
            kind = int(rng.integers(0, 4)) if strange else -1
            rows.append((len(rows), stratum, words, words * (14 if kind == 3 else 6), words * 3 if kind == 0 else 0, 20, 9 if kind == 2 else 0, words // 4 if kind == 1 else 0))
            labels.append((len(rows) - 1, int(is_good)))
    labels += [(None, 1), (5, None), (10**9, 1), (7, 0)]
    want = plain_steps(rows, labels)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["_stratum"]: r["_step"] for r in quality.proven(scored_table(spark, rows), table).collect()}
    assert found == {s: step for s, (_, step) in want.items()}
    assert found["some"] is not None and found["too few"] is None and found["bad only"] is None and 0 < want["mixed"][0] < len(quality.STEPS)


def test_cutoffs_hold_the_risk(spark):
    """Of documents drawn anew from the same source, good ones are rejected within the risk, bad ones mostly."""
    rng = np.random.default_rng(4)

    def drawn(n, at):
        out = []
        for i in range(n):
            good, odd = rng.random() < 0.7, rng.random()
            symbols = int(200 * (rng.random() * 0.4 if odd < 0.03 else 0)) if good else int(200 * rng.random() * 3)
            out.append(((at + i, "en", 200, 1000, symbols, 10, 0, 0), good))
        return out

    first, second = drawn(3000, 0), drawn(20_000, 10_000)
    labels = spark.createDataFrame([(r[0], int(good)) for r, good in first], "doc_id long, quality int")
    own = quality.cutoffs(scored_table(spark, [r for r, _ in first]), labels)["en"]
    rejected = [good for r, good in second if r[4] / 200 > own["symbols"]]
    assert sum(rejected) / sum(good for _, good in second) <= quality.RISK
    assert rejected.count(False) / sum(not good for _, good in second) > 0.8


def test_every_stratum_has_its_own_cutoffs(spark):
    clean, odd = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}###" for i in range(60))
    strata = [f"a{k:02}" for k in range(64) for _ in range(40)] + [f"b{k:02}" for k in range(80) for _ in range(39)] + ["en"] * 3000 + ["zz"]
    rows = [(i, stratum, clean) for i, stratum in enumerate(strata)]
    others = [(100_001, "zz", odd), (100_002, "qq", odd), (100_003, None, odd), (100_004, "en", odd), (100_005, "en", clean)]
    docs = spark.createDataFrame(rows + others, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    # only en has labels enough for a proof
    want = {r[0] for r in rows + others} - {100_004}
    assert {r.doc_id for r in quality.rated(docs, labels).where("kept").collect()} == want
    assert {r.doc_id for r in quality.good_documents(docs, labels).collect()} == want


def test_binomial_tail(spark, monkeypatch):
    cases = [(k, n) for n in (1, 2, 10, 150, 1000, 5000) for k in {0, 1, n // 100, n // 60} if k < n * 0.02]
    table = spark.createDataFrame(cases, "k long, n long")
    found = {(r.k, r.n): r.x for r in table.selectExpr("k", "n", f"{quality.binomial_tail('k', 'n', 0.02)} x").collect()}
    for k, n in cases:
        assert found[k, n] == pytest.approx(float(exact_tail(k, n, "0.02")), rel=1e-9)
    monkeypatch.setattr(quality, "LEFT_OUT", 0)  # terms left out are bounded from above
    short = spark.createDataFrame([(190, 10_000)], "k long, n long").selectExpr(f"{quality.binomial_tail('k', 'n', 0.02)} x").first().x
    assert 0 <= short / float(exact_tail(190, 10_000, "0.02")) - 1 < 1e-6


# --- personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


ODD = [
    "a@b.c_d@e.f g@h", "x.y+z@a-b.co.uk.", "@a.b c@@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.255 001.02.3.4", "1.2.3 4.5.6.7x.8", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111 +1 (043) 555-3286 +1+2345678 +12", "é𝄞 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x@y.z", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a@b.c" * 40, "1 " * 200, "1" * 400, "a@b.c, " * 63, "a@b.c, " * 64, "é 1.2.3.4 " * 65, "a@b.c +49 30 1234567 " * 1000,
]


def test_base_spans(spark, texts):
    every = texts + [(30_000 + i, t) for i, t in enumerate(ODD)]
    rows = pii.extracted(spark.createDataFrame(every, "doc_id bigint, text string")).collect()
    found = sorted((r.doc_id, [(x.kind, x.start, x.stop) for x in r.base]) for r in rows)
    assert found == sorted((d, plain_spans(t)) for d, t in every)


def plain_classifier(rows):
    """Brute force of the further spans: candidates, votes, expectation-maximisation and naive Bayes, text by text in Python."""
    candidates = []
    for d, text in rows:
        text = text or ""
        base = plain_spans(text)
        for kind, pattern in pii.CANDIDATES:
            pattern = pattern.replace(r"\x20", " ")
            for m in re.finditer(pattern, text):
                if any(m.start() < stop and start < m.end() for _, start, stop in base):
                    continue
                s, b, a = m[0], text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 2]
                digits, secret = re.sub("[^0-9]", "", s), kind == "secret"
                cue = pii.CUES[kind]
                if secret:
                    shape = int(bool(re.match(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:sk|pk|ghp|xox[a-z])[_-].*)$", s)))
                    mix = 1 if re.search("[A-Za-z].*[0-9].*[A-Za-z].*[0-9].*[A-Za-z].*[0-9]", s) else -1
                else:
                    shape = 1 if re.match(r"(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$", s) else -1 if s.isdigit() else 0
                    mix = 1 if 9 <= len(digits) <= 11 else -1
                votes = (
                    shape,
                    mix,
                    1 if re.search(rf"(?i)(?:^|[^A-Za-z])(?:{cue})[^A-Za-z]{{0,6}}$", b) else -1,
                    1 if re.search(r"[=:]\s*[\"']?$", b) else (0 if secret else -1) if re.search(r"[A-Za-z]\s$", b) else 0,
                    1 if re.search("[\"']$", b) and re.match("[\"']", a) else -1 if re.search("[A-Za-z_]$", b) or re.match("[A-Za-z_]", a) else 0,
                )
                features = (
                    str(min(len(s) // 4, 20)),
                    str(int(10 * len(digits) / len(s))),
                    "none" if not b else "quote" if re.search("[\"']$", b) else "assign" if re.search(r"[=:]\s*$", b) else "space" if re.search(r"\s$", b) else "letter" if re.search("[A-Za-z]$", b) else "other",
                    "none" if not a else "quote" if re.match("[\"']", a) else "space" if re.match(r"\s", a) else "letter" if re.match("[A-Za-z]", a) else "other",
                    "cue" if re.search(rf"(?i)(?:^|[^A-Za-z])(?:{cue})[^A-Za-z]", b) else "none",
                )
                candidates.append((d, kind, m.start(), m.end(), votes, features))
    taken = set()
    for kind, _ in pii.CANDIDATES:
        own = [c for c in candidates if c[1] == kind]
        if not own:
            continue
        sure, prior = [0.8] * 5, 0.5
        for _ in range(50):
            odds = [math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(c[4], sure, strict=True)) for c in own]
            yes = [1 / (1 + math.exp(-x)) for x in odds]
            prior = min(0.95, max(0.05, sum(yes) / len(own)))
            for j in range(5):
                right = sum(y if c[4][j] > 0 else 1 - y for c, y in zip(own, yes, strict=True) if c[4][j])
                sure[j] = min(0.99, max(0.51, (right + 4) / (sum(c[4][j] != 0 for c in own) + 5)))
        all_yes, all_no = sum(yes), sum(1 - y for y in yes)
        for c in own:
            odds = math.log((all_yes + 0.1) / (all_no + 0.1))
            for k, value in enumerate(c[5]):
                y, n = (sum(f(x) for o, x in zip(own, yes, strict=True) if o[5][k] == value) for f in (lambda x: x, lambda x: 1 - x))
                odds += math.log((y + 0.5) / (all_yes + 1)) - math.log((n + 0.5) / (all_no + 1))
            if odds > 0:
                taken.add((c[0], c[1], c[2], c[3]))
    return candidates, taken


def test_further_spans_are_those_of_brute_force(spark, sf_dir):
    rng = np.random.default_rng(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(30_000 + i, t) for i, t in enumerate(ODD)]
    for i in range(120):
        h, n = hashlib.sha1(str(i).encode()).hexdigest(), "".join(map(str, rng.integers(0, 10, 10)))
        forms = (f'api key: "{h}"', f"see {h} there", f"call {n[:3]}-{n[3:6]}-{n[6:]} now", f"tel {n}", f"number {n}{n} of", f"a_name_of_{i}_and_no_more_than_that", f"x{n}y", f"fax: ({n[:3]}) {n[3:6]} {n[6:]}", f"password={h[:24]};")
        rows.append((40_000 + i, f"é {forms[i % len(forms)]} and {forms[int(rng.integers(0, len(forms)))]}"))
    candidates, want = plain_classifier(rows)
    found = pii.extracted(spark.createDataFrame(rows, "doc_id bigint, text string"))
    marked = pii.with_spans(found, pii.train(found)).collect()
    assert sorted((r.doc_id, c.kind, c.start, c.stop) for r in marked for c in r.candidates) == sorted(c[:4] for c in candidates)
    assert {(r.doc_id, x.kind, x.start, x.stop) for r in marked for x in r.spans[len(r.base) :]} == want
    assert {x[1] for x in want} == {"secret", "number"} and len(want) < len(candidates)


@given(st.text("aé1@.+- ()4", max_size=30))
@settings(max_examples=300, deadline=None)
def test_patterns_match_as_the_plain_ones(text):
    """The possessive patterns, as Python reads them (it has no \\G: matches are sought one by one)."""
    plain = dict(zip(("email", "ip", "card", "phone"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True))
    for kind, _, pattern, _ in pii.BASE:
        found, at = [], 0
        while m := re.compile(pattern.replace(r"|\G", f"|(?<=^.{{{at}}})" if at < 31 else "")).search(text, at):
            found.append(m.span())
            at = m.end()
        assert found == [m.span() for m in re.finditer(plain[kind], text)]


def test_secrets_are_found_and_masked(spark, docs):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(30)]
    rows = [(i, f'and the token = "{h}" of it') for i, h in enumerate(hexes)] + [(100 + i, f"plain text {i} with 4785380592391142 and a long_identifier_of_twenty_and_no_number") for i in range(40)] + [(500, None), (501, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars")
    found = pii.extracted(table.select("doc_id", "text"))
    spans = {r.doc_id: [(x.kind, x.start, x.stop) for x in r.spans] for r in pii.with_spans(found, pii.train(found)).collect()}
    assert all(spans[i] == [("secret", 17, 57)] for i in range(30))
    assert not any(spans[i] for i in spans if i >= 100)
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.masked(table).collect()}
    assert masked[0] == ('and the token = "<SECRET>" of it', 32) and masked[500] == (None, None) and masked[501] == ("", 0)
    assert pii.masked(docs).columns == docs.columns and pii.masked(empty(docs)).count() == 0


# --- repeated passages


def test_substring_dedup(spark, docs, texts):
    first = {}
    for d, t in texts:
        w = tuple(substring_dedup.words_of(t))
        for i in range(len(w) - 12):
            first[w[i : i + 13]] = min(d, first.get(w[i : i + 13], d))
    want = []
    for d, t in texts:
        w, gone = substring_dedup.words_of(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    found = substring_dedup.without_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(want)
    nulls = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (2, PASSAGE)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.without_repeats(nulls).collect()) == [("1", 0), ("2", 120), ("None", 0)]
    assert substring_dedup.without_repeats(empty(docs)).count() == 0


def test_every_difference_has_a_cover_pair():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring_dedup.COVER and (j + d) % 7 in substring_dedup.COVER for d in range(7))


def plain_bytes_without(rows):
    """Brute force: every row is a document."""
    data = [suffix_dedup.bytes_of(t) for _, t in rows]
    count = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    return sorted(out)


@pytest.mark.parametrize("flush", [1 << 18, 50])
def test_suffix_dedup(spark, docs, texts, monkeypatch, flush):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    found = suffix_dedup.without_repeats(docs)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == plain_bytes_without(texts)
    assert suffix_dedup.without_repeats(empty(docs)).count() == 0


def test_a_passage_in_many_surroundings(spark):
    """Shared passages of lengths around the window, each with other text before and behind, some of which is shared too."""
    rng = np.random.default_rng(2)

    def letters(n):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    common, tails = letters(520), [letters(200) for _ in range(4)]
    rows = []
    for i in range(150):
        a = int(rng.integers(0, 250))
        b = a + int(rng.integers(200, 520 - a + 1))
        rows.append((i, letters(int(rng.integers(0, 300))) + tails[i % 4][i % 50 :] + common[a:b] + tails[(i // 4) % 4][: 30 + i] + letters(int(rng.integers(0, 300)))))
    rows += [(1000, "é" * 300 + common), (1001, "è" * 150 + "é" * 250 + common)]
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
    assert sorted(tuple(r[c] for c in names) for r in found) == plain_bytes_without(rows)


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b) * 9), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_deep_shallow_order(texts):
    order = suffix_dedup.deep_shallow(texts).tolist()
    assert sorted(order) == list(range(len(texts)))
    found = [texts[i] for i in order]
    assert all(a.ljust(64, b"\0")[:64] <= b.ljust(64, b"\0")[:64] for a, b in zip(found, found[1:], strict=False))
    if not any(0 in t for t in texts):
        assert found == sorted(texts)


def test_large_groups_of_long_common_prefixes():
    texts = [b"x" * 80 + bytes([i % 5]) * (i % 40) for i in range(200)]
    assert [texts[i] for i in suffix_dedup.deep_shallow(texts)] == sorted(texts)


# --- near duplicates by the Jaccard similarity of shingle sets


def plain_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies():
    """Texts with copies that differ in more and more words, and pairs at exactly and just below 0.8."""
    rng = np.random.default_rng(3)
    out = []
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        out.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6):
            copy = list(words)
            for at in rng.choice(200, edits, replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    exact = [f"e{k}" for k in range(12)]  # 8 shingles; with two words more 10 of 8: 0.8
    return [*out, " ".join(exact), " ".join([*exact, "p", "q"]), " ".join([*exact[:8], *"rstuvwxyz"])]


@pytest.mark.parametrize("often, cross", [(3, 1 << 20), (2, 50)])
def test_near_dedup_links_every_pair_of_similarity_08(spark, texts, monkeypatch, often, cross):
    from brindle.llm import near_sets

    monkeypatch.setattr(near_sets, "OFTEN", often)
    monkeypatch.setattr(near_sets, "CROSS", cross)
    rows = texts + [(50_000 + i, t) for i, t in enumerate(near_copies())]
    sets = {d: plain_set(t) for d, t in rows}
    want = closure(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(table, **simhash.STAGE).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((d, want[d]) for d, _ in rows)
    assert sorted(r.doc_id for r in simhash.one_of_each_group(table).collect()) == sorted(set(want.values()))
    assert simhash.one_of_each_group(empty(table)).count() == 0


@pytest.mark.parametrize("split", [2, 7, 100_000])
def test_large_buckets_that_are_dealt_out_lose_no_group(spark, monkeypatch, split):
    from brindle.llm import near_sets

    monkeypatch.setattr(near_sets, "OFTEN", 10**9)  # common shingles make buckets too
    common, other = [f"c{k}" for k in range(40)], [f"d{k}" for k in range(40)]
    made = [" ".join([*words[:cut], f"x{k}", *words[cut:]]) for words in (common, other) for k, cut in enumerate([0, 3, 20, 37, 40] * 8)]
    made += [" ".join([*common[:k], *(f"y{k}-{i}" for i in range(5)), *common[k:]]) for k in range(0, 41, 2)] + [" ".join(common), "", "c1 c2"]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    sets = [plain_set(x) for x in made]
    want = closure(list(range(len(made))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    rows, roots = near_sets.groups(table, 5, 0.8, split=split)
    got: dict = {}
    for r in rows.join(roots, "s", "left").collect():
        got.setdefault(r.s if r.root is None else r.root, []).append(r._id)
    named = {k: min(members) for members in got.values() for k in members}
    assert named == dict(want)


def test_near_dedup_finds_its_groups_by_simhash(spark, monkeypatch):
    """The rest's buckets are emptied here: what is left is the search over fingerprints."""
    from brindle.llm import near_sets

    shared = near_sets._shared
    monkeypatch.setattr(near_sets, "_shared", lambda keyed: shared(keyed.where("false")))
    made = near_copies()
    sets = [plain_set(x) for x in made]
    want = closure(list(range(len(made))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), **simhash.STAGE).collect()}
    pairs = [(a, b) for a in range(len(made)) for b in range(a) if want[a] == want[b]]
    assert len(pairs) > 50 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(want[a] == want[b] for a in found for b in found if found[a] == found[b])


@pytest.mark.parametrize("split", [5, 100_000])
def test_a_shared_passage_of_long_texts_makes_few_candidates(spark, monkeypatch, split):
    """Neither fingerprints nor counts of shingles help here: the rest's buckets find every group, without the square of a passage's texts."""
    from brindle.llm import near_sets, rings

    counts, candidates = [], near_sets.candidates

    def counted(*args):
        counts.append((found := candidates(*args)).count())
        return found

    monkeypatch.setattr(near_sets, "candidates", counted)
    monkeypatch.setattr(near_sets, "order_of", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(rings, "radius_for", lambda t: -1)
    passage = " ".join(f"p{k}" for k in range(100))
    long = [" ".join([*(f"a{i}-{k}" for k in range(700)), passage, *(f"b{i}-{k}" for k in range(800))]) for i in range(40)]
    made = [*near_copies(), *long, long[0] + " " + " ".join(f"c{k}" for k in range(300)), " ".join(long[1].split()[60:])]
    sets = [plain_set(x) for x in made]
    want = closure(list(range(len(made))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    rows, roots = near_sets.groups(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), 5, 0.8, split=split)
    got: dict = {}
    for r in rows.join(roots, "s", "left").collect():
        got.setdefault(r.s if r.root is None else r.root, []).append(r._id)
    assert {k: min(members) for members in got.values() for k in members} == dict(want)
    own = sum(jaccard(sets[a], sets[b]) >= 0.5 for a in range(len(made)) for b in range(a))
    assert counts[:-1] == [0] * near_sets.STARS + [0] and counts[-1] <= own + 100  # 40 texts make 780 pairs


def test_rings_equal_plain_fingerprints_and_distances():
    from brindle.llm import near_sets, rings

    hashes = near_sets.shingles(" ".join(f"w{k % 37}-{k % 11}" for k in range(9000)), 5)
    for found in (hashes, hashes[:1], hashes[:4], hashes[:0]):
        bits = []
        for word in range(rings.WORDS):
            own = [int(x) for x in rings.mixed(found, word)]
            bits += [2 * sum(x >> k & 1 for x in own) > len(own) for k in range(64)]
        assert rings.fingerprint(found) == sum(b << k for k, b in enumerate(bits)).to_bytes(rings.BITS // 8, "little")
    rng = np.random.default_rng(4)
    prints = [rings.fingerprint(hashes[: 300 + k]) for k in range(40)] + [rng.bytes(rings.BITS // 8) for _ in range(40)]
    bounds = rings.cuts(len(prints))
    plain = [[(k << 52) + (int.from_bytes(x, "little") >> a) % (1 << (b - a)) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))] for x in prints]
    assert rings.segment_keys(prints, bounds).tolist() == plain and bounds[0] == 0 and bounds[-1] == rings.BITS
    x = np.array([np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64) for a in prints for b in prints])
    far = np.bitwise_count(x).sum(axis=1)
    for radius in (0, 20, rings.radius_for(Fraction(4, 5)), rings.BITS):
        assert rings.linked(x, radius).tolist() == np.flatnonzero(far <= radius).tolist()
    assert max(len(rings.cuts(n)) for n in (0, 1, 10**6, 10**9, 10**15)) <= rings.BITS // rings.LEAST + 1


def test_near_dedup_tells_rows_apart_that_share_a_doc_id(spark):
    x, y, z, u, v = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyzuv")
    rows = [(None, x), (None, y), (None, y), (1, z), (5, z), (5, u), (5, v), (5, v), (7, v + " more"), (None, u)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each_group(table).collect()]
    assert sorted(kept, key=str) == sorted([(None, x), (None, y), (1, z), (5, u), (5, v)], key=str)


# --- the pipeline


def plain_pipeline(rows, labels, bench):
    """Brute force of all stages on rows (doc_id, text, lang): (doc_id, lang, text that the ids stand for)."""
    kept = []
    for r in rows:
        n, _, _, _, repeats = plain_signals(r[1])
        if n >= 50 and 100 * repeats <= 50 * n:
            kept.append(r)
    distinct = list(dict.fromkeys(kept))
    sets = [plain_set(t) for _, t, _ in distinct]
    root = closure(list(range(len(distinct))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    first = {}
    for k, r in enumerate(distinct):
        key = (r[0] is None, r[0] or 0)
        if root[k] not in first or key < first[root[k]][0]:
            first[root[k]] = key, r
    kept = [r for _, r in first.values()]
    hits = plain_contamination([t for _, t, _ in kept], bench)
    kept = [r for r, (_, n_hit, _) in zip(kept, hits, strict=True) if not n_hit]
    numbered = [(k, t) for k, (_, t, _) in enumerate(kept)]
    _, taken = plain_classifier(numbered)
    out = []
    for k, (d, text, lang) in enumerate(kept):
        spans = sorted([(a, b, kind) for kind, a, b in plain_spans(text)] + [(a, b, kind) for i, kind, a, b in taken if i == k])
        done, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                done += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        out.append((d, lang, done + text[at:]))
    return sorted(out, key=str)


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from brindle.llm import pieces

    rng = np.random.default_rng(12)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(130).collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(None, None)]
    for i, text in enumerate(near_copies()):
        rows.append((1000 + i, text, "en" if i % 2 else None))
    prose = [" ".join(f"w{k}" for k in rng.integers(0, 900, 90)) for _ in range(14)]
    rows += [(2000 + i, f"{t} write to a{i}@b.org or +49 30 1234567{i} at 10.0.0.{i} with token = \"{hashlib.sha1(t.encode()).hexdigest()}\" x", "de") for i, t in enumerate(prose[:6])]
    rows += [(None, prose[6], "fr"), (None, prose[7], "fr"), (None, prose[7], "fr"), (2001, prose[8], "en"), (2001, prose[8], "en"), (3001, prose[9], None), (3000, prose[9], None)]
    rows += [(3002, f"{prose[10]} {bench[0][1]}", "en"), (3003, None, None), (3004, "", "en"), (3005, "spam " * 200, "en"), (3006, f"{prose[11]} 4111 1111 1111 1111 end", "en")]
    labels = [(r[0], 1) for r in rows if r[0] is not None]
    table = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = pieces.decode(corpus_pipeline.run(spark, str(tmp_path))).collect()
    assert all(r.exact for r in found)
    want = plain_pipeline(rows, labels, bench)
    assert sorted(((r.doc_id, r.lang, r.decoded) for r in found), key=str) == want
    assert len(want) < len(rows) - 60 and any("<SECRET>" in t and "<EMAIL>" in t for _, _, t in want)

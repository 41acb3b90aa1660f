"""Segmentation, HTML, URL filters, licences, the pipeline, and the registered queries with SQL."""

from __future__ import annotations

import datetime
import math
import re
from collections import Counter

import pytest

from brindle.llm import html_text, licences, pieces, registry, url_filter
from brindle.llm.common import stored


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.MODEL)


def every_segmentation(vocab, text):
    edges = vocab.lattice(text)[0]
    out = []

    def go(at, score, ids):
        if not at:
            out.append((score, ids))
        for i, s, own in edges[at] if at else ():
            go(i, score + s, own + ids)

    go(len(text), 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("word", ["hello", "▁the", "▁éeauα", "日本x", "▁▁▁a", "\t", "▁\u0000z"])
def test_n_best_equals_brute_force(vocab, word):
    want = every_segmentation(vocab, word)
    found = vocab.n_best(word, 5)
    assert [round(s, 6) for s, _ in found] == [round(s, 6) for s, _ in want[:5]]
    assert all(x in want for x in found) and len({i for _, i in found}) == len(found)
    ids, score, loss = vocab.best(word)
    assert (score, ids) in want and score == want[0][0]
    assert loss == pytest.approx(want[0][0] - want[1][0]) if len(want) > 1 else loss == float("inf")


def test_many_parts_as_one_by_one(vocab, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    parts = sorted({p for t in texts for p in vocab.parts(pieces.prepared(t))}) + ["日本語日本", "a" * 40, "▁▁▁", "\n", "▁ééé", "𝄞", "▁" + "ab" * 8] * 9
    for part, ids, score, loss in zip(parts, *vocab.best_of_many(parts), strict=True):
        one = vocab.best(part)
        assert score == pytest.approx(one[1]) and (loss == one[2] or loss == pytest.approx(one[2]))
        assert ids == one[0] or one[2] == 0


@pytest.mark.parametrize("text", ["a cat sat é", "x  y", "on\nit", "the the"])
def test_n_best_of_texts(vocab, text):
    want = every_segmentation(vocab, pieces.prepared(text))[:6]
    found = pieces.encoded(text, 6, vocab)
    assert [round(s, 6) for s, _ in found] == [round(s, 6) for s, _ in want]
    assert all(vocab.decode(ids) == text for _, ids in found)
    out = pieces._encode_batch([text], pieces.Parts(vocab, 6))
    assert out["exact"].to_pylist() == [True]
    assert [round(out["score"][0].as_py(), 6)] + [round(a["score"], 6) for a in out["alternatives"][0].as_py()] == [round(s, 6) for s, _ in want]


def test_every_alternative_decodes_to_its_text(spark, sf_dir):
    odd = [None, "", " ", "a cat sat é", "x  y\n", "日本語 𝄞", "x▁y the the"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    docs = docs.selectExpr("*", "text as original")
    rows = pieces.encode(docs).selectExpr("original", "ids", "score", "alternatives.score as scores", f"{pieces.expanded()} as others")
    vocab, n = pieces.vocabulary(pieces.MODEL), 0
    for r in rows.collect():
        if r.original is None:
            assert r.others is None
            continue
        best = pieces.encoded(r.original, pieces.N_BEST, vocab)
        assert len(r.others) == len(best) - 1 and len({tuple(x) for x in (r.ids, *r.others)}) == len(best)
        for own, score, (want, _) in zip((r.ids, *r.others), (r.score, *r.scores), best, strict=True):
            assert vocab.decode(own) == r.original and score == pytest.approx(want)
            n += 1
    assert n > 120


def test_round_trip(spark, sf_dir):
    odd = [None, "", " ", "  lead and trail  ", "\n\n\t", "日本語 𝄞 \u0000 \x7f", "a" * 5000, "x▁y"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    docs = docs.selectExpr("*", "text as original", "1 as ids")
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == r.original
        assert r.exact is (None if r.original is None else True)
    assert pieces.encode(docs.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>The name of the site and of the people</p></header>
<nav><ul><li><a href="/a">one</a></li></ul></nav><div class="cookie-notice">We use cookies on this site for you and for the others of us</div><div class="ad">Buy it</div>
<article><h1>Title &amp; more</h1><p>It was the best of the times and it was the worst of the times, and so on.<p>Short&nbsp;one.<br>more</p><script>var x="</p>";</script>
<form>Name <input></form><ul><li>first</li><li>second</li></ul></article><section id="comments"><p>I think that this is the best of all that I have read in the past.</p></section>
<aside>See also</aside><footer>&copy; 2024</footer></body>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\n\nIt was the best of the times and it was the worst of the times, and so on.\n\nShort one. more\n\nfirst\n\nsecond"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == html_text.main_text("<!-- a") == ""
    plain = "<body><div>The first of the long blocks is here, and it has all of the words that it should have in it.</div><div>Short</div><div>The last of the long blocks is here, and it has all of the words that it should have in it.</div><div class=footer>x</div>"
    assert html_text.main_text(plain).split("\n\n")[1] == "Short"
    assert html_text.main_text('<p>a <b>b</b><i>c</i> &lt;d&gt; <a href="x>y">e</a></p>') == "a bc <d> e"


def test_html_of_all_pages(spark, sf_dir):
    import html as references

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in html_text.op10_html_text(spark, sf_dir).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        parts = [" ".join(references.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert found[r.page_id].text == "\n\n".join(x for x in parts if x)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)
    extra = pages.limit(3).selectExpr("page_id", "url", "html", "'x' as text", "1 as n_chars")
    assert html_text.extracted(extra).columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extracted(spark.createDataFrame([(None, None, None)], "page_id bigint, url string, html string")).first().text == ""


SENTENCE = "It was the best of the times and it was the worst of the times, and so it went on for all of them."


@pytest.mark.parametrize(
    "inside, want",
    [
        (f'<div class="share-price-analysis"><h2>Q3</h2><p>{SENTENCE}</p><p>Up.</p></div>', f"Q3\n\n{SENTENCE}\n\nUp."),
        (f'<div id="legal-history"><p>{SENTENCE}</p><p>1789.</p></div>', f"{SENTENCE}\n\n1789."),
        (f'<section class="search"><p>{SENTENCE}</p></section>', SENTENCE),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."),
        ("<p>a <object data=x>fallback</object> and <video src=y>no video</video> <noscript>plain</noscript></p>", "a fallback and no video plain"),
        (f'<div class="share"><a href=x>Tweet</a></div><div class="comment-list"><p>{SENTENCE}</p></div><p>End.</p>', "End."),
        ('<div class="ad">Buy</div><button>Press</button><select><option>a<option>b</select><p>x', "x"),
        ("<div>one <button>press</div><p>two", "one\n\ntwo"),
        ('<p title="a > b" class=\'x\'>c</p><p data-x=">">d</p>', "c\n\nd"),
        ("<header><h1>Title</h1></header><p>text</p><aside>by the side</aside><footer>foot</footer>", "Title\n\ntext"),
    ],
)
def test_html_inside_an_article(inside, want):
    assert html_text.main_text(f"<html><head><title>t</title></head><body><nav><a href=a>home</a></nav><article><p>{SENTENCE}</p>{inside}</article></body>") == f"{SENTENCE}\n\n{want}"


def test_html_without_an_article():
    whole = f"<body><div><a href=a>one</a> <a href=b>two</a></div><div>An ad</div><h1>Title</h1><p>{SENTENCE}</p><p>Yes.</p><p>{SENTENCE}</p><div>© 2024 The owners of all of this and that</div>"
    assert html_text.main_text(whole) == f"Title\n\n{SENTENCE}\n\nYes.\n\n{SENTENCE}"
    assert html_text.main_text(f'<form id="all">{whole}</form>') == html_text.main_text(whole)
    assert html_text.main_text(f"<p>{SENTENCE}</p><form>Your name and the name of your dog, if you have one with you as you are</form>") == SENTENCE
    other = " ".join(f"szo{i}" for i in range(60))
    assert html_text.main_text(f"<div>{other}</div><ul><li><a href=a>x</a></ul><div>{other} b</div>") == f"{other}\n\n{other} b"
    assert html_text.main_text(f"<p>{SENTENCE}</p><pre>{'x = f(y); ' * 30}</pre><p>{SENTENCE}</p>").count("f(y)") == 30
    assert html_text.main_text("<head><p>a word") == "a word"


def test_html_takes_time_in_proportion():
    import time

    pages = [
        "<div><b>" * 100_000 + "x" + "</i></b></div>" * 100_000,
        '<a ">' * 100_000,
        "<a x=\"'>" * 100_000,
        "<!-- <" * 100_000,
        "<script>" * 50_000,
        "<template>" * 20_000,
        "<p class='a" + " b" * 200_000 + "'>c",
        "<" * 300_000,
        "<button><p>x" * 50_000,
    ]
    for page in pages:
        began = time.time()
        html_text.main_text(f"<article><p>{SENTENCE}</p>{page}")
        assert time.time() - began < 20


def test_block_rules_carry_pages_without_region_marks(spark, sf_dir):
    """With article, nav, footer and classes turned into plain div, 0.9 of the article's blocks stay and 0.9 of the others go."""
    import html as references

    def plain(x):
        return " ".join(references.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split())

    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        outside = r.html.replace(article[0], "")
        others = [plain(x) for x in re.findall(r"<li>(.*?)</li>", outside) + re.findall(r'<div class="?ad"?>(.*?)</div>', outside, re.S) + re.findall(r"<footer>(.*?)(?:</footer>|$)", outside, re.S)]
        bare = re.sub(r"<div [^>]*>", "<div>", re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", r.html))
        got = Counter(html_text.main_text(bare).split("\n\n"))
        for kind, blocks in (("own", [x for x in map(plain, re.split(r"</?(?:p|h1)>", article[1])) if x]), ("other", [x for x in others if x])):
            for x in blocks:
                counts[kind] += 1
                counts[kind, "kept"] += got[x] > 0
                got[x] -= got[x] > 0
    assert counts["own", "kept"] >= 0.9 * counts["own"] and counts["other", "kept"] <= 0.1 * counts["other"]


def day(text):
    return datetime.date.fromisoformat(text)


def test_url_lists_are_temporal(spark, monkeypatch):
    entries = spark.createDataFrame(
        [("a", "block", "bad.com", "add", day("2024-01-10")), ("a", "block", "bad.com", "remove", day("2024-02-01")), ("b", "allow", "ok.bad.com/x", "add", day("2024-01-01")), ("b", "block", None, "add", day("2024-01-01")), ("c", "block", "tie.com", "add", day("2024-01-01")), ("d", "allow", "tie.com", "add", day("2024-01-01"))],
        "list string, verdict string, pattern string, action string, day date",
    )
    captures = [("http://bad.com/", "2024-01-09", "pass"), ("http://BAD.com/", "2024-01-10", "block"), ("https://www.bad.com:80/q?x", "2024-01-31", "block"), ("http://bad.com", "2024-02-01", "pass"), ("http://ok.bad.com/x/y", "2024-01-15", "allow"), ("http://ok.bad.com/xy", "2024-01-15", "block"), ("http://notbad.com", "2024-01-15", "pass"), ("http://tie.com", "2024-05-05", "allow"), (f"http://{'w.' * 2000}bad.com/{'x/' * 4000}", "2024-01-15", "block"), (f"http://ok.bad.com/{'/' * 300}x{'/y' * 3000}", "2024-01-15", "allow"), (None, "2024-01-15", "pass"), ("nonsense", "2024-01-15", "pass"), ("http://bad.com/", None, "pass")]
    table = spark.createDataFrame([(i, u, d and day(d), "mine") for i, (u, d, _) in enumerate(captures)] + [(0, captures[0][0], day("2024-01-09"), "mine")], "id int, url string, fetched date, list string")
    for few in (url_filter.FEW, 0):  # broadcast and shuffled
        monkeypatch.setattr(url_filter, "FEW", few)
        rows = url_filter.filtered(table, entries).collect()
        assert len(rows) == len(captures) + 1
        assert {r.id: r.verdict for r in rows} == {i: v for i, (_, _, v) in enumerate(captures)}
    assert url_filter.filtered(table.where("false"), entries.where("false")).count() == 0


def test_licences(spark):
    mit = licences.TEMPLATES[1][1]
    rows = [("a/LICENSE", mit), ("a/b/x.txt", "Some words of no account."), ("a/b/c/y.txt", "plain text\nLicensed under the Apache License, Version 2.0.\nmore plain text that goes on and on for a while"), ("a/b/c/z.txt", None), ("q/w.txt", ""), (None, "nothing"), ("a/b/x.txt", "Some words of no account."), ("a/d/n.txt", "a licence to print money is not a licence at all, they say")]
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id int, path string, text string, licence string")
    found = {r.id: (r.licence, r.is_file, r.inherited_from) for r in licences.licensed(docs).collect()}
    assert found == {0: ("MIT", True, None), 1: ("MIT", False, "a"), 2: ("Apache-2.0", False, None), 3: ("MIT", False, "a"), 4: (None, False, None), 5: (None, False, None), 6: ("MIT", False, "a"), 7: ("MIT", False, "a")}
    assert licences.licensed(docs.where("false")).count() == 0


def plain_licences(texts):
    """Brute force over every line and paragraph: (licence, score, words of licensed units) of each text."""
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    has = [set(split(t)) for t in texts]
    frequency = Counter(w for words in has for w in words)

    def vector(text):
        return {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + frequency[w])) + 1) for w, n in Counter(split(text)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt((sum(x * x for x in a.values()) * sum(x * x for x in b.values())) or 1)

    templates = [(name, vector(t)) for name, t in licences.TEMPLATES]
    out = []
    for text in texts:
        best, covered = (0, ""), 0
        for block in re.split(r"\n(?:[ \t\v\f\r]*\n)+|^(?:[ \t\v\f\r]*\n)+", text or ""):
            lines = [x for x in block.split("\n") if x.strip(" \t\v\f\r")]
            scores = [max((cosine(t, vector(u)), name) for name, t in templates) for u in (*lines, block)]
            best = max(best, *((round(x, 6), name) for x, name in scores)) if lines else best
            own = [len(split(u)) for u, (x, _) in zip(lines, scores, strict=False) if x >= 0.6]
            covered += len(split(block)) if scores[-1][0] >= 0.6 else sum(own)
        out.append((best[1], best[0], covered) if best[0] >= 0.6 else (None, None, 0))
    return out


@pytest.mark.parametrize("few", [licences.FEW_WORDS, 0])
def test_licences_equal_brute_force(spark, sf_dir, monkeypatch, few):
    monkeypatch.setattr(licences, "FEW_WORDS", few)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    mit, bsd, gpl = (t for _, t in (licences.TEMPLATES[1], licences.TEMPLATES[18], licences.TEMPLATES[8]))
    texts += ["Released under the MIT License, on en be er.", "Licensed under CC BY-NC 4.0, on en be er.", "All rights reserved, on en be."]
    texts += [mit, mit.upper(), f"some words before\n\n{mit}\nand a line\n\n{bsd}", bsd.replace(" ", "\n"), gpl[:120], " ".join(f"x{i}" for i in range(400)) + " " + gpl]
    texts += ["the the the of and to", "public domain software", None, "", "\n\n \n", f"{gpl}\n{mit}", "lizenz für license é"] + ["on en be er and so on"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: (r.licence, r.score, r.licence_words) for r in licences.rated(docs, "text").collect()}
    for i, want in enumerate(plain_licences(texts)):
        assert found[i][1] == (want[1] and pytest.approx(want[1], abs=2e-6)), texts[i]
        assert (found[i][0], found[i][2]) == (want[0], want[2]), texts[i]
    assert found[60][0] == "MIT" and found[66][0] == "BSD-3-Clause" and sum(x[0] is not None for x in found.values()) >= 9


def test_ties_of_licences(spark):
    """Equal scores: the last name of templates, the first name of a directory's files; the deepest directory wins."""
    notices = {k: t for k, t in licences.TEMPLATES if k in ("MIT", "CC-BY-4.0", "GPL-2.0")}
    rows = [("r/LICENSE", notices["MIT"]), ("r/a/COPYING", notices["GPL-2.0"]), ("r/a/COPYING2", notices["GPL-2.0"]), ("r/a/b/c/x", "plain words"), ("r/z", "plain words"), ("x", "plain words"), ("/" + "d/" * 3000 + "x", "plain words")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, path string, text string")
    found = {r.id: (r.licence, r.inherited_from) for r in licences.licensed(docs).collect()}
    assert [found[i] for i in range(7)] == [("MIT", None), ("GPL-2.0", None), ("GPL-2.0", None), ("GPL-2.0", "r/a"), ("MIT", "r"), (None, None), (None, None)]


def test_licence_lines_of_documents(spark, sf_dir):
    names = {"General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "the MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "All rights reserved.": "Proprietary"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in licences.op6_licences(spark, sf_dir).collect():
        want = [v for k, v in names.items() if k in texts[r.doc_id]]
        assert r.licence in want if want else r.licence is None or r.inherited_from


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, same, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), duck.sql(registry.ORACLE_SQL[name]))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() <= before
        before = docs.count()
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() == before and found.where("not exact").count() == 0


def test_queries_take_odd_documents(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "", "")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (2 if name in ("op1_url_filter", "op10_html_text") else 4), name

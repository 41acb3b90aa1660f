"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass decides what it can: blocks that are mostly links are
boilerplate; blocks with many stop words of the page's language (that of the four whose words it has most), and long ones
with some, are text; long ones without are boilerplate, unless they are preformatted or in a table. What is short, or in
between, stays ambiguous and in the second pass takes the label of its nearest decided neighbours, of its own region
before others; a heading goes with what follows it. On a page without an article the ends of the page count as
boilerplate, and a short block with a copyright sign is one. If no block of a page has the stop words, as in other
languages, length takes their place; if nothing is decided, what is ambiguous is text.

Regions are evidence on top. Elements and roles of menus, headers, footers, side bars, forms and dialogues are
boilerplate, so are classes and ids that name nothing else ("comment-list"). A class that has such a word among others
("legal-history") only makes a block that isn't prose boilerplate; inside an article it says nothing, and words that
are as common in articles (share, legal, search) never decide there against prose. Inside an article the doubt goes to
the text. A form around the whole page, as some frameworks have it, marks nothing.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by two line ends.
A map over pages: no shuffle, one page in memory at a time, linear in its length.

Nulls and edge cases: a null or empty html gives an empty text; null ids and urls are passed on; unclosed tags, comments
and quotes end where a browser would end them, or at the end of the page; repeated rows give repeated rows; columns
called text and n_chars are replaced.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import table

#: Function words of four languages.
STOP_WORDS = tuple(
    frozenset(words.split())
    for words in (
        "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you",
        "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous",
        "als am auch auf aus bei das dem den der des die ein eine einer es für ich im ist mit nach nicht sich sie sind und von war wie wird zu zum zur über",
        "al como con de del el ella en entre era es esta este la las lo los más no o para pero por que se sin su sus también un una y ya",
    )
)

#: Elements, roles and words of class or id that mark what is not the article.
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu button select datalist".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
PLAIN_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored sponsors promo nav navbar navigation menu breadcrumb breadcrumbs masthead"
    " footer sidebar aside widget widgets related sharing comment comments commentlist disqus replies cookie cookies consent gdpr popup modal overlay newsletter"
    " subscribe signup login signin pagination pager toolbar skip".split()
)
ARTICLE_WORDS = frozenset("promotion banner header recommended trending share social reply respond notice notices alert subscription search copyright legal disclaimer".split())
#: Words that say nothing about what an element holds.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center col column container content desktop div fixed form global group holder icon icons inner item items large left link links list"
    " main mobile outer page panel post posts primary right row secondary section short site slot small sticky text title top unit wrap wrapper".split()
)
ARTICLE_TAGS = frozenset("article main".split())
RAW_TAGS = frozenset("script style template textarea iframe title xmp noembed noframes".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TRACKED_TAGS = BLOCK_TAGS - frozenset("hr html head body".split())
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())  # a new one ends an open one
EXEMPT_TAGS = frozenset("html body main".split())  # their class tells about the whole page
FIXED_TAGS = frozenset("pre table tbody thead tfoot tr td th blockquote".split())  # long blocks without stop words may be text

SHORT, LONG = 70, 200  # characters
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.15, 0.3
MANY_LINKS = 0.5  # share of a block's characters

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[^\W\d_]+")

NOTHING, DOUBT, FORM, BOILERPLATE = range(4)  # what marks say about a region


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    region: int
    article: bool
    mark: int
    heading: bool
    fixed: bool  # preformatted or in a table


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    """What an element says about what is in it."""
    if tag == "form":
        return FORM
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_article:
        return BOILERPLATE
    if not attributes or tag in EXEMPT_TAGS:
        return NOTHING
    found = NOTHING
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if not in_article and (name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return BOILERPLATE
        if name == "role" and value in BOILERPLATE_ROLES:
            return BOILERPLATE
        if name in ("class", "id"):
            for token in value.split():
                words = set(re.split(r"[^a-z]+", token)) - {""}
                named = words & PLAIN_WORDS
                if words <= PLAIN_WORDS | NEUTRAL_WORDS and named or not in_article and words <= PLAIN_WORDS | ARTICLE_WORDS | NEUTRAL_WORDS and words & ARTICLE_WORDS:
                    return BOILERPLATE
                if words & ARTICLE_WORDS and words <= PLAIN_WORDS | ARTICLE_WORDS | NEUTRAL_WORDS and tag != "header" or not in_article and words & (PLAIN_WORDS | ARTICLE_WORDS):
                    found = DOUBT
    return found


def blocks_of(page: str) -> list[Block]:
    """The page's blocks, in order."""
    out: list[Block] = []
    # open elements that matter: tag, region, article, mark, fixed; and how many there are of each tag
    stack: list[tuple[str, int, bool, int, bool]] = []
    count: Counter[str] = Counter()
    region, article, mark, fixed, regions = 0, False, NOTHING, False, 0
    pieces: list[str] = []
    linked, in_link, heading, at = 0, False, False, 0

    def end_block():
        nonlocal linked, pieces
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, min(linked, len(text)), region, article, mark, heading, fixed))
        pieces, linked = [], 0

    def leave():
        nonlocal region, article, mark, fixed
        count[stack.pop()[0]] -= 1
        _, region, article, mark, fixed = stack[-1] if stack else ("", 0, False, NOTHING, False)

    def say(text: str):
        nonlocal linked
        if text:
            text = references.unescape(text)
            pieces.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    while True:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                in_link = False
            if tag in BLOCK_TAGS or count[tag]:
                end_block()
            if count[tag]:
                while stack[-1][0] != tag:
                    leave()
                leave()
            if tag in BLOCK_TAGS:
                heading = False
            continue
        if tag in RAW_TAGS:
            if not attributes.rstrip().endswith("/") or tag != "iframe":
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                # what a browser reads to the end of the page if it isn't closed; an open template holds nothing
                at = end.end() if end else at if tag == "template" else len(page)
            pieces.append(" ")
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            pieces.append(" ")
        if tag in BLOCK_TAGS:
            end_block()
            if tag in ("article", "section", "div", "nav", "p"):
                in_link = False
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
                leave()
        own = _mark(tag, attributes, article)
        if tag in TRACKED_TAGS or own:
            if attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
                continue
            if own > mark or tag in ARTICLE_TAGS:
                end_block()
                regions += 1
                region = regions
            if tag in ARTICLE_TAGS and own < FORM and mark <= FORM:
                mark = NOTHING  # an article in a form or in a region of doubtful name
            article = tag == "article" and own < FORM or article and max(own, mark) < FORM
            mark = max(own, mark)
            fixed = fixed or tag in FIXED_TAGS
            stack.append((tag, region, article, mark, fixed))
            count[tag] += 1
    end_block()
    return out


class Page:
    """What the rules for a block know about its page."""

    def __init__(self, blocks: list[Block]):
        self.words = [_WORD.findall(b.text.lower()) for b in blocks]
        self.article = any(b.article for b in blocks)
        free = [k for k, b in enumerate(blocks) if b.mark != BOILERPLATE]
        hits = [sum(w in stop for k in free for w in self.words[k]) for stop in STOP_WORDS]
        self.stop = STOP_WORDS[hits.index(max(hits))]
        self.share = [sum(w in self.stop for w in words) / max(1, len(words)) for words in self.words]
        self.known = any(self.share[k] >= FEW_STOP_WORDS and len(blocks[k].text) >= SHORT for k in free)
        # text outside all forms, else they mark nothing
        self.forms = any(b.mark < FORM and (b.article or self.prose(b, k)) for k, b in enumerate(blocks))

    def prose(self, block: Block, k: int) -> bool:
        size, share = len(block.text), self.share[k]
        if block.linked > MANY_LINKS * size:
            return False
        if not self.known:
            return size >= LONG
        return size >= SHORT and share >= MANY_STOP_WORDS or size >= LONG and share >= FEW_STOP_WORDS


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """True: text, False: boilerplate, None: ambiguous."""
    page, out = Page(blocks), []
    for k, block in enumerate(blocks):
        size, prose = len(block.text), page.prose(block, k)
        if block.mark == BOILERPLATE or block.mark == FORM and page.forms:
            out.append(False)
        elif block.mark == DOUBT:
            out.append(prose)
        elif block.linked > MANY_LINKS * size:
            out.append(None if block.article else False)
        elif block.heading:
            out.append(None)
        elif prose:
            out.append(True)
        elif block.article or size < LONG and not _COPYRIGHT.search(block.text) or size >= LONG and (block.fixed or not page.known):
            out.append(None)
        else:
            out.append(False)
    return out


_COPYRIGHT = re.compile(r"©|\(c\) ?[12][0-9]{3}|\bcopyright\b|\ball rights reserved\b", re.I)


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbours: in their region, or else on the page."""
    some_article, n = any(b.article for b in blocks), len(blocks)
    edges = not some_article and any(labels)  # the ends of a page without an article are boilerplate

    def nearest(order, key, first) -> list[tuple[int, bool] | None]:
        seen: dict = {}
        out: list = [None] * n
        for i in order:
            k = key(blocks[i])
            if labels[i] is None:
                out[i] = seen.get(k, first(k))
            else:
                seen[k] = (i, labels[i])
        return out

    def both(key, whole: bool):
        before = nearest(range(n), key, lambda k: (-1, False) if edges and (whole or not k) else None)
        return before, nearest(range(n - 1, -1, -1), key, lambda k: (n, False) if edges and (whole or not k) else None)

    found = [both(lambda b: b.region, False), both(lambda b: 0, True)]
    out = []
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            for level, (before, after) in enumerate(found):
                a, b = before[i], after[i]
                if a or b:
                    if level and block.article:
                        label = True
                    elif a and b and a[1] != b[1]:
                        # a heading goes with what follows it; between two labels the nearer one counts, in doubt the text
                        label = b[1] if block.heading else True if i - a[0] == b[0] - i else (a if i - a[0] < b[0] - i else b)[1]
                    else:
                        label = (a or b)[1]
                    break
            else:
                label = block.article or not some_article
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    labels = second_pass(blocks, first_pass(blocks))
    return "\n\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, its html replaced by text and n_chars (columns of these names are replaced)."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [main_text(x.as_py()) for x in batch.column(names.index(html))]
            new = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)) for f in kept), *new], [*(f.name for f in kept), "text", "n_chars"])

    schema = type(pages.schema)([*kept]).add("text", "string").add("n_chars", "long")
    return pages.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLE_SQL: dict = {}

"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words, which score positive, and tags, which score negative, as do words of links
where a page has them outside its article; the weights are smoothed log odds counted on labelled
pages of many layouts. One linear scan finds the contiguous run with the greatest sum, the content region.
Elements inside the region that are no article text (menus, notices, forms, reader comments ...) are
left out, and its blocks are joined.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prismtab.llm.common import small_batches, steps, table, texts
from prismtab.llm.html_layouts import labelled_pages

#: Elements whose inside is no text at all.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title", "audio", "video")
#: Elements that are never article text.
CHROME = frozenset("nav footer aside form button dialog menu head header fieldset label".split())
#: Elements that have no inside.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that break a line of text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Raw elements that break a line of text.
BREAKING = frozenset(("title", "iframe", "select", "textarea"))
#: Words of class, id and role that mark no article text.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disqus donate follow footer form gdpr header login masthead menu modal nav navbar navigation navigator newsletter notice notices pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar warning widget".split())
#: Elements that marks don't leave out, as the article may be their inside.
HOLDERS = frozenset("html body main article".split())

#: Marks that leave out holders too, as readers' comments are often articles of their own.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: First and last words of a class that says what a page has or hasn't, as in no-sidebar and comments-open.
STATES = (frozenset("no has with without not is hide hidden show".split()), frozenset("open closed enabled disabled visible active on off".split()))

#: Possessive, and no tag reaches over the next "<" outside quotes: a page's tags are found in one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=<))")
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

#: Labelled pages that the weights are learned from.
PAGES, SEED = 400, 7
#: The least that a word and a tag of what is left out takes away, and half the most.
LIGHT = {"!": 0.1, "<!": 0.1}
#: Texts of class, id and role that a worker remembers, of so many letters at most.
REMEMBERED, LETTERS = 1 << 14, 200


class _Item(NamedTuple):
    """A tag, or a stretch of text (text is not None): what its weight goes by, the words in it, is it left out, does a block end."""

    key: str
    text: str | None
    words: int
    out: bool
    breaks: bool


def _says(name_list: str, holder: bool) -> bool:
    for name in name_list.split():
        words = [w.lower() for w in _WORD.findall(name)]
        stated = len(words) > 1 and (words[0] in STATES[0] or words[-1] in STATES[1])
        if not stated and any(w in (COMMENTS if holder else MARKS) for w in words):
            return True
    return False


_remembered = lru_cache(REMEMBERED)(_says)


def _marked(attributes: str, holder: bool) -> bool:
    """Do class, id or role say that the element is no article text?"""
    return any((_remembered if len(m[1]) <= LETTERS else _says)(m[1].strip("\"'"), holder) for m in _MARK.finditer(attributes))


def tokens(page: str) -> list[_Item]:
    """The page's words and tags in order. Scripts, styles, comments and declarations are gone; character references are decoded.

    One pass: a comment, declaration or raw element that nothing ends reaches to the page's end, a "<" that begins no
    tag is text, and an end tag is looked for among the open elements only if there is one of its name.
    """
    items: list[_Item] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are left out
    opened: Counter[str] = Counter()
    out, article = 0, 0

    def text(s: str) -> None:
        if s:
            s = html.unescape(s)
            items.append(_Item("!" if out else "a" if opened["a"] else "", s, len(s.split()), out > 0, False))

    def tag(name: str, gone: bool = False) -> None:
        key = "<!" if out or gone else f"<{name}" + "^" * (article > 0)
        items.append(_Item(key, None, 0, out > 0, name in BLOCK or name in BREAKING))

    def pop() -> bool:
        nonlocal out, article
        name, gone = stack.pop()
        opened[name] -= 1
        out -= gone
        article -= name in ("article", "main")
        return gone

    at, look, size = 0, 0, len(page)
    while at < size:
        lt = page.find("<", look)
        if lt < 0:
            text(page[at:])
            break
        if page.startswith(("<!", "<?"), lt):
            text(page[at:lt])
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = look = size if end < lt + 2 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            look = lt + 1
            continue
        text(page[at:lt])
        at = look = m.end()
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            gone = False
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                gone = pop()
            tag(name, gone)
            continue
        if name in _END and not (name in ("svg", "math") and attributes.endswith("/")):
            end = _END[name].search(page, at)
            at = look = end.end() if end else size
            if name in BREAKING:
                tag(name)
            continue
        gone = _marked(attributes, name in HOLDERS) or name in CHROME and not (name == "header" and article)
        if name not in VOID and not attributes.endswith("/"):
            if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                pop()  # its end tag may be left out
            stack.append((name, gone))
            opened[name] += 1
            out += gone
            article += name in ("article", "main")
        tag(name, gone)
    return items


@cache
def weights() -> tuple[dict[str, float], float]:
    """The weight of each kind of word and tag, and of any other tag, from labelled pages of many layouts.

    Log odds of article against the rest, one half added to each count. Plain words are held above zero and tags below. What is
    left out of the text wherever it stands is held to small weights, so that an advert does not cut an article in two.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in labelled_pages(SEED, PAGES):
        n = list(accumulate(len(tokens(m)) for _, m in page))  # items up to each part's end: no part ends inside an element but the article
        items = tokens("".join(m for _, m in page))
        for k, i in enumerate(items):
            (inside if page[bisect.bisect_right(n, k)][0] else outside)[i.key] += 1 if i.text is None else i.words
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / total_in) - math.log((outside[k] + 0.5) / total_out) for k in {*inside, *outside}}
    tags = {k: min(-0.02, v) for k, v in odds.items() if k.startswith("<")}
    light = {k: min(-v, max(-2 * v, odds[k])) for k, v in LIGHT.items()}
    return tags | light | {"": max(0.1, odds[""]), "a": odds["a"]}, sum(tags.values()) / len(tags)


def region(items: list[_Item]) -> tuple[int, int, float]:
    """First and past-the-last item of the maximum-scoring subsequence, and its score; the first such, (0, 0, 0) if no word."""
    weight, other = weights()
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for k, i in enumerate(items):
        if run <= 0:
            run, start = 0.0, k
        run += weight.get(i.key, other) if i.text is None else weight[i.key] * i.words
        if run > best:
            best, lo, hi = run, start, k + 1
    return lo, hi, best


def extract(page: str | None) -> tuple[str, float]:
    """The article's text and the region's score; null and empty pages have none."""
    items = tokens(page or "")
    lo, hi, score = region(items)
    # Opening marks of the text at the region's edge belong to it as far as no word is between.
    blocks, block = [], []
    for i in items[lo:hi]:
        if i.text is not None:
            if not i.out:
                block.append(i.text)
        elif i.breaks:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (_SPACE.sub(" ", b).strip() for b in blocks)
    return " ".join(b for b in clean if b), score


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars in code points, score of the region.

    Null html counts as empty and gives an empty text; page_id and url are passed on as they are, null or
    repeated; other columns are not read; an empty table gives an empty table. A page is worked on as a
    whole, so a worker holds one batch's slice or its longest page.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                found = [extract(x) for x in texts(part.column(2))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["page_id", "url", "text", "n_chars", "score"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long, score double")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(table(spark, sf_dir, "pages"))

"""Labelled pages of many layouts, made by rule, on which the weights of HTML extraction are learned.

A page is a list of (kind, mark-up) in page order: 1 for article text, 2 for what stands inside the article and is none of its
text, 0 for the rest. Of what stands around an article,
half has no telling element or class, so that its words, links and tags alone must say what it is.
"""

from __future__ import annotations

import random

Page = list[tuple[int, str]]


class Layout:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        #: Does this page's author name things by what they are?
        self.named = rng.random() < 0.5

    def words(self, lo: int, hi: int) -> str:
        return " ".join(["word"] * self.rng.randint(lo, hi))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(5, 24) + "." for _ in range(self.rng.randint(lo, hi)))

    def link(self, lo: int = 1, hi: int = 4) -> str:
        return f"<a href='#'>{self.words(lo, hi)}</a>"

    def box(self, inside: str, *names: str) -> str:
        """In an element or class that says what it is, or in a plain one."""
        name = self.rng.choice(names) if self.named else "div"
        return f"<{name}>{inside}</{name}>" if name.isalpha() else f"<div class='{name[1:]}'>{inside}</div>"

    def links(self, lo: int, hi: int, most: int = 4) -> str:
        n = self.rng.randint(lo, hi)
        shape = self.rng.randrange(4)
        if shape == 0:
            return "<ul>" + "".join(f"<li>{self.link(1, most)}</li>" for _ in range(n)) + "</ul>"
        if shape == 1:
            return " | ".join(self.link(1, most) for _ in range(n))
        if shape == 2:
            return "".join(f"<span>{self.link(1, most)}</span>" for _ in range(n))
        return "<table><tr>" + "".join(f"<td>{self.link(1, most)}</td>" for _ in range(n)) + "</tr></table>"

    def boilerplate(self, before: bool) -> str:
        kind = self.rng.choice(("menu", "crumbs", "advert", "notice", "search", "share") if before else ("side", "cards", "advert", "share", "comments", "menu"))
        if kind == "menu":
            return self.box(self.links(3, 12), "nav", ".menu", "header")
        if kind == "crumbs":
            return self.box(self.links(2, 4), ".breadcrumbs", "nav")
        if kind == "share":
            return self.box(self.links(2, 5, 1), ".share", ".social")
        if kind == "search":
            return f"<form><input><button>{self.words(1, 2)}</button></form>"
        if kind == "side":
            return self.box(f"<h3>{self.words(1, 3)}</h3>" + self.links(3, 9, 9), "aside", ".sidebar", ".related")
        if kind == "cards":
            return self.box("".join(f"<div><a><img></a>{self.link(3, 9)}<span>{self.words(1, 3)}</span></div>" for _ in range(self.rng.randint(2, 6))), ".related", ".teaser")
        self_named, self.named = self.named, True  # nothing but a name tells these from an article
        if kind == "advert":
            out = self.box(f"{self.sentences(1, 2)} {self.link()}", ".ad", ".sponsored", ".promo")
        elif kind == "notice":
            out = self.box(f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>", ".cookie", ".notice")
        else:
            out = self.box("".join(f"<div><span>{self.words(1, 2)}</span><p>{self.sentences(1, 3)}</p></div>" for _ in range(self.rng.randint(1, 6))), ".comments", ".commentlist")
        self.named = self_named
        return out

    def inline(self) -> str:
        text = self.sentences(1, 5)
        for _ in range(self.rng.randrange(3)):
            tag = self.rng.choice(("b", "i", "em", "strong", "code", "a", "span"))
            text += f" <{tag}>{self.words(1, 4)}</{tag}> {self.words(2, 9)}."
        return text + ("<br>" + self.sentences(1, 2) if self.rng.random() < 0.2 else "")

    def element(self) -> str:
        kind = self.rng.choice(("p", "p", "p", "p", "p", "h2", "list", "quote", "pre", "table", "figure", "dl"))
        if kind == "h2":
            return f"<{(h := self.rng.choice(('h2', 'h3')))}>{self.words(2, 8)}</{h}>"
        if kind == "list":
            return f"<{(t := self.rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(self.rng.randint(2, 7))) + f"</{t}>"
        if kind == "quote":
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if kind == "pre":
            return f"<pre><code>{self.words(5, 40)}</code></pre>"
        if kind == "table":
            columns = self.rng.randint(2, 5)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(columns)) + "</tr>" for _ in range(self.rng.randint(2, 30))) + "</table>"
        if kind == "figure":
            return f"<figure><img><figcaption>{self.words(4, 15)}</figcaption></figure>"
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.words(5, 20)}</dd>" for _ in range(self.rng.randint(1, 5))) + "</dl>"
        return f"<p>{self.inline()}</p>"

    def page(self) -> Page:
        holder = self.rng.choice(("article", "article", "main", "div", "section", "div"))
        before = "".join(self.boilerplate(True) for _ in range(self.rng.randint(1, 4)))
        after = "".join(self.boilerplate(False) for _ in range(self.rng.randint(0, 4)))
        parts = [self.element() for _ in range(self.rng.randint(2, 15))]
        if self.rng.random() < 0.4:  # as content systems do
            wrap = self.rng.choice(("div", "section"))
            parts = [f"<{wrap}>{x}</{wrap}>" if self.rng.random() < 0.7 else x for x in parts]
        article = [(1, f"<h1>{self.words(3, 12)}</h1>"), *[(1, x) for x in parts]]
        if self.rng.random() < 0.4:
            self.named, named = True, self.named
            for _ in range(self.rng.randint(1, 2)):
                article.insert(self.rng.randint(1, len(article)), (2, self.boilerplate(False)))
            self.named = named
        foot = self.box(f"<p>{self.words(2, 9)}</p>" + self.links(1, 8), "footer", ".footer")
        return [(0, f"<html><head><title>{self.words(2, 8)}</title></head><body>{before}<{holder}>"), *article, (0, f"</{holder}>{after}{foot}</body></html>")]


def labelled_pages(seed: int, n: int) -> list[Page]:
    return [Layout(random.Random(f"{seed} {i}")).page() for i in range(n)]

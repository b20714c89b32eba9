"""Labelled pages: site layouts whose every block of text is known to be main text or not."""

from __future__ import annotations

import random
from collections.abc import Callable

MAIN, OTHER = "", ""
"""The first character of each block of a labelled page; stripped before features are taken."""

SYLLABLES = "the and ing er on re at en th or ti is le de que ment aux ou la el os ción ar es un ra der sch ein ge ung ä ü é è".split()
"""Fixed values: word parts that the words of labelled pages are made of."""

NAMES = {
    "menu": ["nav", "menu", "main-nav", "navbar", "breadcrumbs", "navigation", "site-menu", "pagination", "tabs", "toc"],
    "header": ["header", "site-header", "masthead", "page-header", "topbar", "branding", "logo"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "legal", "bottom"],
    "sidebar": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "rail", "trending", "popular"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "announcement"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor", "banner-ad"],
    "form": ["form", "login", "search", "newsletter", "subscribe", "signup", "search-box", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "replies", "responses", "discussion", "disqus", "reader-comments"],
    "share": ["share", "social", "share-buttons", "follow", "author-box", "tags", "post-meta"],
    "content": ["content", "article", "post", "entry", "story", "main", "post-content", "article-body", "text", "entry-content"],
    "plain": ["row", "col", "wrap", "container", "inner", "box", "c1", "block", "section", "grid", "x7", "clearfix"],
}
"""Fixed values: class names by what stands in such elements."""

TAGS = {
    "menu": ["nav", "div", "ul"],
    "header": ["header", "div"],
    "footer": ["footer", "div"],
    "sidebar": ["aside", "div", "section"],
    "notice": ["div", "section", "aside", "dialog"],
    "advert": ["div", "aside", "section"],
    "form": ["form", "div"],
    "comments": ["section", "div", "aside"],
    "share": ["div", "ul", "section"],
    "content": ["article", "main", "div", "section"],
}
"""Fixed values: elements by what stands in them."""


class Layout:
    """One site: its choice of elements and class names, and pages in them."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        # Some sites name nothing, some only use elements that say what they are, most do both to some degree.
        self.named = self.rng.choice([0.0, 0.5, 0.9, 1.0, 1.0])
        self.semantic = self.rng.choice([0.0, 0.3, 0.8, 1.0])
        self.bare = self.rng.random() < 0.15
        self.paragraph = self.rng.choice(["p", "p", "p", "p", "div"])
        self.terse = self.rng.random()

    def word(self) -> str:
        return "".join(self.rng.choices(SYLLABLES, k=self.rng.choice([1, 1, 2, 2, 3])))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(1, self.rng.choice([6, 18])).capitalize()
        if self.rng.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text + ("" if self.rng.random() < 0.1 else self.rng.choice("....?!"))

    def aside(self) -> str:
        """What else stands in running text: numbers, addresses, code, marks without a stop, notes on rights."""
        return self.rng.choice(
            [
                f"{self.rng.randint(1, 9999)} {self.word()} {self.rng.randint(1, 99)}%",
                f"{self.word()}@{self.word()}.example",
                f"https://{self.word()}.example/{self.rng.randint(1, 99)}",
                f"{self.word()}_{self.word()} = {self.rng.randint(0, 9)};",
                " | ".join(self.word() for _ in range(self.rng.randint(2, 9))),
                "### ".join(self.word() for _ in range(self.rng.randint(2, 9))),
                f"(c) {self.rng.randint(1990, 2030)} {self.words(1, 3)}.",
                "All rights reserved.",
                self.words(1, 2),
                self.words(1, 6),
                f"+{self.rng.randint(1, 99)} {self.rng.randint(1000, 99999)} {self.rng.randint(1000, 99999)}",
            ]
        )

    def prose(self, low: int = 1, high: int = 7) -> str:
        if self.rng.random() < self.terse:
            high = min(high, max(low, 2))
        text = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        if self.rng.random() < 0.25:
            return self.rng.choice([self.aside(), self.aside(), text + " " + self.aside(), self.aside() + " " + text]).strip()
        return text

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def region(self, kind: str, body: str) -> str:
        """``body`` in an element that this site uses for ``kind``."""
        tag, *others = TAGS[kind]
        if self.rng.random() >= self.semantic:
            tag = self.rng.choice(others)
        # Running text that is not main text can be told only by what its site says of it, so this is always said.
        sure = kind in {"advert", "notice", "comments", "sidebar", "form"}
        named = sure or self.rng.random() < self.named
        name = self.rng.choice(NAMES[kind] if named else NAMES["plain"])
        said = self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="{self.rng.choice(NAMES["plain"])} {name}"'])
        says_so = tag in {"nav", "article", "main", "header", "footer", "form"} or (tag, kind) == ("aside", "sidebar")
        if says_so and self.rng.random() < 0.5:
            said = ""
        if tag == "ul":
            body = f"<li>{body}</li>"
        return f"<{tag}{said}>{body}</{tag}>"

    def block(self, tag: str, label: str, text: str) -> str:
        end = "" if tag in {"p", "li", "td"} and self.rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{label}{text}{end}"

    def links(self, low: int, high: int) -> str:
        tag = self.rng.choice(["li", "li", "p", "div"])
        items = "".join(self.block(tag, OTHER, self.link(self.words(1, 4))) for _ in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def mixed(self) -> str:
        """A paragraph of main text, with inline elements in it."""
        text = self.prose()
        if self.rng.random() < 0.25:
            text += " " + self.link(self.words(1, 3)) + " " + self.sentence()
        if self.rng.random() < 0.2:
            text = f"<b>{self.sentence()}</b> " + text
        if self.rng.random() < 0.15:
            return f"<p><b>{MAIN}{text}<br>"
        return self.block(self.paragraph, MAIN, text)

    def advert(self) -> str:
        text = self.rng.choice([self.prose(1, 2), self.link(self.words(2, 6)), self.words(2, 8)])
        return self.region("advert", self.block(self.rng.choice(["p", "div", "span"]), OTHER, text))

    def related(self) -> str:
        head = self.block("h3", OTHER, self.words(1, 3))
        teasers = "".join(self.block("p", OTHER, self.link(self.sentence()) + " " + self.prose(0, 1)) for _ in range(3))
        return self.region("sidebar", head + self.rng.choice([self.links(2, 6), teasers]))

    def notice(self) -> str:
        return self.region("notice", self.block("p", OTHER, self.prose(1, 2)) + self.block("button", OTHER, self.words(1, 2)))

    def form(self) -> str:
        fields = "".join(self.block("label", OTHER, self.words(1, 3)) + "<input name=q>" for _ in range(self.rng.randint(1, 3)))
        return self.region("form", self.block("p", OTHER, self.sentence()) + fields + self.block("button", OTHER, self.word()))

    def comments(self) -> str:
        def one() -> str:
            who = self.block(self.rng.choice(["span", "h4", "p"]), OTHER, self.words(1, 2))
            inner = who + self.block(self.paragraph, OTHER, self.prose(1, 4))
            return self.region("comments", inner) if self.rng.random() < 0.5 else f"<div>{inner}</div>"

        head = self.block("h3", OTHER, self.words(1, 3))
        return self.region("comments", head + "".join(one() for _ in range(self.rng.randint(1, 6))))

    def body(self) -> str:
        """The main text, with what sites put between its paragraphs."""
        between: list[Callable[[], str]] = [self.advert, self.related, self.notice, self.form]
        item = self.rng.choice([lambda: self.words(1, 4), lambda: self.prose(1, 2)])
        parts = [] if self.rng.random() < 0.35 else [self.block("h1", MAIN, self.words(3, 12).capitalize())]
        if parts and self.rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        if self.rng.random() < 0.2:
            parts.append(self.region("share", self.links(2, 4)))
        for _ in range(self.rng.choice([1, 1, 2, 2, 4, 8, 14, 25])):
            kind = self.rng.random()
            if kind < 0.75:
                parts.append(self.mixed())
            elif kind < 0.80:
                parts.append(self.block(self.rng.choice(["h2", "h3"]), MAIN, self.words(1, 6).capitalize()))
            elif kind < 0.84:
                tag = self.rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(self.block("li", MAIN, item()) for _ in range(self.rng.randint(1, 6))) + f"</{tag}>")
            elif kind < 0.87:
                parts.append(f"<blockquote>{self.block('p', MAIN, self.prose(1, 3))}</blockquote>")
            elif kind < 0.89:
                parts.append(f"<figure><img src=a.png>{self.block('figcaption', MAIN, self.sentence())}</figure>")
            elif kind < 0.91:
                cells = "".join(self.block("td", MAIN, self.words(1, 3)) for _ in range(3))
                parts.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.93:
                parts.append(self.block("pre", MAIN, self.words(3, 9)))
            else:
                parts.append(self.rng.choice(between)())
        if self.rng.random() < 0.2:
            parts.append(self.region("share", self.links(2, 4)))
        if self.rng.random() < 0.2:
            parts.append(self.comments())
        body = "".join(parts)
        return body if self.bare else self.region("content", body)

    def page(self) -> str:
        """A whole page; each block starts with ``MAIN`` or ``OTHER``."""

        alone = self.rng.random() < 0.25

        def maybe(chance: float, make: Callable[[], str]) -> str:
            return make() if not alone and self.rng.random() < chance else ""

        top = maybe(0.3, self.notice) + maybe(
            0.6,
            lambda: self.region(
                "header", self.block(self.rng.choice(["div", "h1", "p", "a"]), OTHER, self.words(1, 4)) + maybe(0.4, self.form)
            ),
        )
        top += maybe(0.8, lambda: self.region("menu", self.links(3, 9))) + maybe(0.4, self.advert)
        middle = maybe(0.3, self.related) + self.body() + maybe(0.3, self.comments) + maybe(0.4, self.related)
        if self.rng.random() < 0.4:
            middle = f'<div class="{self.rng.choice(NAMES["plain"])}">{middle}</div>'
        foot = maybe(
            0.8,
            lambda: self.region(
                "footer",
                maybe(0.5, lambda: self.links(2, 5)) + self.block("p", OTHER, self.rng.choice(["&copy; ", "&copy; 2024 ", ""]) + self.words(1, 3) + ". " + self.prose(0, 1)),
            ),
        )
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head>"
        script = "<script>var t='<p>no</p>';</script>"
        return f"<!DOCTYPE html><html>{head}<body>{top}{script}{middle}{maybe(0.2, self.form)}{foot}</body></html>"


def labelled_pages(count: int, seed: int = 0) -> list[str]:
    """``count`` pages, each of a site of its own."""
    return [Layout(seed * 1_000_003 + i).page() for i in range(count)]

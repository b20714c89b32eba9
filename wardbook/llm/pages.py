"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page's tree."""

from __future__ import annotations

import html as characters
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.layouts import MAIN, OTHER, labelled_pages
from wardbook.llm.support import table
from wardbook.llm.tokens import once

TRAINING_PAGES = 800
"""Labelled pages that the model is fitted to; the same whatever table it is used on."""
ROUNDS = 200

# Elements of the markup standard by how text in them is laid out.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
"""Open elements that a start tag ends."""
PASSES = frozenset("p dt dd tr option".split())
"""Elements that such a tag looks past, to one below that it ends."""

# What elements and words in class, id and role say about the text in them.
ROLE_OF_TAG = {
    **dict.fromkeys(["nav", "menu"], "menu"),
    "header": "header",
    "footer": "footer",
    "aside": "sidebar",
    **dict.fromkeys(["form", "button", "select", "label", "fieldset", "textarea", "option", "legend"], "form"),
    "dialog": "notice",
    **dict.fromkeys(["article", "main"], "content"),
}
ROLE_WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc toolbar sitemap skip",
    "header": "header masthead branding logo topbar tagline",
    "footer": "footer colophon copyright legal bottom contentinfo imprint",
    "sidebar": "sidebar side widget widgets related recommended recommendations rail trending popular complementary teaser "
    "teasers aside",
    "notice": "notice notices cookie cookies consent alert gdpr popup modal dialog announcement notification overlay paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsored sponsor sponsors promo promotion banner dfp adslot "
    "adsense adsbygoogle",
    "form": "form login search newsletter subscribe subscription signup signin register searchbox searchform",
    "comments": "comment comments commentlist reply replies respond responses discussion disqus thread",
    "share": "share sharing social follow author byline tags meta rating",
    "content": "content article post entry story main body text prose",
}
ROLE_OF_WORD = {word: role for role, words in ROLE_WORDS.items() for word in words.split()}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
SAID = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    """An open element: its name, what its ancestors and itself say as features, and the nearest block-level element."""

    tag: str
    roles: tuple[str, ...]
    place: int


class Block(NamedTuple):
    """Text of a leaf: its characters, how many of them are in links, the features of its ancestors, the element they share."""

    text: str
    linked: int
    tag: str
    roles: tuple[str, ...]
    parent: int


def roles_of(tag: str, attributes: str) -> list[str]:
    """What an element says about its text, the tag first."""
    found = [ROLE_OF_TAG[tag]] if tag in ROLE_OF_TAG else []
    if attributes:
        for said in SAID.findall(attributes):
            for part in NAME_PART.findall("".join(said)):
                role = ROLE_OF_WORD.get(part.lower())
                if role and role not in found:
                    found.append(role)
    return found


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order: text without a block-level boundary in it, white space turned into one space.

    Unclosed and misnested elements are ended where the next start tag or an
    enclosing end tag ends them. Scripts, styles, titles, comments and other text
    that is never shown as part of the page leave nothing.
    """
    stack = [Element("", (), 0)]
    blocks: list[Block] = []
    parts: list[str] = []
    linked, links, places = 0, 0, 0
    where = stack[0]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(characters.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, linked, where.tag, where.roles, outer))
            parts.clear()
            linked = 0

    outer, at, opened = 0, 0, Counter()
    for token in TOKEN.finditer(html):
        if token.start() > at:
            text = html[at : token.start()]
            parts.append(text)
            if links:
                linked += len(text)
        at = token.end()
        tag = token[3]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(token[2])
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            elif closing or token[4].endswith("/"):
                continue
            elif token[4]:
                # An inline element may still say what its text is, as a block of its own would.
                said = roles_of(tag, token[4])
                if said and not "".join(parts).strip():
                    where = Element(where.tag, widened(where.roles, said), where.place)
            continue
        flush()
        links = 0
        if closing:
            if opened[tag]:
                while opened[tag] and stack[-1].tag != tag:
                    opened[stack.pop().tag] -= 1
                opened[stack.pop().tag] -= 1
        elif tag not in VOID:
            ended = CLOSES.get(tag) or {"p"}
            depth = keep = len(stack)
            while stack[depth - 1].tag in ended or stack[depth - 1].tag in PASSES and tag in CLOSES:
                depth -= 1
                if stack[depth].tag in ended:
                    keep = depth
            for _ in range(len(stack) - keep):
                opened[stack.pop().tag] -= 1
            opened[tag] += 1
            top = stack[-1]
            places += 1
            stack.append(Element(tag, widened(top.roles, roles_of(tag, token[4])), places))
        where = stack[-1]
        outer = stack[-2].place if len(stack) > 1 else 0
    if at < len(html):
        parts.append(html[at:])
    flush()
    return blocks


def widened(roles: tuple[str, ...], more: list[str]) -> tuple[str, ...]:
    """Roles from the page down to an element; each once for every stretch, so their number is small however deep the page."""
    for role in more:
        if not roles or roles[-1] != role:
            roles = (*roles[-3:], role) if len(roles) > 3 else (*roles, role)
    return roles


def place_features(tag: str, roles: tuple[str, ...]) -> list[str]:
    """Features of the ancestors: which roles there are, the innermost, neighbouring roles, and the element itself."""
    found = [f"tag {tag}", f"in {roles[-1] if roles else None}", f"tag {tag} in {roles[-1] if roles else None}"]
    found += [f"under {r}" for r in set(roles)]
    found += [f"{a} over {b}" for a, b in zip(roles, roles[1:], strict=False)]
    if roles and all(r == "content" for r in roles):
        found.append("content only")
    return found


def text_features(block: Block) -> list[str]:
    """Features of the text: length, share of links, stops, capitals, digits, signs of ownership."""
    text = block.text
    words = text.count(" ") + 1
    length = "1" if words < 2 else "2" if words < 5 else "3" if words < 12 else "4" if words < 30 else "5"
    share = block.linked / max(len(text), 1)
    links = "none" if share == 0 else "some" if share < 0.5 else "most"
    stop = text[-1] in ".!?…:;\"'»”)"
    found = [
        f"length {length}",
        f"links {links}",
        f"length {length} links {links}",
        f"stop {stop}",
    ]
    if "," in text:
        found.append("comma")
    if "©" in text or "(c)" in text:
        found.append("owner")
    if any(map(str.isdigit, text[:40])):
        found.append("digit")
    return found


class Model(NamedTuple):
    """Scores of main text over other text: of features, of the first and last block, and of steps between labels."""

    weights: dict[str, float]
    ends: np.ndarray
    """``[first or last][label]``."""
    steps: np.ndarray
    """``[same parent][label before][label]``."""


def viterbi(scores: np.ndarray, same: np.ndarray, model: Model) -> np.ndarray:
    """The best labels of one page: 1 for main text. ``same`` says whether a block shares its parent with the one before."""
    count = len(scores)
    if not count:
        return np.zeros(0, np.int64)
    steps, (first, last) = model.steps.tolist(), model.ends.tolist()
    no, yes = first[0], first[1] + scores[0]
    back = []
    for score, shared in zip(scores[1:].tolist(), same[1:].tolist(), strict=True):
        (nn, ny), (yn, yy) = steps[shared]
        to_no, to_yes = (no + nn, yes + yn), (no + ny, yes + yy)
        back.append((to_no[1] > to_no[0], to_yes[1] > to_yes[0]))
        no, yes = max(to_no), max(to_yes) + score
    label = int(yes + last[1] > no + last[0])
    labels = [label]
    for step in reversed(back):
        label = int(step[label])
        labels.append(label)
    return np.array(labels[::-1])


def log_likelihood(scores: np.ndarray, same: np.ndarray, labels: np.ndarray, sizes: np.ndarray, ends: np.ndarray, steps: np.ndarray):
    """Mean log-likelihood of pages side by side, and its gradients by block score, ends and steps.

    ``scores``, ``same`` and ``labels`` are padded to ``[page][block]``; sums run forward and backward over all pages at once.
    """
    pages, longest = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    forward = np.zeros((pages, longest, 2))
    forward[:, 0] = ends[0] + emit[:, 0]
    valid = np.arange(longest) < sizes[:, None]
    for t in range(1, longest):
        paths = forward[:, t - 1, :, None] + steps[same[:, t]]
        reach = np.logaddexp(paths[:, 0], paths[:, 1]) + emit[:, t]
        forward[:, t] = np.where(valid[:, t, None], reach, forward[:, t - 1])
    total = np.logaddexp.reduce(forward[:, -1] + ends[1], axis=1)
    backward = np.zeros((pages, longest, 2))
    backward[:, -1] = ends[1]
    for t in range(longest - 2, -1, -1):
        paths = steps[same[:, t + 1]] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
        reach = np.logaddexp(paths[:, :, 0], paths[:, :, 1])
        backward[:, t] = np.where(valid[:, t + 1, None], reach, backward[:, t + 1])
    each = np.exp(forward + backward - total[:, None, None])
    by_score = np.where(valid, labels - each[:, :, 1], 0)
    hot = np.stack([1 - labels, labels], axis=2)
    rows = np.arange(pages)
    by_ends = np.stack([(hot[:, 0] - each[:, 0]).sum(axis=0), (hot[rows, sizes - 1] - each[rows, sizes - 1]).sum(axis=0)])
    after = (emit + backward)[:, 1:, None, :]
    pair = np.exp(forward[:, :-1, :, None] + steps[same[:, 1:]] + after - total[:, None, None, None])
    surplus = np.where(valid[:, 1:, None, None], hot[:, :-1, :, None] * hot[:, 1:, None, :] - pair, 0)
    by_steps = np.stack([surplus[same[:, 1:] == s].sum(axis=0) for s in (0, 1)])
    right = np.where(valid, scores * labels, 0).sum(axis=1) + ends[0][labels[:, 0]] + ends[1][labels[rows, sizes - 1]]
    right += np.where(valid[:, 1:], steps[same[:, 1:], labels[:, :-1], labels[:, 1:]], 0).sum(axis=1)
    return float((right - total).mean()), by_score / pages, by_ends / pages, by_steps / pages


def fit(pages: list[str], rounds: int = ROUNDS, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """A model of labelled pages (``layouts``), by ``rounds`` steps of gradient ascent with adapted rates."""
    parsed = [p for p in map(leaf_blocks, pages) if p]
    numbers: dict[str, int] = {}
    members, owners, block = [], [], 0
    sizes = np.array([len(p) for p in parsed])
    same, labels = np.zeros((len(parsed), sizes.max()), np.int64), np.zeros((len(parsed), sizes.max()), np.int64)
    for k, found in enumerate(parsed):
        for t, b in enumerate(found):
            labels[k, t] = MAIN in b.text
            same[k, t] = t > 0 and b.parent == found[t - 1].parent
            b = b._replace(text=b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-")
            for name in (*place_features(b.tag, b.roles), *text_features(b)):
                members.append(numbers.setdefault(name, len(numbers)))
                owners.append(block)
            block += 1
    members, owners = np.array(members), np.array(owners)
    at = np.flatnonzero(np.arange(sizes.max()) < sizes[:, None])
    sizes_of = [len(numbers), 4, 8]
    state = np.zeros(sum(sizes_of))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        weights, ends, steps = np.split(state, np.cumsum(sizes_of)[:-1])
        scores = np.zeros(same.size)
        scores[at] = np.bincount(owners, weights[members], block)
        _, by_score, by_ends, by_steps = log_likelihood(
            scores.reshape(same.shape), same, labels, sizes, ends.reshape(2, 2), steps.reshape(2, 2, 2)
        )
        by_weight = np.bincount(members, by_score.ravel()[at][owners], len(numbers))
        slope = np.concatenate([by_weight, by_ends.ravel(), by_steps.ravel()]) - decay * state
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        state = state + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights, ends, steps = np.split(state, np.cumsum(sizes_of)[:-1])
    return Model(dict(zip(numbers, weights.tolist(), strict=True)), ends.reshape(2, 2), steps.reshape(2, 2, 2))


def default_model() -> Model:
    """The model of ``TRAINING_PAGES`` labelled pages, fitted once in a driver."""
    return once(("pages", TRAINING_PAGES, ROUNDS), lambda: fit(labelled_pages(TRAINING_PAGES)))


def label_blocks(html: str, model: Model, places: dict) -> tuple[list[str], np.ndarray]:
    """Texts of a page's leaf blocks, and which are main text. ``places`` remembers the scores of ancestors."""
    blocks = leaf_blocks(html)
    weight = model.weights.get
    scores = np.zeros(len(blocks))
    same = np.zeros(len(blocks), np.int64)
    before = None
    for k, b in enumerate(blocks):
        key = (b.tag, b.roles)
        if key not in places:
            places[key] = sum(weight(name, 0.0) for name in place_features(*key))
        scores[k] = places[key] + sum(weight(name, 0.0) for name in text_features(b))
        same[k] = b.parent == before
        before = b.parent
    return [b.text for b in blocks], viterbi(scores, same, model)


def read_pages(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    places: dict = {}
    kind = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_())]))
    for batch in batches:
        found = []
        for html in batch.column("html").to_pylist():
            texts, labels = label_blocks(html or "", model, places)
            found.append([{"text": t, "main": bool(m)} for t, m in zip(texts, labels, strict=True)])
            if len(places) > 1 << 16:
                places.clear()
        columns = [batch.column("page_id"), batch.column("url"), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "blocks"])


def page_blocks(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, blocks``: the leaf blocks of each page's whole html in order, ``(text, main)`` each.

    A null html is empty and has no blocks. Every row gets a row, also those that
    repeat a ``page_id`` or have none; other columns are not read. Markup that is
    cut off or misnested is read as far as it goes; text in no element at all is a
    block like any other. A page is read in one task, in time in proportion to its length.

    The model is a linear-chain conditional random field of two labels, fitted to labelled pages of made-up
    layouts (``layouts``), ``TRAINING_PAGES`` of them. Features are the roles that ancestor tags and their class,
    id and role words name, and the text's length, links and stops; steps between labels
    depend on whether two blocks share their parent. Labels are the best sequence (Viterbi).
    """
    schema = "page_id long, url string, blocks array<struct<text:string,main:boolean>>"
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(partial(read_pages, model=model or default_model()), schema)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: the main blocks of each page joined by an empty line; empty if there are none."""
    text = F.expr(r"array_join(transform(filter(blocks, b -> b.main), b -> b.text), '\n\n')")
    return (
        page_blocks(pages, model)
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

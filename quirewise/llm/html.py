"""Main text of web pages by two passes over their blocks.

The first pass looks at each block alone: its length, its share of stop words and its share of linked text call it good
or bad, or leave it open if it is short or says too little. The second pass lets an open block inherit from the nearest
decided blocks before and after it. What the markup says plainly goes first: blocks in menus, footers, forms, adverts,
comments and the like are bad. An article that holds most of the good text is a hint for open blocks: inside it the
neighbours that count are its own, outside it an open block needs good ones on both sides.

Markup is believed only as far as it goes. A form that holds much text for its fields is no form, a part that is never
closed ends before the first block that reads like an article, and a part named after a place of the layout that holds
most of the good text is not apart. Where no list of stop words fits a page, long blocks of sentences are good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GOOD, BAD, OPEN = "good", "bad", "open"
#: Linked share from which a block is bad, in an article and outside; characters under which a block is short; share of
#: stop words from which a longer one is good.
LINKED_IN_ARTICLE, LINKED, SHORT, STOPS = 0.6, 0.3, 70, 0.25
#: Share of stop words in all long blocks from which the lists fit a page.
FITS = 0.1

RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "canvas"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
FIELDS = {"input", "select", "textarea", "button"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id or role, alone or together with other such words, of what is not the article.
LABELS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice popup promo promotion "
    "related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside such a name, as in "site-footer" or "share-buttons".
BESIDE = set(
    "bar block bottom box button buttons container global header icon icons inner item items left link links list main "
    "message outer overlay page panel primary right secondary section site text top wrapper".split()
)
#: Names of places of the layout, which may be given to what holds the article.
PLACES = set("banner breadcrumb breadcrumbs footer login menu modal nav navbar navigation notice popup search sidebar toolbar widget".split())
#: Characters of text for each field, and once more, from which a form is not taken for one.
FORM_TEXT = 150
#: A whole class, id or role of an article that is not the page's own.
OTHERS = set(
    "ad ads advert advertisement comment comments promo promotion related reply replies sponsor sponsored".split()
)
#: Frequent function words of the languages at hand.
STOP_WORDS = set(
    "the of and to in a is that for it on as with was by are be this from at or an not have but "
    "der die das und ist nicht ein eine zu den von mit auf für im dem sich des auch es an werden aus er "
    "le la les de et est un une des du en que qui dans pour pas au sur par avec ce il plus "
    "el los las y es del que por con para una se al lo como su más o no".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\btype\s*=\s*["']?hidden""", re.I)
_SENTENCE = re.compile(r"[.!?;:…\u3002\uff01\uff1f\uff1b\u0964\u06d4\u061f](?:\s|\W|\Z)|[\u3002\uff01\uff1f]")
#: Scripts that write a word in a character or two.
_DENSE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_WORDS = re.compile(r"[^\W\d_]+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


@dataclass(eq=False)
class Part:
    """An element that its tag or its name sets apart."""

    form: bool
    place: bool
    fields: int = 0
    text: int = 0
    closed: bool = False
    over: bool = False


@dataclass
class Block:
    text: str
    linked: int
    apart: bool
    article: int
    parts: tuple[Part, ...] = ()


def _label(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role sets an element apart, and whether it names no more than a place of the layout.

    A name counts as a whole: "share-buttons" is one, "share-price" and "no-sidebar" are not.
    """
    apart, place = False, True
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            for name in next(filter(None, m.groups()), "").lower().split():
                words = set(re.split(r"[-_]+", name)) - {""}
                if words & LABELS and words <= LABELS | BESIDE:
                    apart, place = True, place and not words & LABELS - PLACES
    return apart, place


def _is_other(attributes: str) -> bool:
    """Whether an article is a comment, an advert or the like by a whole word of its class, id or role."""
    return "=" in attributes and any(
        OTHERS.intersection(next(filter(None, m.groups()), "").lower().split()) for m in _NAMED.finditer(attributes)
    )


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order, with their white space closed up; blocks without text are left out."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    stack: list[tuple[str, Part | None, bool]] = []
    inside: list[Part] = []
    articles = links = 0
    article = 0
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, linked, bool(inside), article if articles else 0, tuple(inside)))
            for part in inside:
                part.text += len(text)
        pieces, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            pieces.append(text)
            if links:
                linked += len("".join(text.split()))

    def leave(depth: int) -> None:
        nonlocal articles, links
        for tag, part, was_article in stack[depth:]:
            if part:
                inside.remove(part)
            articles -= was_article
            links -= tag == "a"
        del stack[depth:]

    at = 0
    while match := _MARKUP.search(html, at):
        add(html[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(match[1] or match[4]), match[3] or match[6] or ""
        if tag in BLOCKS:
            close()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if stack[depth][1]:
                        stack[depth][1].closed = True
                    leave(depth)
                    break
            continue
        if tag in FIELDS and not _HIDDEN.search(attributes):
            for part in inside:
                part.fields += 1
        if tag in RAW:
            if tag in ("svg", "math") and attributes.endswith("/"):
                continue
            end = None if tag in unclosed else _ENDS[tag].search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(html)
            else:
                unclosed.add(tag)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in ("p", "li", "td", "th", "tr", "option", "dt", "dd", "a") and stack and stack[-1][0] == tag:
            leave(len(stack) - 1)
        own = tag in ("article", "main")
        part = None
        if own:
            if tag == "article" and _is_other(attributes):
                part = Part(False, False)
        else:
            named, place = _label(attributes) if tag not in ("body", "html") else (False, False)
            if tag in APART or (tag == "header" and not articles) or named:
                part = Part(tag == "form" and not named, place and tag not in APART and tag != "header")
        is_article = own and not part and not inside
        if is_article and not articles:
            article += 1
        stack.append((tag, part, is_article))
        if part:
            inside.append(part)
        articles += is_article
        links += tag == "a"
    if "<" not in html[at:] or not re.search(r"<[a-zA-Z/!?]", html[at:]):
        add(html[at:])
    close()
    return out


def settle(found: list[Block]) -> bool:
    """Decide which blocks are apart, and return whether the lists of stop words fit the page."""
    alone = [Block(b.text, b.linked, False, b.article) for b in found]
    long = [b for b in alone if _length(b.text) >= SHORT and b.linked <= LINKED * len(b.text)]
    words = [w for b in long for w in _WORDS.findall(b.text.lower())]
    fits = sum(map(STOP_WORDS.__contains__, words)) >= FITS * len(words)
    good = [len(b.text) if first_pass(b, fits) == GOOD else 0 for b in alone]
    total = sum(good)
    held: dict[Part, int] = {}
    for block, size in zip(found, good):
        for part in block.parts:
            held[part] = held.get(part, 0) + size
    for block, size in zip(found, good):
        for part in block.parts:
            if not part.closed and size:
                part.over = True
            if part.form and part.text >= FORM_TEXT * (part.fields + 1) or part.place and 2 * held[part] > total:
                part.over = True
        block.apart = any(not part.over for part in block.parts)
    return fits


def _length(text: str) -> int:
    return len(text) + 2 * len(_DENSE.findall(text))


def first_pass(block: Block, fits: bool = True) -> str:
    """What a block says for itself."""
    if block.apart:
        return BAD
    size = len(block.text.replace(" ", ""))
    if block.linked > (LINKED_IN_ARTICLE if block.article else LINKED) * size:
        return BAD
    length = _length(block.text)
    if not block.article and "\xa9" in block.text and length < 2 * SHORT:
        return BAD
    if length < SHORT:
        return OPEN
    if not fits:
        return GOOD if _SENTENCE.search(block.text) else OPEN
    words = _WORDS.findall(block.text.lower())
    return GOOD if sum(map(STOP_WORDS.__contains__, words)) >= STOPS * len(words) else OPEN


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: good ones, and open ones by their neighbours. An open block in an article takes the
    label of the nearest decided neighbour of the article, of two as near the good one, and is good if there is none. An
    open block outside needs good neighbours only, and if the articles hold most of the good text, one on both sides. On a
    page without a good block all open ones are kept."""
    good = [0, 0]
    for block, label in zip(found, labels):
        good[block.article > 0] += len(block.text) * (label == GOOD)
    if GOOD not in labels:
        return [label == OPEN for label in labels]
    has_article = any(b.article and not b.apart for b in found) and good[1] >= good[0]
    before: list[tuple[str, int] | None] = []
    last: tuple[str, int] | None = None
    for i, (block, label) in enumerate(zip(found, labels)):
        if i and block.article != found[i - 1].article and has_article:
            last = None
        before.append(last)
        if label != OPEN and not (has_article and block.apart):
            last = (label, i)
    after: list[tuple[str, int] | None] = [None] * len(found)
    last = None
    for i in range(len(found) - 1, -1, -1):
        if i + 1 < len(found) and found[i].article != found[i + 1].article and has_article:
            last = None
        after[i] = last
        if labels[i] != OPEN and not (has_article and found[i].apart):
            last = (labels[i], i)
    kept = []
    for i, (block, label) in enumerate(zip(found, labels)):
        if label == OPEN:
            near = [n for n in (before[i], after[i]) if n]
            if block.article:
                label = min(near, key=lambda n: (abs(n[1] - i), n[0] == BAD))[0] if near else GOOD
            else:
                label = GOOD if len(near) > has_article and all(n[0] == GOOD for n in near) else BAD
        kept.append(label == GOOD)
    return kept


def main_text(html: str | None) -> str:
    """Good blocks in page order, an empty line between them; empty for null, for an empty page and if none is good."""
    found = blocks(html or "")
    fits = settle(found)
    kept = second_pass(found, [first_pass(b, fits) for b in found])
    return "\n\n".join(b.text for b, keep in zip(found, kept) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; the whole html is read, other columns are not.

    A null url stays null. Repeated rows give a row each, an empty table none.
    """

    @F.pandas_udf(StringType())
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([main_text(h) for h in html], dtype=object)

    texts = pages.select("page_id", "url", text_of("html").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

"""Main text of pages: what markup alone must not decide, and a plain twin of both passes over random pages."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest

from quirewise.llm import html

STORY = "The quick story of the day is that it was for the people and not by them, as it is to be read in a long paragraph of words. "
IT = "Questo racconto parla di una città lontana dove tutti gli uomini vivono felici insieme alle loro famiglie. "
JA = "これは日本語の記事です。とても長い文章が書かれています。"


def kept(page):
    return html.main_text(page).split("\n\n")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<form action=x><input type=hidden><p>{STORY}</p><p>{STORY * 2}</p><p>Short end.</p></form>", [STORY, STORY * 2, "Short end."]),
        (f"<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><p>{STORY}</p><p>{STORY * 2}</p>", [STORY, STORY * 2]),
        (f"<div class='content no-sidebar'><p>{STORY}</p></div>", [STORY]),
        (f"<div class='widget-area page'><p>{STORY}</p></div>", [STORY]),
        (f"<div class=sidebar><p>{STORY * 3}</p></div><p>Bye</p>", [STORY * 3, "Bye"]),
        (
            f"<article><p>{STORY}</p><p class=share-price>Price: 12</p><ul class=recipe-menu><li>Eggs</ul><p class=ad-free>No ads</p>"
            f"<p class=comment-on-the-law>{STORY}</p><p>{STORY}</p></article>",
            [STORY, "Price: 12", "Eggs", "No ads", STORY, STORY],
        ),
        (f"<div><p>{STORY}</p><p>Long © paragraph. {STORY}</p></div>", [STORY, f"Long © paragraph. {STORY}"]),
        (f"<nav><a href=x>Casa</a></nav><p>{IT * 2}</p><p>{IT}</p>", [IT * 2, IT]),
        (f"<nav><a href=x>ホーム</a></nav><p>{JA * 2}</p><p>短い。</p>", [JA * 2, "短い。"]),
        ("<p>Hello world.</p>", ["Hello world."]),
        ("<nav><a href=x>Home</a></nav><h1>Head</h1><p>One line.</p><footer>© us</footer>", ["Head", "One line."]),
        (f"<form class=login><label>Name</label><input><input type=password><button>In</button></form><p>{STORY}</p>", [STORY]),
        (f"<form><p>Subscribe to our newsletter for the best of the day</p><input name=mail></form><p>{STORY}</p>", [STORY]),
        (f"<article><p>{STORY}</p></article><section class=comments><article><p>{STORY * 9}</p></article></section>", [STORY]),
        (f"<div id=cookie-banner><p>{STORY * 3}</p></div><article><p>{STORY}</p></article>", [STORY]),
        (f"<div class='share-buttons'>Share this</div><p>{STORY}</p><div class=site-footer>{STORY[:60]}</div>", [STORY]),
    ],
)
def test_markup_is_believed_only_as_far_as_it_goes(page, want):
    for whole in (page, f"<html><head><title>t</title></head><body>{page}</body></html>"):
        assert kept(whole) == [w.strip() for w in want]


# A plain twin, for pages in which every element is closed.


class Node:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.items = tag, attributes, parent, []

    def up(self):
        node = self
        while node:
            yield node
            node = node.parent


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.items.append(node)
        if tag not in html.VOID:
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at.parent

    def handle_data(self, data):
        self.at.items.append(data)


def names_apart(node):
    words = [set(re.findall("[a-z]+", name)) for key in ("class", "id", "role") for name in (node.attributes.get(key) or "").lower().split()]
    return [w for w in words if w & html.LABELS and not w - html.LABELS - html.BESIDE]


def twin(page):
    root = Tree(page).root
    rows = [[]]

    def walk(node):
        for item in node.items:
            if isinstance(item, str):
                rows[-1].append((item, node))
            elif item.tag not in html.RAW:
                edge = item.tag in html.BLOCKS
                if edge:
                    rows.append([])
                if item.tag == "br":
                    rows[-1].append((" ", node))
                walk(item)
                if edge:
                    rows.append([])

    walk(root)
    rows = [r for r in rows if "".join(t for t, _ in r).split()]
    texts = [" ".join("".join(t for t, _ in r).split()) for r in rows]

    def main(node):
        return node.tag == "main" or node.tag == "article" and not any(
            set((node.attributes.get(k) or "").lower().split()) & html.OTHERS for k in ("class", "id", "role")
        )

    def apart_by_markup(node):
        if node.tag in ("article", "main"):
            return not main(node)
        in_article = any(main(n) and not any(apart_by_markup(u) for u in n.up() if u is not n) for n in list(node.up())[1:])
        return node.tag in html.APART or node.tag == "header" and not in_article or node.tag != "body" and bool(names_apart(node))

    places = [next(n for t, n in r if t.split()) for r in rows]

    def parts_of(i):
        return [n for n in places[i].up() if apart_by_markup(n)]

    def outermost_article(i):
        own = [n for n in places[i].up() if main(n) and not any(apart_by_markup(u) for u in list(n.up())[1:])]
        return own[-1] if own else None

    articles = [outermost_article(i) for i in range(len(rows))]
    linked = [sum(len("".join(t.split())) for t, n in r if any(u.tag == "a" for u in n.up())) for r in rows]

    def label(i, apart, fits):
        if apart:
            return "bad"
        text, size = texts[i], len(texts[i].replace(" ", ""))
        if linked[i] > (0.6 if articles[i] else 0.3) * size:
            return "bad"
        long = len(text) + 2 * len(html._DENSE.findall(text))
        if not articles[i] and "©" in text and long < 140:
            return "bad"
        if long < 70:
            return "open"
        words = re.findall(r"[^\W\d_]+", text.lower())
        if not fits:
            return "good" if html._SENTENCE.search(text) else "open"
        return "good" if sum(w in html.STOP_WORDS for w in words) >= 0.25 * len(words) else "open"

    long = [i for i, t in enumerate(texts) if len(t) + 2 * len(html._DENSE.findall(t)) >= 70 and linked[i] <= 0.3 * len(t)]
    words = [w for i in long for w in re.findall(r"[^\W\d_]+", texts[i].lower())]
    fits = sum(w in html.STOP_WORDS for w in words) >= 0.1 * len(words)
    size = [len(t) if label(i, False, fits) == "good" else 0 for i, t in enumerate(texts)]

    def void(part):
        inside = [i for i in range(len(rows)) if part in parts_of(i)]
        named = names_apart(part)
        if part.tag == "form" and not named:
            def fields(node):
                return sum((i.tag in html.FIELDS and i.attributes.get("type") != "hidden") + fields(i) for i in node.items if isinstance(i, Node) and i.tag not in html.RAW - html.FIELDS)
            return sum(len(texts[i]) for i in inside) >= 150 * (fields(part) + 1)
        place = part.tag not in html.APART | {"header", "article"} and named and not any(w & (html.LABELS - html.PLACES) for w in named)
        return bool(place) and 2 * sum(size[i] for i in inside) > sum(size)

    apart = [any(not void(p) for p in parts_of(i)) for i in range(len(rows))]
    labels = [label(i, apart[i], fits) for i in range(len(rows))]
    if "good" not in labels:
        return [t for t, mark in zip(texts, labels) if mark == "open"]
    weight = [sum(len(t) for t, a, mark in zip(texts, articles, labels) if (a is not None) == inside and mark == "good") for inside in (False, True)]
    hint = any(a is not None and not x for a, x in zip(articles, apart)) and weight[1] >= weight[0]
    out = []
    for i, mark in enumerate(labels):
        if mark == "open":
            near = []
            for steps in (range(i - 1, -1, -1), range(i + 1, len(labels))):
                for j in steps:
                    if hint and articles[j] is not articles[i]:
                        break
                    if labels[j] != "open" and not (hint and apart[j]):
                        near.append((abs(i - j), labels[j] == "bad"))
                        break
            if articles[i] is not None:
                mark = "bad" if near and min(near)[1] else "good"
            else:
                mark = "good" if len(near) > hint and not any(bad for _, bad in near) else "bad"
        if mark == "good":
            out.append(texts[i])
    return out


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["the", "of", "and", "is", "tree", "night", "x", "&amp;", "caf&eacute;", "12", "river."]) for _ in range(n))

    def piece(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            text = words(rng.choice([1, 3, 8, 30, 60])) + rng.choice(["", ".", " &copy; us"])
            if rng.random() < 0.2:
                text = f"<a href=x>{text}</a> {words(rng.choice([0, 2, 20]))}"
            return f"<p>{text}</p>" if rng.random() < 0.8 else f"<b>{text}</b><br>"
        tag = rng.choice(["div", "div", "section", "article", "nav", "footer", "header", "aside", "form", "ul", "main"])
        mark = rng.choice(["", "", "", " class=sidebar", " class='share-price'", " id=comments", " class='site-footer x'", " class='content no-sidebar'", " role=navigation", " class=comment"])
        field = "<input name=a>" * rng.randrange(0, 3) if tag == "form" else ""
        return f"<{tag}{mark}>{field}" + "".join(piece(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    return "<html><head><title>t</title></head><body>" + "".join(piece(3) for _ in range(rng.randrange(1, 7))) + "</body></html>"


def test_random_pages_against_the_twin():
    rng, different = random.Random(17), set()
    for n in range(1500):
        page = random_page(rng)
        assert kept(page) == (twin(page) or [""]), page
        different.add(html.main_text(page))
    assert len(different) > 1000

from __future__ import annotations

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.functions.patterns import NAMED_PATTERNS
from quirewise.operators import geometry as geo
from quirewise.operators import redact as ops
from quirewise.sources import corpus


def _page(table, *texts):
    return table("doc_pages", *[(1, i, t) for i, t in enumerate(texts, start=1)])


def _span(table, text="abcdef", x=10.0, y=100.0, size=10.0):
    return table("spans", (1, 1, 0, text, x, y, size))


@pytest.mark.parametrize(
    ("area", "want"),
    [
        ((15.0, 100.0, 5.0, 5.0), "a cdef"),  # exactly glyph b
        ((20.0, 100.0, 0.1, 5.0), "ab def"),
        ((0.0, 0.0, 10.0, 500.0), "abcdef"),  # touches the left edge
        ((40.0, 0.0, 10.0, 500.0), "abcdef"),  # touches the right edge
        ((0.0, 110.0, 99.0, 5.0), "abcdef"),  # touches the top
        ((0.0, 90.0, 99.0, 10.0), "abcdef"),  # touches the bottom
        ((0.0, 109.9, 99.0, 5.0), "      "),
        ((14.9, 0.0, 5.2, 500.0), "   def"),
    ],
)
def test_areas_blank_glyphs_they_overlap(table, area, want):
    got = ops.redact_areas(_span(table), table("areas", (1, 1, *area)))
    assert rows(got, "text") == [(want,)]


def test_no_areas_and_areas_elsewhere(table):
    spans = _span(table)
    assert rows(ops.redact_areas(spans, table("areas"))) == rows(spans)
    other = table("areas", (1, 2, 0.0, 0.0, 999.0, 999.0), (2, 1, 0.0, 0.0, 999.0, 999.0))
    assert rows(ops.redact_areas(spans, other)) == rows(spans)
    assert rows(ops.area_errors(other, _page(table, "x")), "doc_id", "page", "error") == [
        (1, 2, "page 2 does not exist"),
        (2, 1, "page 1 does not exist"),
    ]


def test_second_run_on_the_line_is_not_dragged_in(table):
    spans = table("spans", (1, 1, 0, "secret", 10.0, 100.0, 10.0), (1, 1, 1, "public", 60.0, 100.0, 10.0))
    got = ops.redact_areas(spans, table("areas", (1, 1, 0.0, 95.0, 50.0, 20.0)))
    assert rows(got, "span", "text") == [(0, "      "), (1, "public")]


def test_areas_against_glyph_loop(table):
    rng = random.Random(11)
    spans, areas = [], []
    for page in range(1, 5):
        for span in range(12):
            text = "".join(rng.choice("abc dé\U0001f600") for _ in range(rng.randrange(0, 25)))
            spans.append((1, page, span, text, rng.uniform(0, 50), rng.uniform(-60, 800), rng.choice([6.0, 12.0, 40.0])))
        for _ in range(8):
            areas.append((1, page, rng.uniform(-20, 150), rng.uniform(-60, 800), rng.uniform(0, 60), rng.uniform(0, 300)))
    areas.append((1, 1, 5.0, -1e9, 3.0, 2e9))
    want = []
    for doc, page, span, text, x, y, size in spans:
        adv = size * 0.5
        out = ""
        for i, c in enumerate(text):
            hit = any(
                p == page and ax < x + (i + 1) * adv and ax + w > x + i * adv and ay < y + size and ay + h > y
                for _, p, ax, ay, w, h in areas
            )
            out += " " if hit else c
        want.append((page, span, out))
    got = ops.redact_areas(table("spans", *spans), table("areas", *areas))
    assert rows(got, "page", "span", "text") == sorted(want)


def test_ssn_and_matches_across_lines(table):
    page = _page(table, "ssn 123-45-6789 on file\ncall 555\n123-4567 now")
    found = rows(ops.pii_spans(page, ["ssn", "phone_us"]), "pattern", "start", "end", "match")
    assert found == [("phone_us", 29, 41, "555\n123-4567"), ("ssn", 4, 15, "123-45-6789")]
    boxes = ops.match_boxes(ops.pii_spans(page, ["ssn", "phone_us"]), corpus.layout_spans(page, with_offsets=True))
    assert rows(boxes, "pattern", "x", "y", "width", "height") == [
        ("phone_us", 24.0, 732.0, 48.0, 24.0),
        ("ssn", 48.0, 756.0, 66.0, 12.0),
    ]


def test_no_match_across_pages(table):
    assert rows(ops.pii_spans(_page(table, "123-45", "-6789"), ["ssn"])) == []


def test_a_match_without_glyphs_gives_no_box(table):
    page = _page(table, "a\n\nb")
    found = ops.pii_spans(page, ["regex:\\n+"])
    assert found.count() == 1
    assert ops.match_boxes(found, corpus.layout_spans(page, with_offsets=True)).count() == 0


def test_text_inside_the_box_goes_too(table):
    page = _page(table, "call 555\n123-4567 now")
    # The match spans both lines, so its box covers the first eight glyphs of both.
    assert rows(ops.auto_redact(page, ["phone_us"]), "span", "text") == [(0, "        "), (1, "         now")]
    assert rows(ops.pii_mask(page, ["phone_us"]), "text") == [("call " + " " * 12 + " now",)]


def test_one_pass_equals_the_three_steps(table):
    rng = random.Random(4)
    bits = ["a@b.co", "123-45-6789", "555-123-4567", "1" * 16, "word", "\n", "é", " ", "+1 (555) 123-4567", "555\n123-4567"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    page = _page(table, *texts)
    spans = corpus.layout_spans(page, with_offsets=True)
    areas = ops.match_boxes(ops.pii_spans(page, list(NAMED_PATTERNS)), spans)
    steps = ops.redact_areas(spans, areas)
    once = ops.auto_redact(page, list(NAMED_PATTERNS))
    key = ("page", "span", "text")
    assert rows(once, *key) == rows(steps, *key)


def test_mask_against_a_loop(table):
    rng = random.Random(8)
    bits = ["a@b.co", "123-45-6789", "5551234567-123-45-6789", "1" * 20, "word", "\n", "é", " ", "\u0001"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    want = []
    for i, text in enumerate(texts, start=1):
        out = list(text)
        for source in NAMED_PATTERNS.values():
            for m in re.finditer(source, text):
                out[m.start() : m.end()] = " " * (m.end() - m.start())
        want.append((i, "".join(out)))
    assert rows(ops.pii_mask(_page(table, *texts), list(NAMED_PATTERNS)), "page", "text") == want


def test_mask_keeps_missing_text(table):
    assert rows(ops.pii_mask(_page(table, None, ""), ["email"]), "page", "text") == [(1, None), (2, "")]


def test_search(table):
    page = _page(table, "one a.b two a.b", "axb")
    hits = ops.search_text(page, corpus.layout_spans(page, with_offsets=True), "a.b")
    assert rows(hits, "page", "start", "x", "width", "match") == [(1, 4, 48.0, 18.0, "a.b"), (1, 12, 96.0, 18.0, "a.b")]


def test_page_size_walk(table):
    nodes = table(
        "page_nodes",
        (1, -1, None, None, [0.0, 0.0, 100.0, 200.0], None),
        (1, -2, -1, None, None, None),
        (1, -3, -2, None, [1.0, 2.0], None),
        (1, 1, -3, 1, None, None),  # inherited over three levels, past a malformed box
        (1, 2, -1, 2, [10.0, 10.0, 30.0, 50.0], None),
        (1, 3, -3, 3, [0.0, None, 1.0, 1.0], None),
        (2, 1, None, 1, None, None),  # default
        (2, 2, -9, 2, None, None),  # parent does not exist
    )
    want = [(1, 1, 100.0, 200.0), (1, 2, 20.0, 40.0), (1, 3, 100.0, 200.0), (2, 1, 612.0, 792.0), (2, 2, 612.0, 792.0)]
    assert rows(geo.page_size(nodes), "doc_id", "page", "width", "height") == want


def test_deep_page_trees_and_rings(table):
    chain = [(1, -1, None, None, [0.0, 0.0, 7.0, 9.0], None)] + [(1, -i - 1, -i, None, None, None) for i in range(1, 40)]
    ring = [(2, -1, -2, None, None, None), (2, -2, -1, None, None, None)]
    nodes = table("page_nodes", *chain, *ring, (1, 1, -40, 1, None, None), (2, 1, -2, 1, None, None))
    got = rows(geo.page_size(nodes), "doc_id", "page", "width", "height", "error")
    assert got == [(1, 1, 7.0, 9.0, None), (2, 1, None, None, "the page tree has a ring")]


@pytest.mark.parametrize(("old", "angle", "new"), [(None, 90, 90), (90, 450, 180), (0, 450, 90), (90, -180, 270), (270, 90, 0)])
def test_rotate(table, old, angle, new):
    nodes = table("page_nodes", (1, 1, None, 1, None, old))
    assert rows(geo.rotate_pages(nodes, angle), "rotate") == [(new,)]


def test_rotate_refuses_odd_angles(table):
    with pytest.raises(ValueError, match="by quarters"):
        geo.rotate_pages(table("page_nodes"), 45)


def test_scale_and_crop(table):
    nodes = table("page_nodes", (1, 1, None, 1, [0.0, 0.0, 612.0, 792.0], None), (1, 2, None, 2, None, None))
    assert rows(geo.scale_pages(nodes, 0.5, 2), "page", "media_box") == [(1, [0.0, 0.0, 306.0, 1584.0]), (2, None)]
    assert rows(geo.crop_pages(nodes, 1, 2, 3, 4), "page", "crop_box") == [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0])]
    spans = _span(table)
    assert rows(geo.scale_spans(spans, 2, 0.5), "x", "y") == [(20.0, 50.0)]
    seen = lambda *box: geo.crop_visibility(spans, *box).first()["visible"]
    assert seen(0, 0, 500, 500) and seen(39, 109, 500, 500)
    assert not seen(40, 0, 500, 500) and not seen(0, 110, 500, 500)


def test_empty_pattern_list(table):
    page = _page(table, "a@b.co")
    assert rows(ops.pii_mask(page, []), "text") == [("a@b.co",)]
    assert rows(ops.auto_redact(page, []), "text") == [("a@b.co",)]
    with pytest.raises(ValueError):
        ops.pii_spans(page, [])


def test_long_pages_join_by_stretch(table):
    text = "\n".join(f"line {i} a{i}@b.co" for i in range(2000))
    page = _page(table, text)
    boxes = ops.match_boxes(ops.pii_spans(page, ["email"]), corpus.layout_spans(page, with_offsets=True))
    assert boxes.count() == 2000
    assert boxes.agg(F.max("height")).first()[0] == 12.0


def _turned_by_glyph(text, m, size, areas):
    """Every glyph against every area: two convex shapes are apart if the normal of a side parts them."""
    a, b, c, d, e, f = m
    advance, out = size * 0.5, ""
    for i, char in enumerate(text):
        glyph = [(a * u + c * v + e, b * u + d * v + f) for u in (i * advance, (i + 1) * advance) for v in (0.0, size)]
        hit = False
        for x, y, w, h in areas:
            box = [(p, q) for p in (x, x + w) for q in (y, y + h)]
            apart = False
            for n in ((1.0, 0.0), (0.0, 1.0), (-b, a), (-d, c)):
                one, two = ([p * n[0] + q * n[1] for p, q in shape] for shape in (glyph, box))
                apart = apart or max(one) <= min(two) + 1e-9 or max(two) <= min(one) + 1e-9
            hit = hit or not apart
        out += " " if hit else char
    return out


MATRICES = [
    [1.0, 0.0, 0.0, 1.0], [0.6, 0.8, -0.8, 0.6], [0.0, 1.0, -1.0, 0.0], [-1.0, 0.0, 0.0, 1.0], [0.5, -0.5, 0.5, 0.5],
    [2.0, 0.25, -0.5, 0.75], [0.7071, 0.7071, -0.7071, 0.7071], [0.0, -2.0, 0.5, 0.0],
]


def test_turned_runs_glyph_by_glyph(table, spark):
    rng = random.Random(21)
    runs, areas, want = [], [], []
    for page in range(1, 121):
        m = [*MATRICES[page % len(MATRICES)], rng.randrange(100, 300) + 0.5, rng.randrange(200, 500) + 0.25]
        text = "x" * rng.randrange(1, 40)
        own = [(rng.randrange(0, 400) + 0.1, rng.randrange(100, 600) + 0.2, rng.choice([0.5, 20.0, 120.0]), rng.choice([1.0, 30.0])) for _ in range(6)]
        runs.append((1, page, 0, text, 0.0, 0.0, 10.0, m))
        areas += [(1, page, *area) for area in own]
        want.append((page, _turned_by_glyph(text, m, 10.0, own)))
    spans = spark.createDataFrame(runs, "doc_id bigint, page int, span int, text string, x double, y double, font_size double, matrix array<double>")
    got = ops.redact_areas(spans, table("areas", *areas))
    assert rows(got, "page", "text") == sorted(want) and sum("x " in t or " x" in t for _, t in want) > 10
    assert got.columns == spans.columns


def test_turned_edges_and_odd_matrices(table, spark):
    schema = "doc_id bigint, page int, span int, text string, x double, y double, font_size double, matrix array<double>"
    up = [0.0, 1.0, -1.0, 0.0, 100.0, 200.0]  # upwards: glyph i covers x 90 to 100 and y 200 + 5i to 205 + 5i
    runs = [
        (1, 1, 0, "abcd", 0.0, 0.0, 10.0, up), (1, 1, 1, "", 0.0, 0.0, 10.0, up), (1, 1, 2, "flat", 0.0, 0.0, 10.0, [1.0, 0.0, 1.0, 0.0, 92.0, 206.0]),
        (1, 1, 3, "efgh", 92.0, 201.0, 10.0, None), (1, 1, 4, "ijkl", 92.0, 201.0, 10.0, [1.0, None, 0.0, 1.0, 0.0, 0.0]), (1, 1, 5, None, 0.0, 0.0, 10.0, up),
    ]
    spans = spark.createDataFrame(runs, schema)
    blank = lambda *area: [r[1] for r in rows(ops.redact_areas(spans, table("areas", (1, 1, *area))), "span", "text")]
    assert blank(90.0, 205.0, 2.0, 5.0) == ["a cd", "", "flat", "efgh", "ijkl", None]  # the plain runs begin at its right edge
    assert blank(100.0, 205.0, 5.0, 5.0)[0] == "abcd" and blank(80.0, 205.0, 10.0, 5.0)[0] == "abcd"  # touching
    assert blank(95.0, 207.0, 0.0, 0.0)[0] == "a cd"
    assert blank(92.5, 206.0, 1.0, 1.0)[2:5] == ["flat", " fgh", " jkl"]

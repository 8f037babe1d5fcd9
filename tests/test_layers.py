from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.functions import linediff
from quirewise.operators import forms, history, layer
from quirewise.operators.pages import split_at


@pytest.fixture(scope="module")
def tree(table):
    return table(
        "form_nodes",
        (1, 1, None, 1, "group", None, None, None, None),
        (1, 2, 1, 2, "Name", "Tx", "John", None, 1),
        (1, 3, 1, 1, "Twice", "Tx", None, None, 9),
        (1, 4, None, 2, "radio", "Btn", "On", None, 7),
        (1, 5, 4, 1, None, None, None, "Widget", 2),
        (1, 6, 4, 2, "ignored", "Tx", "x", None, 1),  # kid of a field, not a field
        (1, 7, None, 3, "untyped", None, "v", None, 1),
        (1, 8, None, 4, None, "Tx", "nameless", None, 1),
        (1, 9, None, 5, "mixed", "Tx", None, None, 1),
        (1, 10, 9, 2, "widget", None, None, "Widget", 1),
        (1, 11, 9, 1, "Twice", "Ch", 'a,"b"', None, None),  # first kid is no widget: descend
        (1, 12, 77, 1, "orphan", "Tx", "x", None, 1),
        (2, 1, None, 1, "Name", "Tx", "Eve", None, 1),
    )


def test_fields_in_walk_order(table, tree):
    pages = table("doc_id bigint, page bigint", (1, 1), (1, 2), (2, 1))
    got = forms.form_fields(tree, pages).orderBy("doc_id", "walk_key").select("doc_id", "name", "field_type", "value", "page")
    assert [tuple(r) for r in got.collect()] == [
        (1, "Twice", "Tx", None, 0),
        (1, "Name", "Tx", "John", 1),
        (1, "radio", "Btn", "On", 2),
        (1, "Twice", "Ch", 'a,"b"', 0),
        (2, "Name", "Tx", "Eve", 1),
    ]


def test_fill(table, tree):
    updates = table("form_updates", (1, "Twice", "old"), (2, "Twice", "new"), (1, "untyped", "u"), (1, "nobody", "z"))
    got = rows(forms.form_fill(tree, updates), "doc_id", "node_id", "value", "needs_redraw")
    assert got == [
        (1, 2, "John", False), (1, 3, "new", True), (1, 4, "On", False), (1, 7, "u", True), (1, 10, None, False),
        (1, 11, "new", True), (2, 1, "Eve", False),
    ]
    per_doc = table("doc_id bigint, ord bigint, name string, value string", (2, 1, "Name", "Mallory"))
    got = rows(forms.form_fill(tree, per_doc).where("name = 'Name'"), "doc_id", "value")
    assert got == [(1, "John"), (2, "Mallory")]


def test_exports(tree):
    fields = forms.form_fields(tree)
    lines = [r.line for r in forms.form_csv_lines(fields).where("doc_id = 1").orderBy("walk_key").collect()]
    assert lines == ["Name,Type,Value,Page", "Twice,Tx,,9", "Name,Tx,John,1", "radio,Btn,On,2", 'Twice,Ch,"a,""b""",0']
    entries = {r.name: json.loads(r.entry) for r in forms.form_json_entries(fields).where("doc_id = 1").collect()}
    assert entries["Twice"] == {"type": "Ch", "value": 'a,"b"', "page": 0}
    assert set(entries) == {"Twice", "Name", "radio"}


def test_deep_and_cyclic_trees(table):
    chain = [(1, i, i - 1 or None, 1, f"g{i}", "Tx", None, None, 1) for i in range(1, 41)]
    assert rows(forms.form_fields(table("form_nodes", *chain)), "name") == [("g40",)]
    ring = [(1, 1, 2, 1, "a", "Tx", None, None, 1), (1, 2, 1, 1, "b", "Tx", None, None, 1), (1, 3, 1, 2, "c", "Tx", None, None, 1)]
    good = (2, 1, None, 1, "d", "Tx", None, None, 1)
    assert rows(forms.form_fields(table("form_nodes", *ring, good)), "doc_id", "name") == [(2, "d")]


def test_walk_keys_keep_the_order_of_long_numbers(table):
    orders = [-5, 3, 1234567890123, 1234567890129, 10000000000001, 2**62]
    nodes = [(1, i + 1, None, o, f"f{o}", "Tx", None, None, 1) for i, o in enumerate(orders)]
    got = forms.form_fields(table("form_nodes", *nodes)).orderBy("walk_key").collect()
    assert [r.name for r in got] == [f"f{o}" for o in sorted(orders)]


def _mark(ord_, subtype, rect, appearance):
    return (1, 1, 0, ord_, None, subtype, rect, None, f"m{ord_}", appearance)


def test_flatten(table):
    rect = [100.0, 100.0, 300.0, 120.0]
    marks = table(
        "annotations",
        _mark(1, "Widget", rect, True),
        _mark(2, "Widget", rect, False),
        _mark(3, "Text", rect, True),
        _mark(4, "Widget", None, True),
        _mark(5, None, rect, True),
    )
    spans = table("spans", (1, 1, 0, "body", 24.0, 756.0, 12.0))
    got = forms.form_flatten(marks, spans).orderBy("layer", "seq").select("text", "x", "y", "width", "height")
    assert [tuple(r) for r in got.collect()] == [("m1", 100.0, 100.0, 200.0, 20.0), ("body", 24.0, 756.0, 24.0, 12.0)]
    assert rows(forms.annotations_after_flatten(marks), "ord") == [(2,), (3,), (4,), (5,)]


def test_annotations(table):
    old = table("annotations", _mark(1, "Link", [0.0, 0.0, 1.0, 1.0], False))
    asked = table(
        "doc_id bigint, page bigint, ord bigint, kind string, x0 double, y0 double, x1 double, y1 double, note string",
        (1, 1, 1, "highlight", 1.0, 2.0, 3.0, 4.0, "kept"),
        (1, 1, 2, "note", 1.0, 2.0, 3.0, 4.0, None),
        (1, 9, 3, "note", 1.0, 2.0, 3.0, 4.0, None),
        (1, 1, 4, "circle", 1.0, 2.0, 3.0, 4.0, None),
    )
    pages = table("doc_id bigint, page bigint", (1, 1))
    got = layer.add_annotations(old, asked, pages).orderBy("layer", "ord")
    assert [tuple(r) for r in got.select("subtype", "quad", "contents", "error").collect()] == [
        ("Link", None, "m1", None),
        ("Highlight", [1.0, 4.0, 3.0, 4.0, 1.0, 2.0, 3.0, 2.0], "kept", None),
        ("Text", None, None, None),
        ("Text", None, None, "page 9 does not exist"),
        (None, None, None, "no such kind of mark: circle"),
    ]
    assert layer.subtype_of("strikeout") == "StrikeOut"
    with pytest.raises(ValueError, match="no such kind of mark"):
        layer.subtype_of("circle")


def _word(text, x=100.0, y=100.0, w=200.0, h=40.0):
    return (text, x, y, w, h)


def test_ocr_spans(table):
    sizes = table("doc_id bigint, page bigint, width double, height double", (1, 1, 612.0, 792.0), (1, 2, 612.0, 792.0))
    given = table(
        "ocr_pages",
        (1, 0, 1275.0, 1650.0, [_word(" HELLO "), _word(" \t"), _word("x", w=1e6), _word("abc", w=0.0, h=0.5)]),
        (1, 5, 1275.0, 1650.0, [_word("gone")]),
        (1, 1, 0.0, 1650.0, [_word("gone")]),
        (1, 1, 1275.0, 1650.0, []),
    )
    got = rows(layer.ocr_spans(given, sizes), "word", "text", "x", "y", "font_size", "stretch")
    assert got == [
        (0, "HELLO", 48.0, 724.8, 19.2, 200.0),
        (2, "x", 48.0, 724.8, 19.2, 1000.0),
        (3, "abc", 48.0, 743.76, 1.0, 1.0),
    ]


def test_ocr_boxes_and_text(table):
    def line(text, *points):
        return (text, list(points))

    schema = "doc_id bigint, page_index bigint, lines array<struct<text:string,points:array<struct<x:double,y:double>>>>"
    slanted = line("a", (1.0, 5.0), (11.0, 3.0), (12.0, 9.0), (2.0, 11.0))
    flat = line("b", (1.0, 5.0), (11.0, 5.0), (11.0, 5.0), (1.0, 5.0))
    got = rows(layer.ocr_boxes(table(schema, (1, 0, [slanted, flat, line(" ", *slanted[1])]))), "text", "x", "y", "width", "height")
    assert got == [("a", 1.0, 3.0, 11.0, 8.0)]
    docs = table("doc_id bigint, ocr array<array<string>>", (1, [["", " "], ["a", "b"], ["c", " "]]), (2, [[]]), (3, None))
    assert rows(layer.ocr_text(docs)) == [(1, "a\nb\n\nc"), (2, ""), (3, "")]


def test_compare(table):
    left = table("doc_pages", (1, 1, "same"), (1, 2, "a\nb\nc"), (1, 3, "left only"), (1, 4, "x\ny"))
    right = table("doc_pages", (1, 1, "same"), (1, 2, "a\nB\nc\nd"), (1, 4, "x\ny"), (1, 5, "right only"))
    want = [(1, True, None), (2, False, "-2,+2,+4"), (3, False, None), (4, True, None), (5, False, None)]
    assert rows(layer.compare_pages(left, right), "page", "identical", "diff_lines") == want
    assert rows(layer.compare_pages(left, right, 1), "page", "identical", "diff_lines")[1] == (2, False, "+4")
    with pytest.raises(ValueError):
        layer.compare_pages(left, right, -1)


def test_an_inserted_line_is_one_difference(table):
    lines = [f"line {i}" for i in range(50)]
    left = table("doc_pages", (1, 1, "\n".join(lines)), (1, 2, None), (1, 3, ""), (1, 4, "a"))
    right = table("doc_pages", (1, 1, "\n".join(lines[:7] + ["new"] + lines[7:])), (1, 2, ""), (1, 3, "a"), (1, 4, None))
    got = rows(layer.compare_pages(left, right), "page", "identical", "diff_lines")
    assert got == [(1, False, "+8"), (2, True, None), (3, False, "-1,+1"), (4, False, "-1,+1")]


def _first_shortest(a, b, same):
    """By the full table of common subsequences."""
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if same(a[i], b[j]) else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = []
    while i < n or j < m:
        if i < n and j < m and same(a[i], b[j]):
            i, j = i + 1, j + 1
        elif i < n and (j == m or table[i + 1][j] >= table[i][j + 1]):
            i += 1
            out.append(f"-{i}")
        else:
            j += 1
            out.append(f"+{j}")
    return out


def test_line_scripts_against_the_full_table():
    rng = random.Random(11)
    for _ in range(3000):
        letters = "ab" if rng.random() < 0.5 else "abcdef"
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(2))
        for same in (str.__eq__, lambda x, y: abs(ord(x) - ord(y)) < 2):
            assert linediff.script(a, b, same) == _first_shortest(a, b, same), (a, b)
    long = [str(rng.randrange(40)) for _ in range(3000)]
    assert linediff.script(long, long[:900] + ["x"] + long[901:], str.__eq__) == ["-901", "+901"]


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_near_lines(most):
    rng = random.Random(most)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for k, d in enumerate(y, 1):
                row.append(min(old[k] + 1, row[-1] + 1, old[k - 1] + (c != d)))
        return row[-1]

    for _ in range(400):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(2))
        assert linediff.near(x, y, most) == (distance(x, y) <= most), (x, y)


def test_overlay(table):
    sizes = table(
        "doc_id bigint, page bigint, width double, height double",
        *[(1, p, 600.0, 800.0) for p in (1, 2, 3)], (2, 1, 300.0, 200.0), (2, 2, 0.5, 0.5),
    )
    counts = table("doc_id bigint, n_pages bigint", (1, 3), (2, 2), (3, 0))
    pairs = table("base_id bigint, overlay_id bigint", (1, 2), (2, 1), (1, 3), (3, 2))
    got = layer.overlay_align(pairs, sizes, counts)
    assert rows(got.where("error is null"), "base_id", "page", "overlay_page", "scale", "x", "y") == [
        (1, 1, 1, 2.0, 0.0, 200.0), (1, 2, 2, 600.0, 150.0, 250.0), (1, 3, 2, 600.0, 150.0, 250.0),
        (2, 1, 1, 0.25, 75.0, 0.0), (2, 2, 2, 0.001, 0.063, 0.0),
    ]
    assert rows(got.where("error is not null"), "base_id", "overlay_id", "error") == [
        (1, 3, "no input pages"), (3, 2, "no input pages"),
    ]


def _runs(table, *items):
    day = dt.datetime(2024, 1, 1)
    return table(
        "id bigint, tool_id string, subject_id bigint, status string, started_at timestamp, value double",
        *[(i, tool, who, status, day + dt.timedelta(hours=h), float(h)) for i, tool, who, status, h in items],
    )


def test_history(table):
    runs = _runs(table, (1, "a", 1, "done", 1), (2, "a", 1, "done", 3), (3, "b", 1, "failed", 3), (4, "a", 2, "done", 2))
    assert [r.id for r in history.recent_items(runs, 3).collect()] == [2, 3, 4]
    assert rows(history.recent_per_subject(runs, 2), "subject_id", "rank", "id") == [(1, 1, 2), (1, 2, 3), (2, 1, 4)]
    cutoff = F.lit(dt.datetime(2024, 1, 1, 2))
    assert rows(history.prune_older(runs, cutoff), "id") == [(2,), (3,), (4,)]
    assert rows(history.history_status(runs), "tool_id", "status", "runs") == [("a", "done", 3), ("b", "failed", 1)]
    fresh = _runs(table, (1, "z", 9, "done", 9), (7, "n", 7, "done", 1))
    got = history.upsert_latest(runs, fresh, "id", ["started_at"])
    assert rows(got, "id", "tool_id") == [(1, "z"), (2, "a"), (3, "b"), (4, "a"), (7, "n")]


def test_chain(table):
    pages = table("doc_pages", (1, 1, "a"), (1, 2, "b"), (1, 3, "c"))
    got = history.tool_chain(pages, [("keep", lambda df: df.where("page > 1")), ("split", lambda df: split_at(df, [2]))])
    assert rows(got, "page", "part", "steps") == [(2, 1, ["keep", "split"]), (3, 2, ["keep", "split"])]
    with pytest.raises(ValueError):
        history.tool_chain(pages, [])

from __future__ import annotations

import pytest
from conftest import rows

from quirewise.operators import convert, metadata, protect, sanitize
from quirewise.sources import corpus

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title>'
    '<meta name="author" content="Bob &lt;b&gt;"><script>var t="</p>";</script></head>'
    '<body onload="go()"><p onclick=\'x\' class="k" onmouseover=y>one on = two</p><a href="/x">link <b>text</b></a>'
    '<iframe src="u">f</iframe><object>o</object><embed src="e"><img src="i" width="3" height="4" bpc="8" '
    'colorspace="DeviceRGB" filter="FlateDecode" predictor="15"><img colorspace="[x y]"></body></html>'
)


@pytest.fixture(scope="module")
def page(table):
    return table("page_id bigint, url string, html string", (1, "u", PAGE))


def _html(df):
    return df.first()["html"]


def test_flags_are_independent(page):
    none = _html(sanitize.sanitize(page))
    assert none == PAGE
    scripts = _html(sanitize.sanitize(page, scripts=True))
    assert "<script" not in scripts and "onload" not in scripts and "onclick" not in scripts
    assert "onmouseover" not in scripts and "one on = two" in scripts and 'class="k"' in scripts
    assert "<iframe" in scripts and "<a href" in scripts and "<title" in scripts
    embedded = _html(sanitize.sanitize(page, embedded=True))
    assert "<iframe" not in embedded and "<object" not in embedded and "<embed" not in embedded
    assert "<script" in embedded and "onload" in embedded
    meta = _html(sanitize.sanitize(page, metadata=True))
    assert "<title" not in meta and "<meta" not in meta and "<a href" in meta
    links = _html(sanitize.sanitize(page, links=True))
    assert "<a " not in links and "</a>" not in links and "link <b>text</b>" in links and "<title" in links


def test_sanitize_holds(table):
    given = {
        "<svg/onload=x()>": "<svg>",
        '<img alt="a>b" onerror="x">t': '<img alt="a>b">t',
        "a<script>x": "a",
        "a<script>x</script >b": "ab",
        '<a href="javascript:x(1)">l</a>': '<a href="">l</a>',
        '<p title=" onclick=1" class="k"onclick=2>on = y</p>': '<p title=" onclick=1" class="k">on = y</p>',
        "<p>onclick=1 stays</p>": "<p>onclick=1 stays</p>",
    }
    pages = table("page_id bigint, html string", *enumerate(given))
    got = {r.page_id: r.html for r in sanitize.sanitize(pages, scripts=True).collect()}
    assert [got[i] for i in range(len(given))] == list(given.values())
    assert [r.handlers for r in sanitize.sanitize_report(pages).orderBy("page_id").collect()] == [1, 1, 0, 0, 0, 1, 0]


def test_metadata_in_any_order_and_quotes(table):
    html = "<script>'<title>no</title>'</script><title>T</title><meta content='Bob &amp; Al' name=Author><META name='keywords' content=\"k>1\">"
    row = metadata.metadata_extract(table("page_id bigint, html string", (1, html))).first()
    assert (row.title, row.author, row.keywords, row.subject) == ("T", "Bob & Al", "k>1", None)


def test_renamed_files_differ(table):
    same = ("x", "a", "d")
    records = table("doc_id bigint, title string, author string, creation_date string", (1, *same), (2, *same), (3, "x", "a", "d (2)"))
    names = [r.file_name for r in metadata.auto_rename(records).collect()]
    assert len(set(names)) == 3


def test_report_counts(page):
    assert rows(sanitize.sanitize_report(page)) == [(1, 1, 3, 3, 3, 1)]
    clean = sanitize.sanitize(page, True, True, True, True)
    assert rows(sanitize.sanitize_report(clean)) == [(1, 0, 0, 0, 0, 0)]


def test_link_annotations_keep_others_and_untyped(table):
    marks = table("doc_id bigint, subtype string", (1, "Link"), (1, "Text"), (1, None))
    assert rows(sanitize.strip_link_annotations(marks), "subtype") == [("Text",), (None,)]


def _secrets(table, *rows_):
    return table("doc_id bigint, user_password string, owner_password string", *rows_)


def test_protect_round_trip(table):
    docs = table("doc_id bigint, text string", (1, "one é"), (2, "two"), (3, "three"))
    locked = protect.protect(docs, _secrets(table, (1, "u1", None), (2, "u2", "o2")))
    assert rows(locked, "doc_id", "text") == [(1, None), (2, None), (3, "three")]

    def open_with(*pairs):
        tried = table("doc_id bigint, password string", *pairs)
        return rows(protect.unprotect(locked, tried), "doc_id", "text", "error")

    plain = (3, "three", None)
    assert open_with((1, "u1"), (2, "u2")) == [(1, "one é", None), (2, "two", None), plain]
    assert open_with((1, "u1"), (2, "o2"), (3, "any")) == [(1, "one é", None), (2, "two", None), plain]
    assert open_with((1, "o2")) == [(1, None, "wrong password"), (2, None, "wrong password"), plain]
    again = protect.protect(locked.drop("error"), _secrets(table, (1, "x", None)))
    assert rows(again.where("doc_id < 3"), "doc_id", "error") == [(1, "document is already protected"), (2, None)]
    assert rows(protect.unprotect(again, table("doc_id bigint, password string", (1, "u1"))), "doc_id", "text")[0] == (1, "one é")


def test_tampering_fails_verification(table):
    docs = table("doc_id bigint, text string", (1, "a"), (2, "b"), (4, None))
    manifest = protect.digest_manifest(docs).union(table("doc_id bigint, digest string", (9, "x")))
    later = table("doc_id bigint, text string", (1, "a"), (2, "b "), (3, "new"), (4, ""))
    assert rows(protect.verify_manifest(manifest, later)) == [
        (1, "valid"), (2, "tampered"), (3, "unsigned"), (4, "valid"), (9, "missing"),
    ]


def test_certify_once(table):
    docs = table("doc_id bigint, text string", (1, "a"), (2, "b"))
    signed = protect.digest_manifest(docs.where("doc_id = 2"))
    asked = table(
        "doc_id bigint, ord bigint, permission bigint", (1, 1, 0), (1, 2, 3), (1, 3, 1), (2, 1, 2), (5, 1, 1)
    )
    got = rows(protect.certify(asked, signed, docs), "doc_id", "ord", "error")
    assert got == [
        (1, 1, "permission 0 is not 1, 2 or 3"),
        (1, 2, None),
        (1, 3, "document is already signed"),
        (2, 1, "document is already signed"),
        (5, 1, "document does not exist"),
    ]


def test_metadata_extract(page, table):
    got = metadata.metadata_extract(page).first()
    assert (got.title, got.author, got.subject, got.mod_date) == ("T & t", "Bob <b>", None, None)
    bare = table("page_id bigint, html string", (1, "<p>x</p>"))
    assert list(metadata.metadata_extract(bare).first())[1:] == [None] * 8


def test_metadata_edit(table):
    meta = table("doc_meta", (1, "Original Title", "Alice", None, None, None, None, "D:1", None))
    patch = table(
        "meta_patch",
        (1, 1, "First", None, None, None, None, None),
        (1, 2, "", None, "S", None, None, None),
        (2, 1, None, None, None, "k", None, None),
    )
    assert rows(metadata.metadata_edit(meta, patch), "doc_id", "title", "author", "subject", "keywords", "creation_date") == [
        (1, "", "Alice", "S", None, "D:1"),
        (2, None, None, None, "k", None),
    ]


def test_auto_rename(table):
    records = table(
        "doc_id bigint, title string, author string, creation_date string",
        (1, "a/b", "x", None), (2, "a/b", "x", None), (3, "a/b", None, "2020"), (90_000, "a:b", "x", None),
    )
    assert rows(metadata.auto_rename(records), "doc_id", "file_name") == [
        (1, "a_b - x - unknown.pdf"),
        (2, "a_b - x - unknown (2).pdf"),
        (3, "a_b - unknown - 2020.pdf"),
        (90_000, "a_b - x - unknown (3).pdf"),
    ]


def test_inventory_lines(page):
    lines = rows(metadata.resource_inventory(corpus.resources(page).where("kind = 'img'")), "idx", "line")
    assert lines[0][1].startswith("3x4 bpc=8 colorspace=DeviceRGB filter=FlateDecode predictor=true bytes=")
    assert lines[1][1].startswith("-1x-1 bpc=-1 colorspace=(none/indexed-array) filter=(none, raw) predictor=false bytes=")


def test_skipped_resources_take_no_number(page):
    got = rows(metadata.extract_resources(page), "item", "kind", "body")
    assert [g[0] for g in got] == list(range(len(got)))
    assert ("script" in {g[1] for g in got}) and ("img" not in {g[1] for g in got})
    summary = rows(metadata.resource_summary(corpus.resources(page)).where("kind = 'img'"), "items")
    assert summary == [(2,)]


def _errors(table, html, standard="basic"):
    df = table("page_id bigint, html string", (1, html))
    return metadata.conformance_validate(df, standard).first()


def test_conformance(table):
    assert _errors(table, PAGE).valid and _errors(table, PAGE, "strict").errors == ["document holds scripts"]
    assert _errors(table, "<p>x").errors == ["missing doctype", "document has no root element"]
    got = _errors(table, "<html><style>p{font-family: A} b{font-family:A} i{font-family: ;} s{font-family:serif}"
                         "@font-face{src:x; font-family: B} u{font-family:B; x:y}</style><title> </title>")  # fmt: skip
    assert got.errors == [
        "missing doctype", "missing charset declaration", "missing document language", "missing title",
        "font 'A' is not embedded", "font '(unknown)' is not embedded",
    ]
    with pytest.raises(ValueError, match="unsupported standard"):
        _errors(table, "", "9z")


def test_conformance_fix_adds_only_what_is_missing(table):
    for html in ("<html><p>x</p></html>", "<HTML><HEAD></HEAD></HTML>", PAGE):
        df = table("page_id bigint, html string, cipher binary", (1, html, None))
        fixed = metadata.conformance_fix(df, "basic")
        assert metadata.conformance_validate(fixed, "basic").first().valid, html
        assert metadata.conformance_fix(fixed, "basic").first().html == fixed.first().html
    assert metadata.conformance_fix(df, "basic").first().html == PAGE
    locked = table("page_id bigint, html string, cipher binary", (1, "<p>", b"x"))
    got = metadata.conformance_fix(locked, "basic").first()
    assert got.html == "<p>" and got.error == "cannot convert an encrypted document"


def test_fit_budget(table):
    sizes = table("candidates", (1, 1, 90), (1, 2, 50), (1, 3, 60), (2, 1, 99), (2, 9, 98))
    assert rows(metadata.fit_budget(sizes, 60)) == [(1, 2), (2, 9)]
    docs = table("doc_id bigint, text string", (1, "é" * 100), (2, "a"), (3, None))
    got = rows(metadata.fit_text_budget(docs, 150), "doc_id", "level", "scale", "bytes")
    assert got == [(1, 5, 73, 146), (2, 1, 100, 1), (3, 1, 100, 0)]
    assert rows(metadata.fit_text_budget(docs, 10), "doc_id", "level", "bytes")[0] == (1, 9, 90)


def test_convert(table):
    docs = table("doc_id bigint, text string", (1, "Hi & <there>\n\n\n\n2"), (2, None))
    xml = rows(convert.to_xml(docs), "xml")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<document>\n'
    assert (head + '  <page number="1">Hi &amp; &lt;there&gt;\n\n\n</page>\n  <page number="2">2</page>\n</document>\n',) in xml
    assert (head + "</document>\n",) in xml
    html = rows(convert.to_html(docs.where("doc_id = 1")), "html")[0][0]
    assert '<section id="page-2"><pre>2</pre></section>\n' in html
    for fmt, whole in (("xml", convert.to_xml), ("html", convert.to_html)):
        parts = [r[0] for r in convert.page_fragments(corpus.paginate(docs), fmt).orderBy("page").select("fragment").collect()]
        assert "".join(parts) in whole(docs).where("doc_id = 1").first()[1]


def test_failed_pages_are_marked(table):
    pages = table("doc_id bigint, page bigint, text string, error string", (1, 1, None, "bad font"), (1, 2, None, None))
    got = [r[0] for r in rows(convert.page_fragments(pages, "xml"), "fragment")]
    assert got == [
        '  <page number="1">[text extraction failed: bad font]</page>\n',
        '  <page number="2">[text extraction failed: no text]</page>\n',
    ]


def test_html_to_text(page):
    text = convert.html_to_text(page).first()["text"]
    assert text.startswith("T & t one on = two link text") and "var t" not in text

"""Text conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.text import escape_markup, unescape_entities
from quirewise.sources.corpus import page_texts

# The frames of the two formats.
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<document>\n'
XML_TAIL = "</document>\n"
HTML_HEAD = '<!doctype html>\n<html><head><meta charset="utf-8"></head><body>\n'
HTML_TAIL = "</body></html>\n"


def _body(text: Column, error: Column | None = None) -> Column:
    reason = F.coalesce(error, F.lit("no text")) if error is not None else F.lit("no text")
    failed = F.concat(F.lit("[text extraction failed: "), reason, F.lit("]"))
    return escape_markup(F.coalesce(text, failed))


def _xml_page(number: Column, text: Column) -> Column:
    return F.concat(F.lit('  <page number="'), number, F.lit('">'), text, F.lit("</page>\n"))


def _html_page(number: Column, text: Column) -> Column:
    return F.concat(F.lit('<section id="page-'), number, F.lit('"><pre>'), text, F.lit("</pre></section>\n"))


_FORMATS = {
    "xml": (XML_HEAD, _xml_page, XML_TAIL),
    "html": (HTML_HEAD, _html_page, HTML_TAIL),
}


def _convert(documents: DataFrame, fmt: str) -> DataFrame:
    head, page, tail = _FORMATS[fmt]
    pages = F.transform(
        F.coalesce(page_texts(F.col("text")), F.array().cast("array<string>")),
        lambda text, i: page(i + 1, _body(text)),
    )
    return documents.select("doc_id", F.concat(F.lit(head), F.array_join(pages, ""), F.lit(tail)).alias(fmt))


def to_xml(documents: DataFrame) -> DataFrame:
    """One XML text per document, made inside its row."""
    return _convert(documents, "xml")


def to_html(documents: DataFrame) -> DataFrame:
    """One HTML text per document, made inside its row."""
    return _convert(documents, "html")


def page_fragments(doc_pages: DataFrame, fmt: str) -> DataFrame:
    """The converted text of a page table as rows ``(doc_id, page, fragment)``, without gathering a document.

    Fragments of a document in page order, between the head and the tail of the format, are its converted text.
    A page may carry an ``error``, which takes the place of its text.
    """
    _, page, _ = _FORMATS[fmt]
    error = F.col("error") if "error" in doc_pages.columns else None
    return doc_pages.select("doc_id", "page", page(F.col("page"), _body(F.col("text"), error)).alias("fragment"))


def html_to_text(pages: DataFrame) -> DataFrame:
    """Plain text of web pages: scripts, styles, comments and tags go, entities are undone, blanks collapse."""
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = F.trim(F.regexp_replace(unescape_entities(text), r"[ \t\r\n]+", " "))
    return pages.select("page_id", text.alias("text"))

"""Strip active and hidden content; every class of content has its own flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each class of content looks like in a web page.
TAG = r"""<[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
SCRIPTS = r"""(?is)<script\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</script\b[^>]*>|\z)"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>]+)"""
# A handler follows a blank, a slash or the end of a value; quoted values are stepped over.
HANDLERS = rf"""(?is)("[^"]*"|'[^']*')|[\s/]*(?<=[\s/"'])on[a-z]+\s*=\s*{_VALUE}"""
IS_HANDLER = r"(?is)^[\s/]*on[a-z]+\s*="
TARGETS = r"""(?is)\b(href|src|action|formaction)\s*=\s*(?:"\s*javascript:[^"]*"|'\s*javascript:[^']*'|javascript:[^\s>]*)"""
ACTIVE = r"(?i)on[a-z]+\s*=|javascript:"
EMBEDDED = r"(?is)<iframe\b.*?</iframe>|<object\b.*?</object>|<embed\b[^>]*>"
HEAD_DATA = r"(?is)<title\b.*?</title>|<meta\b[^>]*>"
LINK_TAGS = r"(?is)<a\b[^>]*>|</a>"
LINKS = r"(?is)<a\b[^>]*>"


def sanitize(
    pages: DataFrame,
    scripts: bool = False,
    embedded: bool = False,
    metadata: bool = False,
    links: bool = False,
    column: str = "html",
) -> DataFrame:
    """Remove the chosen classes from web pages. Scripts go first, as their strings may hold markup."""
    html = F.col(column)
    if scripts:
        html = _strip_handlers(F.regexp_replace(html, SCRIPTS, ""))
    if embedded:
        html = F.regexp_replace(html, EMBEDDED, "")
    if metadata:
        html = F.regexp_replace(html, HEAD_DATA, "")
    if links:
        html = F.regexp_replace(html, LINK_TAGS, "")
    return pages.withColumn(column, html)


def _strip_handlers(html: Column) -> Column:
    """Drop handler attributes and script targets: cut out the tags, clean each, put the pieces together again."""
    gaps = F.split(html, TAG, -1)
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    cleaned = F.transform(
        tags, lambda t: F.regexp_replace(F.regexp_replace(t, HANDLERS, "$1"), TARGETS, '$1=""')
    )
    pieces = F.zip_with(gaps, cleaned, lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return F.when(html.rlike(ACTIVE), F.array_join(pieces, "")).otherwise(html)


def strip_link_annotations(annotations: DataFrame) -> DataFrame:
    """Drop link annotations; annotations without a subtype stay."""
    return annotations.where(~F.coalesce(F.col("subtype") == "Link", F.lit(False)))


def sanitize_report(pages: DataFrame, column: str = "html") -> DataFrame:
    """How many items of each class a page holds; handlers are counted outside scripts."""
    bare = F.regexp_replace(column, SCRIPTS, "")
    tags = F.regexp_extract_all(bare, F.lit(TAG), F.lit(0))
    found = F.flatten(F.transform(tags, lambda tag: F.regexp_extract_all(tag, F.lit(HANDLERS), F.lit(0))))
    handlers = F.size(F.filter(found, lambda part: part.rlike(IS_HANDLER))).cast("bigint")

    def count(pattern: str) -> Column:
        return F.regexp_count(F.col(column), F.lit(pattern)).cast("bigint")

    return pages.select(
        "page_id",
        count(SCRIPTS).alias("scripts"),
        F.when(bare.rlike(ACTIVE), handlers).otherwise(F.lit(0).cast("bigint")).alias("handlers"),
        count(EMBEDDED).alias("embedded"),
        count(HEAD_DATA).alias("metadata"),
        count(LINKS).alias("links"),
    )

"""Metadata, inventory, conformance, budgets and text conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.operators import convert as conv
from quirewise.operators import metadata as ops
from quirewise.operators.pages import page_count
from quirewise.operators.sanitize import sanitize
from quirewise.plans.tables import META, PAGES, RESOURCES, Tables, query, unescape_sql, with_

TARGET = 1500


def _patch(t: Tables) -> DataFrame:
    """Two patches per document: an early full one, then one that leaves fields alone or empties them."""
    null = F.lit(None).cast("string")

    def patch(order: int, title, author, subject):
        return F.struct(
            F.lit(order).cast("bigint").alias("ord"),
            title.alias("title"),
            author.alias("author"),
            subject.alias("subject"),
            null.alias("keywords"),
            F.lit(None).cast("string").alias("creator"),
            F.concat(F.lit("batch "), F.lit(order)).alias("producer"),
        )

    both = F.array(
        patch(1, null, F.col("source"), F.col("lang")),
        patch(2, F.when(F.col("lang") == "de", F.col("source")), null, F.when(F.col("source") == "src1", F.lit(""))),
    )
    return t.documents.select("doc_id", F.explode(both).alias("_p")).select("doc_id", "_p.*")


def _rename_input(t: Tables) -> DataFrame:
    """Titles with characters that file names refuse, and many collisions."""
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("report: "), F.col("lang")).alias("title"),
        F.when(F.col("source") != "src7", F.col("source")).alias("author"),
        F.lit(None).cast("string").alias("creation_date"),
    )


def _bare(t: Tables) -> DataFrame:
    """Web pages without their head data."""
    return sanitize(t.pages, metadata=True)


def _validated(pages: DataFrame, standard: str) -> DataFrame:
    return ops.conformance_validate(pages, standard).select(
        "page_id", F.array_join("errors", "; ").alias("errors"), "valid"
    )


QUERIES = {
    "metadata_extract": query(lambda t: t.doc_meta),
    "metadata_edit": query(lambda t: ops.metadata_edit(t.doc_meta, _patch(t))),
    "doc_info": query(lambda t: ops.doc_info(t.documents, page_count(t.documents), t.doc_meta)),
    "auto_rename": query(lambda t: ops.auto_rename(_rename_input(t)).select("doc_id", "file_name")),
    "resource_inventory": query(lambda t: ops.resource_inventory(t.resources)),
    "extract_resources": query(lambda t: ops.extract_resources(t.pages)),
    "resource_summary": query(lambda t: ops.resource_summary(t.resources)),
    "conformance_validate": query(lambda t: _validated(t.pages, "strict")),
    "conformance_fix": query(
        lambda t: ops.conformance_fix(_bare(t), "basic").select("page_id", "html", "error")
    ),
    "conformance_after_fix": query(lambda t: _validated(ops.conformance_fix(_bare(t), "basic"), "basic")),
    "fit_budget": query(lambda t: ops.fit_text_budget(t.documents, TARGET)),
    "to_xml": query(lambda t: conv.to_xml(t.documents)),
    "to_html": query(lambda t: conv.to_html(t.documents)),
    "page_fragments": query(lambda t: conv.page_fragments(t.doc_pages, "xml")),
    "extract_text": query(lambda t: conv.html_to_text(t.pages)),
}

_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BARE = r"regexp_replace(html, '(?is)<title\b.*?</title>|<meta\b[^>]*>', '', 'g')"
_BODY = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"
_SHOWN = unescape_sql(rf"regexp_replace({_BODY}, '(?s)<[^>]*>', ' ', 'g')")


def _converted(fmt: str, head: str, page: str, tail: str) -> str:
    return (
        with_(PAGES)
        + f"""SELECT d.doc_id, {head} || coalesce(body, '') || {tail} AS {fmt} FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg({page}, '' ORDER BY page) AS body FROM doc_pages GROUP BY ALL) USING (doc_id)"""
    )


_XML_PAGE = f"""'  <page number="' || page || '">' || {_ESCAPED} || '</page>' || chr(10)"""

ORACLES = {
    "metadata_extract": with_(META) + "SELECT * FROM doc_meta",
    "metadata_edit": with_(META)
    + """SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN source END, title) AS title, coalesce(source, author) AS author,
  CASE WHEN source = 'src1' THEN '' ELSE coalesce(lang, subject) END AS subject, keywords, creator,
  CASE WHEN d.doc_id IS NOT NULL THEN 'batch 2' ELSE producer END AS producer, creation_date, mod_date
FROM doc_meta m FULL JOIN documents d USING (doc_id)""",
    "doc_info": with_(PAGES, META)
    + """SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, coalesce(n_pages, 0) AS n_pages, title, author,
  creation_date, mod_date FROM documents LEFT JOIN page_totals USING (doc_id) LEFT JOIN doc_meta USING (doc_id)""",
    "auto_rename": """WITH named AS (
  SELECT doc_id, 'report_ ' || lang || ' - ' || CASE WHEN source <> 'src7' THEN source ELSE 'unknown' END || ' - unknown'
    AS base FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM named)
SELECT doc_id, base || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END || '.pdf' AS file_name FROM numbered""",
    "resource_inventory": with_(RESOURCES)
    + """SELECT page_id, kind, idx, '-1x-1 bpc=-1 colorspace=(none/indexed-array) filter=(none, raw) predictor=false bytes='
  || bytes AS line FROM resources""",
    "extract_resources": with_(RESOURCES)
    + """SELECT page_id, n - 1 AS item, seq, kind, kind || '_' || (n - 1) || '_' || seq AS file_name, body
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS n FROM resources WHERE length(body) > 0)""",
    "resource_summary": with_(RESOURCES)
    + """SELECT kind, count(*) AS items, sum(bytes)::BIGINT AS bytes, max(bytes) AS largest FROM resources GROUP BY kind""",
    "conformance_validate": """WITH checked AS (SELECT page_id, concat_ws('; ',
  CASE WHEN NOT regexp_matches(html, '(?i)^\\s*<!doctype html') THEN 'missing doctype' END,
  CASE WHEN NOT regexp_matches(html, '(?i)<html\\b') THEN 'document has no root element' END,
  CASE WHEN regexp_matches(html, '(?i)<html\\b') AND NOT regexp_matches(html, '(?i)<meta\\s[^>]*charset=')
    THEN 'missing charset declaration' END,
  CASE WHEN regexp_matches(html, '(?i)<html\\b') AND NOT regexp_matches(html, '(?i)<html\\b[^>]*\\blang=')
    THEN 'missing document language' END,
  CASE WHEN regexp_matches(html, '(?i)<html\\b') AND NOT regexp_matches(html, '(?is)<title\\b[^>]*>.*?[^\\s<].*?</title>')
    THEN 'missing title' END,
  CASE WHEN regexp_matches(html, '(?i)<html\\b') AND regexp_matches(html, '(?i)<script\\b') THEN 'document holds scripts' END)
  AS errors FROM pages)
SELECT page_id, errors, errors = '' AS valid FROM checked""",
    "conformance_fix": rf"""SELECT page_id, NULL::VARCHAR AS error, regexp_replace({_BARE}, '(?i)(<head\b[^>]*>)',
  '\1<meta charset="utf-8"><title>untitled</title>', 'g') AS html FROM pages""",
    "conformance_after_fix": "SELECT page_id, '' AS errors, true AS valid FROM pages",
    "fit_budget": f"""WITH tried AS (
  SELECT doc_id, level, round(100 - (level - 1) / 8 * 55)::BIGINT AS scale,
         strlen(substr(text, 1, ceil(length(text) * round(100 - (level - 1) / 8 * 55) / 100)::BIGINT))::BIGINT AS bytes
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), (SELECT unnest(generate_series(1, 9)) AS level)),
best AS (SELECT doc_id, coalesce(min(level) FILTER (bytes <= {TARGET}), 9) AS level FROM tried GROUP BY ALL)
SELECT doc_id, level, scale, bytes FROM tried SEMI JOIN best USING (doc_id, level)""",
    "to_xml": _converted(
        "xml",
        """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<document>' || chr(10)""",
        _XML_PAGE,
        "'</document>' || chr(10)",
    ),
    "to_html": _converted(
        "html",
        """'<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"></head><body>' || chr(10)""",
        f"""'<section id="page-' || page || '"><pre>' || {_ESCAPED} || '</pre></section>' || chr(10)""",
        "'</body></html>' || chr(10)",
    ),
    "page_fragments": with_(PAGES) + f"SELECT doc_id, page, {_XML_PAGE} AS fragment FROM doc_pages",
    "extract_text": rf"""SELECT page_id, trim(regexp_replace({_SHOWN}, '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""",
}

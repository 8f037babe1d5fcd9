"""Forms, annotations, recognised text, comparison and overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.functions.patterns import NAMED_PATTERNS
from quirewise.operators import forms, layer
from quirewise.operators.pages import page_count
from quirewise.operators.redact import pii_mask
from quirewise.plans.redaction import mask_sql
from quirewise.plans.tables import ANNOTATIONS, FORM, PAGES, SIZES, SPANS, Tables, query, with_
from quirewise.sources import corpus
from quirewise.sources.corpus import page_texts
from quirewise.sources.sinks import stage_table

PATTERNS = list(NAMED_PATTERNS)


def _fields(t: Tables) -> DataFrame:
    return forms.form_fields(t.form_nodes, t.doc_pages)


def _updates(t: Tables) -> DataFrame:
    """Several updates per field name; the latest order wins."""
    return t.orders.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("field-"), F.col("o_custkey")).alias("name"),
        F.col("o_orderpriority").alias("value"),
    )


def _requests(t: Tables) -> DataFrame:
    """One mark per document; some kinds are unknown and some pages do not exist."""
    doc = F.col("doc_id")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("highlight", "underline", "strikeout", "note", "circle")]), (doc % 5 + 1).cast("int")
    )
    x = (doc % 100).cast("double")
    return t.documents.select(
        "doc_id",
        (doc % 6 + 1).alias("page"),
        F.lit(1).cast("bigint").alias("ord"),
        kind.alias("kind"),
        x.alias("x0"),
        F.lit(10.0).alias("y0"),
        (x + 50.0).alias("x1"),
        F.lit(22.5).alias("y1"),
        F.when(doc % 2 == 0, F.concat(F.lit("see "), F.col("source"))).alias("note"),
    )


def _annotated(t: Tables) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return layer.add_annotations(t.annotations, _requests(t), t.doc_pages).select(
        "doc_id", "page", "layer", "ord", "subtype", text("rect"), text("quad"), "contents", "error"
    )


def _ocr_documents(t: Tables) -> DataFrame:
    """Recognised lines per page of each document."""
    pages = F.transform(page_texts(F.col("text")), lambda p: F.split(p, "\n"))
    return t.documents.select("doc_id", pages.alias("ocr"))


def _compared(t: Tables) -> DataFrame:
    """All pages against masked ones, some of which have a line more or less; some pages are on one side only."""
    key = F.col("doc_id") + F.col("page")
    masked = pii_mask(t.doc_pages, PATTERNS).select("doc_id", "page", "text")
    longer = F.regexp_replace("text", r"^([^\n]*)", "$1\nput in")
    text = F.when(key % 3 == 0, longer).when(key % 5 == 0, F.regexp_replace("text", r"^[^\n]*\n?", "")).otherwise(F.col("text"))
    edited = masked.where((F.col("doc_id") % 7 != 0) | (F.col("page") != 2)).withColumn("text", text)
    extra = t.documents.where("doc_id % 11 = 0").select("doc_id", F.lit(0).cast("bigint").alias("page"), F.lit("extra").alias("text"))
    return layer.compare_pages(t.doc_pages, edited.unionByName(extra))


def _pairs(t: Tables) -> DataFrame:
    """Every document with the next one as its overlay; the last one has none."""
    return t.documents.select(F.col("doc_id").alias("base_id"), (F.col("doc_id") + 1).alias("overlay_id"))


def _overlaid(t: Tables) -> DataFrame:
    # Sizes serve four times: both sides of the pairs, and the page counts of both.
    sizes = stage_table(t.page_sizes, "page-sizes")
    return layer.overlay_align(_pairs(t), sizes, page_count(t.documents, sizes))


QUERIES = {
    "form_fields": query(_fields),
    "form_fill": query(lambda t: forms.form_fill(t.form_nodes, _updates(t))),
    "form_export_csv": query(lambda t: forms.form_csv_lines(_fields(t))),
    "form_export_json": query(lambda t: forms.form_json_entries(_fields(t))),
    "form_flatten": query(lambda t: forms.form_flatten(t.annotations, t.spans)),
    "annotations_after_flatten": query(
        lambda t: forms.annotations_after_flatten(t.annotations).select("doc_id", "page", "ord", "subtype", "contents")
    ),
    "add_annotations": query(_annotated),
    "ocr_spans": query(lambda t: layer.ocr_spans(corpus.ocr_pages(t.doc_pages), t.page_sizes)),
    "ocr_boxes": query(lambda t: layer.ocr_boxes(corpus.ocr_quads(t.doc_pages))),
    "ocr_text": query(lambda t: layer.ocr_text(_ocr_documents(t))),
    "compare_pages": query(_compared),
    "overlay_align": query(_overlaid),
}

_BLANK = r"regexp_matches(text, '\S')"

ORACLES = {
    "form_fields": with_(PAGES, FORM, recursive=True) + "SELECT * FROM fields",
    "form_fill": with_(
        PAGES,
        FORM,
        "\nlatest AS (SELECT 'field-' || o_custkey AS name, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY ALL)",
        recursive=True,
    )
    + """SELECT doc_id, node_id, walk_key, name, coalesce(v, value) AS value, v IS NOT NULL AS needs_redraw
FROM walk LEFT JOIN latest USING (name) WHERE NOT is_group AND name IS NOT NULL""",
    "form_export_csv": with_(PAGES, FORM, recursive=True)
    + """SELECT DISTINCT doc_id, '' AS walk_key, 'Name,Type,Value,Page' AS line FROM fields
UNION ALL SELECT doc_id, walk_key, name || ',' || field_type || ',' || coalesce(value, '') || ',' || page FROM fields""",
    "form_export_json": with_(PAGES, FORM, recursive=True)
    + """SELECT doc_id, name, '{"type":"' || f.field_type || '","value":"' || coalesce(f.value, '') || '","page":' || f.page
  || '}' AS entry
FROM (SELECT doc_id, name, arg_max({'field_type': field_type, 'value': value, 'page': page}, walk_key) AS f
      FROM fields GROUP BY ALL)""",
    "form_flatten": with_(
        SPANS,
        """
drawn AS (SELECT doc_id, page, 0::BIGINT AS layer, 3::BIGINT AS seq, 'Widget on page ' || page AS text,
  (192 + page)::DOUBLE AS x, 100.0::DOUBLE AS y, 50.0::DOUBLE AS width, 20.0::DOUBLE AS height FROM doc_pages)""",
    )
    + """SELECT * FROM drawn
UNION ALL SELECT doc_id, page, 1, span, text, x, y, length(text) * 6, font_size FROM spans""",
    "annotations_after_flatten": with_(ANNOTATIONS)
    + """SELECT doc_id, page, ord, subtype, contents FROM annotations WHERE NOT (subtype = 'Widget' AND has_appearance)""",
    "add_annotations": with_(
        ANNOTATIONS,
        """
asked AS (
  SELECT doc_id, doc_id % 6 + 1 AS page, ['highlight', 'underline', 'strikeout', 'note', 'circle'][doc_id % 5 + 1] AS kind,
    [NULL, 'Highlight', 'Underline', 'StrikeOut', 'Text', NULL][doc_id % 5 + 2] AS subtype,
    (doc_id % 100)::DOUBLE AS x0, (doc_id % 100 + 50)::DOUBLE AS x1,
    CASE WHEN doc_id % 2 = 0 THEN 'see ' || source END AS note
  FROM documents)""",
    )
    + """SELECT doc_id, page, layer, ord, subtype,
  concat_ws(',', x0::DOUBLE::VARCHAR, '100.0', (x0 + 50)::DOUBLE::VARCHAR, '120.0') AS rect, NULL::VARCHAR AS quad,
  contents, NULL::VARCHAR AS error FROM annotations
UNION ALL
SELECT a.doc_id, a.page, 1, 1, subtype, concat_ws(',', x0::VARCHAR, '10.0', x1::VARCHAR, '22.5'),
  CASE WHEN subtype <> 'Text' THEN concat_ws(',', x0::VARCHAR, '22.5', x1::VARCHAR, '22.5', x0::VARCHAR, '10.0',
    x1::VARCHAR, '10.0') END, note,
  CASE WHEN subtype IS NULL THEN 'no such kind of mark: ' || a.kind
       WHEN p.page IS NULL THEN 'page ' || a.page || ' does not exist' END
FROM asked a LEFT JOIN doc_pages p ON p.doc_id = a.doc_id AND p.page = a.page""",
    "ocr_spans": with_(
        SIZES,
        r"""
words AS (SELECT doc_id, CAST(ln // 4 + 1 AS BIGINT) AS page, ln % 4 AS w, length(line) AS full_len,
  regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS text FROM doc_lines),
scaled AS (SELECT w.*, width / 1275 AS sx, height / 1650 AS sy, height, 25.0::DOUBLE AS h,
  (24 + 12 * w)::DOUBLE * 150 / 72 AS y FROM words w JOIN page_sizes USING (doc_id, page) WHERE text <> '')""",
    )
    + """SELECT doc_id, page, w::BIGINT AS word, text, round(50 * sx, 3) AS x, round(height - (y + h) * sy, 3) AS y,
  round(greatest(h * sy, 1), 3) AS font_size,
  round(greatest(least(full_len * 12.5 * sx / (length(text) * greatest(h * sy, 1) * 0.5) * 100, 1000), 1), 3) AS stretch
FROM scaled""",
    "ocr_boxes": with_(PAGES)
    + f"""SELECT doc_id, ln // 4 AS page_index, ln % 4 AS line, line AS text, 50.0::DOUBLE AS x,
  round((24 + 12 * (ln % 4))::DOUBLE * 150 / 72, 3) AS y, round(length(line) * 12.5, 3)::DOUBLE AS width, 27.0::DOUBLE AS height
FROM doc_lines WHERE {_BLANK.replace('text', 'line')}""",
    "ocr_text": with_(PAGES)
    + rf"""SELECT d.doc_id, regexp_replace(regexp_replace(coalesce(t, ''), '^\s+', ''), '\s+$', '') AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(p, '' ORDER BY page) AS t FROM (
    SELECT doc_id, ln // 4 AS page, coalesce(string_agg(line || chr(10), '' ORDER BY ln)
      FILTER ({_BLANK.replace('text', 'line')}), '') || chr(10) AS p
    FROM doc_lines GROUP BY ALL) GROUP BY ALL) USING (doc_id)""",
    # Rows of the table of longest common subsequences from the last line up, then the walk through them from the first.
    "compare_pages": with_(
        PAGES,
        f"\nmasked AS ({mask_sql('doc_pages')})",
        """
edited AS (
  SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN regexp_replace(text, '^([^\\n]*)', '\\1' || chr(10) || 'put in')
    WHEN (doc_id + page) % 5 = 0 THEN regexp_replace(text, '^[^\\n]*\\n?', '') ELSE text END AS text
  FROM masked WHERE doc_id % 7 <> 0 OR page <> 2
  UNION ALL SELECT doc_id, 0, 'extra' FROM documents WHERE doc_id % 11 = 0),
both_ AS (
  SELECT doc_id, page, coalesce(a.text, '') AS ta, coalesce(b.text, '') AS tb, a.page IS NOT NULL AND b.page IS NOT NULL AS paired
  FROM doc_pages a FULL JOIN edited b USING (doc_id, page)),
changed AS (
  SELECT doc_id, page, string_split(ta, chr(10)) AS la, string_split(tb, chr(10)) AS lb FROM both_ WHERE paired AND ta <> tb),
common AS (
  SELECT doc_id, page, la, lb, len(la) AS i, list_transform(range(len(lb) + 1), lambda j: 0::BIGINT) AS l FROM changed
  UNION ALL
  SELECT doc_id, page, la, lb, i - 1, list_transform(range(1, len(lb) + 2), lambda j: greatest(l[j], coalesce(list_max(
    list_transform(range(j, len(lb) + 1), lambda k: CASE WHEN la[i] = lb[k] THEN l[k + 1] + 1 ELSE 0 END)), 0)))
  FROM common WHERE i > 0),
steps AS (
  SELECT doc_id, page, 1::BIGINT AS i, 1::BIGINT AS j, ''::VARCHAR AS script, false AS done FROM changed
  UNION ALL
  SELECT doc_id, page, i + (step < 2)::INT, j + (step <> 1)::INT,
    script || CASE step WHEN 0 THEN '' WHEN 1 THEN ',-' || i ELSE ',+' || j END,
    i + (step < 2)::INT > n AND j + (step <> 1)::INT > m
  FROM (
    SELECT s.*, len(here.la) AS n, len(here.lb) AS m,
      CASE WHEN s.i <= len(here.la) AND s.j <= len(here.lb) AND here.la[s.i] = here.lb[s.j] THEN 0
           WHEN s.i <= len(here.la) AND (s.j > len(here.lb) OR below.l[s.j] >= here.l[s.j + 1]) THEN 1 ELSE 2 END AS step
    FROM steps s JOIN common here ON here.doc_id = s.doc_id AND here.page = s.page AND here.i = s.i - 1
    LEFT JOIN common below ON below.doc_id = s.doc_id AND below.page = s.page AND below.i = s.i
    WHERE NOT done))""",
        recursive=True,
    )
    + """SELECT b.doc_id, b.page, paired AND ta = tb AS identical, substr(s.script, 2) AS diff_lines
FROM both_ b LEFT JOIN (SELECT * FROM steps WHERE done) s ON s.doc_id = b.doc_id AND s.page = b.page""",
    "overlay_align": with_(
        SIZES,
        """
pairs AS (SELECT b.doc_id AS base_id, b.doc_id + 1 AS overlay_id FROM documents b),
fit AS (
  SELECT p.base_id, b.page, p.overlay_id, o.page AS overlay_page, b.width AS bw, b.height AS bh, o.width AS ow,
         o.height AS oh, least(b.width / greatest(o.width, 1), b.height / greatest(o.height, 1)) AS s
  FROM pairs p JOIN page_sizes b ON b.doc_id = p.base_id JOIN page_totals n ON n.doc_id = p.overlay_id
  JOIN page_sizes o ON o.doc_id = p.overlay_id AND o.page = least(b.page, n.n_pages))""",
    )
    + """SELECT base_id, page, overlay_id, overlay_page, round(s, 3) AS scale, round((bw - ow * s) / 2, 3) AS x,
  round((bh - oh * s) / 2, 3) AS y, NULL::VARCHAR AS error FROM fit
UNION ALL
SELECT base_id, NULL, overlay_id, NULL, NULL, NULL, NULL, 'no input pages' FROM pairs
WHERE base_id NOT IN (SELECT doc_id FROM page_totals) OR overlay_id NOT IN (SELECT doc_id FROM page_totals)""",
}

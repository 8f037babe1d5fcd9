"""Sources, sinks and the page set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.operators import pages as ops
from quirewise.plans.tables import NODES, PAGES, SPANS, SIZES, Tables, query, with_
from quirewise.session import shared_folder
from quirewise.sources.corpus import count_pages
from quirewise.sources.parts import write_parts
from quirewise.sources.sinks import stage_table
from quirewise.sources.tolerant import read_tolerant

CUTS = [2, 5, 5, 0]
SPEC = "1-5,7,10-12"
REMOVED = [2, 4, 4]
EXTRACTED = [3, 1, 1, 99]
PART_BUDGET = 2000
INK = 0.84


def _merge_list(t: Tables) -> DataFrame:
    """Ten documents to a binder, the whole row of them twice."""
    doc = F.col("doc_id")
    place = F.explode(F.array(doc % 10, doc % 10 + 10)).alias("ord")
    return t.documents.select(F.floor(doc / 10).alias("out_id"), place, "doc_id")


def _page_order(counts: DataFrame) -> DataFrame:
    """Reversed pages; one source has a page out of range, one a repeated page, one leaves the last entry out."""
    n, page, source = F.col("n_pages"), F.col("page"), F.col("source")
    faulty = (
        F.when((source == "src1") & (page == 1), n + 5).when((source == "src2") & (page == 1), n).otherwise(page)
    )
    numbers = F.sequence(F.when(source == "src3", 2).otherwise(1).cast("bigint"), n)
    pages = counts.withColumn("page", F.explode(F.when(n >= F.when(source == "src3", 2).otherwise(1), numbers)))
    return pages.select("doc_id", (n + 1 - page).alias("new_page"), faulty.alias("page"))


def _reordered(t: Tables) -> DataFrame:
    # Counts serve the order and its checks, so that the text is read for counting only once.
    counts = stage_table(
        t.documents.select("doc_id", "source", count_pages(F.col("text")).alias("n_pages")), "page-counts"
    )
    moved = ops.reorder_pages(t.doc_pages, _page_order(counts), counts.select("doc_id", "n_pages"))
    return moved.select("doc_id", "new_page", "page", "text", "error")


def _parts(t: Tables) -> DataFrame:
    parted = ops.split_at(t.doc_pages, CUTS).select("doc_id", "part", "page", "text")
    manifest = write_parts(parted, f"{shared_folder(t.spark)}/parts-{uuid.uuid4().hex}")
    # Which task wrote a file depends on the cluster, its name does not.
    return manifest.withColumns({c: F.substring_index(c, "/", -1) for c in ("first_file", "last_file")})


QUERIES = {
    "read_corpus": query(
        lambda t: t.documents.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("length"))
    ),
    "read_tolerant": query(
        lambda t: read_tolerant(t.spark, t.root, "documents").select(
            "doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("length"), "error"
        )
    ),
    "paginate": query(lambda t: t.doc_pages),
    "layout_spans": query(lambda t: t.spans),
    "write_parts": query(_parts),
    "page_count": query(lambda t: ops.page_count(t.documents)),
    "merge_docs": query(
        lambda t: ops.merge_docs(_merge_list(t), ops.page_count(t.documents), t.doc_pages).select(
            "out_id", "out_page", "doc_id", "page", "text"
        )
    ),
    "split_at": query(lambda t: ops.split_at(t.doc_pages, CUTS).select("doc_id", "page", "part")),
    "split_manifest": query(lambda t: ops.split_manifest(t.documents, CUTS)),
    "split_ranges": query(lambda t: ops.split_ranges(t.doc_pages, SPEC).select("doc_id", "page", "part")),
    "split_every": query(lambda t: ops.split_ranges(t.doc_pages, "every:3").select("doc_id", "page", "part")),
    "split_by_size": query(lambda t: ops.split_by_size(t.documents, PART_BUDGET)),
    "remove_pages": query(
        lambda t: ops.remove_pages(t.doc_pages, REMOVED).select("doc_id", "page", "source_page", "text")
    ),
    "extract_pages": query(
        lambda t: ops.extract_pages(t.doc_pages, EXTRACTED).select("doc_id", "page", "source_page", "text")
    ),
    "reorder_pages": query(_reordered),
    "dup_pages": query(lambda t: ops.dup_pages(t.doc_pages)),
    "dup_pages_corpus": query(lambda t: ops.dup_pages(t.doc_pages, "corpus")),
    "drop_dup_pages": query(
        lambda t: ops.drop_dup_pages(t.doc_pages).select("doc_id", "page", "source_page", "text")
    ),
    "drop_dup_pages_corpus": query(
        lambda t: ops.drop_dup_pages(t.doc_pages, "corpus").select("doc_id", "page", "source_page", "text")
    ),
    "blank_pages": query(
        lambda t: ops.blank_pages(t.doc_pages, INK).select("doc_id", "page", F.round("ink", 6).alias("ink"))
    ),
    "remove_blank_pages": query(
        lambda t: ops.remove_blank_pages(t.doc_pages, INK).select("doc_id", "page", "source_page")
    ),
    "n_up": query(lambda t: ops.n_up(t.page_nodes, 4)),
    "page_labels": query(
        lambda t: ops.page_labels(t.doc_pages, t.page_sizes, "top-right", "Page {n} of {total}", 3, 10.0)
    ),
}

_FIRST = "SELECT doc_id, min(page) AS page FROM doc_pages GROUP BY doc_id, sha256(coalesce(text, ''))"
_FIRST_CORPUS = """SELECT (k).doc_id AS doc_id, (k).page AS page FROM (
  SELECT min({'doc_id': doc_id, 'page': page}) AS k FROM doc_pages GROUP BY sha256(coalesce(text, '')))"""


def _kept(condition: str) -> str:
    return (
        with_(PAGES)
        + f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page, page AS source_page, text
FROM doc_pages WHERE {condition}"""
    )


_INK = r"length(regexp_replace(text, '\s', '', 'g'))::DOUBLE / greatest(length(text), 1)"

ORACLES = {
    "read_corpus": "SELECT doc_id, lang, source, n_chars, length(text) AS length FROM documents",
    "read_tolerant": "SELECT doc_id, lang, source, n_chars, length(text) AS length, NULL::VARCHAR AS error FROM documents",
    "paginate": with_(PAGES) + "SELECT p.*, n_pages FROM doc_pages p JOIN page_totals USING (doc_id)",
    "layout_spans": with_(SPANS) + "SELECT * FROM spans",
    "write_parts": with_(PAGES)
    + """SELECT doc_id, part, pages, first_page, last_page, name || first || '.parquet' AS first_file, name || last || '.parquet' AS last_file
FROM (SELECT doc_id, part, count(*) AS pages, min(page) AS first_page, max(page) AS last_page, doc_id || '-' || part AS name,
        CASE WHEN min(page) >= 100000 THEN '-' || min(page) // 100000 ELSE '' END AS first,
        CASE WHEN max(page) >= 100000 THEN '-' || max(page) // 100000 ELSE '' END AS last
      FROM (SELECT *, 1 + (page > 2)::BIGINT + (page > 5)::BIGINT AS part FROM doc_pages) GROUP BY ALL)""",
    "page_count": with_(PAGES)
    + "SELECT doc_id, coalesce(n_pages, 0) AS n_pages FROM documents LEFT JOIN page_totals USING (doc_id)",
    "merge_docs": with_(
        PAGES,
        """
listed AS (SELECT doc_id // 10 AS out_id, doc_id % 10 + 10 * again AS ord, doc_id
  FROM documents, (VALUES (0), (1)) a(again))""",
    )
    + """SELECT out_id, row_number() OVER (PARTITION BY out_id ORDER BY ord, page) AS out_page, doc_id, page, text
FROM listed JOIN doc_pages USING (doc_id)""",
    "split_at": with_(PAGES)
    + "SELECT doc_id, page, 1 + (page > 2)::BIGINT + (page > 5)::BIGINT AS part FROM doc_pages",
    "split_manifest": with_(PAGES)
    + """SELECT doc_id, part, min(page) AS first_page, max(page) AS last_page, NULL::VARCHAR AS error
FROM (SELECT doc_id, page, 1 + (page > 2)::BIGINT + (page > 5)::BIGINT AS part FROM doc_pages) GROUP BY ALL
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'document has no pages' FROM documents WHERE text IS NULL""",
    "split_ranges": with_(PAGES)
    + """SELECT doc_id, page, part FROM doc_pages
JOIN (VALUES (1::BIGINT, 1, 5), (2, 7, 7), (3, 10, 12)) r(part, lo, hi) ON page BETWEEN lo AND hi""",
    "split_every": with_(PAGES) + "SELECT doc_id, page, (page + 2) // 3 AS part FROM doc_pages",
    "split_by_size": with_(
        PAGES,
        f"""
sized AS (SELECT doc_id, page, strlen(text)::BIGINT AS bytes FROM doc_pages),
filled AS (
  SELECT doc_id, page, bytes, 1::BIGINT AS part, bytes AS used FROM sized WHERE page = 1
  UNION ALL
  SELECT s.doc_id, s.page, s.bytes, f.part + (f.used + s.bytes > {PART_BUDGET})::BIGINT,
         CASE WHEN f.used + s.bytes > {PART_BUDGET} THEN s.bytes ELSE f.used + s.bytes END
  FROM filled f JOIN sized s ON s.doc_id = f.doc_id AND s.page = f.page + 1)""",
        recursive=True,
    )
    + "SELECT doc_id, page, bytes, part FROM filled",
    "remove_pages": _kept("page NOT IN (2, 4)"),
    "extract_pages": _kept("page IN (1, 3, 99)"),
    "reorder_pages": with_(
        PAGES,
        """
orders_ AS (
  SELECT doc_id, n_pages + 1 - page AS new_page, n_pages,
         CASE WHEN source = 'src1' AND page = 1 THEN n_pages + 5 WHEN source = 'src2' AND page = 1 THEN n_pages
              ELSE page END AS page
  FROM doc_pages JOIN page_totals USING (doc_id) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
  WHERE source <> 'src3' OR page > 1),
faults AS (
  SELECT doc_id, new_page, CASE WHEN page < 1 OR page > n_pages
           THEN 'the order names page ' || page || ' of a document with ' || n_pages || ' pages'
         WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY new_page) > 1
           THEN 'the order names page ' || page || ' more than once' END AS error
  FROM orders_),
lists AS (SELECT doc_id, count(*) AS n, any_value(n_pages) AS n_pages FROM orders_ GROUP BY ALL),
errors AS (
  SELECT doc_id, coalesce(f.error, CASE WHEN n <> n_pages THEN 'the order leaves out some of the ' || n_pages || ' pages' END)
    AS error
  FROM lists LEFT JOIN (SELECT doc_id, arg_min(error, new_page) AS error FROM faults WHERE error IS NOT NULL
                        GROUP BY ALL) f USING (doc_id))""",
    )
    + """SELECT doc_id, new_page, page, text, NULL::VARCHAR AS error
FROM orders_ JOIN doc_pages USING (doc_id, page) JOIN errors e USING (doc_id) WHERE e.error IS NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL, error FROM errors WHERE error IS NOT NULL""",
    "dup_pages": with_(PAGES, f"\nfirsts AS ({_FIRST})")
    + "SELECT doc_id, page FROM doc_pages ANTI JOIN firsts USING (doc_id, page)",
    "dup_pages_corpus": with_(PAGES, f"\nfirsts AS ({_FIRST_CORPUS})")
    + "SELECT doc_id, page FROM doc_pages ANTI JOIN firsts USING (doc_id, page)",
    "drop_dup_pages": with_(PAGES, f"\nfirsts AS ({_FIRST})")
    + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page, page AS source_page, text
FROM doc_pages SEMI JOIN firsts USING (doc_id, page)""",
    "drop_dup_pages_corpus": with_(PAGES, f"\nfirsts AS ({_FIRST_CORPUS})")
    + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page, page AS source_page, text
FROM doc_pages SEMI JOIN firsts USING (doc_id, page)""",
    "blank_pages": with_(PAGES)
    + f"SELECT doc_id, page, round({_INK}, 6) AS ink FROM doc_pages WHERE {_INK} <= {INK}",
    "remove_blank_pages": with_(PAGES)
    + f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page, page AS source_page
FROM doc_pages WHERE {_INK} > {INK}""",
    "n_up": with_(
        NODES,
        """
own AS (SELECT doc_id, page, media_box AS b FROM page_nodes WHERE page IS NOT NULL),
sheet AS (SELECT doc_id, coalesce(b[3], 612.0) AS sw, coalesce(b[4], 792.0) AS sh FROM own WHERE page = 1),
cells AS (
  SELECT doc_id, page, sw, sh, sw / 2 AS cw, sh / 2 AS ch, (page - 1) // 4 + 1 AS sheet, (page - 1) % 4 AS slot,
         CASE WHEN b IS NULL THEN sw / 2 ELSE coalesce(b[3], 612.0) - coalesce(b[1], 0) END AS w,
         CASE WHEN b IS NULL THEN sh / 2 ELSE coalesce(b[4], 792.0) - coalesce(b[2], 0) END AS h
  FROM own JOIN sheet USING (doc_id)),
fit AS (SELECT *, least(cw / w, ch / h) AS s FROM cells)""",
    )
    + """SELECT doc_id, page, sheet, slot, round(s, 3) AS scale, round((slot % 2) * cw + (cw - w * s) / 2, 3) AS x,
  round((1 - slot // 2) * ch + (ch - h * s) / 2, 3) AS y, round(sw, 3) AS sheet_width, round(sh, 3) AS sheet_height
FROM fit""",
    "page_labels": with_(SIZES)
    + """SELECT doc_id, page, label, round(width - 24 - length(label) * 10 * 0.5, 3)::DOUBLE AS x,
  round(height - 24 - 10, 3)::DOUBLE AS y
FROM (SELECT doc_id, page, width, height, 'Page ' || (page + 2) || ' of ' || n_pages AS label
      FROM page_sizes JOIN page_totals USING (doc_id))""",
}

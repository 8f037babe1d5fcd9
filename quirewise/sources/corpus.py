"""Read the given tables with declared schemas and derive the page, span, form and resource tables.

A document is one row, so everything that only needs its own document is computed inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions.expr import let, prefix_sums
from quirewise.model import (
    ADVANCE,
    FONT_SIZE,
    LINES_PER_PAGE,
    MARGIN,
    OCR_DPI,
    PAGE_HEIGHT,
    PAGE_WIDTH,
    input_schema,
)


# Partitions of an input, each up to spark.sql.files.maxPartitionBytes, below which it counts as small.
SMALL_INPUT = 16


class CorpusReadError(Exception):
    """An input cannot be read; the message holds its path and the reason."""


def read_corpus(spark: SparkSession, root: str, name: str, spread_by: str | None = None) -> DataFrame:
    """Read one table with its declared schema.

    With ``spread_by``, an input of a few partitions, too small to give every core work, is spread over the cores by
    that key; any other input keeps its own partitions and is not shuffled.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    try:
        df = spark.read.schema(input_schema(name)).parquet(path)
    except AnalysisException as err:
        raise CorpusReadError(f"cannot read {path}: {err}") from err
    cores = spark.sparkContext.defaultParallelism
    if spread_by and df.rdd.getNumPartitions() < min(cores, SMALL_INPUT):
        df = df.repartition(min(cores, 4 * SMALL_INPUT), spread_by)
    return df


def _pages(text: Column) -> Column:
    """Text to an array of pages of LINES_PER_PAGE lines each, every page with the page count beside it."""

    def cut(lines: Column) -> Column:
        n_pages = F.ceil(F.size(lines) / LINES_PER_PAGE).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n_pages - 1),
            lambda p: F.struct(
                F.array_join(F.slice(lines, p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n").alias("text"),
                n_pages.cast("bigint").alias("n_pages"),
            ),
        )

    return let(F.split(text, "\n"), cut)


def page_texts(text: Column) -> Column:
    """Text to an array of page texts."""
    return F.transform(_pages(text), lambda p: p["text"])


def count_pages(text: Column) -> Column:
    """Number of pages of a text; 0 for no text."""
    lines = F.size(F.split(text, "\n"))
    return F.when(text.isNull(), F.lit(0)).otherwise(F.ceil(lines / LINES_PER_PAGE)).cast("bigint")


def paginate(documents: DataFrame) -> DataFrame:
    """Documents to pages numbered from 1 without gaps, with the page count of the document beside each page."""
    return documents.select("doc_id", F.posexplode(_pages(F.col("text"))).alias("_pos", "_page")).select(
        "doc_id", (F.col("_pos") + 1).cast("bigint").alias("page"), "_page.text", "_page.n_pages"
    )


def baseline(line: Column) -> Column:
    """Baseline of the n-th line of a page, counted from 0."""
    return F.lit(PAGE_HEIGHT - MARGIN) - F.lit(FONT_SIZE) * (line + 1)


def layout_spans(doc_pages: DataFrame, with_offsets: bool = False) -> DataFrame:
    """One positioned run per line; ``char_start`` is the place of the run in the text of its page."""
    lines = F.split("text", "\n")
    if with_offsets:

        def placed(parts: Column) -> Column:
            starts = prefix_sums(F.transform(parts, lambda line: F.length(line) + 1))
            return F.zip_with(parts, starts, lambda t, s: F.struct(t.alias("text"), s.alias("char_start")))

        pages = doc_pages.select("doc_id", "page", F.posexplode(let(lines, placed)).alias("_pos", "_run"))
        text, extra = F.col("_run.text"), [F.col("_run.char_start").cast("bigint").alias("char_start")]
    else:
        pages = doc_pages.select("doc_id", "page", F.posexplode(lines).alias("_pos", "_line"))
        text, extra = F.col("_line"), []
    return pages.select(
        "doc_id",
        "page",
        F.col("_pos").cast("bigint").alias("span"),
        text.alias("text"),
        F.lit(MARGIN).alias("x"),
        baseline(F.col("_pos")).alias("y"),
        F.lit(FONT_SIZE).alias("font_size"),
        *extra,
    )


def page_nodes(documents: DataFrame) -> DataFrame:
    """A page tree per document: a root, an inner node for every 8 pages, and the pages.

    Some nodes carry no box and some a malformed one, so that inheritance has work to do.
    """
    n = F.col("n_pages").cast("int")
    no_box = F.lit(None).cast("array<double>")

    def box(*v: float) -> Column:
        return F.array(*[F.lit(float(x)) for x in v])

    def node(node_id: Column, parent: Column, page: Column, media: Column, rotate: Column) -> Column:
        return F.struct(
            node_id.cast("bigint").alias("node_id"),
            parent.cast("bigint").alias("parent_id"),
            page.cast("bigint").alias("page"),
            media.alias("media_box"),
            rotate.cast("bigint").alias("rotate"),
        )

    null = F.lit(None)
    root = node(
        F.lit(-1), null, null, F.when(F.col("doc_id") % 4 == 0, no_box).otherwise(box(0, 0, 595, 842)), null
    )
    inner = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")),
        lambda k: node(-(k + 2), F.lit(-1), null, F.when(k % 2 == 0, no_box).otherwise(box(0, 0, 500, 700)), null),
    )
    leaves = F.transform(
        F.sequence(F.lit(1), n),
        lambda p: node(
            p,
            -(F.floor((p - 1) / 8) + 2),
            p,
            F.when(p % 5 == 0, box(0, 0, 612))
            .when(p % 3 == 1, box(0, 0, 612, 792))
            .when(p % 3 == 2, box(10, 20, 605, 862))
            .otherwise(no_box),
            F.when(p % 4 != 0, (p % 4) * 90),
        ),
    )
    counted = documents.select("doc_id", count_pages(F.col("text")).alias("n_pages")).where("n_pages > 0")
    return counted.select("doc_id", F.explode(F.concat(F.array(root), inner, leaves)).alias("_n")).select(
        "doc_id", "_n.*"
    )


def resources(pages: DataFrame, held_only: bool = False) -> DataFrame:
    """Embedded resources of web pages: ``seq`` counts from 0 per page, ``idx`` from 0 per page and kind.

    With ``held_only``, only resources with a body, and ``item`` counts those from 0 per page.
    """
    # Paired tags with a body, then tags that carry everything in attributes.
    paired = ("script", "style", "a", "title", "iframe", "object", "form", "table")
    single = ("meta", "img", "embed", "link")

    def item(kind: str, tag: Column, has_body: bool) -> Column:
        attrs = F.regexp_extract(tag, f"(?is)^<{kind}\\b([^>]*)>", 1)
        body = F.regexp_extract(tag, f"(?is)^<{kind}\\b[^>]*>(.*)</{kind}>$", 1) if has_body else F.lit("")
        return F.struct(attrs.alias("attrs"), body.alias("body"), F.octet_length(tag).cast("bigint").alias("bytes"))

    def items(kind: str) -> Column:
        tail = f".*?</{kind}>" if kind in paired else ""
        tags = F.regexp_extract_all("html", F.lit(f"(?is)<{kind}\\b[^>]*>{tail}"), F.lit(0))
        return F.transform(
            tags,
            lambda tag, i: F.struct(
                F.lit(kind).alias("kind"), i.cast("bigint").alias("idx"), item(kind, tag, kind in paired).alias("v")
            ),
        )

    arrays = [items(kind) for kind in paired + single]
    found = F.transform(F.concat(*arrays), lambda r, i: F.struct(i.cast("bigint").alias("seq"), r.alias("r")))
    if held_only:
        found = F.filter(found, lambda f: F.length(f["r"]["v"]["body"]) > 0)
    item_no = [F.col("_pos").cast("bigint").alias("item")] if held_only else []
    return pages.select("page_id", F.posexplode(found).alias("_pos", "_f")).select(
        "page_id", *item_no, "_f.seq", "_f.r.kind", "_f.r.idx", "_f.r.v.*"
    )


def form_nodes(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """A field tree per region: nations are groups, customers fields; every third field has a widget kid,
    every third a nested field."""
    null_text = F.lit(None).cast("string")

    def row(doc, node, parent, ord_, name, kind, value, subtype, page) -> list[Column]:
        return [
            doc.cast("bigint").alias("doc_id"),
            node.cast("bigint").alias("node_id"),
            parent.cast("bigint").alias("parent_id"),
            ord_.cast("bigint").alias("ord"),
            name.alias("name"),
            kind.alias("field_type"),
            value.alias("value"),
            subtype.alias("subtype"),
            page.cast("bigint").alias("page_ref"),
        ]

    null = F.lit(None)
    key = F.col("c_custkey")
    forms = nation.join(region, nation.n_regionkey == region.r_regionkey)
    groups = forms.select(
        *row(
            F.col("r_regionkey"), F.col("n_nationkey"), null, F.col("n_nationkey"), F.col("n_name"),
            null_text, null_text, null_text, null,
        )
    )
    field = F.struct(
        *row(
            F.col("n_regionkey"), key * 2 + 1000, F.col("c_nationkey"), key, F.concat(F.lit("field-"), key),
            F.when(F.col("c_acctbal") < 0, null_text).otherwise(F.lit("Tx")),
            F.when(key % 7 == 0, null_text).otherwise(F.col("c_mktsegment")), null_text, key % 6 + 1,
        )
    )
    kid = F.struct(
        *row(
            F.col("n_regionkey"), key * 2 + 1001, key * 2 + 1000, F.lit(0),
            F.when(key % 3 == 1, F.concat(F.lit("sub-"), key)),
            F.when(key % 3 == 1, F.lit("Btn")), F.when(key % 3 == 1, F.lit("Off")),
            F.when(key % 3 == 0, F.lit("Widget")), key % 6 + 2,
        )
    )
    fields = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(F.explode(F.when(key % 3 == 2, F.array(field)).otherwise(F.array(field, kid))).alias("_f"))
        .select("_f.*")
    )
    return groups.unionByName(fields)


def annotations(doc_pages: DataFrame) -> DataFrame:
    """Four marks on every page: a link, a note, and a form widget with and one without an appearance."""
    x = F.lit(72.0) + F.col("page")

    def mark(ord_: int, subtype: str, x0: Column, appearance: bool) -> Column:
        return F.struct(
            F.lit(0).cast("bigint").alias("layer"),
            F.lit(ord_).cast("bigint").alias("ord"),
            F.lit(None).cast("string").alias("kind"),
            F.lit(subtype).alias("subtype"),
            F.array(x0, F.lit(100.0), x0 + 50.0, F.lit(120.0)).alias("rect"),
            F.lit(None).cast("array<double>").alias("quad"),
            F.concat(F.lit(f"{subtype} on page "), F.col("page")).alias("contents"),
            F.lit(appearance).alias("has_appearance"),
        )

    marks = F.array(
        mark(1, "Link", x, False),
        mark(2, "Text", x + 60.0, False),
        mark(3, "Widget", x + 120.0, True),
        mark(4, "Widget", x + 180.0, False),
    )
    return doc_pages.select("doc_id", "page", F.explode(marks).alias("_a")).select("doc_id", "page", "_a.*")


def ocr_pages(doc_pages: DataFrame) -> DataFrame:
    """Recognised lines of every page in pixels, origin top left."""
    k = F.lit(OCR_DPI / 72.0)

    def word(line: Column, i: Column) -> Column:
        return F.struct(
            line.alias("text"),
            (F.lit(MARGIN) * k).alias("x"),
            ((F.lit(PAGE_HEIGHT) - baseline(i) - F.lit(FONT_SIZE)) * k).alias("y"),
            (F.length(line) * F.lit(FONT_SIZE * ADVANCE) * k).alias("width"),
            (F.lit(FONT_SIZE) * k).alias("height"),
        )

    return doc_pages.select(
        "doc_id",
        (F.col("page") - 1).alias("page_index"),
        (F.lit(PAGE_WIDTH) * k).alias("image_width"),
        (F.lit(PAGE_HEIGHT) * k).alias("image_height"),
        F.transform(F.split("text", "\n"), word).alias("words"),
    )


def ocr_quads(doc_pages: DataFrame) -> DataFrame:
    """Recognised lines of every page with a slanted four-point outline."""
    k = F.lit(OCR_DPI / 72.0)

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def line(text: Column, i: Column) -> Column:
        left = F.lit(MARGIN) * k
        right = left + F.length(text) * F.lit(FONT_SIZE * ADVANCE) * k
        top = (F.lit(PAGE_HEIGHT) - baseline(i) - F.lit(FONT_SIZE)) * k
        bottom = top + F.lit(FONT_SIZE) * k
        corners = F.array(point(left, top + 2.0), point(right, top), point(right, bottom), point(left, bottom + 2.0))
        return F.struct(text.alias("text"), corners.alias("points"))

    return doc_pages.select(
        "doc_id", (F.col("page") - 1).alias("page_index"), F.transform(F.split("text", "\n"), line).alias("lines")
    )


def history(events: DataFrame) -> DataFrame:
    """Runs of tools: one per event."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("tool_id"),
        F.col("user_id").alias("subject_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
        "value",
    )

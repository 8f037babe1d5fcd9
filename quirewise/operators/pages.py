"""Operators on the page set of documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.expr import let
from quirewise.functions.geometry import place_label, r3, text_width
from quirewise.functions.text import fill_template, ink_share
from quirewise.model import table_schema
from quirewise.operators.spread import number_within, running_total, spread_join
from quirewise.sources.corpus import count_pages, page_texts

# Pages of one document numbered per task at most; page numbers are dense, so no bucket is larger.
PAGE_BUCKET = 4096
# Starts of parts in one block of the size split.
_STARTS = 256


def _long_list(pages: Iterable[int]) -> Column:
    return F.array(*[F.lit(int(p)) for p in sorted(set(pages))]).cast("array<bigint>")


def with_page_total(doc_pages: DataFrame) -> DataFrame:
    """The page count of the document beside each page; computed only where it is not there yet."""
    if "n_pages" in doc_pages.columns:
        return doc_pages
    totals = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return spread_join(doc_pages, totals, ["doc_id"], salt_by=["page"])


def page_count(documents: DataFrame, doc_pages: DataFrame | None = None) -> DataFrame:
    """Pages per document, 0 for a document without any.

    Counted in the row of the document, or from a page table if one is given.
    """
    if doc_pages is None:
        return documents.select("doc_id", count_pages(F.col("text")).alias("n_pages"))
    totals = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return (
        documents.select("doc_id")
        .join(totals, "doc_id", "left")
        .select("doc_id", F.coalesce("n_pages", F.lit(0).cast("bigint")).alias("n_pages"))
    )


def merge_docs(merge_list: DataFrame | Sequence[int], page_counts: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Concatenate the pages of the listed documents in list order.

    ``merge_list(out_id, ord, doc_id)``, or a plain list of documents for one output, may name a document twice.
    Offsets come from page counts, so no global numbering is needed; a document that many outputs share is spread
    over several tasks.
    """
    if not isinstance(merge_list, DataFrame):
        if not merge_list:
            raise ValueError("no input documents to merge")
        entries = [(0, i, int(doc)) for i, doc in enumerate(merge_list)]
        merge_list = doc_pages.sparkSession.createDataFrame(entries, table_schema("merge_list"))
    sized = merge_list.join(page_counts, "doc_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    placed = running_total(sized, ["out_id"], "ord", "n_pages", "_offset").drop("n_pages")
    content = doc_pages.drop("n_pages")
    joined = spread_join(placed, content, ["doc_id"], salt_by=["out_id", "ord"], hot_in=merge_list)
    return joined.withColumn("out_page", F.col("_offset") + F.col("page")).drop("_offset")


def split_at(doc_pages: DataFrame, points: Sequence[int]) -> DataFrame:
    """Cut after each listed page: the part of a page is one more than the cut points before it.

    Points at 0 or below, repeated, or at the end and beyond change nothing.
    """
    cuts = F.filter(_long_list(points), lambda p: (p > 0) & (p < F.col("page")))
    return doc_pages.withColumn("part", (F.size(cuts) + 1).cast("bigint"))


def split_manifest(documents: DataFrame, points: Sequence[int]) -> DataFrame:
    """First and last page of each part; a document without pages gets one row with an error."""
    n = F.col("n_pages")
    cuts = F.filter(_long_list(points), lambda p: (p > 0) & (p < n))
    starts = F.concat(F.array(F.lit(1).cast("bigint")), F.transform(cuts, lambda p: p + 1))
    ends = F.concat(cuts, F.array(n))
    parts = F.when(n > 0, F.arrays_zip(starts.alias("first_page"), ends.alias("last_page")))
    return (
        page_count(documents)
        .select("doc_id", "n_pages", F.posexplode_outer(parts).alias("_pos", "_part"))
        .select(
            "doc_id",
            (F.col("_pos") + 1).cast("bigint").alias("part"),
            F.col("_part.first_page").alias("first_page"),
            F.col("_part.last_page").alias("last_page"),
            F.when(n == 0, F.lit("document has no pages")).alias("error"),
        )
    )


def parse_split_spec(spec: str) -> int | list[tuple[int, int]]:
    """``"every:k"`` to k, ``"1-5,7"`` to [(1, 5), (7, 7)]."""
    if found := re.fullmatch(r"every:(\d+)", spec.strip()):
        if (k := int(found[1])) < 1:
            raise ValueError("every:k needs k of 1 or more")
        return k
    ranges = []
    for item in spec.split(","):
        found = re.fullmatch(r"(\d+)(?:-(\d+))?", item.strip())
        if not found:
            raise ValueError(f"bad page range '{item}' in '{spec}'")
        low, high = int(found[1]), int(found[2] or found[1])
        if low < 1 or high < low:
            raise ValueError(f"bad page range '{item}' in '{spec}'")
        ranges.append((low, high))
    return ranges


def split_ranges(doc_pages: DataFrame, spec: str) -> DataFrame:
    """One part per listed range, or runs of k pages; a page in several ranges is in several parts."""
    parsed = parse_split_spec(spec)
    if isinstance(parsed, int):
        return doc_pages.withColumn("part", F.ceil(F.col("page") / parsed))
    parts = F.array(
        *[
            F.when(F.col("page").between(low, high), F.lit(i).cast("bigint"))
            for i, (low, high) in enumerate(parsed, start=1)
        ]
    )
    return doc_pages.withColumn("part", F.explode(F.filter(parts, lambda p: p.isNotNull())))


def _first_of_parts(sizes: Column, budget: int) -> Column:
    """Places from 0 of the pages that begin a part, filled from the front.

    The fold keeps what is used of the open part. Starts are gathered in blocks of a few hundred, which are put together at
    the end, so that a document with very many parts does not copy all of them for each.
    """
    none, no_blocks = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def state(used: Column, at: Column, open_: Column, done: Column) -> Column:
        return F.struct(used.alias("used"), at.alias("at"), open_.alias("open"), done.alias("done"))

    def step(s: Column, size: Column) -> Column:
        begins = (s["at"] == 0) | (s["used"] + size > budget)
        full = F.size(s["open"]) == _STARTS
        opened = F.when(full, F.array(s["at"])).otherwise(F.concat(s["open"], F.array(s["at"])))
        return state(
            F.when(begins, size).otherwise(s["used"] + size),
            s["at"] + 1,
            F.when(begins, opened).otherwise(s["open"]),
            F.when(begins & full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]),
        )

    start = state(F.lit(0).cast("bigint"), F.lit(0), none, no_blocks)
    return F.aggregate(sizes, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["open"]))))


def split_by_size(documents: DataFrame, budget: int) -> DataFrame:
    """Fill parts greedily up to a byte budget; a page above the budget is a part of its own. No shuffle."""
    if budget < 1:
        raise ValueError(f"budget must be positive, got {budget}")

    def numbered(sizes: Column) -> Column:
        def parts(starts: Column) -> Column:
            length = lambda at, k: F.coalesce(F.get(starts, k + 1), F.size(sizes)) - at
            return F.flatten(F.transform(starts, lambda at, k: F.array_repeat((k + 1).cast("bigint"), length(at, k))))

        return F.arrays_zip(sizes.alias("bytes"), let(_first_of_parts(sizes, budget), parts).alias("part"))

    sizes = F.transform(page_texts(F.col("text")), lambda p: F.octet_length(p).cast("bigint"))
    return (
        documents.select("doc_id", sizes.alias("_sizes"))
        .select("doc_id", F.posexplode(let(F.col("_sizes"), numbered)).alias("_pos", "_v"))
        .select(
            "doc_id",
            (F.col("_pos") + 1).cast("bigint").alias("page"),
            F.col("_v.bytes").alias("bytes"),
            F.col("_v.part").alias("part"),
        )
    )


def remove_pages(doc_pages: DataFrame, pages: Sequence[int] | DataFrame) -> DataFrame:
    """Drop the listed pages and renumber the rest densely; ``source_page`` keeps the old number.

    A literal list needs no shuffle: a kept page moves up by the listed pages before it. A table
    ``(doc_id, page)`` lists pages per document.
    """
    if isinstance(pages, DataFrame):
        kept = doc_pages.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
        return renumber(kept)
    listed = _long_list(pages)
    kept = doc_pages.where(~F.array_contains(listed, F.col("page")))
    before = F.size(F.filter(listed, lambda p: (p > 0) & (p < F.col("page"))))
    return _numbered(kept, (F.col("page") - before).cast("bigint"))


def extract_pages(doc_pages: DataFrame, pages: Sequence[int] | DataFrame) -> DataFrame:
    """Keep the listed pages in document order; repeats and unknown numbers in the list change nothing."""
    if isinstance(pages, DataFrame):
        kept = doc_pages.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
        return renumber(kept)
    listed = _long_list(pages)
    kept = doc_pages.where(F.array_contains(listed, F.col("page")))
    return _numbered(kept, F.size(F.filter(listed, lambda p: (p > 0) & (p <= F.col("page")))).cast("bigint"))


def _numbered(kept: DataFrame, number: Column) -> DataFrame:
    numbered = kept.drop("n_pages").withColumn("_new", number)
    return numbered.withColumnRenamed("page", "source_page").withColumnRenamed("_new", "page")


def renumber(kept: DataFrame) -> DataFrame:
    """Dense page numbers per document in the old order; only keys are numbered, content joins by key."""
    keys = number_within(kept.select("doc_id", "page"), ["doc_id"], "page", "_new", PAGE_BUCKET)
    return (
        kept.drop("n_pages")
        .join(keys, ["doc_id", "page"])
        .withColumnRenamed("page", "source_page")
        .withColumnRenamed("_new", "page")
    )


def reorder_errors(page_order: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Documents whose order is no permutation, each with the first fault of its list.

    Checked per entry: out of range, then seen before; at last whether the list is complete.
    """
    first_seen = page_order.groupBy("doc_id", "page").agg(F.min("new_page").alias("new_page"))
    firsts = first_seen.select("doc_id", "new_page", F.lit(True).alias("_first"))
    text = F.col("page").cast("string")
    fault = F.when(
        (F.col("page") < 1) | (F.col("page") > F.col("n_pages")),
        F.concat(F.lit("the order names page "), text, F.lit(" of a document with "), F.col("n_pages"), F.lit(" pages")),
    ).when(F.col("_first").isNull(), F.concat(F.lit("the order names page "), text, F.lit(" more than once")))
    incomplete = F.concat(F.lit("the order leaves out some of the "), F.col("n_pages"), F.lit(" pages"))
    entries = page_order.join(firsts, ["doc_id", "new_page"], "left")
    return (
        spread_join(entries, page_counts, ["doc_id"], salt_by=["new_page"], hot_in=page_order)
        .withColumn("error", fault)
        .groupBy("doc_id")
        .agg(
            F.min(F.when(F.col("error").isNotNull(), F.struct("new_page", "error"))).alias("_fault"),
            F.count(F.lit(1)).alias("_n"),
            F.min("n_pages").alias("n_pages"),
        )
        .select(
            "doc_id",
            F.coalesce("_fault.error", F.when(F.col("_n") != F.col("n_pages"), incomplete)).alias("error"),
        )
        .where("error is not null")
    )


def reorder_pages(doc_pages: DataFrame, page_order: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Pages in the given order ``(doc_id, new_page, page)``; a document with a bad order gives one error row."""
    errors = reorder_errors(page_order, page_counts)
    content = doc_pages.drop("n_pages")
    moved = (
        page_order.join(errors, "doc_id", "left_anti")
        .join(content, ["doc_id", "page"])
        .withColumn("error", F.lit(None).cast("string"))
    )
    return moved.unionByName(errors, allowMissingColumns=True)


def _page_hash() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _first_copies(doc_pages: DataFrame, scope: str) -> DataFrame:
    """Key of the first page of every group of equal pages. Groups collapse before the shuffle, whatever their size."""
    hashed = doc_pages.select("doc_id", "page", _page_hash().alias("_h"))
    if scope == "doc":
        return hashed.groupBy("doc_id", "_h").agg(F.min("page").alias("page")).select("doc_id", "page")
    if scope == "corpus":
        return hashed.groupBy("_h").agg(F.min(F.struct("doc_id", "page")).alias("_k")).select("_k.doc_id", "_k.page")
    raise ValueError(f"scope must be doc or corpus, not '{scope}'")


def dup_pages(doc_pages: DataFrame, scope: str = "doc") -> DataFrame:
    """Pages equal to an earlier page. The anti join is on the page key, which no group can skew."""
    return doc_pages.select("doc_id", "page").join(_first_copies(doc_pages, scope), ["doc_id", "page"], "left_anti")


def drop_dup_pages(doc_pages: DataFrame, scope: str = "doc") -> DataFrame:
    """Keep the first of each group of equal pages and renumber."""
    first = number_within(_first_copies(doc_pages, scope), ["doc_id"], "page", "_new", PAGE_BUCKET)
    return (
        doc_pages.drop("n_pages")
        .join(first, ["doc_id", "page"])
        .withColumnRenamed("page", "source_page")
        .withColumnRenamed("_new", "page")
    )


def blank_pages(doc_pages: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pages whose share of non-blank characters is at or below the threshold."""
    return doc_pages.withColumn("ink", ink_share(F.col("text"))).where(F.col("ink") <= threshold)


def remove_blank_pages(doc_pages: DataFrame, threshold: float = 0.0) -> DataFrame:
    return renumber(doc_pages.where(ink_share(F.col("text")) > threshold))


def n_up(nodes: DataFrame, n: int) -> DataFrame:
    """Place n pages on each sheet, left to right and top row first, scaled to fit and centred.

    The sheet takes the upper right corner of the first page's own box; a page without a box fills its cell.
    """
    if n not in (2, 4, 6, 9):
        raise ValueError(f"no layout for {n} pages on a sheet; there are 2, 4, 6 and 9")
    cols = 2 if n <= 4 else 3
    rows = n // cols
    pages = nodes.where("page is not null").select("doc_id", "page", "media_box")
    corner = lambda i, default: F.coalesce(F.get("media_box", i), F.lit(default))
    sheets = pages.where("page = 1").select("doc_id", corner(2, 612.0).alias("_sw"), corner(3, 792.0).alias("_sh"))
    k = F.col("page") - 1
    slot = k % n
    has_box = F.col("media_box").isNotNull()
    placed = (
        pages.join(sheets, "doc_id")
        .withColumn("_cw", F.col("_sw") / cols)
        .withColumn("_ch", F.col("_sh") / rows)
        .withColumn("_w", F.when(has_box, corner(2, 612.0) - corner(0, 0.0)).otherwise(F.col("_cw")))
        .withColumn("_h", F.when(has_box, corner(3, 792.0) - corner(1, 0.0)).otherwise(F.col("_ch")))
        .withColumn("scale", F.least(F.col("_cw") / F.col("_w"), F.col("_ch") / F.col("_h")))
    )
    col = slot % cols
    row = F.lit(rows - 1) - F.floor(slot / cols)
    return placed.select(
        "doc_id",
        "page",
        (F.floor(k / n) + 1).alias("sheet"),
        slot.alias("slot"),
        r3(F.col("scale")).alias("scale"),
        r3(col * F.col("_cw") + (F.col("_cw") - F.col("_w") * F.col("scale")) / 2).alias("x"),
        r3(row * F.col("_ch") + (F.col("_ch") - F.col("_h") * F.col("scale")) / 2).alias("y"),
        r3(F.col("_sw")).alias("sheet_width"),
        r3(F.col("_sh")).alias("sheet_height"),
    )


def page_labels(
    doc_pages: DataFrame,
    sizes: DataFrame | None = None,
    position: str = "bottom-center",
    template: str = "{n}",
    start: int = 1,
    font_size: float = 12.0,
) -> DataFrame:
    """Label text and origin for every page; ``{n}`` is the number, then ``{total}`` the page count.

    ``sizes(doc_id, page, width, height)`` gives page sizes; without it every page has the default size.
    """
    pages = with_page_total(doc_pages).select("doc_id", "page", "n_pages")
    if sizes is None:
        pages = pages.withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    else:
        pages = pages.join(sizes.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    label = fill_template(template, {"n": F.lit(start) + F.col("page") - 1, "total": F.col("n_pages")})
    x, y = place_label(
        position, F.col("width"), F.col("height"), text_width(F.col("label"), F.lit(float(font_size))), font_size
    )
    return pages.withColumn("label", label).select("doc_id", "page", "label", r3(x).alias("x"), r3(y).alias("y"))

"""Annotations, recognised text, comparison and overlay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.geometry import r3
from quirewise.functions.linediff import near, script
from quirewise.model import ADVANCE

# Annotation kinds and their subtypes.
SUBTYPES = {"highlight": "Highlight", "underline": "Underline", "strikeout": "StrikeOut", "note": "Text"}


def subtype_of(kind: str) -> str:
    if kind not in SUBTYPES:
        raise ValueError(
            f"no such kind of mark: {kind}"
        )
    return SUBTYPES[kind]


def add_annotations(annotations: DataFrame, requests: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Append marks: ``requests(doc_id, page, ord, kind, x0, y0, x1, y1, note)``.

    New marks come after the old ones of their page (layer 1). A request with an unknown kind or page gives an
    error row.
    """
    subtype = F.lit(None).cast("string")
    for kind, name in SUBTYPES.items():
        subtype = F.when(F.col("kind") == kind, name).otherwise(subtype)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    known = doc_pages.select("doc_id", "page", F.lit(True).alias("_known"))
    error = F.when(
        F.col("subtype").isNull(),
        F.concat(
            F.lit("no such kind of mark: "), F.coalesce("kind", F.lit("null"))
        ),
    ).when(F.col("_known").isNull(), F.concat(F.lit("page "), F.col("page"), F.lit(" does not exist")))
    added = (
        requests.join(known, ["doc_id", "page"], "left")
        .withColumn("subtype", subtype)
        .select(
            "doc_id",
            "page",
            F.lit(1).cast("bigint").alias("layer"),
            "ord",
            "kind",
            "subtype",
            F.array(x0, y0, x1, y1).alias("rect"),
            F.when(F.col("subtype") != "Text", F.array(x0, y1, x1, y1, x0, y0, x1, y0)).alias("quad"),
            F.col("note").alias("contents"),
            F.lit(False).alias("has_appearance"),
            error.alias("error"),
        )
    )
    return annotations.withColumn("error", F.lit(None).cast("string")).unionByName(added)


def ocr_spans(ocr_pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """Recognised words to runs on the page, in points from the bottom left.

    Blank words are skipped, and so are pages that do not exist, hold no word, or have no image size.
    """
    usable = ocr_pages.where("image_width > 0 and image_height > 0 and size(words) > 0").withColumn(
        "page", F.col("page_index") + 1
    )
    words = (
        usable.join(sizes.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
        .select(
            "doc_id",
            "page",
            "height",
            (F.col("width") / F.col("image_width")).alias("_sx"),
            (F.col("height") / F.col("image_height")).alias("_sy"),
            F.posexplode("words").alias("_pos", "_w"),
        )
        .withColumn("text", F.regexp_replace("_w.text", r"(?U)^\s+|\s+$", ""))
        .where("text != ''")
    )
    size = F.greatest(F.col("_w.height") * F.col("_sy"), F.lit(1.0))
    natural = F.length("text") * size * F.lit(ADVANCE)
    stretch = F.greatest(F.least(F.col("_w.width") * F.col("_sx") / natural * 100, F.lit(1000.0)), F.lit(1.0))
    return words.select(
        "doc_id",
        "page",
        F.col("_pos").cast("bigint").alias("word"),
        "text",
        r3(F.col("_w.x") * F.col("_sx")).alias("x"),
        r3(F.col("height") - (F.col("_w.y") + F.col("_w.height")) * F.col("_sy")).alias("y"),
        r3(size).alias("font_size"),
        r3(stretch).alias("stretch"),
    )


def ocr_boxes(ocr_lines: DataFrame) -> DataFrame:
    """Four-point outlines to upright boxes; blank lines and boxes without area are skipped."""

    def bounds(line: Column) -> Column:
        xs = F.transform(line["points"], lambda p: p["x"])
        ys = F.transform(line["points"], lambda p: p["y"])
        return F.struct(
            line["text"].alias("text"),
            F.array_min(xs).alias("x"),
            F.array_min(ys).alias("y"),
            (F.array_max(xs) - F.array_min(xs)).alias("width"),
            (F.array_max(ys) - F.array_min(ys)).alias("height"),
        )

    boxes = F.transform("lines", bounds)
    return (
        ocr_lines.select("doc_id", "page_index", F.posexplode(boxes).alias("_pos", "_b"))
        .where(_not_blank(F.col("_b.text")) & (F.col("_b.width") > 0) & (F.col("_b.height") > 0))
        .select(
            "doc_id",
            "page_index",
            F.col("_pos").cast("bigint").alias("line"),
            "_b.text",
            *[r3(F.col(f"_b.{c}")).alias(c) for c in ("x", "y", "width", "height")],
        )
    )


def _not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def ocr_text(documents: DataFrame, column: str = "ocr") -> DataFrame:
    """Recognised lines of each document as one text.

    ``ocr`` holds the pages of a document, each an array of lines. Every line ends with a line break, every page with
    one more, and the whole is trimmed; blank lines are skipped, lines without a box stay.
    """
    pages = F.transform(
        F.col(column),
        lambda lines: F.concat(
            F.array_join(F.transform(F.filter(lines, _not_blank), lambda t: F.concat(t, F.lit("\n"))), ""), F.lit("\n")
        ),
    )
    whole = F.regexp_replace(F.array_join(pages, ""), r"(?U)^\s+|\s+$", "")
    return documents.select("doc_id", F.coalesce(whole, F.lit("")).alias("text"))


def compare_pages(left: DataFrame, right: DataFrame, tolerance: int = 0) -> DataFrame:
    """Page by page over the longer of two page tables that share ``doc_id``.

    ``diff_lines`` is a shortest script from the left page to the right one, ``-2,+2,+5``: lines that go by their number on
    the left, lines that come by their number on the right. So a line that is put in is one difference, whatever comes
    after it. Lines that are at most ``tolerance`` edits of a character apart count as equal. A page on one side only is
    not identical and has no script; a null text is empty. Only pages whose texts differ are looked at line by line.
    """
    if tolerance < 0:
        raise ValueError(f"tolerance must be 0 or more, got {tolerance}")
    a = left.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("_a"))
    b = right.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("_b"))

    @F.pandas_udf("string")
    def changed(old: pd.Series, new: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            if x is None or y is None:
                return None
            return ",".join(script(x.split("\n"), y.split("\n"), lambda p, q: near(p, q, tolerance)))

        return pd.Series([one(x, y) for x, y in zip(old, new)], dtype=object)

    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differs = both & (F.col("_a") != F.col("_b"))
    compared = a.join(b, ["doc_id", "page"], "full").select(
        "doc_id",
        "page",
        both.alias("_both"),
        changed(F.when(differs, F.col("_a")), F.when(differs, F.col("_b"))).alias("_script"),
    )
    script_ = F.when(F.col("_script") != "", F.col("_script"))
    return compared.select("doc_id", "page", (F.col("_both") & script_.isNull()).alias("identical"), script_.alias("diff_lines"))


def overlay_align(pairs: DataFrame, sizes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Pair every page of a base document with an overlay page: ``pairs(base_id, overlay_id)``.

    The last overlay page repeats; the overlay is scaled to fit and centred. A pair with an empty side gives an
    error row.
    """
    count = lambda side: page_counts.select(
        F.col("doc_id").alias(f"{side}_id"), F.col("n_pages").alias(f"_n_{side}")
    )
    counted = pairs.join(count("base"), "base_id", "left").join(count("overlay"), "overlay_id", "left")
    n_base = F.coalesce("_n_base", F.lit(0))
    n_overlay = F.coalesce("_n_overlay", F.lit(0))
    counted = counted.withColumn("error", F.when((n_base == 0) | (n_overlay == 0), F.lit("no input pages")))
    base = sizes.select(
        F.col("doc_id").alias("base_id"),
        "page",
        F.col("width").alias("_bw"),
        F.col("height").alias("_bh"),
    )
    over = sizes.select(
        F.col("doc_id").alias("overlay_id"),
        F.col("page").alias("overlay_page"),
        F.col("width").alias("_ow"),
        F.col("height").alias("_oh"),
    )
    scale = F.least(
        F.col("_bw") / F.greatest("_ow", F.lit(1.0)), F.col("_bh") / F.greatest("_oh", F.lit(1.0))
    )
    placed = (
        counted.where("error is null")
        .join(base, "base_id")
        .withColumn("overlay_page", F.least("page", "_n_overlay"))
        .join(over, ["overlay_id", "overlay_page"])
        .withColumn("_scale", scale)
        .select(
            "base_id",
            "page",
            "overlay_id",
            "overlay_page",
            r3(F.col("_scale")).alias("scale"),
            r3((F.col("_bw") - F.col("_ow") * F.col("_scale")) / 2).alias("x"),
            r3((F.col("_bh") - F.col("_oh") * F.col("_scale")) / 2).alias("y"),
            "error",
        )
    )
    failed = counted.where("error is not null").select("base_id", "overlay_id", "error")
    return placed.unionByName(failed, allowMissingColumns=True)

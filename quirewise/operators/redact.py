"""Find and remove text by pattern or by area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.expr import indices, let, prefix_sums
from quirewise.functions.geometry import (
    blank_ranges,
    glyph_range,
    r3,
    run_matrix,
    strict_overlap,
    turned_extent,
    turned_glyph_range,
)
from quirewise.functions.patterns import all_matches, blank_all, compile_patterns
from quirewise.model import ADVANCE, FONT_SIZE, MARGIN
from quirewise.operators.spread import spread_join
from quirewise.sources.corpus import baseline

# Cell sizes for joins inside a page: characters of text, points of height.
TEXT_CELL = 512
LAST_TEXT_CELL = 2**31 // TEXT_CELL
BAND = 36
LAST_BAND = 400

def pii_spans(doc_pages: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """All matches per page and pattern with character positions from 0, end exclusive. No shuffle."""
    compiled = compile_patterns(patterns)
    if not compiled:
        raise ValueError("no patterns given")

    matches = all_matches(F.col("text"), compiled)
    start, length = F.col("_m.lo"), F.col("_m.hi") - F.col("_m.lo")
    return doc_pages.select("doc_id", "page", "text", F.explode(matches).alias("_m")).select(
        "doc_id",
        "page",
        "_m.pattern",
        start.cast("bigint").alias("start"),
        F.col("_m.hi").cast("bigint").alias("end"),
        F.substr("text", start + 1, length).alias("match"),
    )


def _cells(low: Column, high: Column, width: int, last: int) -> Column:
    """Cells of ``width`` that an extent meets, as an array; what lies outside falls into the end cells."""
    cell = lambda v: F.least(F.greatest(F.floor(v / F.lit(float(width))), F.lit(-1)), F.lit(last))
    return F.sequence(cell(low), F.greatest(cell(low), cell(high)))


def match_boxes(matches: DataFrame, spans: DataFrame) -> DataFrame:
    """One area per match: the bounds of its glyphs. A match that covers no glyph gives none.

    ``spans`` needs ``char_start``. Matches meet runs by stretches of the page text, so a page with many of both does
    not pair them all.
    """
    advance = F.col("font_size") * F.lit(ADVANCE)
    length = F.length("text")
    start, end, at = F.col("start"), F.col("end"), F.col("char_start")
    runs = spans.where(length > 0).select(
        "doc_id",
        "page",
        "char_start",
        length.alias("_len"),
        "x",
        "y",
        "font_size",
        F.explode(_cells(at, at + length - 1, TEXT_CELL, LAST_TEXT_CELL)).alias("_cell"),
    )
    hits = matches.where(end > start).select(
        "doc_id",
        "page",
        "pattern",
        "start",
        "end",
        F.explode(_cells(start, end - 1, TEXT_CELL, LAST_TEXT_CELL)).alias("_cell"),
    )
    first = F.greatest(start - at, F.lit(0))
    past = F.least(end - at, F.col("_len"))
    # A pair that meets in two cells changes no minimum and no maximum.
    bounds = (
        hits.join(runs, ["doc_id", "page", "_cell"])
        .where((at < end) & (at + F.col("_len") > start))
        .groupBy("doc_id", "page", "pattern", "start", "end")
        .agg(
            F.min(F.col("x") + first * advance).alias("_x0"),
            F.max(F.col("x") + past * advance).alias("_x1"),
            F.min("y").alias("_y0"),
            F.max(F.col("y") + F.col("font_size")).alias("_y1"),
        )
    )
    return bounds.select(
        "doc_id",
        "page",
        "pattern",
        "start",
        "end",
        r3(F.col("_x0")).alias("x"),
        r3(F.col("_y0")).alias("y"),
        r3(F.col("_x1") - F.col("_x0")).alias("width"),
        r3(F.col("_y1") - F.col("_y0")).alias("height"),
    )


def redact_areas(spans: DataFrame, areas: DataFrame) -> DataFrame:
    """Blank every glyph whose box overlaps an area of its page; touching edges do not count.

    An area without width or height that lies inside a glyph blanks it as well. Runs may carry a ``matrix`` of six numbers
    that turns, scales or shears their glyphs and places them on the page; where it is null, or lacks a number, the run
    stands upright at its origin.

    Areas meet runs by horizontal bands of the page, spread over tasks where a band holds very many. An area meets a
    run in one range of glyphs; ranges shrink to the longest per first glyph before they are gathered, so a run never
    gathers more ranges than it has glyphs, however many areas a page has.
    """
    key = ["doc_id", "page", "span"]
    advance = F.col("font_size") * F.lit(ADVANCE)
    top = F.col("y") + F.col("font_size")
    band = lambda low, high: F.explode(_cells(low, high, BAND, LAST_BAND)).alias("_band")
    turned = "matrix" in spans.columns
    if turned:
        # A turned run stands in the bands of its bounds; the axes decide.
        placed = spans.withColumn("_m", run_matrix(F.col("matrix"), F.col("x"), F.col("y")))
        extent = turned_extent(F.col("_m"), F.length("text") * advance, F.col("font_size"))
        placed = placed.withColumn("_e", extent).withColumns({"_low": F.col("_e.low"), "_high": F.col("_e.high")})
    else:
        placed = spans.withColumns({"_low": F.col("y"), "_high": top})
    runs = placed.where(F.length("text") > 0).select(
        *key, F.length("text").alias("_len"), "x", "_low", "_high", "font_size", *["_m"][: int(turned)], band(F.col("_low"), F.col("_high"))
    )
    low, high = F.col("y"), F.col("y") + F.col("height")
    boxes = areas.select(
        "doc_id",
        "page",
        F.col("x").alias("_bx0"),
        (F.col("x") + F.col("width")).alias("_bx1"),
        F.col("y").alias("_by0"),
        (F.col("y") + F.col("height")).alias("_by1"),
        band(F.least(low, high), F.greatest(low, high)),
    )
    if turned:
        box = tuple(F.col(c) for c in ("_bx0", "_by0", "_bx1", "_by1"))
        found = turned_glyph_range(F.col("_m"), advance, F.col("font_size"), F.col("_len"), box)
    else:
        found = glyph_range(F.col("x"), advance, F.col("_len"), F.col("_bx0"), F.col("_bx1"))
    hits = (
        spread_join(boxes, runs, ["doc_id", "page", "_band"], salt_by=["_bx0", "_by0", "_bx1", "_by1"])
        .where(strict_overlap(F.col("_low"), F.col("_high"), F.col("_by0"), F.col("_by1")))
        .select(*key, found.alias("_r"))
        .where("_r.lo < _r.hi")
    )
    ranges = (
        hits.groupBy(*key, F.col("_r.lo").alias("lo"))
        .agg(F.max("_r.hi").alias("hi"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))
    )
    redacted = F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(
        blank_ranges(F.col("text"), F.col("_ranges"))
    )
    return spans.join(ranges, key, "left").withColumn("text", redacted).drop("_ranges")


def area_errors(areas: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Areas on pages that do not exist, each with its error."""
    missing = areas.join(doc_pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    return missing.withColumn("error", F.concat(F.lit("page "), F.col("page"), F.lit(" does not exist")))


def auto_redact(doc_pages: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Match, box and blank in one pass over the page row, without a shuffle; returns the runs of every page.

    A match becomes one box, so text that merely lies inside the box goes too.
    """
    compiled = compile_patterns(patterns)
    advance = FONT_SIZE * ADVANCE
    rise = F.lit(FONT_SIZE)
    matches = all_matches(F.col("text"), compiled)

    def bounds(match: Column, lines: Column, starts: Column) -> Column:
        """Bounds of the glyphs of one match over the lines it touches; null if it touches none."""
        touched = F.filter(
            indices(F.size(lines)),
            lambda i: (F.get(starts, i) < match["hi"])
            & (F.get(starts, i) + F.length(F.get(lines, i)) > match["lo"]),
        )

        def box(rows: Column) -> Column:
            left = F.array_min(F.transform(rows, lambda i: F.greatest(match["lo"] - F.get(starts, i), F.lit(0))))
            right = F.array_max(
                F.transform(rows, lambda i: F.least(match["hi"] - F.get(starts, i), F.length(F.get(lines, i))))
            )
            return F.when(
                F.size(rows) > 0,
                F.struct(
                    (F.lit(MARGIN) + left * F.lit(advance)).alias("x0"),
                    (F.lit(MARGIN) + right * F.lit(advance)).alias("x1"),
                    baseline(F.array_max(rows)).alias("y0"),
                    (baseline(F.array_min(rows)) + rise).alias("y1"),
                ),
            )

        return let(touched, box)

    def blanked(boxes: Column, lines: Column) -> Column:
        def one_line(line: Column, i: Column) -> Column:
            near = F.filter(
                boxes, lambda b: strict_overlap(baseline(i), baseline(i) + rise, b["y0"], b["y1"])
            )
            ranges = F.filter(
                F.transform(
                    near, lambda b: glyph_range(F.lit(MARGIN), F.lit(advance), F.length(line), b["x0"], b["x1"])
                ),
                lambda r: r["lo"] < r["hi"],
            )
            return blank_ranges(line, ranges)

        return F.transform(lines, one_line)

    def redacted(found: Column) -> Column:
        def with_lines(lines: Column) -> Column:
            def with_starts(starts: Column) -> Column:
                boxes = F.filter(F.transform(found, lambda m: bounds(m, lines, starts)), lambda b: b.isNotNull())
                return let(boxes, lambda bs: blanked(bs, lines))

            return let(prefix_sums(F.transform(lines, lambda line: F.length(line) + 1)), with_starts)

        return F.when(F.size(found) == 0, F.split("text", "\n")).otherwise(let(F.split("text", "\n"), with_lines))

    return (
        doc_pages.select("doc_id", "page", F.posexplode(let(matches, redacted)).alias("_pos", "text"))
        .select(
            "doc_id",
            "page",
            F.col("_pos").cast("bigint").alias("span"),
            "text",
            F.lit(MARGIN).alias("x"),
            baseline(F.col("_pos")).alias("y"),
            F.lit(FONT_SIZE).alias("font_size"),
        )
    )


def pii_mask(df: DataFrame, patterns: Sequence[str], column: str = "text") -> DataFrame:
    """Blank exactly the matched characters of a text column: the union over all patterns. No shuffle."""
    return df.withColumn(column, blank_all(F.col(column), compile_patterns(patterns)))


def search_text(doc_pages: DataFrame, spans: DataFrame, query: str) -> DataFrame:
    """Page, box and text of each hit of a literal."""
    hits = pii_spans(doc_pages, [f"text:{query}"])
    return match_boxes(hits, spans).withColumn("match", F.lit(query)).drop("pattern")

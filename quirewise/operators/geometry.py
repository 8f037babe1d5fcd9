"""Operators on page boxes and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.functions.geometry import box_size, r3, strict_overlap
from quirewise.model import ADVANCE, PAGE_HEIGHT, PAGE_WIDTH
from quirewise.operators.tree import climb

def page_size(nodes: DataFrame) -> DataFrame:
    """Width and height of every page from the nearest well-formed box on the way to the root.

    Only inner nodes, few beside the pages, climb the tree; pages join them once. A page whose nodes hang in a ring has
    no size but an ``error``; all other pages are not touched by it.
    """
    inner = nodes.where("page is null").select(
        "doc_id", "node_id", "parent_id", box_size(F.col("media_box")).alias("size")
    )
    start = inner.select("doc_id", "node_id", F.when(F.col("size").isNull(), F.col("parent_id")).alias("_at"), "size")

    def merge(pending: DataFrame, known: DataFrame) -> DataFrame:
        above = known.select(
            "doc_id", F.col("node_id").alias("_at"), F.col("_at").alias("_up"), F.col("size").alias("_above")
        )
        return pending.drop("size").join(above, ["doc_id", "_at"], "left").select(
            "doc_id", "node_id", F.col("_up").alias("_at"), F.col("_above").alias("size")
        )

    known = climb(start, merge, "inner-nodes").select("doc_id", "node_id", "size", F.col("_at").isNotNull().alias("_ring"))
    pages = nodes.where("page is not null").select(
        "doc_id", "page", F.col("parent_id").alias("node_id"), box_size(F.col("media_box")).alias("_own")
    )
    default = F.struct(F.lit(PAGE_WIDTH).alias("w"), F.lit(PAGE_HEIGHT).alias("h"))
    lost = F.col("_own").isNull() & F.coalesce("_ring", F.lit(False))
    size = F.when(~lost, F.coalesce("_own", "size", default))
    return (
        pages.join(known, ["doc_id", "node_id"], "left")
        .select("doc_id", "page", size.alias("_s"), F.when(lost, F.lit("the page tree has a ring")).alias("error"))
        .select("doc_id", "page", r3(F.col("_s.w")).alias("width"), r3(F.col("_s.h")).alias("height"), "error")
    )


def rotate_pages(nodes: DataFrame, angle: int) -> DataFrame:
    """Add an angle to the rotation of every page, kept within 0 to 359."""
    if angle % 90 != 0:
        raise ValueError(f"pages turn by quarters, not by {angle} degrees")
    turned = F.pmod(F.coalesce("rotate", F.lit(0)) + F.lit(angle), F.lit(360)).cast("bigint")
    return nodes.where("page is not null").withColumn("rotate", turned)


def scale_pages(nodes: DataFrame, sx: float, sy: float) -> DataFrame:
    """Scale the own box of every page; a page that inherits its box keeps it so."""
    factors = (sx, sy, sx, sy)
    defaults = (0.0, 0.0, PAGE_WIDTH, PAGE_HEIGHT)
    scaled = F.array(
        *[
            r3(F.coalesce(F.get("media_box", i), F.lit(default)) * F.lit(float(factor)))
            for i, (default, factor) in enumerate(zip(defaults, factors))
        ]
    )
    return nodes.where("page is not null").withColumn(
        "media_box", F.when(F.col("media_box").isNotNull(), scaled)
    )


def scale_spans(spans: DataFrame, sx: float, sy: float) -> DataFrame:
    """Content moves with its page."""
    return spans.withColumns({"x": r3(F.col("x") * F.lit(float(sx))), "y": r3(F.col("y") * F.lit(float(sy)))})


def crop_pages(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Set one crop box on every page; the content stays."""
    box = F.array(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])
    return nodes.where("page is not null").withColumn("crop_box", box)


def crop_visibility(spans: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Which runs show inside a crop box; touching its edge is not enough."""
    right = F.col("x") + F.length("text") * F.col("font_size") * F.lit(ADVANCE)
    lit = lambda v: F.lit(float(v))
    shown = strict_overlap(F.col("x"), right, lit(x0), lit(x1)) & strict_overlap(
        F.col("y"), F.col("y") + F.col("font_size"), lit(y0), lit(y1)
    )
    return spans.withColumn("visible", shown)

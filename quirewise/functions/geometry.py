"""Scalar geometry: boxes, glyph positions and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewise.functions.expr import let
from quirewise.model import ADVANCE, MARGIN


def num(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def r3(col: Column) -> Column:
    """Three digits, as coordinates are written."""
    return F.round(col, 3)


def text_width(text: Column, font_size: Column) -> Column:
    return F.length(text) * font_size * F.lit(ADVANCE)


def strict_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Open intervals overlap; touching edges do not."""
    return (a0 < b1) & (a1 > b0)


def box_size(box: Column) -> Column:
    """(width, height) of a well-formed box, else null."""
    ok = (F.size(box) >= 4) & F.forall(F.slice(box, 1, 4), lambda v: v.isNotNull())
    return F.when(
        ok,
        F.struct(
            (F.get(box, 2) - F.get(box, 0)).alias("w"),
            (F.get(box, 3) - F.get(box, 1)).alias("h"),
        ),
    )


def glyph_range(x: Column, advance: Column, length: Column, left: Column, right: Column) -> Column:
    """Half-open range of glyph indices of a run that a horizontal extent hits, as a struct (lo, hi).

    Glyph i covers ``x + i * advance`` to ``x + (i + 1) * advance``. The quotients only guess the ends; the
    comparisons settle them, so the result equals a glyph-by-glyph test.
    """

    def first_hit(edge: Column) -> Column:
        # smallest i with x + (i + 1) * advance > edge
        return let(
            F.floor((edge - x) / advance),
            lambda i: i
            + F.when(x + (i + 1) * advance <= edge, 1).when(x + i * advance > edge, -1).otherwise(0),
        )

    def past_hit(edge: Column) -> Column:
        # smallest i with x + i * advance >= edge
        return let(
            F.ceil((edge - x) / advance),
            lambda i: i
            + F.when(x + i * advance < edge, 1).when(x + (i - 1) * advance >= edge, -1).otherwise(0),
        )

    lo = F.greatest(first_hit(left), F.lit(0)).cast("int")
    hi = F.least(past_hit(right), length).cast("int")
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def run_matrix(matrix: Column, x: Column, y: Column) -> Column:
    """The matrix ``[a, b, c, d, e, f]`` of a run, or plain placement at its origin if there is none."""
    ok = (F.size(matrix) >= 6) & F.forall(F.slice(matrix, 1, 6), lambda v: v.isNotNull())
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(F.coalesce(ok, F.lit(False)), F.slice(matrix, 1, 6)).otherwise(F.array(one, zero, zero, one, x, y))


def turned_extent(m: Column, width: Column, height: Column) -> Column:
    """Lowest and highest y of a box at the origin under a matrix, as a struct (low, high)."""
    b, d, f = F.get(m, 1) * width, F.get(m, 3) * height, F.get(m, 5)
    zero = F.lit(0.0)
    return F.struct(
        (f + F.least(zero, b) + F.least(zero, d)).alias("low"), (f + F.greatest(zero, b) + F.greatest(zero, d)).alias("high")
    )


def turned_glyph_range(m: Column, advance: Column, height: Column, length: Column, box: tuple[Column, ...]) -> Column:
    """Half-open range of glyphs of a turned, scaled or sheared run that an upright area overlaps, as a struct (lo, hi).

    Glyph i is the image of ``i * advance .. (i + 1) * advance`` by ``0 .. height``. It overlaps the area if their shadows
    overlap on the axes of the area and on the normals of its own sides. Every shadow moves evenly with i, so each axis
    allows one range of glyphs. Quotients guess its ends and the comparisons settle them, so the result equals a
    glyph-by-glyph test. Touching shadows do not overlap, and a run that the matrix flattens to a line is never hit.
    """
    a, b, c, d, e, f = (F.get(m, i) for i in range(6))
    x0, y0, x1, y1 = box
    zero = F.lit(0.0)

    def allowed(nx: Column, ny: Column) -> Column:
        def ends(n: Column) -> Column:
            step, rise = advance * (n["x"] * a + n["y"] * b), height * (n["x"] * c + n["y"] * d)
            low = n["x"] * e + n["y"] * f + F.least(zero, step) + F.least(zero, rise)
            left = F.least(n["x"] * x0, n["x"] * x1) + F.least(n["y"] * y0, n["y"] * y1)
            right = F.greatest(n["x"] * x0, n["x"] * x1) + F.greatest(n["y"] * y0, n["y"] * y1)
            return F.struct(step.alias("step"), low.alias("low"), (low + F.abs(step) + F.abs(rise)).alias("high"), left.alias("left"), right.alias("right"))

        def span(s: Column) -> Column:
            before = lambda i: s["low"] + i * s["step"] < s["right"]
            after = lambda i: s["high"] + i * s["step"] > s["left"]

            def first(test, edge: Column, start: Column) -> Column:
                """The smallest i for which a test that turns true once is true."""
                return let(
                    F.floor((edge - start) / s["step"]),
                    lambda i: F.when(test(i - 1), i - 1).when(test(i), i).when(test(i + 1), i + 1).otherwise(i + 2),
                )

            rising = F.struct(
                first(after, s["left"], s["high"]).alias("lo"), first(lambda i: ~before(i), s["right"], s["low"]).alias("hi")
            )
            falling = F.struct(
                first(before, s["right"], s["low"]).alias("lo"), first(lambda i: ~after(i), s["left"], s["high"]).alias("hi")
            )
            far = F.lit(2**31 - 1).cast("bigint")
            still = F.when(before(zero) & after(zero), F.struct(F.lit(0).cast("bigint").alias("lo"), far.alias("hi")))
            none = F.struct(far.alias("lo"), F.lit(0).cast("bigint").alias("hi"))
            return F.when(s["step"] > 0, rising).when(s["step"] < 0, falling).otherwise(F.coalesce(still, none))

        return let(let(F.struct(nx.alias("x"), ny.alias("y")), ends), span)

    axes = [(F.lit(1.0), zero), (zero, F.lit(1.0)), (-b, a), (-d, c)]
    ranges = F.array(*[allowed(*axis) for axis in axes])

    def common(r: Column) -> Column:
        lo = F.greatest(F.array_max(F.transform(r, lambda s: s["lo"])), F.lit(0))
        hi = F.least(F.array_min(F.transform(r, lambda s: s["hi"])), length)
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    return let(ranges, common)


def blank_range(text: Column, lo: Column, hi: Column) -> Column:
    """Replace the characters lo..hi (half-open, from 0) by spaces."""
    return F.concat(
        F.substr(text, F.lit(1), lo),
        F.repeat(F.lit(" "), hi - lo),
        F.substr(text, hi + 1),
    )


def blank_ranges(text: Column, ranges: Column) -> Column:
    """Blank every (lo, hi) of an array of ranges."""
    return F.aggregate(ranges, text, lambda acc, r: blank_range(acc, r["lo"], r["hi"]))


def place_label(position: str, page_w: Column, page_h: Column, width: Column, font_size: float) -> tuple[Column, Column]:
    """Origin of a label on a page; an unknown position means bottom-center."""
    known = position in ("bottom-left", "bottom-right", "top-left", "top-center", "top-right")
    row, _, side = (position if known else "bottom-center").partition("-")
    x = {
        "left": F.lit(MARGIN),
        "center": (page_w - width) / 2,
        "right": page_w - F.lit(MARGIN) - width,
    }[side]
    y = F.lit(MARGIN) if row == "bottom" else page_h - F.lit(MARGIN) - F.lit(float(font_size))
    return x, y


def corners_to_area(x0: Column, y0: Column, x1: Column, y1: Column, image_height: Column, dpi: float) -> Column:
    """Two drawn pixel corners in any order to an area in points; null when a side is under one point."""
    k = 72.0 / dpi
    width = (F.greatest(x0, x1) - F.least(x0, x1)) * k
    height = (F.greatest(y0, y1) - F.least(y0, y1)) * k
    return F.when(
        (width >= 1) & (height >= 1),
        F.struct(
            (F.least(x0, x1) * k).alias("x"),
            (image_height * k - F.greatest(y0, y1) * k).alias("y"),
            width.alias("width"),
            height.alias("height"),
        ),
    )


def affine_apply(m: Column, x: Column, y: Column) -> Column:
    """Apply the matrix ``[a, b, c, d, e, f]`` to a point."""
    a, b, c, d, e, f = (F.get(m, i) for i in range(6))
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def affine_compose(first: Column, then: Column) -> Column:
    """The matrix that applies ``first`` and then ``then``."""
    a, b, c, d, e, f = (F.get(first, i) for i in range(6))
    p, q, r, s, t, u = (F.get(then, i) for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)

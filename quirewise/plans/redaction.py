"""Page geometry and redaction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.functions.patterns import NAMED_PATTERNS
from quirewise.operators import geometry as geo
from quirewise.operators import literals
from quirewise.operators import redact as ops
from quirewise.plans.tables import NODES, PAGES, SIZES, SPANS, Tables, query, with_

PATTERNS = list(NAMED_PATTERNS)
QUERY = "on the"
#: User patterns and the same for the SQL twin.
CUSTOM = {
    "regex:(?i)licensed? under": "(?i)licensed? under",
    r"regex:\p{Lu}\p{L}{11,}": r"\p{Lu}\p{L}{11,}",
    "regex:[[:alpha:]]+[.!]+$": "[[:alpha:]]+[.!]+$",
    "text:.com": r"\.com",
}
ANGLE = -450
#: Over six hundred literals by a rule: all runs of four syllables.
SYLLABLES = ("th", "er", "an", "in", "on")
LITERALS = ["".join(run) for run in itertools.product(SYLLABLES, repeat=4)] + ["on the", "tion", ".com"]


def _areas(t: Tables) -> DataFrame:
    """A column and a line of areas on every page; their place moves with the page number."""
    page = F.col("page").cast("double")

    def area(x, y, width: float, height: float):
        return F.struct(
            x.alias("x"), y.alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height")
        )

    both = F.array(
        area(F.lit(24.0) + page * 6, F.lit(700.0), 30.0, 60.0), area(F.lit(100.0) + page, F.lit(744.0), 45.5, 8.0)
    )
    return t.doc_pages.select("doc_id", "page", F.explode(both).alias("_a")).select("doc_id", "page", "_a.*")


def _turned(t: Tables) -> DataFrame:
    """Runs of which three in four are turned, scaled, or mirrored and sheared."""
    matrix = lambda *m: F.array(*[v if not isinstance(v, float) else F.lit(v) for v in m])
    x, y, kind = F.col("x"), F.col("y"), F.col("doc_id") % 4
    turned = F.when(kind == 0, matrix(0.8, 0.6, -0.6, 0.8, x, y - 60.0)).when(kind == 1, matrix(0.0, -1.5, 1.5, 0.0, x, y))
    turned = turned.when(kind == 2, matrix(-1.0, 0.0, 0.25, 0.5, x + 300.0, y))
    return t.spans.withColumn("matrix", turned)


QUERIES = {
    "page_size": query(lambda t: t.page_sizes),
    "rotate_pages": query(lambda t: geo.rotate_pages(t.page_nodes, ANGLE).select("doc_id", "page", "rotate")),
    "scale_pages": query(
        lambda t: geo.scale_pages(t.page_nodes, 0.5, 1.25).select(
            "doc_id", "page", F.array_join(F.col("media_box").cast("array<string>"), ",").alias("media_box")
        )
    ),
    "scale_spans": query(
        lambda t: geo.scale_spans(t.spans, 0.5, 1.25).select("doc_id", "page", "span", "x", "y")
    ),
    "crop_pages": query(
        lambda t: geo.crop_pages(t.page_nodes, 20, 720, 300, 760).select(
            "doc_id", "page", F.array_join(F.col("crop_box").cast("array<string>"), ",").alias("crop_box")
        )
    ),
    "crop_visibility": query(
        lambda t: geo.crop_visibility(t.spans, 30, 732, 300, 760).select("doc_id", "page", "span", "visible")
    ),
    "pii_spans": query(lambda t: ops.pii_spans(t.doc_pages, PATTERNS)),
    "pii_spans_custom": query(lambda t: ops.pii_spans(t.doc_pages, list(CUSTOM))),
    "literal_spans": query(lambda t: literals.literal_spans(t.doc_pages, LITERALS)),
    "literal_mask": query(lambda t: literals.literal_mask(t.doc_pages, LITERALS).select("doc_id", "page", "text")),
    "match_boxes": query(lambda t: ops.match_boxes(ops.pii_spans(t.doc_pages, PATTERNS), t.spans)),
    "redact_areas": query(
        lambda t: ops.redact_areas(t.spans, _areas(t)).select("doc_id", "page", "span", "text")
    ),
    "redact_turned": query(
        lambda t: ops.redact_areas(_turned(t), _areas(t)).select("doc_id", "page", "span", "text")
    ),
    "auto_redact": query(lambda t: ops.auto_redact(t.doc_pages, PATTERNS).select("doc_id", "page", "span", "text")),
    "pii_mask": query(lambda t: ops.pii_mask(t.doc_pages, PATTERNS).select("doc_id", "page", "text")),
    "search_text": query(lambda t: ops.search_text(t.doc_pages, t.spans, QUERY)),
}


def _matches(name: str, pattern: str) -> str:
    """Matches of one pattern by cutting the page text at marks set around them."""
    marked = rf"regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(2), 'g')"
    return rf"""SELECT doc_id, page, '{name}' AS pattern, ends - length(piece) AS start, ends AS "end", piece AS match
  FROM (SELECT doc_id, page, i, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, page ORDER BY i) AS BIGINT) AS ends
        FROM (SELECT doc_id, page, unnest(p) AS piece, unnest(generate_series(1, len(p))) AS i
              FROM (SELECT doc_id, page, string_split_regex({marked}, '[\x01\x02]') AS p FROM doc_pages)))
  WHERE i % 2 = 0 AND length(piece) > 0"""


def matches_cte(patterns: dict[str, str]) -> str:
    return "\nmatches AS (\n  " + "\n  UNION ALL\n  ".join(_matches(n, p) for n, p in patterns.items()) + ")"


BOXES = """
boxes AS (
  SELECT m.doc_id, m.page, pattern, start, "end",
         min(s.x + greatest(start - char_start, 0) * 6) AS x0,
         max(s.x + least("end" - char_start, length(s.text)) * 6) AS x1, min(s.y) AS y0, max(s.y + 12) AS y1
  FROM matches m JOIN spans s ON s.doc_id = m.doc_id AND s.page = m.page
   AND s.char_start < "end" AND s.char_start + length(s.text) > start
  GROUP BY ALL)"""

BLANKED = """
hits AS (
  SELECT s.doc_id, s.page, s.span, list({'x0': b.x0, 'x1': b.x1}) AS bs
  FROM spans s JOIN boxes b ON b.doc_id = s.doc_id AND b.page = s.page AND s.y < b.y1 AND s.y + 12 > b.y0
  GROUP BY ALL)"""

REDACTED = """SELECT s.doc_id, s.page, s.span, CASE WHEN bs IS NULL THEN text ELSE array_to_string(list_transform(
  string_split(text, ''), lambda c, i: CASE WHEN len(list_filter(bs, lambda b: b.x0 < 24 + i * 6 AND b.x1 > 18 + i * 6)) > 0
  THEN ' ' ELSE c END), '') END AS text
FROM spans s LEFT JOIN hits h USING (doc_id, page, span)"""


def _mask(pattern: str) -> str:
    return (
        rf"string_split(array_to_string(list_transform(string_split_regex(regexp_replace(text, '({pattern})', "
        rf"chr(1) || '\1' || chr(2), 'g'), '[\x01\x02]'), lambda v, i: CASE WHEN i % 2 = 0 THEN repeat(' ', length(v)) "
        r"ELSE v END), ''), '')"
    )


def mask_sql(source: str) -> str:
    """Masks of all patterns, blank where any is blank."""
    masks = ", ".join(f"{_mask(p)} AS m{i}" for i, p in enumerate(NAMED_PATTERNS.values()))
    blank = " OR ".join(f"m{i}[k] = ' '" for i in range(len(NAMED_PATTERNS)))
    return f"""SELECT doc_id, page, array_to_string(list_transform(m0, lambda c, k: CASE WHEN {blank} THEN ' ' ELSE c END), '')
  AS text FROM (SELECT doc_id, page, {masks} FROM {source})"""


def _shadow(n: str) -> str:
    """Whether the shadows of glyph i and of an area overlap on the axis ``n``."""
    step, rise = f"(6 * ({n}.x * a + {n}.y * b))", f"(12 * ({n}.x * c + {n}.y * d))"
    low = f"({n}.x * e + {n}.y * f + least(0, {step}) + least(0, {rise}))"
    left = f"(least({n}.x * x0, {n}.x * x1) + least({n}.y * y0, {n}.y * y1))"
    return (
        f"{low} + i * {step} < greatest({n}.x * x0, {n}.x * x1) + greatest({n}.y * y0, {n}.y * y1) "
        f"AND {low} + abs({step}) + abs({rise}) + i * {step} > {left}"
    )


# Each literal cuts the text by itself; what lies before a piece tells where it starts.
LITERAL_HITS = """
syllables AS (SELECT unnest(['th', 'er', 'an', 'in', 'on']) AS s),
literals AS (
  SELECT a.s || b.s || c.s || d.s AS literal FROM syllables a, syllables b, syllables c, syllables d
  UNION ALL SELECT unnest(['on the', 'tion', '.com'])),
cut AS (
  SELECT doc_id, page, literal, string_split(text, literal) AS parts
  FROM doc_pages JOIN literals ON contains(text, literal)),
hits AS (
  SELECT doc_id, page, literal,
    CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(literal) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM cut))"""

AREAS = """
boxes AS (
  SELECT doc_id, page, 24.0 + page * 6 AS x0, 54.0 + page * 6 AS x1, 700.0 AS y0, 760.0 AS y1 FROM doc_pages
  UNION ALL SELECT doc_id, page, 100.0 + page, 145.5 + page, 744.0, 752.0 FROM doc_pages)"""

ORACLES = {
    "page_size": with_(SIZES) + "SELECT * FROM page_sizes",
    "rotate_pages": with_(NODES)
    + f"""SELECT doc_id, page, ((coalesce(rotate, 0) + ({ANGLE})) % 360 + 360) % 360 AS rotate
FROM page_nodes WHERE page IS NOT NULL""",
    "scale_pages": with_(NODES)
    + """SELECT doc_id, page, CASE WHEN media_box IS NULL THEN NULL ELSE concat_ws(',',
  (coalesce(media_box[1], 0) * 0.5)::DOUBLE::VARCHAR, (coalesce(media_box[2], 0) * 1.25)::DOUBLE::VARCHAR,
  (coalesce(media_box[3], 612) * 0.5)::DOUBLE::VARCHAR, (coalesce(media_box[4], 792) * 1.25)::DOUBLE::VARCHAR) END
  AS media_box FROM page_nodes WHERE page IS NOT NULL""",
    "scale_spans": with_(SPANS)
    + "SELECT doc_id, page, span, (x * 0.5)::DOUBLE AS x, round(y * 1.25, 3)::DOUBLE AS y FROM spans",
    "crop_pages": with_(PAGES) + "SELECT doc_id, page, '20.0,720.0,300.0,760.0' AS crop_box FROM doc_pages",
    "crop_visibility": with_(SPANS)
    + """SELECT doc_id, page, span, x < 300 AND x + length(text) * 6 > 30 AND y < 760 AND y + 12 > 732 AS visible
FROM spans""",
    "pii_spans": with_(PAGES, matches_cte(NAMED_PATTERNS)) + "SELECT * FROM matches",
    "pii_spans_custom": with_(PAGES, matches_cte(CUSTOM)) + "SELECT * FROM matches",
    "literal_spans": with_(PAGES, LITERAL_HITS)
    + """SELECT doc_id, page, 'text:' || literal AS pattern, start, start + length(literal) AS "end", literal AS match FROM hits""",
    "literal_mask": with_(
        PAGES,
        LITERAL_HITS,
        """
gone AS (SELECT doc_id, page, list(DISTINCT k) AS ks
  FROM (SELECT doc_id, page, unnest(range(start, start + length(literal))) AS k FROM hits) GROUP BY ALL)""",
    )
    + """SELECT p.doc_id, p.page, CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_transform(string_split(text, ''),
  lambda c, i: CASE WHEN list_contains(ks, i - 1) THEN ' ' ELSE c END), '') END AS text
FROM doc_pages p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.page = p.page""",
    "match_boxes": with_(SPANS, matches_cte(NAMED_PATTERNS), BOXES)
    + """SELECT doc_id, page, pattern, start, "end", x0::DOUBLE AS x, y0::DOUBLE AS y, (x1 - x0)::DOUBLE AS width,
  (y1 - y0)::DOUBLE AS height FROM boxes""",
    "redact_areas": with_(
        SPANS,
        AREAS,
        BLANKED,
    )
    + REDACTED,
    # Every glyph of every run against every area of its page, on all four axes.
    "redact_turned": with_(
        SPANS,
        AREAS,
        """
matrices AS (
  SELECT doc_id, page, span, text, CASE doc_id % 4 WHEN 0 THEN [0.8, 0.6, -0.6, 0.8, x, y - 60]::DOUBLE[]
    WHEN 1 THEN [0, -1.5, 1.5, 0, x, y]::DOUBLE[] WHEN 2 THEN [-1, 0, 0.25, 0.5, x + 300, y]::DOUBLE[]
    ELSE [1, 0, 0, 1, x, y]::DOUBLE[] END AS m
  FROM spans),
glyphs AS (
  SELECT doc_id, page, span, unnest(range(length(text)))::DOUBLE AS i, m[1] AS a, m[2] AS b, m[3] AS c, m[4] AS d, m[5] AS e,
    m[6] AS f FROM matrices),
hit AS (
  SELECT DISTINCT g.doc_id, g.page, g.span, i::BIGINT AS i
  FROM glyphs g JOIN (SELECT doc_id, page, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM boxes) r
    ON r.doc_id = g.doc_id AND r.page = g.page
  WHERE len(list_filter([{'x': 1::DOUBLE, 'y': 0::DOUBLE}, {'x': 0, 'y': 1}, {'x': -b, 'y': a}, {'x': -d, 'y': c}], lambda n: """
        + _shadow("n")
        + """)) = 4),
gone AS (SELECT doc_id, page, span, list(i) AS blanks FROM hit GROUP BY ALL)""",
    )
    + """SELECT s.doc_id, s.page, s.span, CASE WHEN blanks IS NULL THEN text ELSE array_to_string(list_transform(
  string_split(text, ''), lambda c, k: CASE WHEN list_contains(blanks, k - 1) THEN ' ' ELSE c END), '') END AS text
FROM spans s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.page = s.page AND g.span = s.span""",
    "auto_redact": with_(SPANS, matches_cte(NAMED_PATTERNS), BOXES, BLANKED) + REDACTED,
    "pii_mask": with_(PAGES) + mask_sql("doc_pages"),
    "search_text": with_(SPANS, matches_cte({"q": QUERY}), BOXES)
    + f"""SELECT doc_id, page, start, "end", x0::DOUBLE AS x, y0::DOUBLE AS y, (x1 - x0)::DOUBLE AS width,
  (y1 - y0)::DOUBLE AS height, '{QUERY}' AS match FROM boxes""",
}

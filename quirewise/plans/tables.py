"""The derived tables a query starts from, and the same derivations in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quirewise.operators import geometry, metadata
from quirewise.session import prepare
from quirewise.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Lazy tables of one corpus folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = prepare(spark)
        self.root = root

    @cached_property
    def documents(self) -> DataFrame:
        return corpus.read_corpus(self.spark, self.root, "documents", spread_by="doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return corpus.read_corpus(self.spark, self.root, "pages", spread_by="page_id")

    @cached_property
    def events(self) -> DataFrame:
        return corpus.read_corpus(self.spark, self.root, "events")

    @cached_property
    def orders(self) -> DataFrame:
        return corpus.read_corpus(self.spark, self.root, "orders")

    @cached_property
    def doc_pages(self) -> DataFrame:
        return corpus.paginate(self.documents)

    @cached_property
    def spans(self) -> DataFrame:
        return corpus.layout_spans(self.doc_pages, with_offsets=True)

    @cached_property
    def page_nodes(self) -> DataFrame:
        return corpus.page_nodes(self.documents)

    @cached_property
    def page_sizes(self) -> DataFrame:
        return geometry.page_size(self.page_nodes).drop("error")

    @cached_property
    def resources(self) -> DataFrame:
        return corpus.resources(self.pages)

    @cached_property
    def doc_meta(self) -> DataFrame:
        return metadata.metadata_extract(self.pages)

    @cached_property
    def annotations(self) -> DataFrame:
        return corpus.annotations(self.doc_pages)

    @cached_property
    def form_nodes(self) -> DataFrame:
        return corpus.form_nodes(
            *[corpus.read_corpus(self.spark, self.root, name) for name in ("region", "nation", "customer")]
        )

    @cached_property
    def history(self) -> DataFrame:
        return corpus.history(self.events)


def query(make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, root: make(Tables(spark, root))


# SQL twins of the derivations, as common table expressions.
LINES = """
doc_lines AS (
  SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS ln, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"""

PAGES = LINES + """,
doc_pages AS (
  SELECT doc_id, CAST(ln // 4 + 1 AS BIGINT) AS page, string_agg(line, chr(10) ORDER BY ln) AS text
  FROM doc_lines GROUP BY ALL),
page_totals AS (SELECT doc_id, count(*) AS n_pages FROM doc_pages GROUP BY ALL)"""

SPANS = PAGES + """,
spans AS (
  SELECT doc_id, CAST(ln // 4 + 1 AS BIGINT) AS page, CAST(ln % 4 AS BIGINT) AS span, line AS text,
         24.0::DOUBLE AS x, (768 - 12 * (ln % 4 + 1))::DOUBLE AS y, 12.0::DOUBLE AS font_size,
         CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, ln // 4 ORDER BY ln
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
  FROM doc_lines)"""

NODES = PAGES + """,
page_nodes AS (
  SELECT doc_id, -1::BIGINT AS node_id, NULL::BIGINT AS parent_id, NULL::BIGINT AS page,
         CASE WHEN doc_id % 4 = 0 THEN NULL ELSE [0, 0, 595, 842]::DOUBLE[] END AS media_box, NULL::BIGINT AS rotate
  FROM page_totals
  UNION ALL
  SELECT doc_id, -(k + 2), -1, NULL,
         CASE WHEN k % 2 = 0 THEN NULL ELSE [0, 0, 500, 700]::DOUBLE[] END, NULL
  FROM (SELECT doc_id, unnest(generate_series(0, (n_pages - 1) // 8)) AS k FROM page_totals)
  UNION ALL
  SELECT doc_id, page, -((page - 1) // 8 + 2), page,
         CASE WHEN page % 5 = 0 THEN [0, 0, 612]::DOUBLE[] WHEN page % 3 = 1 THEN [0, 0, 612, 792]::DOUBLE[]
              WHEN page % 3 = 2 THEN [10, 20, 605, 862]::DOUBLE[] END,
         CASE WHEN page % 4 <> 0 THEN (page % 4) * 90 END
  FROM doc_pages)"""

SIZES = NODES + """,
page_sizes AS (
  SELECT p.doc_id, p.page,
         CASE WHEN len(p.media_box) >= 4 THEN p.media_box[3] - p.media_box[1]
              WHEN i.media_box IS NOT NULL THEN i.media_box[3] - i.media_box[1]
              WHEN r.media_box IS NOT NULL THEN r.media_box[3] - r.media_box[1] ELSE 612 END::DOUBLE AS width,
         CASE WHEN len(p.media_box) >= 4 THEN p.media_box[4] - p.media_box[2]
              WHEN i.media_box IS NOT NULL THEN i.media_box[4] - i.media_box[2]
              WHEN r.media_box IS NOT NULL THEN r.media_box[4] - r.media_box[2] ELSE 792 END::DOUBLE AS height
  FROM page_nodes p
  JOIN page_nodes i ON i.doc_id = p.doc_id AND i.node_id = p.parent_id
  JOIN page_nodes r ON r.doc_id = i.doc_id AND r.node_id = i.parent_id
  WHERE p.page IS NOT NULL)"""

ANNOTATIONS = PAGES + """,
annotations AS (
  SELECT doc_id, page, 0::BIGINT AS layer, m.ord, NULL::VARCHAR AS kind, m.subtype,
         72.0 + page + m.dx AS x0, m.subtype || ' on page ' || page AS contents, m.ap AS has_appearance
  FROM doc_pages, (VALUES (1::BIGINT, 'Link', 0, false), (2, 'Text', 60, false), (3, 'Widget', 120, true),
                          (4, 'Widget', 180, false)) m(ord, subtype, dx, ap))"""

# One kind of tag with a body, then one without, in the order of the sequence numbers.
_KINDS = [
    *[(k, rf"(?is)<{k}\b[^>]*>.*?</{k}>", True) for k in ("script", "style", "a", "title", "iframe", "object", "form", "table")],
    *[(k, rf"(?is)<{k}\b[^>]*>", False) for k in ("meta", "img", "embed", "link")],
]


def _tags(order: int, kind: str, pattern: str, body: bool) -> str:
    inner = rf"regexp_extract(tag, '(?is)^<{kind}\b[^>]*>(.*)</{kind}>$', 1)" if body else "''"
    return rf"""SELECT page_id, {order} AS o, '{kind}' AS kind, CAST(i AS BIGINT) AS idx,
         regexp_extract(tag, '(?is)^<{kind}\b([^>]*)>', 1) AS attrs, {inner} AS body, strlen(tag) AS bytes
  FROM (SELECT page_id, unnest(t) AS tag, unnest(generate_series(0, len(t) - 1)) AS i
        FROM (SELECT page_id, regexp_extract_all(html, '{pattern}') AS t FROM pages))"""


RESOURCES = (
    "\nfound AS (\n  "
    + "\n  UNION ALL\n  ".join(_tags(o, *k) for o, k in enumerate(_KINDS))
    + """),
resources AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o, idx) - 1 AS seq, kind, idx, attrs, body,
         CAST(bytes AS BIGINT) AS bytes
  FROM found)"""
)

_UNESCAPE = """replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""


def unescape_sql(expr: str) -> str:
    return _UNESCAPE.format(expr)


def _field(pattern: str) -> str:
    return f"nullif({unescape_sql(f'''regexp_extract(html, '{pattern}', 1)''')}, '')"


META = (
    "\ndoc_meta AS (SELECT page_id AS doc_id, "
    + _field(r"(?is)<title\b[^>]*>(.*?)</title>")
    + " AS title, "
    + ", ".join(
        _field(rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"') + f" AS {column}"
        for column, name in metadata.META_NAMES.items()
    )
    + " FROM pages)"
)

FORM = """
form_nodes AS (
  SELECT r_regionkey::BIGINT AS doc_id, n_nationkey::BIGINT AS node_id, NULL::BIGINT AS parent_id,
         n_nationkey::BIGINT AS ord, n_name AS name, NULL::VARCHAR AS field_type, NULL::VARCHAR AS value,
         NULL::VARCHAR AS subtype, NULL::BIGINT AS page_ref
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT n_regionkey, c_custkey * 2 + 1000, c_nationkey, c_custkey, 'field-' || c_custkey,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE 'Tx' END, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END,
         NULL, c_custkey % 6 + 1
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT n_regionkey, c_custkey * 2 + 1001, c_custkey * 2 + 1000, 0,
         CASE WHEN c_custkey % 3 = 1 THEN 'sub-' || c_custkey END, CASE WHEN c_custkey % 3 = 1 THEN 'Btn' END,
         CASE WHEN c_custkey % 3 = 1 THEN 'Off' END, CASE WHEN c_custkey % 3 = 0 THEN 'Widget' END, c_custkey % 6 + 2
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 2),
kids AS (
  SELECT doc_id, parent_id AS node_id, arg_min(coalesce(subtype, ''), (ord, node_id)) AS kid_type,
         arg_min(page_ref, (ord, node_id)) AS kid_page
  FROM form_nodes WHERE parent_id IS NOT NULL GROUP BY ALL),
tree AS (
  SELECT n.*, k.node_id IS NOT NULL AND k.kid_type <> 'Widget' AS is_group,
         CASE WHEN k.node_id IS NULL THEN page_ref ELSE kid_page END AS at_page
  FROM form_nodes n LEFT JOIN kids k USING (doc_id, node_id)),
walk AS (
  SELECT *, lpad((ord::HUGEINT + 9223372036854775808)::VARCHAR, 20, '0') AS walk_key FROM tree WHERE parent_id IS NULL
  UNION ALL
  SELECT t.*, w.walk_key || '/' || lpad((t.ord::HUGEINT + 9223372036854775808)::VARCHAR, 20, '0')
  FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.parent_id = w.node_id WHERE w.is_group),
fields AS (
  SELECT w.doc_id, w.walk_key, w.name, w.field_type, w.value, coalesce(p.page, 0) AS page
  FROM walk w LEFT JOIN doc_pages p ON p.doc_id = w.doc_id AND p.page = w.at_page
  WHERE NOT is_group AND w.name IS NOT NULL AND w.field_type IS NOT NULL)"""

HISTORY = """
history AS (
  SELECT event_id AS id, event_type AS tool_id, user_id AS subject_id,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, ts AS started_at, value
  FROM events)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n"

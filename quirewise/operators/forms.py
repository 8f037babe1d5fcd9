"""Form trees: list, fill, flatten and export fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.text import csv_quote
from quirewise.operators.spread import spread_join
from quirewise.operators.tree import climb
from quirewise.sources.sinks import stage_table

_LEAST = str(2**63)


def _step(order: Column) -> Column:
    """Part of a walk key: every order, moved above zero, in as many digits, so that text sorts as the walk does."""
    return F.lpad((order.cast("decimal(20,0)") + F.lit(_LEAST).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


def _reached(groups: DataFrame) -> DataFrame:
    """Groups whose ancestors are all groups, with their walk keys; groups in a ring hang on no root."""
    start = groups.select(
        "doc_id",
        "node_id",
        F.col("parent_id").alias("_at"),
        _step(F.col("ord")).alias("walk_key"),
        F.lit(False).alias("lost"),
    )

    def merge(pending: DataFrame, known: DataFrame) -> DataFrame:
        above = known.select(
            "doc_id",
            F.col("node_id").alias("_at"),
            F.col("_at").alias("_up"),
            F.col("walk_key").alias("_key"),
            F.col("lost").alias("_lost"),
        )
        return pending.drop("lost").join(above, ["doc_id", "_at"], "left").select(
            "doc_id",
            "node_id",
            F.col("_up").alias("_at"),
            F.concat_ws("/", "_key", "walk_key").alias("walk_key"),
            F.coalesce("_lost", F.lit(True)).alias("lost"),
        )

    known = climb(start, merge, "groups")
    return known.where(~F.col("lost") & F.col("_at").isNull()).select("doc_id", "node_id", "walk_key")


def _walked(nodes: DataFrame) -> DataFrame:
    """Fields the walk reaches, with their walk key and the page of their first widget.

    A node with kids is a field if its first kid is a widget, else a group to descend into; a node without kids is a
    field. Only groups, few beside the fields, climb the tree; all other nodes join the reached groups once.
    """
    kids = (
        nodes.where("parent_id is not null")
        .groupBy("doc_id", F.col("parent_id").alias("node_id"))
        .agg(F.min(F.struct("ord", "node_id", "subtype", "page_ref")).alias("first_kid"))
    )
    tree = nodes.join(kids, ["doc_id", "node_id"], "left")
    widget = F.coalesce(F.col("first_kid.subtype") == "Widget", F.lit(False))
    is_group = F.col("first_kid").isNotNull() & ~widget
    groups = stage_table(tree.where(is_group).select("doc_id", "node_id", "parent_id", "ord"), "groups")
    reached = _reached(groups)
    fields = tree.where(~is_group)
    top = fields.where("parent_id is null").withColumn("walk_key", _step(F.col("ord")))
    above = reached.select("doc_id", F.col("node_id").alias("parent_id"), F.col("walk_key").alias("_above"))
    below = (
        fields.join(above, ["doc_id", "parent_id"])
        .withColumn("walk_key", F.concat_ws("/", "_above", _step(F.col("ord"))))
        .drop("_above")
    )
    page = F.when(F.col("first_kid").isNull(), F.col("page_ref")).otherwise(F.col("first_kid.page_ref"))
    return top.unionByName(below).withColumn("_page", page).drop("first_kid")


def form_fields(nodes: DataFrame, doc_pages: DataFrame | None = None) -> DataFrame:
    """Flatten form trees to their fields, which need a name and a type.

    The name is the node's own; a page that does not resolve, in ``doc_pages`` if given, is 0.
    """
    fields = _walked(nodes).where("name is not null and field_type is not null")
    if doc_pages is None:
        page = F.coalesce("_page", F.lit(0))
    else:
        known = doc_pages.select("doc_id", F.col("page").alias("_page"), F.lit(True).alias("_known"))
        fields = fields.join(known, ["doc_id", "_page"], "left")
        page = F.when(F.col("_known"), F.col("_page")).otherwise(F.lit(0))
    return fields.select("doc_id", "walk_key", "name", "field_type", "value", page.cast("bigint").alias("page"))


def form_fill(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Set values by field name: ``updates([doc_id,] ord, name, value)``.

    The last update of a name wins, every field of that name is set, unknown names change nothing, and a field needs
    no type. Without ``doc_id`` updates hold for every document. ``needs_redraw`` marks the fields that changed hands.
    """
    on = ["doc_id", "name"] if "doc_id" in updates.columns else ["name"]
    latest = updates.groupBy(*on).agg(F.max_by("value", "ord").alias("_new"))
    fields = _walked(nodes).where("name is not null")
    filled = spread_join(fields, latest, on, salt_by=["doc_id", "node_id"], how="left", hot_in=nodes)
    return filled.select(
        "doc_id",
        "node_id",
        "walk_key",
        "name",
        F.coalesce("_new", "value").alias("value"),
        F.col("_new").isNotNull().alias("needs_redraw"),
    )


def _flattens() -> Column:
    rect_ok = (F.size("rect") >= 4) & F.forall("rect", lambda v: v.isNotNull())
    return F.coalesce((F.col("subtype") == "Widget") & F.col("has_appearance") & rect_ok, F.lit(False))


def form_flatten(annotations: DataFrame, spans: DataFrame) -> DataFrame:
    """Page content after flattening: widgets with an appearance come first (layer 0), then the runs (layer 1)."""
    rect = lambda i: F.get("rect", i)
    drawn = annotations.where(_flattens()).select(
        "doc_id",
        "page",
        F.lit(0).cast("bigint").alias("layer"),
        F.col("ord").alias("seq"),
        F.col("contents").alias("text"),
        rect(0).alias("x"),
        rect(1).alias("y"),
        (rect(2) - rect(0)).alias("width"),
        (rect(3) - rect(1)).alias("height"),
    )
    runs = spans.select(
        "doc_id",
        "page",
        F.lit(1).cast("bigint").alias("layer"),
        F.col("span").alias("seq"),
        "text",
        "x",
        "y",
        (F.length("text") * F.col("font_size") * 0.5).alias("width"),
        F.col("font_size").alias("height"),
    )
    return drawn.unionByName(runs)


def annotations_after_flatten(annotations: DataFrame) -> DataFrame:
    """Annotations that stay: widgets without an appearance and everything that is no widget."""
    return annotations.where(~_flattens())


def form_csv_lines(fields: DataFrame) -> DataFrame:
    """CSV export as lines: a header line per form (empty walk key), then a line per field in walk order.

    Lines of a form sorted by ``walk_key`` and joined by line breaks are its CSV text.
    """
    line = F.concat_ws(
        ",",
        csv_quote(F.col("name")),
        csv_quote(F.col("field_type")),
        csv_quote(F.coalesce("value", F.lit(""))),
        F.col("page").cast("string"),
    )
    header = fields.select("doc_id").distinct().select(
        "doc_id", F.lit("").alias("walk_key"), F.lit("Name,Type,Value,Page").alias("line")
    )
    return header.unionByName(fields.select("doc_id", "walk_key", line.alias("line")))


def form_json_entries(fields: DataFrame) -> DataFrame:
    """JSON export as entries, one per field name; the last field of a name wins."""
    last = fields.groupBy("doc_id", "name").agg(
        F.max_by(F.struct("field_type", "value", "page"), "walk_key").alias("_f")
    )
    entry = F.to_json(
        F.struct(
            F.col("_f.field_type").alias("type"),
            F.coalesce("_f.value", F.lit("")).alias("value"),
            F.col("_f.page").alias("page"),
        )
    )
    return last.select("doc_id", "name", entry.alias("entry"))

"""Schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Page layout in points, and how plain text becomes pages.
LINES_PER_PAGE = 4
PAGE_WIDTH = 612.0
PAGE_HEIGHT = 792.0
MARGIN = 24.0
FONT_SIZE = 12.0
ADVANCE = 0.5
OCR_DPI = 150.0


# Input tables, declared once and never inferred.
INPUT_SCHEMAS: dict[str, str] = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}

# Tables the operators work on.
TABLE_SCHEMAS: dict[str, str] = {
    "doc_pages": "doc_id bigint, page bigint, text string",
    "page_nodes": "doc_id bigint, node_id bigint, parent_id bigint, page bigint, media_box array<double>, rotate bigint",
    "spans": "doc_id bigint, page bigint, span bigint, text string, x double, y double, font_size double",
    "areas": "doc_id bigint, page bigint, x double, y double, width double, height double",
    "resources": "page_id bigint, seq bigint, kind string, idx bigint, attrs string, body string, bytes bigint",
    "doc_meta": "doc_id bigint, title string, author string, subject string, keywords string, creator string, "
    "producer string, creation_date string, mod_date string",
    "meta_patch": "doc_id bigint, ord bigint, title string, author string, subject string, keywords string, "
    "creator string, producer string",
    "form_nodes": "doc_id bigint, node_id bigint, parent_id bigint, ord bigint, name string, field_type string, "
    "value string, subtype string, page_ref bigint",
    "form_updates": "ord bigint, name string, value string",
    "annotations": "doc_id bigint, page bigint, layer bigint, ord bigint, kind string, subtype string, "
    "rect array<double>, quad array<double>, contents string, has_appearance boolean",
    "ocr_pages": "doc_id bigint, page_index bigint, image_width double, image_height double, "
    "words array<struct<text:string,x:double,y:double,width:double,height:double>>",
    "merge_list": "out_id bigint, ord bigint, doc_id bigint",
    "page_order": "doc_id bigint, new_page bigint, page bigint",
    "candidates": "doc_id bigint, level bigint, bytes bigint",
    "manifest": "doc_id bigint, digest string, permission bigint",
    "history": "id bigint, tool_id string, subject_id bigint, status string, started_at timestamp",
}


def input_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(INPUT_SCHEMAS[name])


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_SCHEMAS[name])

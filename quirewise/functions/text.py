"""Scalar text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_markup(col: Column) -> Column:
    """Escape ``&`` first, then ``<`` and ``>``; quotes stay."""
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def unescape_entities(col: Column) -> Column:
    """Undo the common entities, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by its value, in the order of ``values``."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def csv_quote(col: Column) -> Column:
    """Quote a field only if it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(col.rlike('[,"\\n\\r]'), quoted).otherwise(col)


def ink_share(col: Column) -> Column:
    """Share of characters that are not blank."""
    text = F.coalesce(col, F.lit(""))
    ink = F.length(F.regexp_replace(text, "\\s", ""))
    return ink / F.greatest(F.length(text), F.lit(1))


def megabytes(size: Column) -> Column:
    return F.format_string("%.2f MB", size / F.lit(1024.0 * 1024.0))


def keep_smaller(candidate: Column, original: Column) -> Column:
    """Take the candidate payload only if it is strictly smaller."""
    return F.when(F.octet_length(candidate) < F.octet_length(original), candidate).otherwise(original)


def parse_page_list(spec: str) -> list[int]:
    """``"1, 3, x, 5"`` to ``[1, 3, 5]``: items that are no whole number are skipped."""
    return [int(item) for item in (p.strip() for p in spec.split(",")) if re.fullmatch(r"\+?[0-9]+", item)]


def parse_page_list_column(spec: Column) -> Column:
    items = F.transform(F.split(spec, ","), lambda s: F.trim(s).try_cast("int"))
    return F.filter(items, lambda v: v.isNotNull() & (v >= 0))


def safe_file_name(col: Column) -> Column:
    """Characters that file systems refuse become ``_``."""
    return F.regexp_replace(col, '[\\\\/:*?"<>|\\x00-\\x1f]', "_")


_BYTE_ORDER_MARK = "FEFF"


def decode_text(data: Column) -> Column:
    """Bytes to text: UTF-16BE behind its byte order mark, else one byte is one character."""
    marked = F.hex(F.substring(data, 1, 2)) == _BYTE_ORDER_MARK
    return F.when(marked, F.decode(F.substring(data, 3, 2**30), "UTF-16BE")).otherwise(F.decode(data, "ISO-8859-1"))


def encode_text(text: Column) -> Column:
    """Text to bytes: plain when ASCII, else UTF-16BE behind its byte order mark."""
    wide = F.concat(F.unhex(F.lit(_BYTE_ORDER_MARK)), F.encode(text, "UTF-16BE"))
    return F.when(F.length(text) == F.octet_length(text), F.encode(text, "UTF-8")).otherwise(wide)


def decode_lossy(data: Column) -> Column:
    """UTF-8 bytes to text; what is no valid UTF-8 becomes a replacement character."""
    return F.make_valid_utf8(data.cast("string"))

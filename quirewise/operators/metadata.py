"""Metadata, inventory, conformance and size budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.text import safe_file_name, unescape_entities
from quirewise.operators.sanitize import SCRIPTS
from quirewise.operators.spread import number_within
from quirewise.sources.corpus import resources

EDITABLE = ("title", "author", "subject", "keywords", "creator", "producer")

# Where a web page keeps each field.
META_NAMES = {
    "author": "author",
    "subject": "description",
    "keywords": "keywords",
    "creator": "generator",
    "producer": "publisher",
    "creation_date": "date",
    "mod_date": "last-modified",
}


def _named(name: str) -> Callable[[Column], Column]:
    return lambda meta: meta["name"] == name


def metadata_extract(pages: DataFrame) -> DataFrame:
    """Eight optional fields per web page; a field that is not set is null. What scripts hold does not count."""
    html = F.regexp_replace("html", SCRIPTS, "")

    def attribute(tag: Column, name: str) -> Column:
        pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])

    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    metas = F.transform(
        tags, lambda t: F.struct(F.lower(attribute(t, "name")).alias("name"), attribute(t, "content").alias("content"))
    )

    def cleaned(raw: Column) -> Column:
        return F.when(raw != "", unescape_entities(raw))

    named = {
        column: cleaned(F.get(F.filter("_metas", _named(name)), F.lit(0))["content"])
        for column, name in META_NAMES.items()
    }
    title = cleaned(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    found = pages.select("page_id", title.alias("title"), metas.alias("_metas"))
    return found.select(F.col("page_id").alias("doc_id"), "title", *[col.alias(name) for name, col in named.items()])


def metadata_edit(doc_meta: DataFrame, patch: DataFrame) -> DataFrame:
    """Apply a patch ``(doc_id, ord, <six fields>)``: null leaves alone, a value sets, an empty string is stored.

    The last patch of a document wins field by field; dates cannot be edited; a missing record is created.
    """
    latest = patch.groupBy("doc_id").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}")
            for c in EDITABLE
        ]
    )
    merged = doc_meta.join(latest, "doc_id", "full")
    return merged.select(
        "doc_id",
        *[F.coalesce(f"_{c}", c).alias(c) for c in EDITABLE],
        "creation_date",
        "mod_date",
    )


def doc_info(documents: DataFrame, page_counts: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Pages, size and metadata as one record per document."""
    sized = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    return sized.join(page_counts, "doc_id").join(
        doc_meta.select("doc_id", "title", "author", "creation_date", "mod_date"), "doc_id", "left"
    )


def auto_rename(records: DataFrame, pattern: str = "{title} - {author} - {date}") -> DataFrame:
    """File name per document from a pattern; unsafe characters become ``_``, collisions are numbered by id.

    A base that looks numbered already is always numbered, so no two documents get the same name.
    """
    name = F.lit(pattern)
    for slot, column in (("title", "title"), ("author", "author"), ("date", "creation_date")):
        name = F.replace(name, F.lit("{" + slot + "}"), F.coalesce(column, F.lit("unknown")))
    named = records.select("doc_id", safe_file_name(name).alias("base"))
    numbered = number_within(named, ["base"], "doc_id", "copy")
    return numbered.withColumn(
        "file_name",
        F.when((F.col("copy") == 1) & ~F.col("base").rlike(r" \(\d+\)$"), F.concat("base", F.lit(".pdf"))).otherwise(
            F.concat("base", F.lit(" ("), F.col("copy"), F.lit(").pdf"))
        ),
    )


def _attribute(name: str) -> Column:
    return F.regexp_extract("attrs", f'(?is)\\b{name}="([^"]*)"', 1)


def resource_inventory(found: DataFrame) -> DataFrame:
    """One descriptive line per resource. A missing number is -1; the colour space must be a plain name."""
    number = lambda name: F.coalesce(_attribute(name).try_cast("bigint"), F.lit(-1))
    space = _attribute("colorspace")
    filters = _attribute("filter")
    line = F.format_string(
        "%dx%d bpc=%d colorspace=%s filter=%s predictor=%s bytes=%d",
        number("width"),
        number("height"),
        number("bpc"),
        F.when(space.rlike("^[A-Za-z0-9]+$"), space).otherwise("(none/indexed-array)"),
        F.when(filters == "", "(none, raw)").otherwise(filters),
        (F.coalesce(_attribute("predictor").try_cast("bigint"), F.lit(0)) > 1).cast("string"),
        F.col("bytes"),
    )
    return found.select("page_id", "kind", "idx", line.alias("line"))


def extract_resources(pages: DataFrame) -> DataFrame:
    """Resources that hold content, numbered from 0 per page in their order; skipped ones take no number.

    Numbered inside the row of the page, so no content is shuffled.
    """
    name = F.concat(F.col("kind"), F.lit("_"), F.col("item"), F.lit("_"), F.col("seq"))
    return resources(pages, held_only=True).select("page_id", "item", "seq", "kind", name.alias("file_name"), "body")


def resource_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(
        F.count(F.lit(1)).alias("items"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")
    )


@dataclass(frozen=True)
class Rule:
    """``broken`` is true where the rule is violated; a rule with ``stops`` ends the checks there."""

    name: str
    broken: Column
    message: str
    stops: bool = False


def web_rules(standard: str) -> list[Rule]:
    """Rules by standard: ``basic`` has the structure rules, ``strict`` forbids scripts as well."""
    if standard not in ("basic", "strict"):
        raise ValueError(f"unsupported standard '{standard}' (expected basic or strict)")
    html = F.col("html")
    rules = [
        Rule("doctype", ~html.rlike(r"(?i)^\s*<!doctype html"), "missing doctype"),
        Rule("root", ~html.rlike(r"(?i)<html\b"), "document has no root element", stops=True),
        Rule("charset", ~html.rlike(r"(?i)<meta\s[^>]*charset="), "missing charset declaration"),
        Rule("lang", ~html.rlike(r"(?i)<html\b[^>]*\blang="), "missing document language"),
        Rule("title", ~html.rlike(r"(?is)<title\b[^>]*>.*?[^\s<].*?</title>"), "missing title"),
    ]
    if standard == "strict":
        rules.append(Rule("script", html.rlike(r"(?i)<script\b"), "document holds scripts"))
    return rules


def font_errors(html: Column) -> Column:
    """One message per font that is named but not declared in the page, in order of first use.

    Generic families need no declaration.
    """
    declared = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)@font-face\s*\{[^}]*?font-family:\s*([^;}]*)"), F.lit(1)),
        lambda f: F.trim(f),
    )
    used = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)[^-\w]font-family:\s*([^;}\"]*)"), F.lit(1)),
        lambda f: F.when(F.trim(f) == "", "(unknown)").otherwise(F.trim(f)),
    )
    generic = F.array(*[F.lit(g) for g in ("serif", "sans-serif", "monospace", "cursive", "fantasy")])
    missing = F.array_distinct(F.array_except(used, F.concat(declared, generic)))
    return F.transform(missing, lambda f: F.concat(F.lit("font '"), f, F.lit("' is not embedded")))


def conformance_validate(pages: DataFrame, standard: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Ordered list of violations per page; a page is valid if and only if it is empty."""
    rules = list(rules if rules is not None else web_rules(standard))
    stopped = F.lit(False)
    checks = []
    for rule in rules:
        checks.append(F.when(~stopped & rule.broken, F.lit(rule.message)))
        if rule.stops:
            stopped = stopped | rule.broken
    listed = F.filter(F.array(*checks), lambda m: m.isNotNull())
    fonts = F.when(stopped, F.array().cast("array<string>")).otherwise(font_errors(F.col("html")))
    return pages.select("page_id", F.concat(listed, fonts).alias("errors")).withColumn(
        "valid", F.size("errors") == 0
    )


def conformance_fix(pages: DataFrame, standard: str, lang: str = "en") -> DataFrame:
    """Add what is missing at the head of a page: doctype, charset, language, title. Content stays as it is.

    Encrypted pages (``cipher`` set) get an error.
    """
    rules = {r.name: r.broken for r in web_rules(standard)}
    html = F.col("html")
    head = F.concat(
        F.when(rules["charset"], F.lit('<meta charset="utf-8">')).otherwise(""),
        F.when(rules["title"], F.lit("<title>untitled</title>")).otherwise(""),
    )
    has_head = html.rlike(r"(?i)<head\b")
    out = F.when(
        has_head, F.regexp_replace(html, F.lit(r"(?i)(<head\b[^>]*>)"), F.concat(F.lit("$1"), head))
    ).otherwise(
        F.regexp_replace(
            html, F.lit(r"(?i)(<html\b[^>]*>)"), F.concat(F.lit("$1<head>"), head, F.lit("</head>"))
        )
    )
    out = F.when(head == "", html).otherwise(out)
    out = F.when(rules["lang"], F.regexp_replace(out, r"(?i)<html\b", f'<html lang="{lang}"')).otherwise(out)
    out = F.concat(F.when(rules["doctype"], F.lit("<!DOCTYPE html>")).otherwise(""), out)
    locked = F.col("cipher").isNotNull() if "cipher" in pages.columns else F.lit(False)
    return pages.withColumn("error", F.when(locked, F.lit("cannot convert an encrypted document"))).withColumn(
        "html", F.when(locked, html).otherwise(out)
    )


def level_settings(level: Column) -> tuple[Column, Column]:
    """(quality, scale percent) of a level, clamped to 1..9, halves rounded away from zero."""
    step = (F.greatest(F.least(level, F.lit(9)), F.lit(1)) - 1) / 8
    return F.round(90 - step * 72).cast("bigint"), F.round(100 - step * 55).cast("bigint")


def fit_budget(candidates: DataFrame, target: int) -> DataFrame:
    """First level per document whose size is at or under the target, else 9; ``candidates(doc_id, level, bytes)``."""
    fits = F.min(F.when(F.col("bytes") <= target, F.col("level")))
    return candidates.groupBy("doc_id").agg(F.coalesce(fits, F.lit(9)).cast("bigint").alias("level"))


def fit_text_budget(documents: DataFrame, target: int) -> DataFrame:
    """Fit text by keeping ``scale`` percent of its characters; levels are tried inside the row, without a shuffle."""
    text = F.coalesce("text", F.lit(""))

    def at_level(level: Column) -> Column:
        _, scale = level_settings(level)
        kept = F.ceil(F.length(text) * scale / 100).cast("int")
        size = F.octet_length(F.substr(text, F.lit(1), kept)).cast("bigint")
        return F.struct(level.cast("bigint").alias("level"), scale.alias("scale"), size.alias("bytes"))

    levels = F.transform(F.sequence(F.lit(1), F.lit(9)), at_level)
    # The full text decides most rows; sizes of the other levels are only needed above the target.
    full = F.octet_length(text).cast("bigint")
    whole = F.struct(
        F.lit(1).cast("bigint").alias("level"), F.lit(100).cast("bigint").alias("scale"), full.alias("bytes")
    )
    tried = F.coalesce(F.get(F.filter(levels, lambda c: c["bytes"] <= target), 0), F.element_at(levels, -1))
    return documents.select("doc_id", F.when(full <= target, whole).otherwise(tried).alias("_c")).select(
        "doc_id", "_c.*"
    )

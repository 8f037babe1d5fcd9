"""Quality rules whose limits come from the data: quantile sketches per language and source, then a joined filter.

A sketch is a histogram over geometric buckets: a value x > 0 lies in bucket ``ceil(log(x) / log(GAMMA))``, zero has a
bucket of its own. Counts per bucket add up, so sketches of partitions and of sources merge without loss, and every
quantile is right to a relative error of 1 %. A sketch has at most a few hundred buckets whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirewise.llm.words import word_list, words_in_repeated_runs
from quirewise.sources.sinks import stage_table

GAMMA = 1.01 / 0.99
ZERO = -10_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Measure -> (least spread, sides). The spread of a group is the distance of its quartiles; where nearly all texts
#: agree it is taken to be at least this much.
MEASURES = {
    "word_length": (0.5, "both"),
    "symbol_rate": (0.1, "high"),
    "caps_rate": (0.1, "high"),
    "dup_line_rate": (0.05, "high"),
    "repeat_rate": (0.05, "high"),
}


def measured(documents: DataFrame) -> DataFrame:
    """Counts of every whole text: one row per row of ``documents``, worked out inside the row.

    A null text has no word. Repeated ids give a row each. Other columns of ``documents`` are not looked at.
    """
    split = documents.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_text")).select(
        "doc_id",
        "lang",
        "source",
        "_text",
        word_list(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("_lines"),
    )

    def found(pattern: str) -> Column:
        return F.size(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).cast("bigint")

    return split.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("bigint").alias("word_chars"),
        found(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        words_in_repeated_runs(F.col("_words"), WINDOW).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        found("[A-Z]{2,}").alias("n_caps"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return counts.withColumns(
        {
            "word_length": rate("word_chars", "n_words"),
            "symbol_rate": rate("n_symbols", "n_words"),
            "caps_rate": rate("n_caps", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
        }
    )


def _key(name: str) -> Column:
    """A group of its own for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))


def bucket_of(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GAMMA))).otherwise(F.lit(ZERO)).cast("bigint")


def value_of(bucket: Column) -> Column:
    middle = F.pow(F.lit(GAMMA), bucket.cast("double")) * (2 / (1 + GAMMA))
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(middle)


def sketches(rated: DataFrame) -> DataFrame:
    """Sketch rows ``(lang, source, measure, bucket, n)`` of texts that have words."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES])
    rows = rated.where("n_words > 0").select(_key("lang").alias("lang"), _key("source").alias("source"), F.inline(pairs))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches over all columns but the keys."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Per group its number of texts ``rows`` and ``limits``, the lowest and highest usual value of every measure."""
    group = W.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})

    def quartile(name: str, q: float) -> Column:
        reached = (F.col("measure") == name) & (F.col("up_to") > q * (F.col("total") - 1))
        return value_of(F.min(F.when(reached, F.col("bucket"))))

    quartiles = [quartile(m, q).alias(f"{m}_{q}") for m in MEASURES for q in (0.25, 0.75)]
    table = ranked.groupBy(*keys).agg(F.max("total").alias("rows"), *quartiles)
    sides = []
    for name, (least, kind) in MEASURES.items():
        low, high = F.col(f"`{name}_0.25`"), F.col(f"`{name}_0.75`")
        spread = F.greatest(high - low, F.lit(least)) * width
        sides.append((low - spread if kind == "both" else F.lit(0.0)).alias(f"{name}_low"))
        sides.append((high + spread).alias(f"{name}_high"))
    return table.select(*keys, "rows", F.struct(*sides).alias("limits"))


def limits(sketch: DataFrame, min_rows: int, width: float) -> DataFrame:
    """Limits per (language, source): its own if it has ``min_rows`` texts, else its language's, else those of all."""
    everything = sketch.withColumn("all", F.lit(1))
    own = fences(sketch, ["lang", "source"], width).withColumn("all", F.lit(1))
    lang = fences(merged(sketch, "lang"), ["lang"], width).select(
        "lang", F.col("rows").alias("lang_rows"), F.col("limits").alias("lang_limits")
    )
    every = fences(merged(everything, "all"), ["all"], width).select("all", F.col("limits").alias("all_limits"))
    return (
        own.join(lang, "lang")
        .join(every, "all")
        .select(
            "lang",
            "source",
            F.when(F.col("rows") >= min_rows, F.col("limits"))
            .when(F.col("lang_rows") >= min_rows, F.col("lang_limits"))
            .otherwise(F.col("all_limits"))
            .alias("limits"),
        )
    )


def judged(documents: DataFrame, min_rows: int = 200, width: float = 4.0) -> DataFrame:
    """Counts of every text, ``base_failed`` and ``kept``.

    A text fails the base rules with fewer than 20 words or with over 30 % of its words in repeated runs. Of the others,
    those are kept whose measures all lie within the limits of their language and source: quartiles widened by
    ``width`` spreads. Null languages and sources are groups of their own; a group under ``min_rows`` texts uses the
    merged sketch of its language, or of everything. An empty table gives no rows. Repeated rows are judged each.

    The counts are written once to the shared folder: they are small, feed both the sketches and the filter, and spare
    a second pass over the texts. The limits are a written table as well, whose size Spark knows when it picks the join.
    """
    counts = stage_table(measured(documents), "quality-counts")
    rated = with_rates(counts)
    table = stage_table(limits(sketches(rated), min_rows, width), "quality-limits")
    keyed = rated.withColumns({"_lang": _key("lang"), "_source": _key("source")})
    table = table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "limits")
    usual = F.lit(True)
    for name in MEASURES:
        value = F.col(name)
        usual &= (value >= F.col(f"limits.{name}_low")) & (value <= F.col(f"limits.{name}_high"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        keyed.join(table, ["_lang", "_source"], "left")
        .withColumn("base_failed", failed)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & F.coalesce(usual, F.lit(False))).alias("kept"),
        )
    )

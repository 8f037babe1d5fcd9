"""Fingerprints of texts by one-permutation MinHash, built from column expressions only.

Every word shingle is hashed once. The top bits of the hash name a bin, the smallest rest in a bin is its value. Empty
bins are filled by optimal densification: bin ``b`` looks at other bins in an order of its own until it meets a filled
one and takes its value. The order ``(a + t * s) mod BINS`` with odd ``s`` visits every bin, so the search ends for every
text with a word. The lowest ``BITS`` bits of each value are kept; two unequal values share them with chance
``2 ** -BITS``, which the likeness takes out again.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirewise.functions.expr import let
from quirewise.llm.words import shingle_hashes, word_list
from quirewise.sources.sinks import stage_table

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
_REST = 64 - BIN_BITS
_EMPTY = (1 << _REST) - 1
_DIRECT = 8

_random = random.Random(2)
_STARTS = [_random.randrange(BINS) for _ in range(BINS)]
_STEPS = [_random.randrange(1, BINS, 2) for _ in range(BINS)]


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def _ints(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(map(str, values)) + ")")


def bin_values(hashes: Column) -> Column:
    """The smallest value of each bin, null for an empty one. A marker per bin sorts behind all values of its bin; as
    signed numbers the hashes sort by bin."""
    markers = _longs([(b << _REST) | _EMPTY for b in range(-BINS // 2, BINS // 2)])

    def first_of_bin(s: Column) -> Column:
        def new_bin(x: Column, i: Column) -> Column:
            return (i == 0) | (F.shiftright(x, _REST) != F.shiftright(F.get(s, i - 1), _REST))

        return F.filter(s, new_bin)

    rest = F.lit(_EMPTY)
    first = let(F.sort_array(F.concat(hashes, markers)), first_of_bin)
    return F.transform(first, lambda x: F.when(x.bitwiseAND(rest) != rest, x.bitwiseAND(rest)))


def densified(values: Column) -> Column:
    """Fill empty bins from others. The first tries go one by one; if all of them are empty, the bin that comes first in
    the order of this one is picked from the list of filled bins, which is made beforehand where it is likely needed."""
    starts, steps = _ints(_STARTS), _ints(_STEPS)
    inverse = _ints([pow(s, -1, BINS) for s in _STEPS])

    def listed(v: Column) -> Column:
        return F.filter(
            F.transform(v, lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda e: e["x"].isNotNull()
        )

    def fill(v: Column) -> Column:
        few = F.size(F.filter(v, lambda x: x.isNotNull())) < BINS // 2

        def with_filled(full: Column) -> Column:
            def value(x: Column, b: Column) -> Column:
                tries = [
                    F.get(v, (F.get(starts, b) + t * F.get(steps, b)).bitwiseAND(F.lit(BINS - 1)))
                    for t in range(_DIRECT)
                ]

                def turn(e: Column) -> Column:
                    way = (e["j"] - F.get(starts, b)) * F.get(inverse, b)
                    return F.struct(way.bitwiseAND(F.lit(BINS - 1)).alias("t"), e["x"].alias("x"))

                return F.coalesce(x, *tries, F.array_min(F.transform(F.coalesce(full, listed(v)), turn))["x"])

            return F.transform(v, value)

        return let(F.when(few, listed(v)), with_filled)

    return let(values, fill)


def signature(text: Column) -> Column:
    """The kept bits of all bins as an array of bytes; an empty array for a text without words."""
    hashes = let(word_list(text), lambda w: shingle_hashes(w, SHINGLE))

    def bits(h: Column) -> Column:
        low = F.transform(densified(bin_values(h)), lambda x: (x.bitwiseAND(F.lit(2**BITS - 1)) - 128).cast("tinyint"))
        return F.when(F.size(h) > 0, low).otherwise(F.array().cast("array<tinyint>"))

    return let(hashes, bits)


def packed(bits: Column) -> Column:
    """The bytes as lowercase hex digits."""
    digits = F.expr("array(" + ",".join(f"'{b:02x}'" for b in range(256)) + ")")
    return F.array_join(F.transform(bits, lambda b: F.get(digits, b.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, without the chance agreement of the kept bits.

    Two texts without words are alike, one without words is unlike all others.
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    estimate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, F.lit(1.0)).when(empty_a | empty_b, F.lit(0.0)).otherwise(estimate)


def _bounds(rows: DataFrame, cells: int) -> list[int]:
    """Ids that cut the rows into ranges of about equal row counts, ascending, to an eighth of a range."""
    shares = [i / cells for i in range(1, cells)]
    found = rows.agg(F.percentile_approx("_id", shares, 8 * cells)).first()[0] if shares else None
    return sorted(set(found or []))


def _cell_of(number: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the number, by halving."""
    if not bounds:
        return F.lit(0)
    steps = _ints([1 << k for k in reversed(range(len(bounds).bit_length()))])
    bound = F.array(*[F.lit(b).cast("bigint") for b in bounds])

    def step(at: Column, by: Column) -> Column:
        below = (at + by <= len(bounds)) & (F.get(bound, at + by - 1) <= number)
        return F.when(below, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(documents: DataFrame, cells: int = 1024, most_rows: int = 16_384) -> DataFrame:
    """``(doc_id, text, next_text, bits, next_bits)``: each row with the next one in descending order of ``doc_id``.

    Ids are cut into cells of about equal row counts, about ``cells`` of them or as many as keep a cell near
    ``most_rows`` rows, however the ids lie, and a text moves once, to its cell. The highest row of a cell is also sent to
    the cell above as a visitor, and the highest of all to the lowest cell. The table of these rows has one row per cell;
    Spark broadcasts it if it is small and joins it by shuffle if not. Rows with the same id follow each other by text,
    descending; a null id is the lowest. Only rows with one and the same id (null counts as one) are not cut apart.
    """
    lowest = -(2**63)
    rows = documents.select("doc_id", F.coalesce("doc_id", F.lit(lowest)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = documents.count()
    per_cell = min(max(n // cells, 1), most_rows)
    cell = _cell_of(F.col("_id"), _bounds(rows, -(-n // per_cell)))

    heads = rows.groupBy(cell.alias("_cell")).agg(F.max("_id").alias("_id"))
    in_order = W.orderBy(F.col("_cell").desc())
    top = F.first("_id").over(in_order)
    heads = heads.select("_cell", F.coalesce(F.lead("_id").over(in_order), top).alias("_id"))
    heads = stage_table(heads.select("_id", F.col("_cell").alias("_guest_cell")), "minhash-heads")

    placed = rows.join(heads, "_id", "left").withColumn("bits", signature(F.col("text")))
    places = F.array(F.struct(cell.alias("_cell"), F.lit(False).alias("_guest")))
    guest = F.array(F.struct(F.col("_guest_cell").alias("_cell"), F.lit(True).alias("_guest")))
    places = F.when(F.col("_guest_cell").isNull(), places).otherwise(F.concat(places, guest))
    sent = placed.select("doc_id", "_id", "text", "bits", F.inline(places))
    line = W.partitionBy("_cell").orderBy("_guest", F.col("_id").desc(), F.col("text").desc())
    following = sent.withColumns({"next_text": F.lead("text").over(line), "next_bits": F.lead("bits").over(line)})
    return following.where(~F.col("_guest")).select("doc_id", "text", "next_text", "bits", "next_bits")


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (``doc_id``, ``text``; other columns are not looked at).

    Fingerprints of the text and of its edited form, whose last half is the start of the next document, and the likeness
    of the text to its edited form and to the next document. A null text is empty; the fingerprint of a text without
    words is the empty string; equal texts have equal fingerprints. A single document follows itself. An empty table
    gives no rows.
    """
    pairs = with_next(documents)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = pairs.select("*", n.cast("bigint").alias("n_chars"), edited.alias("edited")).withColumn(
        "edited_bits", signature(F.col("edited"))
    )
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )

"""Words and runs of words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewise.functions.expr import let

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[ \t-\r]+"


def word_list(text: Column) -> Column:
    """Words of a text, in order; none for null, empty and blank texts."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def run_hashes(words: Column, length: int) -> Column:
    """A 64-bit hash of every run of ``length`` words. Words are hashed one by one, so their borders count, and the hash
    of a run is made of the hashes of its halves, so that a long run costs no more than a few steps a word."""

    def beside(a: Column, b: Column, shift: int) -> Column:
        later = F.slice(b, F.lit(shift + 1), F.size(b) - shift)
        return F.zip_with(a, later, lambda x, y: F.xxhash64(x, y))

    def runs(single: Column, of: int) -> Column:
        if of == 1:
            return single
        half = of // 2

        def whole(h: Column) -> Column:
            twice = beside(h, h, half)
            return beside(twice, single, 2 * half) if of % 2 else twice

        return let(runs(single, half), whole)

    def hashed(single: Column) -> Column:
        return F.slice(runs(single, length), F.lit(1), F.size(single) - (length - 1))

    enough = F.size(words) >= length
    found = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(enough, found).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(words: Column, length: int) -> Column:
    """Hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    n = F.size(words)
    return F.when((n > 0) & (n < length), F.array(F.xxhash64(words))).otherwise(run_hashes(words, length))


def words_in_repeated_runs(words: Column, length: int) -> Column:
    """How many words stand in a run of ``length`` words that the text has twice or more, first included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        def total(at: Column) -> Column:
            new = F.transform(at, lambda p, j: F.least(F.lit(length), F.coalesce(F.get(at, j + 1) - p, F.lit(length))))
            return F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(placed, starts), total)

    def count(hashes: Column) -> Column:
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0).cast("bigint")).otherwise(covered(hashes))

    return let(run_hashes(words, length), count)

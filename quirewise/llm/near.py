"""Near copies among whole texts: SimHash fingerprints, and five-word shingles for what the fingerprints do not reach.

Two texts that share four fifths of their five-word shingles differ in some ten bits of a fingerprint, too many for a
search by fingerprint alone. So texts are also linked if their shingle sets are at least ``SIMILARITY`` alike. Pairs to
look at share all smallest hashes of one of ``BANDS`` bands; a fingerprint of the shingles that is too far off ends the
look, and ``MARKS`` smallest hashes by range of the hash decide. Texts of up to some hundred words are decided as by their
full sets, longer ones to about 0.01.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.components import components
from quirewise.llm.simhash import _ONES, SHINGLE, Near, _majority, _ring_links, _shingles, links_by_key
from quirewise.sources.sinks import stage_table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
MARKS = 1024
#: Bits in which the fingerprints of sets that are so alike may differ; the mean is 10 and the deviation 3.
FAR = 24
_BLOCK = 1 << 14

_random = np.random.default_rng(8)
_FACTORS = _random.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None) -> tuple[int, int, list[int], bytes]:
    """Fingerprint of three-word and of five-word shingles, band keys, marks; no keys for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0, 0, [], b""
    short = _majority(_shingles(words, SHINGLE))
    hashes = np.unique(_shingles(words, WORDS))
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), _BLOCK):
        mixed = hashes[i : i + _BLOCK] * _FACTORS
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(1))
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    # Sorted hashes come range by range; the first of a range is its mark, never zero, as zero is an empty range.
    place = (hashes >> np.uint64(64 - 10)).astype(np.int64)
    ranges, first = np.unique(place, return_index=True)
    marks = np.zeros(MARKS, "<u2")
    marks[ranges] = hashes[first] % np.uint64(65535) + np.uint64(1)
    return short, _majority(hashes), keys.view(np.int64).tolist(), marks.tobytes()


def _alike(rows: pa.Table) -> Near:
    fp = rows["fp"].to_numpy()
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), "<u2").reshape(-1, MARKS)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = _ONES[(fp[a] ^ fp[b]).view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int64) <= FAR
        left = np.flatnonzero(out)
        for i in range(0, len(left), _BLOCK):
            at = left[i : i + _BLOCK]
            x, y = marks[a[at]], marks[b[at]]
            both = ((x == y) & (x > 0)).sum(1)
            out[at] = both >= SIMILARITY * ((x > 0) | (y > 0)).sum(1)
        return out

    return near


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, with its columns: the one with the smallest id.

    Groups are all that is linked, over any number of links: equal texts, texts whose fingerprints differ in three bits
    or fewer, texts whose five-word shingles are 0.8 alike. Case of A-Z does not count. Null and blank texts are one
    group. Texts are told apart by themselves and not by their ids: unlike texts of one id all stay, and of alike ones
    the one with the smaller hash. Of rows with the id and text that stay the one whose columns have the smallest hash is
    kept; rows with a null id are kept and link nothing. An empty table gives no rows.

    Equal texts are one node from the start, so the largest group of copies costs one row. Keys that only one text has
    leave before the marks are attached. Nodes are numbered in the order of their smallest ids.
    """
    rows = documents.where("doc_id is not null").select(F.struct("*").alias("row"))
    named = rows.select(F.col("row.doc_id").alias("id"), F.coalesce("row.text", F.lit("")).alias("text")).withColumn("m", F.md5("text"))
    counted = named.groupBy("m", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("m").agg(F.min_by("n", "id").alias("n"), F.min("id").alias("id"))
    placed = counted.repartitionByRange("id", "m").sortWithinPartitions("id", "m")
    same = stage_table(placed.select("id", "m", "n", F.monotonically_increasing_id().alias("node")), "near-texts")

    def once(of: DataFrame, kept: DataFrame, column: str, order: Column) -> DataFrame:
        """``(node, column)`` of one row each; only rows that are repeated are shuffled."""
        again = of.join(kept.where("n > 1"), ["id", "m"]).groupBy("node").agg(F.min_by(column, order).alias(column))
        return of.join(kept.where("n = 1"), ["id", "m"]).select("node", column).unionByName(again)

    @F.pandas_udf("short bigint, fp bigint, keys array<bigint>, marks binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [sketch(t) for t in texts]
            prints = np.array([r[:2] for r in found], np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame(
                {"short": prints[:, 0], "fp": prints[:, 1], "keys": [r[2] for r in found], "marks": [r[3] for r in found]}
            )

    first = once(named, same, "text", F.col("id"))
    sketches = stage_table(first.select("node", sketched("text").alias("s")).select("node", "s.*"), "near-sketches")

    prints = stage_table(sketches.groupBy(F.col("short").alias("fp")).agg(F.min("node").alias("node")), "near-prints")
    equal = sketches.select("node", F.col("short").alias("fp")).join(prints.withColumnRenamed("node", "least"), "fp")
    links = equal.select(F.col("node").alias("a"), F.col("least").alias("b")).union(_ring_links(prints))

    keys = sketches.select("node", "fp", F.posexplode("keys").alias("k", "key"))
    shared = keys.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "key")
    wanted = stage_table(keys.join(shared, ["k", "key"]), "near-keys")
    alike = links_by_key(wanted, _alike, lambda found: found.join(sketches.select("node", "marks"), "node"))
    roots = components(links.union(alike)).where("node <> root").select("node")
    kept = same.join(roots, "node", "left_anti")
    hashed = [F.col("row")[c] for c, kind in documents.dtypes if "map<" not in kind]
    whole = rows.select("row", F.col("row.doc_id").alias("id"), F.md5(F.coalesce("row.text", F.lit(""))).alias("m"))
    return once(whole, kept, "row", F.xxhash64(*hashed)).select("row.*").unionByName(documents.where("doc_id is null"))

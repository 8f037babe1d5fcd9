"""SimHash fingerprints of texts, links between near fingerprints, and the groups they make.

Candidates come from the ring of the eight bytes of a fingerprint. If two differ in at most ``DISTANCE`` bits, there is
a byte from which every chain of ``l`` following bytes differs in at most ``l * DISTANCE / 8`` bits. With three bits that
means: its first two bytes are equal, and of the next three at least two. So each fingerprint gets a key for each start
and each choice of those two bytes, 24 in all, and pairs with a key in common are tested for the whole chain before the
full distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quirewise.llm.components import components
from quirewise.sources.sinks import stage_table

SEGMENTS = 8
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Rows of equal keys that one task holds at most, but for the chance of the dealing; rounds of representatives.
HELD = 4096
ROUNDS = 3
_BLOCK = 1 << 15
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_BUDGET = np.array([length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)], np.uint8)

#: Tells for two arrays of row numbers which pairs are near.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: (first byte, bytes of the key) of every key.
KEYS = [
    (start, sorted((start + k) % SEGMENTS for k in (0, 1, *two)))
    for start in range(SEGMENTS)
    for two in combinations((2, 3, 4), 2)
]


def _shingles(words: list[bytes], length: int) -> np.ndarray:
    """Hash of every run of ``length`` words; of all words if there are fewer."""
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(length, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist())
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "<u8", len(words) - last)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned number; zero for null and for a text without words."""
    return _majority(_shingles((text or "").encode().lower().split(), SHINGLE))


@F.pandas_udf(LongType())
def simhash_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint of a text as the signed number with the same bits."""
    for texts in batches:
        yield pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def keyed(prints: DataFrame) -> DataFrame:
    """24 rows per fingerprint, one for each key."""
    masks = [(k, _signed(sum(0xFF << (8 * b) for b in part))) for k, (_, part) in enumerate(KEYS)]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in masks])
    return prints.select("fp", "node", F.inline(keys))


def _near(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether differences ``x`` keep the budgets of the chain that key ``k`` starts, and the full distance."""
    bits = _ONES[x.view(np.uint8).reshape(-1, SEGMENTS)]
    start = np.array([s for s, _ in KEYS])[k]
    ring = np.take_along_axis(bits, (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS, 1)
    chain = np.cumsum(ring, 1, dtype=np.uint8)
    return (chain <= _BUDGET).all(1) & (chain[:, -1] <= DISTANCE)


def _links(k: np.ndarray, key: np.ndarray, near: Near, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that hold each run of equal keys together: of the near pairs in a run those that join two of its parts.

    The first row of each run is compared with all later ones, then the second, and so on; pairs whose parts are joined
    already are passed over, and a run that is one part is left. So copies of a first row cost one comparison each, and
    rows out stay below rows in. Rows of a run with equal ``root`` are one part from the start.
    """
    edge = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
    first = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((first, [len(k)])))
    run = np.repeat(np.arange(len(first)), size)
    part = np.arange(len(k))
    behind = part - first[run]
    if root is not None:
        order = np.lexsort((root, run))
        new = (np.diff(run[order], prepend=-1) != 0) | np.concatenate(([True], root[order][1:] != root[order][:-1]))
        part[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    parts = np.bincount(run[np.unique(part)], minlength=len(first))
    one, two = [], []
    turn = 0
    rows = np.flatnonzero((behind > 0) & (parts[run] > 1))
    while len(rows):
        pivot = first[run[rows]] + turn
        apart = part[rows] != part[pivot]
        pairs = zip(*(np.array_split(x[apart], len(rows) // _BLOCK + 1) for x in (pivot, rows)))
        for left, right in pairs:
            close = near(left, right)
            for i, j in zip(left[close].tolist(), right[close].tolist()):
                a, b, r = part[i], part[j], run[i]
                if a != b:
                    one.append(i)
                    two.append(j)
                    parts[r] -= 1
                    all_of = part[first[r] : first[r] + size[r]]
                    all_of[all_of == b] = a
        turn += 1
        rows = rows[(behind[rows] > turn) & (parts[run[rows]] > 1)]
    return np.array(one, np.int64), np.array(two, np.int64)


def _by_key(batches: Iterator[pa.RecordBatch], near_in: Callable[[pa.Table], Near]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: links within runs of equal keys. The last run of a batch waits for the next batch."""
    held: pa.Table | None = None

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        root = rows["root"].to_numpy() if "root" in rows.column_names else None
        one, two = _links(rows["k"].to_numpy(), rows["key"].to_numpy(), near_in(rows), root)
        if len(one):
            node = rows["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(node[two])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        k, key = rows["k"].to_numpy(), rows["key"].to_numpy()
        cut = int(np.argmax((k == k[-1]) & (key == key[-1])))
        if cut:
            yield from out(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield from out(held)


def _of_fingerprints(rows: pa.Table) -> Near:
    k, fp = rows["k"].to_numpy(), rows["fp"].to_numpy()
    return lambda a, b: _near(k[a], fp[a] ^ fp[b])


def _sorted_by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("k", "key").sortWithinPartitions("k", "key", "node")


def _linked(rows: DataFrame, near_in: Callable[[pa.Table], Near], attach: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _sorted_by_key(attach(rows)).mapInArrow(lambda batches: _by_key(batches, near_in), "a bigint, b bigint")


def links_by_key(
    keys: DataFrame,
    near_in: Callable[[pa.Table], Near],
    attach: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    held: int | None = None,
) -> DataFrame:
    """Links ``(a, b)`` that hold together what near pairs with a key in common hold together.

    ``keys(k, key, node, fp)`` has a row per key of a node; ``attach`` adds by ``node`` what ``near_in`` needs besides.
    A run of up to ``held`` rows is linked by one task. Longer ones are cut by hash into runs of about half of that; then
    one row stands for each part found, round by round. What is not one part after that is compared block by block, all
    rows with all rows of other parts, so that no near pair is missed. This last step is quadratic in the rows outside
    the largest part, spread over tasks of bounded size.
    """
    held = held or HELD
    sizes = keys.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held)
    hot = F.broadcast(stage_table(sizes, "hot-keys"))
    links = _linked(keys.join(hot, ["k", "key"], "left_anti"), near_in, attach)
    if hot.isEmpty():
        return links
    rows = stage_table(keys.join(hot, ["k", "key"]), "hot-rows")
    half = max(held // 2, 1)

    def dealt(of: DataFrame, turn: int) -> DataFrame:
        seat = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / half))
        key = F.when(F.col("n") > held, F.xxhash64("key", seat)).otherwise(F.col("key"))
        return of.select("k", key.alias("key"), "node", "fp")

    found = _linked(dealt(rows, 0), near_in, attach)
    turn = 0
    while True:
        roots = components(found)
        star = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        parted = rows.drop("n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        per_part = parted.groupBy("k", "key", "root").agg(
            F.min(F.struct("node", "fp")).alias("head"), F.count(F.lit(1)).alias("size")
        )
        parts = stage_table(per_part, "hot-parts")
        many = parts.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        many = F.broadcast(stage_table(many, "hot-open"))
        if many.isEmpty():
            return links.union(star)
        turn += 1
        new = None
        if turn <= ROUNDS:
            heads = parts.join(many, ["k", "key"]).select("k", "key", "head.*", "n")
            new = stage_table(_linked(dealt(heads, turn), near_in, attach), "hot-links")
        if new is None or new.isEmpty():
            return links.union(star).union(_linked(_blocks(parted, parts, many, half), near_in, attach))
        found = star.union(new)


def _blocks(parted: DataFrame, parts: DataFrame, many: DataFrame, half: int) -> DataFrame:
    """The rows of open runs once for each pair of blocks they are in, with the pair as their key.

    A block has about ``half`` rows, of one part if that is large and else of all small parts. Two blocks of one part make
    no pair.
    """
    own = F.when(F.col("size") > half // 2, F.col("root"))
    sized = parts.join(many.select("k", "key"), ["k", "key"]).groupBy("k", "key", own.alias("own"))
    n_blocks = F.ceil(F.sum("size") / half).alias("blocks")
    sized = stage_table(sized.agg(n_blocks), "hot-blocks")
    large = sized.where("own is not null").select("k", "key", F.col("own").alias("root"), F.col("blocks").alias("_own"))
    mixed = sized.where("own is null").select("k", "key", F.col("blocks").alias("_mixed"))
    rows = parted.join(many.select("k", "key"), ["k", "key"], "left_semi")
    rows = rows.join(F.broadcast(large), ["k", "key", "root"], "left").join(F.broadcast(mixed), ["k", "key"], "left")
    is_mixed = F.col("_own").isNull()
    number = F.pmod(F.xxhash64("node", F.lit(-1)), F.coalesce("_own", "_mixed"))
    block = F.struct(
        is_mixed.alias("mixed"), F.when(is_mixed, F.lit(0)).otherwise(F.col("root")).alias("own"), number.alias("b")
    )
    rows = rows.select("k", "key", "node", "fp", "root", block.alias("block"))

    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b")
    listed = sized.select("k", "key", F.col("own").isNull().alias("mixed"), F.coalesce("own", F.lit(0)).alias("own"), each)
    listed = listed.select("k", "key", F.struct("mixed", "own", "b").alias("x"))
    x, y = F.col("x"), F.col("y")
    other = x["mixed"] | y["mixed"] | (x["own"] != y["own"])
    pairs = listed.join(listed.withColumnRenamed("x", "y"), ["k", "key"]).where(((x < y) & other) | ((x == y) & x["mixed"]))
    seats = pairs.select("k", "key", F.xxhash64("key", "x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return rows.join(seats, ["k", "key", "block"]).select("k", F.col("pair").alias("key"), "node", "fp", "root")


def _ring_links(single: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between nodes whose fingerprints are near; ``single(fp, node)`` has each fingerprint once."""
    return links_by_key(keyed(single.where("node is not null")), _of_fingerprints)


def grouped(documents: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``: the fingerprint of every row and the smallest id that its links reach.

    Equal texts, also empty ones, have equal fingerprints and are one group. Links are sought between different
    fingerprints, each held once with its smallest id, so copies cost nothing more. A row with a null id shares the
    group of its fingerprint; if no row with that fingerprint has an id, its ``component_id`` is null. Repeated rows
    give a row each, an empty table none; other columns are not looked at.
    """
    prints = stage_table(documents.select("doc_id", simhash_of("text").alias("fp")), "simhash")
    single = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    roots = components(_ring_links(single))
    groups = single.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))



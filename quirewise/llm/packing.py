"""Packing of documents into training sequences of several permitted lengths, by best fit.

Pieces go in from the longest to the shortest. A piece takes the open sequence with the least room that still holds it.
If none does, a sequence is opened whose length has the least cost per token it can be filled with, given the pieces
still to come that fit beside this one. In the end each sequence gets the shortest permitted length for what it holds.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.sources.sinks import stage_table

#: Permitted lengths and the cost of each: its positions and a fixed share for handling a sequence.
COSTS = {length: length + 32.0 for length in (512, 1024, 2048, 4096, 8192)}
SHARD_ROWS = 20_000

SCHEMA = (
    "doc_id bigint, piece bigint, start bigint, n_tokens bigint, text_hash bigint, bin string, bin_offset bigint, "
    "bin_tokens bigint, bin_length bigint"
)


def n_words(text: Column) -> Column:
    """Number of words, counted as the first characters of words, without a list of them."""
    starts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![^ \t-\r])[^ \t-\r]"), F.lit(0))
    return F.size(starts).cast("bigint")


def best_fit(sizes: list[int], costs: Mapping[int, float]) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; ``sizes`` must not rise and must not be above the longest permitted length."""
    lengths = sorted(costs)
    falling = np.array(sizes, np.int64)
    to_come = np.concatenate((np.cumsum(falling[::-1])[::-1], [0]))
    rooms: list[int] = []
    bins_with: dict[int, list[int]] = {}
    used: list[int] = []
    capacity: list[int] = []
    placed = []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            chosen = bins_with[room].pop()
            if not bins_with[room]:
                del bins_with[room], rooms[at]
        else:
            best = None
            for length in lengths[bisect_left(lengths, size) :]:
                fits = max(i + 1, len(sizes) - int(np.searchsorted(falling[::-1], length - size, "right")))
                price = costs[length] / min(length, size + int(to_come[fits]))
                if best is None or price <= best[0]:
                    best = (price, length)
            chosen = len(used)
            used.append(0)
            capacity.append(best[1])
        placed.append((chosen, used[chosen]))
        used[chosen] += size
        room = capacity[chosen] - used[chosen]
        if room:
            if room not in bins_with:
                bins_with[room] = []
                insort(rooms, room)
            bins_with[room].append(chosen)
    return placed


def tokens(spark: SparkSession, ranks: dict[bytes, int], pattern: str, end: int) -> Callable[..., Column]:
    """A column function ``ids(text)``: the tokens of a text and one end mark, as little-endian unsigned 32-bit numbers.

    The vocabulary, some 50,000 tokens, goes out once as a broadcast; a worker keeps the tokenizer it has built.
    """
    shared = spark.sparkContext.broadcast((ranks, pattern))
    mark = end.to_bytes(4, "little")

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (len(shared.value[0]), shared.value[1])
        if key not in _workers:
            import tiktoken

            _workers[key] = tiktoken.Encoding("ranks", pat_str=key[1], mergeable_ranks=shared.value[0], special_tokens={})
        encode = _workers[key].encode_ordinary
        for texts in batches:
            yield pd.Series([np.array(encode(t or ""), "<u4").tobytes() + mark for t in texts], dtype=object)

    return ids


#: Tokenizers of this worker, by size and pattern.
_workers: dict[tuple[int, str], object] = {}


def packed(
    documents: DataFrame, costs: Mapping[int, float] | None = None, shard_rows: int = SHARD_ROWS, length: Column | None = None
) -> DataFrame:
    """A row per piece: which tokens of which document lie where in which sequence.

    ``length`` is the number of tokens of a document with its end mark, as a column of ``documents``; without it a word is a
    token and the end one more, so an empty or null text has length 1. A document that is longer than the longest
    permitted length is cut into pieces of that length and a rest; ``start`` is the place of a piece in its document and
    ``text_hash`` tells texts of one id apart. Documents are dealt by hash over shards of about ``shard_rows`` pieces, whose
    number follows the number of pieces; each shard is packed on its own, so memory is bounded by the shard and the loss
    is at most a few open sequences per shard. Repeated rows are packed each; equal lengths are placed in order of id.
    ``bin_length`` is the permitted length after downsizing. An empty table gives no rows; other columns are not looked at.
    """
    costs = dict(costs or COSTS)
    longest = max(costs)
    size = n_words(F.col("text")) + 1 if length is None else length
    counted = documents.select("doc_id", text_hash().alias("_h"), size.cast("bigint").alias("_n"))
    counted = stage_table(counted, "packing-lengths")
    rows = counted.agg(F.sum(F.expr(f"(_n - 1) div {longest}L + 1"))).first()[0] or 0
    shards = max(1, math.ceil(rows / shard_rows))
    pieces = counted.select(
        "doc_id", "_h", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {longest}L"))).alias("piece")
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("bigint"), F.col("_n") - F.col("piece") * longest).alias("n_tokens"),
        F.col("_h").alias("text_hash"),
        F.pmod(F.xxhash64("_h", "piece"), F.lit(shards)).alias("_shard"),
    )
    lengths = np.array(sorted(costs))

    def pack(shard: pa.Table) -> pa.Table:
        size = shard["n_tokens"].to_numpy()
        ids = shard["doc_id"].fill_null(-(2**63)).to_numpy()
        order = np.lexsort((shard["piece"].to_numpy(), ids, -size))
        places = np.array(best_fit(size[order].tolist(), costs), np.int64).reshape(-1, 2)
        used = np.bincount(places[:, 0], weights=size[order]).astype(np.int64)
        fitting = lengths[np.searchsorted(lengths, used)]
        name = shard["_shard"][0].as_py()
        out = shard.select(["doc_id", "piece", "start", "n_tokens", "text_hash"]).take(order)
        for column, values in (
            ("bin", pa.array([f"{name}-{b}" for b in places[:, 0].tolist()])),
            ("bin_offset", pa.array(places[:, 1])),
            ("bin_tokens", pa.array(used[places[:, 0]])),
            ("bin_length", pa.array(fitting[places[:, 0]])),
        ):
            out = out.append_column(column, values)
        return out.select([part.split()[0] for part in SCHEMA.split(", ")])

    return pieces.groupBy("_shard").applyInArrow(pack, SCHEMA)


def text_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def sequences(pieces: DataFrame, coded: DataFrame) -> DataFrame:
    """``(bin, bin_length, n_pieces, ids)``: the packed sequences themselves, pieces at their places, without padding.

    ``coded`` has ``doc_id``, ``text`` and ``ids`` of the documents that were packed. A sequence gathers no more than its
    permitted length.
    """
    own = coded.select("doc_id", text_hash().alias("text_hash"), "ids").dropDuplicates(["doc_id", "text_hash"])
    own = own.withColumnRenamed("doc_id", "_id")
    both = pieces.join(own, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (pieces["text_hash"] == own["text_hash"]))
    cut = F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("n_tokens")).cast("int"))
    placed = F.sort_array(F.collect_list(F.struct("bin_offset", cut.alias("part"))))
    empty = F.lit(b"")
    joined = placed.alias("parts")
    gathered = both.groupBy("bin", "bin_length").agg(joined)
    whole = F.aggregate("parts", empty, lambda done, p: F.concat(done, p["part"]))
    return gathered.select("bin", "bin_length", F.size("parts").cast("bigint").alias("n_pieces"), whole.alias("ids"))

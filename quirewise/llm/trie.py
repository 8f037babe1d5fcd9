"""Prefix trie of conversations, with totals over every subtree by time-forward processing.

A node is a distinct sequence of first turns. Its key is its depth and the smallest conversation that starts with it, as
a conversation has one prefix of each depth. The nodes are cut into shards: a subtree with little beneath it is one
shard, and what lies above such subtrees is cut into pieces of paths. Within a shard the nodes are sorted externally by
reverse level order and read once; every node takes the totals its children have sent from a priority queue that spills,
adds its own and sends the sum to its parent. The roots of the shards are then treated as nodes of a smaller tree.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewise.llm.packing import n_words
from quirewise.sources.sinks import stage_table

#: Turns beneath a node from which it belongs to the top of the tree, and nodes of one piece of a path there.
SHARD_ROWS, PIECE = 100_000, 50_000
#: Depths that one window of prefix keys spans; conversation ids in one chunk of a list of ends.
SPAN, CHUNK = 65_536, 8_192
#: Messages that a queue holds in memory.
QUEUE_ROWS = 200_000

FAMILY, TURNS_TAKEN = 20, 4


class SpillingQueue:
    """Rows of whole numbers, least first. Beyond ``rows`` rows what is held goes out to a file as a sorted run.

    The files are scratch of the running task like Spark's own spills: unnamed, and gone with the task.
    """

    def __init__(self, width: int, rows: int = QUEUE_ROWS) -> None:
        self.width, self.rows = width, rows
        self.held: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []

    def push(self, row: tuple[int, ...]) -> None:
        heapq.heappush(self.held, row)
        if len(self.held) > self.rows:
            out = tempfile.TemporaryFile()
            np.array(sorted(self.held), np.int64).tofile(out)
            self.held = []
            self._open(self._read(out), len(self.runs))

    def _read(self, out) -> Iterator[tuple[int, ...]]:
        out.seek(0)
        with out:
            while len(part := np.fromfile(out, np.int64, 4096 * self.width)):
                yield from map(tuple, part.reshape(-1, self.width).tolist())

    def _open(self, run: Iterator[tuple[int, ...]], name: int) -> None:
        if (row := next(run, None)) is not None:
            heapq.heappush(self.runs, (row, name, run))

    def least(self) -> tuple[int, ...] | None:
        heads = [q[0] for q in (self.held,) if q] + [q[0][0] for q in (self.runs,) if q]
        return min(heads, default=None)

    def pop(self) -> tuple[int, ...]:
        if not self.runs or (self.held and self.held[0] <= self.runs[0][0]):
            return heapq.heappop(self.held)
        row, name, run = heapq.heappop(self.runs)
        self._open(run, name)
        return row


_NODE = "depth bigint, conv_id bigint, above_depth bigint, above_conv bigint, is_top boolean"
_TOTALS = f"{_NODE}, n_children bigint, n_leaves bigint, saved bigint"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come deepest first; the parent of a node that is no top comes later in the same stream."""
    queue = SpillingQueue(5)
    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("depth", "conv_id", "above_depth", "above_conv", "is_top")]
        totals = [batch[name].to_pylist() for name in ("n_children", "n_leaves", "saved")]
        out = []
        for depth, conv, above_depth, above_conv, is_top, children, leaves, saved in zip(*columns, *totals):
            while (first := queue.least()) is not None and first[0] == -depth and first[1] == conv:
                _, _, more, below, tokens = queue.pop()
                children, leaves, saved = children + more, leaves + below, saved + tokens
            leaves = leaves if children else 1
            out.append((children, leaves, saved))
            if not is_top:
                queue.push((-above_depth, above_conv, 1, leaves, saved))
        done = [pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([batch[n] for n in _NODE_NAMES] + done, [*_NODE_NAMES, "n_children", "n_leaves", "saved"])


_NODE_NAMES = [part.split()[0] for part in _NODE.split(", ")]


def subtree_totals(nodes: DataFrame, shard: list[str]) -> DataFrame:
    """Children, leaves and saved tokens of the subtree of every node within its shard.

    ``nodes`` has the columns of a node, what it has from outside its shard, and the columns of ``shard``. A node whose
    parent is outside is marked ``is_top``; a node without children is a leaf.
    """
    dealt = nodes.repartition(*shard) if shard else nodes.repartition(1)
    return dealt.sortWithinPartitions(F.desc("depth"), "conv_id").select(*_NODE_NAMES, "n_children", "n_leaves", "saved").mapInArrow(_forward, _TOTALS)


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, pid, turn_key, words)`` of all turns, written once; ``at`` is a global order of the rows.

    Turns are ordered by number, null first, and those of one number by role and text. Rows are dealt by ranges of that
    order, so a conversation with a third of all turns is spread over many tasks; only turns that share a number carry
    their text through the sort.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")
    )
    tied = rows.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with_ties = rows.join(tied, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    keyed = with_ties.select(
        "conv_id",
        "turn",
        F.when(F.col("n").isNotNull(), F.col("role")).alias("tie_role"),
        F.when(F.col("n").isNotNull(), F.col("text")).alias("tie_text"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("turn_key"),
        n_words(F.col("text")).alias("words"),
        F.monotonically_increasing_id().alias("i"),
    )
    order = ["conv_id", "turn", "tie_role", "tie_text", "i"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # The upper bits of the number are the partition, the lower ones count its rows.
    return stage_table(placed.select("conv_id", "at", F.shiftright("at", 33).alias("pid"), "turn_key", "words"), "trie-turns")


def _family_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % TURNS_TAKEN


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, turn_key, words, length)`` of the rebuilt conversations, and ``(conv_id, length)`` of each.

    A conversation begins with the first h turns of the first of its family and goes on with its own after its first h.
    """
    pieces = turns.groupBy("conv_id", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = pieces.groupBy("conv_id").agg(F.sum("n").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    lent = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = own.withColumn("base", base).withColumn("h", _family_turns(F.col("conv_id"))).join(lent, "base", "left")
    taken = F.least(F.col("h"), F.coalesce("base_own", F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stage_table(convs.select("conv_id", "base", "h", "taken", "length"), "trie-conversations")
    pieces = pieces.join(convs, "conv_id").select("conv_id", "pid", "first", "before", "h", "taken", "length")
    placed = turns.join(pieces, ["conv_id", "pid"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    mine = placed.where("pos > h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "turn_key", "words", "length"
    )
    heads = placed.where(F.col("pos") < TURNS_TAKEN).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_key", "words")
    theirs = convs.where("taken > 0").join(heads, "base").where("depth <= taken")
    return mine.unionByName(theirs.select("conv_id", "depth", "turn_key", "words", "length")), convs.select("conv_id", "length")


def prefixes(members: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds the 128-bit key ``(p1, p2)`` of the first ``depth`` turns and ``(q1, q2)``, that of one turn less.

    Keys of turns and their depth are hashed and joined by exclusive or, so a long conversation is keyed in spans that
    are put together afterwards and no window holds more than ``span`` rows.
    """
    marked = members.select(
        "conv_id", "depth", "words", "length",
        F.xxhash64(F.lit(1), "depth", "turn_key").alias("h1"),
        F.xxhash64(F.lit(2), "depth", "turn_key").alias("h2"),
        F.expr(f"depth div {span}").alias("span"),
    )
    inside = W.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    of_spans = marked.where(F.col("length") >= span).groupBy("conv_id", "span").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    starts = of_spans.select("conv_id", "span", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2"))
    running = marked.withColumns({f"p{k}": F.bit_xor(f"h{k}").over(inside) for k in (1, 2)}).join(starts, ["conv_id", "span"], "left")
    zero = F.lit(0).cast("bigint")
    for k in (1, 2):
        running = running.withColumn(f"p{k}", F.col(f"p{k}").bitwiseXOR(F.coalesce(F.col(f"s{k}"), zero)))
        running = running.withColumn(f"q{k}", F.col(f"p{k}").bitwiseXOR(F.col(f"h{k}")))
    return running.select("conv_id", "depth", "words", "length", "p1", "p2", "q1", "q2")


def _ends(ends: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)`` of the ids that end at a node.

    Ids are sorted and written out as text over ranges; what is left for the one task of a node, as a hash is made from
    front to back, is to read the chunks and hash them, none held longer than its turn.
    """
    node = ["depth", "p1", "p2"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(node, key), first=ids[0], ids=",".join(map(str, ids)).encode())], chunk_schema)

        for batch in batches:
            ready = []
            for *at, conv in zip(*(batch[c].to_pylist() for c in (*node, "conv_id"))):
                if ids and (at != key or len(ids) >= CHUNK):
                    ready.append(out())
                    ids = []
                key = at
                ids.append(conv)
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if ids:
            yield out()

    chunk_schema = pa.schema([(c, pa.int64()) for c in (*node, "first")] + [("ids", pa.binary())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*node, "ends_sha256"]
        for batch in batches:
            rows = []
            for *at, ids in zip(*(batch[c].to_pylist() for c in (*node, "ids"))):
                if at != key:
                    if key is not None:
                        rows.append([*key, state.hexdigest()])
                    key, state = at, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names)

    order = [*node, "conv_id"]
    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
    cut = cut.mapInArrow(chunks, "depth bigint, p1 bigint, p2 bigint, first bigint, ids binary")
    cut = cut.repartition(*node).sortWithinPartitions(*node, "first")
    return cut.mapInArrow(hashes, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, piece: int = PIECE) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Rows without a conversation id take no part; null roles and texts are empty, repeated rows are turns of their own,
    turns of one number come in order of role and text, and other columns are not looked at. Ids below zero have families
    that end at zero, as the remainder is cut towards zero. An empty table has no nodes, any other has a root.

    Subtrees with ``shard_rows`` turns beneath them or fewer are shards. What is above is cut into path pieces of up to
    ``piece`` nodes, whose roots, about one for each ``shard_rows`` turns or ``piece`` nodes, pass their totals on in the
    last step; then every piece is read once more with what the pieces below it hold.
    """
    turns, convs = rebuilt(numbered(conversations))
    members = stage_table(prefixes(turns), "trie-members")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = convs.select(
        "conv_id", zero.alias("depth"), zero.alias("words"), "length",
        zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"),
    )
    found = members.unionByName(roots).groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        F.max("q1").alias("q1"),
        F.max("q2").alias("q2"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    found = stage_table(found, "trie-found")
    above = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above_conv")
    )
    nodes = found.join(above, ["depth", "q1", "q2"], "left").select(
        "depth", "conv_id", (F.col("depth") - 1).alias("above_depth"), "above_conv", "p1", "p2", "n_convs",
        ((F.col("n_convs") - 1) * F.col("words")).alias("own"), (F.col("weight") > shard_rows).alias("heavy"),
    )
    nodes = stage_table(nodes, "trie-nodes")

    # The shard of a light node is the first light prefix of its conversation.
    heavy = nodes.where("heavy")
    heavy_keys = stage_table(heavy.select("depth", "p1", "p2"), "trie-heavy")
    on_path = members.unionByName(roots).join(heavy_keys, ["depth", "p1", "p2"], "left_semi")
    first_light = on_path.groupBy("conv_id").agg((F.max("depth") + 1).alias("depth"))
    shards = members.join(first_light, ["conv_id", "depth"]).select("conv_id", F.col("depth").alias("top"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    light = nodes.where("not heavy").join(shards, "conv_id", "left").select(
        "depth", "conv_id", "above_depth", "above_conv",
        (F.col("depth") == F.coalesce("top", F.lit(0))).alias("is_top"),
        zero.alias("n_children"), zero.alias("n_leaves"), F.col("own").alias("saved"), "top", "s1", "s2",
    )
    light = stage_table(subtree_totals(light, ["top", "s1", "s2"]), "trie-light")

    parent = [F.col("above_depth").alias("depth"), F.col("above_conv").alias("conv_id")]
    pieces = heavy.withColumn("piece", F.expr(f"depth div {piece}L")).withColumn(
        "is_top", (F.col("depth") % piece == 0) | (F.col("above_conv") != F.col("conv_id"))
    )
    from_light = light.where("is_top and depth > 0").select(*parent, F.lit(1).cast("bigint").alias("n"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
    from_pieces = pieces.where("is_top and depth > 0").select(*parent, F.lit(1).cast("bigint").alias("n"), zero.alias("l"), zero.alias("s"))

    def with_sent(sent: DataFrame) -> DataFrame:
        """Heavy nodes with their own tokens and what has been sent to them."""
        summed = sent.groupBy("depth", "conv_id").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("s").alias("s"))
        return pieces.join(summed, ["depth", "conv_id"], "left").select(
            "depth", "conv_id", "above_depth", "above_conv", "is_top", "piece", F.col("conv_id").alias("of"),
            F.coalesce("n", zero).alias("n_children"), F.coalesce("l", zero).alias("n_leaves"), (F.col("own") + F.coalesce("s", zero)).alias("saved"),
        )

    sent = stage_table(from_light.unionByName(from_pieces).groupBy("depth", "conv_id").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("s").alias("s")), "trie-sent")
    tops = stage_table(subtree_totals(with_sent(sent), ["of", "piece"]).where("is_top"), "trie-tops")
    of_piece = tops.select(
        F.col("conv_id").alias("above_conv"), F.expr(f"depth div {piece}L").alias("above_piece"), F.col("depth").alias("top_depth")
    )
    small = tops.withColumn("above_piece", F.expr(f"above_depth div {piece}L")).join(of_piece, ["above_conv", "above_piece"], "left")
    small = small.select(
        "depth", "conv_id", F.col("top_depth").alias("above_depth"), "above_conv", (F.col("depth") == 0).alias("is_top"),
        # A piece is no leaf of the small tree, whatever it holds; its leaves are counted already.
        F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved",
    )
    across = subtree_totals(small, []).select("depth", "conv_id", "n_leaves", "saved")
    across = tops.where("depth > 0").select("depth", "conv_id", *(F.col(c) for c in ("above_depth", "above_conv"))).join(across, ["depth", "conv_id"])
    from_tops = across.select(*parent, zero.alias("n"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
    top = subtree_totals(with_sent(sent.unionByName(from_tops)), ["of", "piece"])

    ends = members.where("depth = length").select("depth", "p1", "p2", "conv_id").unionByName(
        convs.where("length = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id")
    )
    described = nodes.select("depth", "conv_id", "p1", "p2", "n_convs").join(_ends(ends), ["depth", "p1", "p2"], "left")
    totals = light.unionByName(top).select("depth", "conv_id", "above_conv", "n_children", "n_leaves", "saved")
    return described.join(totals, ["depth", "conv_id"]).select(
        "conv_id", "depth", F.col("above_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )

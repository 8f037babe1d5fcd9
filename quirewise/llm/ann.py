"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, greedy search in the graph.

Every distinct vector is a node. All nodes are brought to one length by a further coordinate, so that nearness among them
is a metric, and dealt to cells by two trees of random planes. Nodes first meet all others of their cells. Then, round by
round, the neighbours of a node, and those that have it as a neighbour, are joined with one another, if one of the two is
new there; what is nearer than the worst neighbour so far goes into the lists. A query walks the finished graph: it looks
at the neighbours of the best nodes it knows until none of them is left to look at.

The vectors travel to the cells that need them, each once for a cell and round, however many lists of the cell name it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewise.sources.sinks import drop_staged, stage_table

#: Neighbours of a node; new and old ones, forward and backward, that take part in a round; share of changed places that ends the rounds.
DEGREE, TAKEN, LEFT = 48, 24, 0.01
#: Nodes of a cell, and rows of the sample from which the planes are taken: at most 2**22 numbers.
CELL, SAMPLE_ROWS, SAMPLE_NUMBERS = 4096, 16_384, 1 << 22
#: Nodes that a search keeps, nodes it looks at in one step, queries of one batch.
BEAM, STEP, BATCH = 80, 32, 256
#: Nodes of the sample among which a walk looks for places to begin, and how many it takes.
ENTRIES, BEGINNINGS = 1024, 8
#: Candidates of a round that a task holds before it keeps the best.
HELD = 3_000_000

_INT, _BIN = pa.int64(), pa.binary()
_LIST = "node bigint, cell bigint, others binary, scores binary, fresh binary, x binary, changed bigint"


def is_vector(vector: Column) -> Column:
    """Neither null nor zero nor with a component that is null or not finite."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda v: v != 0), F.lit(False))


def distinct_vectors(embeddings: DataFrame, copies: int) -> DataFrame:
    """``(ids, vector)``: every distinct vector once, with its ``copies`` smallest ids; written once.

    Repeated rows count once. A vector that a third of all rows share is cut to its first ids before the shuffle.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_vector(F.col("vector"))).distinct()
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= copies)
    nodes = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stage_table(nodes.select("ids", "vector"), "ann-vectors")


@dataclass
class Planes:
    """Trees of planes, level by level: directions and thresholds of all planes of a level."""

    trees: list[list[tuple[np.ndarray, np.ndarray]]]

    @classmethod
    def grown(cls, sample: np.ndarray, levels: int, trees: int = 2) -> Planes:
        source, out = np.random.default_rng(13), []
        for _ in range(trees):
            at, tree = np.zeros(len(sample), np.int64), []
            for level in range(levels):
                directions, limits = np.zeros((1 << level, sample.shape[1]), np.float32), np.zeros(1 << level, np.float32)
                for leaf in range(1 << level):
                    here = np.flatnonzero(at == leaf)
                    if len(here) > 1:
                        a, b = source.choice(here, 2, replace=False)
                        directions[leaf] = sample[a] - sample[b]
                        limits[leaf] = np.median(sample[here] @ directions[leaf])
                tree.append((directions, limits))
                at = cls._below(sample, at, directions, limits)
            out.append(tree)
        return cls(out)

    @staticmethod
    def _below(x: np.ndarray, at: np.ndarray, directions: np.ndarray, limits: np.ndarray) -> np.ndarray:
        return 2 * at + ((x * directions[at]).sum(1) > limits[at])

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for directions, limits in tree:
                at = self._below(x, at, directions, limits)
            out.append(at)
        return out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of binary values of one length as a matrix."""
    values = column.to_pylist()
    found = np.frombuffer(b"".join(values), kind)
    return found.reshape(len(values), -1) if values else found.reshape(0, 1)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as a matrix in double precision; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _even(x: np.ndarray, longest: float) -> np.ndarray:
    """All vectors at one length, by a further coordinate."""
    x = x / longest
    return np.concatenate((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]), 1).astype(np.float32)


def _best(dest: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best different others of every destination, best first."""
    order = np.lexsort((other, -score, dest))
    dest, other, score = dest[order], other[order], score[order]
    # Equal pairs have equal scores, so they stand side by side.
    again = np.zeros(len(dest), bool)
    again[1:] = (dest[1:] == dest[:-1]) & (other[1:] == other[:-1])
    dest, other, score = dest[~again], other[~again], score[~again]
    start = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]) if len(dest) else np.zeros(0, np.int64)
    place = np.arange(len(dest)) - np.repeat(start, np.diff(np.r_[start, len(dest)]))
    keep = place < most
    return dest[keep], other[keep], score[keep]


_FOUND = "cell bigint, dest binary, others binary, scores binary"
_FOUND_NAMES = ["cell", "dest", "others", "scores"]


def _update_rows(ids: np.ndarray, dest: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.Table:
    """What was found, in one row for each cell whose nodes it is for."""
    home = ids >> 32
    order = np.argsort(home[dest], kind="stable")
    dest, other, score = dest[order], other[order], score[order]
    cells, start = np.unique(home[dest], return_index=True)
    parts = list(zip(start, np.r_[start[1:], len(dest)])) if len(cells) else []
    packed = [[ids[v[a:b]].astype("<i8").tobytes() for a, b in parts] for v in (dest, other)]
    scores = [score[a:b].astype("<f4").tobytes() for a, b in parts]
    return pa.table([pa.array(cells, _INT), *(pa.array(c, _BIN) for c in (*packed, scores))], _FOUND_NAMES)


def _meet_in_cell(degree: int):
    def meet(rows: pa.Table) -> pa.Table:
        ids, x = rows["node"].to_numpy(), _matrix(rows["x"], "<f2").astype(np.float32)
        most = min(degree, len(ids) - 1)
        if most < 1:
            return _update_rows(ids, *(np.zeros(0, np.int64),) * 3)
        parts = []
        for i in range(0, len(ids), 512):
            near = x[i : i + 512] @ x.T
            own = np.arange(len(near))
            near[own, own + i] = -np.inf
            other = np.argpartition(-near, most - 1, axis=1)[:, :most]
            parts.append((np.repeat(own + i, most), other.ravel(), np.take_along_axis(near, other, 1).ravel()))
        return _update_rows(ids, *_best(*(np.concatenate(p) for p in zip(*parts)), degree))

    return meet


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_LIST_SCHEMA = _schema(node=_INT, cell=_INT, others=_BIN, scores=_BIN, fresh=_BIN, x=_BIN, changed=_INT)


def _merged(degree: int):
    """The lists of a cell and what was found for its nodes become its new lists; a new neighbour is fresh."""

    def merge(lists: pa.Table, found: pa.Table) -> pa.Table:
        lists = lists.take(pa.array(np.argsort(lists["node"].to_numpy())))
        ids = lists["node"].to_numpy()
        old, old_score, flag = (
            np.frombuffer(b"".join(lists[c].to_pylist()), k) for c, k in (("others", "<i8"), ("scores", "<f4"), ("fresh", "u1"))
        )
        owner = np.repeat(np.arange(len(ids)), [len(f) for f in lists["fresh"].to_pylist()])
        dest, other, score = (np.frombuffer(b"".join(found[c].to_pylist()), k) for c, k in zip(_FOUND_NAMES[1:], ("<i8", "<i8", "<f4")))
        owner = np.concatenate((owner, np.searchsorted(ids, dest)))
        everyone, value = np.concatenate((old, other)), np.concatenate((old_score, score))
        flag = np.concatenate((flag, np.full(len(other), 2, "u1")))
        # One entry for a pair, the one that was there before if there is one.
        order = np.lexsort((flag, everyone, owner))
        owner, everyone, value, flag = owner[order], everyone[order], value[order], flag[order]
        once = np.ones(len(owner), bool)
        once[1:] = (owner[1:] != owner[:-1]) | (everyone[1:] != everyone[:-1])
        owner, everyone, value, flag = owner[once], everyone[once], value[once], flag[once]
        order = np.lexsort((everyone, -value, owner))
        owner, everyone, value, flag = owner[order], everyone[order], value[order], flag[order]
        start = np.searchsorted(owner, np.arange(len(ids) + 1))
        keep = np.arange(len(owner)) - start[owner] < degree
        owner, everyone, value, flag = owner[keep], everyone[keep], value[keep], flag[keep]
        start = np.searchsorted(owner, np.arange(len(ids) + 1))
        changed = np.bincount(owner[flag == 2], minlength=len(ids))
        flag = np.minimum(flag, 1).astype("u1")
        cut = list(zip(start[:-1], start[1:]))
        packed = [pa.array([v[a:b].tobytes() for a, b in cut], _BIN) for v in (everyone.astype("<i8"), value.astype("<f4"), flag)]
        return pa.table([lists["node"], lists["cell"], *packed, lists["x"], pa.array(changed, _INT)], _LIST_SCHEMA)

    return merge


def _with_found(base: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    lists = base.select("node", "cell", "others", "scores", "fresh", "x")
    return lists.groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(_merged(degree), _LIST)


def _picks(flags: np.ndarray, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the best fresh and of the best other neighbours that take part."""
    return np.flatnonzero(flags == 1)[:taken], np.flatnonzero(flags == 0)[:taken]


def _aged(taken: int):
    """Lists whose fresh neighbours that took part are no longer fresh."""

    def age(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fresh in batch["fresh"].to_pylist():
                flags = np.frombuffer(fresh, "u1").copy()
                flags[_picks(flags, taken)[0]] = 0
                out.append(flags.tobytes())
            place = batch.schema.get_field_index("fresh")
            yield pa.RecordBatch.from_arrays([pa.array(out, _BIN) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return age


_NAMED = "home bigint, fresh_to binary, fresh_by binary, old_to binary, old_by binary"
_NAMED_NAMES = [part.split()[0] for part in _NAMED.split(", ")]


def _named(taken: int, turn: int):
    """The nodes that the lists have as neighbours and who names them, in one row of a batch for each cell they lie in.

    Of those that name a node in one batch, ``taken`` are kept, by a hash that changes with the round.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: list[tuple[list, list]] = [([], []), ([], [])]
            for node, others, fresh in zip(*(batch[c].to_pylist() for c in ("node", "others", "fresh"))):
                other = np.frombuffer(others, "<i8")
                for (to, by), p in zip(ends, _picks(np.frombuffer(fresh, "u1"), taken)):
                    to.append(other[p])
                    by.append(np.full(len(p), node, np.int64))
            if not len(batch):
                continue
            sides = []
            for to, by in ends:
                to, by = np.concatenate(to), np.concatenate(by)
                sides.append(_best(to, by, _lot(to, by, turn), taken)[:2])
            # Nodes rise, and with them the cells in their upper half.
            homes = np.unique(np.concatenate([to >> 32 for to, _ in sides]))
            packed = []
            for to, by in sides:
                cut = np.searchsorted(to >> 32, np.append(homes, homes[-1] + 1) if len(homes) else homes)
                packed += [pa.array([v[a:b].astype("<i8").tobytes() for a, b in zip(cut, cut[1:])], _BIN) for v in (to, by)]
            yield pa.RecordBatch.from_arrays([pa.array(homes, _INT), *packed], _NAMED_NAMES)

    return name


def _lot(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A number for every pair that looks drawn."""
    with np.errstate(over="ignore"):
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(turn)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)).astype(np.float64)


_SIDES_SCHEMA = _schema(node=_INT, cell=_INT, fresh=_BIN, old=_BIN)


def _gathered(taken: int, turn: int):
    """``(node, cell, fresh, old)``: both sides of the lists of the nodes of a cell."""

    def gather(lists: pa.Table, named: pa.Table) -> pa.Table:
        lists = lists.take(pa.array(np.argsort(lists["node"].to_numpy())))
        ids = lists["node"].to_numpy()
        others = [np.frombuffer(o, "<i8") for o in lists["others"].to_pylist()]
        picked = [_picks(np.frombuffer(f, "u1"), taken) for f in lists["fresh"].to_pylist()]
        back = []
        for kind in ("fresh", "old"):
            to, by = (np.frombuffer(b"".join(named[f"{kind}_{c}"].to_pylist()), "<i8") for c in ("to", "by"))
            to, by, _ = _best(to, by, _lot(to, by, turn), taken)
            start = np.searchsorted(to, np.append(ids, ids[-1:] + 1))
            back.append([by[a:b] for a, b in zip(start, start[1:])])
        fresh, old = [], []
        for other, p, *named_by in zip(others, picked, *back):
            sides = [np.unique(np.concatenate((other[q], by))) for q, by in zip(p, named_by)]
            fresh.append(sides[0].astype("<i8").tobytes())
            old.append(np.setdiff1d(sides[1], sides[0], assume_unique=True).astype("<i8").tobytes())
        return pa.table([lists["node"], lists["cell"], pa.array(fresh, _BIN), pa.array(old, _BIN)], _SIDES_SCHEMA)

    return gather


def _requests(asker: str, columns: list[str]):
    """``(home, asker, nodes)``: what the rows of an asker name, by the cell it lies in, each node once in a batch."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[object, list[bytes]] = {}
            for key, *named in zip(*(batch[c].to_pylist() for c in (asker, *columns))):
                by.setdefault(key, []).extend(named)
            rows = []
            for key, named in by.items():
                nodes = np.unique(np.frombuffer(b"".join(named), "<i8"))
                homes, start = np.unique(nodes >> 32, return_index=True)
                rows += [(h, str(key), nodes[a:b].tobytes()) for h, a, b in zip(homes.tolist(), start, np.r_[start[1:], len(nodes)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((_INT, pa.string(), _BIN))], _ASK_NAMES)

    return request


_ASK, _ASK_NAMES = "home bigint, asker string, nodes binary", ["home", "asker", "nodes"]


def fetched(requests: DataFrame, store: DataFrame, column: str, per_number: int) -> DataFrame:
    """``(asker, nodes, lengths, <column>)``: the values of the nodes asked for, one row for each asker and cell.

    ``store`` has a row per node with its cell. Askers and cells meet once, and what passes between them is packed, so the
    rows follow the cells and not the nodes; lengths are in units of ``per_number`` bytes.
    """
    names = ["asker", "nodes", "lengths", column]

    def answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()
        order = np.argsort(node)
        node, values = node[order], rows[column].to_pylist()
        out = []
        for asker, raw in zip(asked["asker"].to_pylist(), asked["nodes"].to_pylist()):
            own = [values[i] for i in order[np.searchsorted(node, np.frombuffer(raw, "<i8"))].tolist()]
            lengths = np.array([len(v) // per_number for v in own], "<i4")
            out.append((asker, raw, lengths.tobytes(), b"".join(own)))
        kinds = [pa.string(), _BIN, _BIN, _BIN]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    asked = requests.groupBy("home").cogroup(store.select("node", "cell", column).groupBy("cell"))
    return asked.applyInArrow(answer, f"asker string, nodes binary, lengths binary, {column} binary")


def _together(answers: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, lengths and values of all answers to one asker."""
    parts = (("nodes", "<i8"), ("lengths", "<i4"), (column, kind))
    return tuple(np.frombuffer(b"".join(answers[c].to_pylist()), k) for c, k in parts)


def _padded(ids: np.ndarray, members: list[bytes]) -> np.ndarray:
    """Places in ``ids`` of the members of each list, -1 where a list is shorter."""
    flat = np.searchsorted(ids, np.frombuffer(b"".join(members), "<i8"))
    lengths = np.array([len(m) // 8 for m in members])
    out = np.full((len(members), max(1, int(lengths.max(initial=0)))), -1, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _joined(degree: int, width: int):
    """Neighbours of the nodes of a cell meet one another."""

    def join(lists: pa.Table, points: pa.Table) -> pa.Table:
        ids, _, values = _together(points, "x", "<f2")
        # A node that several batches of the cell asked for comes more than once.
        ids, first = np.unique(ids, return_index=True)
        # The last number of each is the score that a new neighbour has to beat.
        x = values.reshape(-1, width)[first]
        x, worst = x[:, :-1], x[:, -1].astype(np.float32)
        fresh, old = _padded(ids, lists["fresh"].to_pylist()), _padded(ids, lists["old"].to_pylist())
        held, size = [], 0

        def best() -> list:
            kept = _best(*(np.concatenate(p) for p in zip(*held)), degree)
            dest, _, score = kept
            last = np.flatnonzero(np.r_[dest[1:] != dest[:-1], True]) if len(dest) else np.zeros(0, np.int64)
            count = np.diff(np.r_[-1, last])
            full = last[count >= degree]
            worst[dest[full]] = np.maximum(worst[dest[full]], score[full])
            return [kept]

        for i in range(0, len(fresh), 128):
            a, b = fresh[i : i + 128], np.concatenate((fresh[i : i + 128], old[i : i + 128]), 1)
            near = x[a].astype(np.float32) @ x[b].astype(np.float32).transpose(0, 2, 1)
            meets = (a[:, :, None] >= 0) & (b[:, None, :] >= 0) & (a[:, :, None] != b[:, None, :])
            for dest, other, flip in ((a, b, False), (b, a, True)):
                limit = worst[dest]
                row, p, q = np.nonzero(meets & (near > (limit[:, None, :] if flip else limit[:, :, None])))
                held.append((dest[row, q if flip else p], other[row, p if flip else q], near[row, p, q]))
                size += len(row)
            if size > HELD:
                held = best()
                size = len(held[0][0])
        return _update_rows(ids, *(best()[0] if held else (np.zeros(0, np.int64),) * 3))

    return join


def _with_worst(degree: int):
    """``(node, cell, x)``: the vector of a node, and after it the score of its worst neighbour, or less if it lacks some."""

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.frombuffer(s, "<f4") for s in batch["scores"].to_pylist()]
            # Rounded down, so that half precision turns no neighbour away.
            least = np.nextafter(np.array([s[-1] if len(s) >= degree else -4.0 for s in scores], "<f2"), np.float16(-8))
            x = [v + w.tobytes() for v, w in zip(batch["x"].to_pylist(), least)]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["cell"], pa.array(x, _BIN)], ["node", "cell", "x"])

    return worst


@dataclass
class Index:
    """``nodes``: ``(node, ids, vector)``; ``graph``: a row per node with its neighbours; most numbers of a vector; rounds
    until the graph was done; ids and vectors of the nodes at which walks may begin."""

    nodes: DataFrame
    graph: DataFrame
    width: int
    rounds: int
    entries: tuple[np.ndarray, np.ndarray]


def build(embeddings: DataFrame, copies: int = 21, degree: int = DEGREE, taken: int = TAKEN, cell_rows: int = CELL) -> Index:
    """The index over all vectors of ``embeddings(vec_id, embedding)``.

    Null ids, and vectors that are null, zero or hold null or non-finite components take no part; repeated rows count
    once; a shorter vector counts as if it ended in zeros. Other columns are not looked at. The planes of the cells come
    from a sample of at most ``SAMPLE_ROWS`` vectors, by hash of the id; every vector is placed and linked. A cell with
    more than ``cell_rows`` nodes is cut by hash, so that what a task holds is bounded by the cell and the lists.
    """
    vectors = distinct_vectors(embeddings, copies)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n, width, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(size)).first()
    if not n:
        nodes = vectors.select(F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("cell"), "ids", "vector")
        empty = nodes.sparkSession.createDataFrame([], _LIST)
        return Index(nodes, empty, 1, 0, (np.zeros(0, np.int64), np.zeros((0, 1))))
    if not math.isfinite(longest):
        longest = vectors.agg(F.max(F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double")))))).first()[0] * math.sqrt(width)
    rows = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    drawn = vectors.select(F.xxhash64(F.get("ids", F.lit(0))).alias("h"), "vector").orderBy("h").limit(rows)
    sample = _even(_vectors(drawn.toArrow()["vector"].combine_chunks(), width), longest)
    levels = max(0, min(math.ceil(math.log2(n / cell_rows)), int(math.log2(max(1, len(sample) / 16)))))
    planes = vectors.sparkSession.sparkContext.broadcast(Planes.grown(sample, levels))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _even(_vectors(batch["vector"], width), longest)
            cells = planes.value.cells(x)
            packed = pa.array([row.tobytes() for row in x.astype("<f2")], _BIN)
            yield pa.RecordBatch.from_arrays([batch["ids"], batch["vector"], packed, *map(pa.array, cells)], ["ids", "vector", "x", "leaf", "other_leaf"])

    kind = vectors.schema["vector"].dataType.simpleString()
    points = vectors.mapInArrow(place, f"ids array<bigint>, vector {kind}, x binary, leaf bigint, other_leaf bigint")
    points = stage_table(points, "ann-points")
    # There are at most 2**levels leaves, a number bounded by the sample; those that are too large are cut by hash. The
    # upper half of the number of a node is its cell, the lower half counts the nodes of the cell.
    parts = points.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
    first = F.get("ids", F.lit(0))
    cell = F.pmod(F.xxhash64(first), F.col("parts")) * (1 << levels) + F.col("leaf")
    placed = points.join(parts, "leaf").withColumn("cell", cell)
    number = F.row_number().over(W.partitionBy("cell").orderBy(first, "x")).cast("bigint")
    placed = stage_table(placed.withColumn("node", F.shiftleft("cell", 32).bitwiseOR(number)).drop("leaf", "parts"), "ann-nodes")
    drop_staged(points)
    drop_staged(vectors)
    entries = placed.select(F.xxhash64(first).alias("h"), "node", "vector").orderBy("h", "node").limit(min(ENTRIES, rows))
    entries = entries.select("node", "vector").toArrow().combine_chunks()
    entries = entries["node"].to_numpy(), _vectors(entries["vector"].chunk(0), width)

    meet = _meet_in_cell(degree)
    found = placed.select("node", "cell", "x").groupBy("cell").applyInArrow(meet, _FOUND)
    if levels:
        other = placed.groupBy("other_leaf").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
        other = placed.join(other, "other_leaf").select("node", "x", "other_leaf", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
        found = found.unionByName(other.groupBy("other_leaf", "part").applyInArrow(meet, _FOUND))
    none = F.lit(b"").alias
    graph = stage_table(_with_found(placed.select("node", "cell", none("others"), none("scores"), none("fresh"), "x"), found, degree), "ann-graph")
    rounds = 0
    while levels or n > cell_rows:
        turned = stage_table(_round(graph, degree, taken, rounds, width + 1), "ann-graph")
        drop_staged(graph)
        graph, rounds = turned, rounds + 1
        if graph.agg(F.sum("changed")).first()[0] <= LEFT * n * degree:
            break
    return Index(placed.select("node", "cell", "ids", "vector"), graph, width, rounds, entries)


def _round(graph: DataFrame, degree: int, taken: int, turn: int, numbers: int) -> DataFrame:
    lists = graph.select("node", "cell", "others", "fresh")
    named = lists.mapInArrow(_named(taken, turn), _NAMED)
    sides = "node bigint, cell bigint, fresh binary, old binary"
    both = lists.groupBy("cell").cogroup(named.groupBy("home")).applyInArrow(_gathered(taken, turn), sides)
    both = stage_table(both.where("octet_length(fresh) > 0"), "ann-lists")
    asked = both.select("cell", "fresh", "old").mapInArrow(_requests("cell", ["fresh", "old"]), _ASK)
    points = graph.select("node", "cell", "x", "scores").mapInArrow(_with_worst(degree), "node bigint, cell bigint, x binary")
    sent = fetched(asked, points, "x", 2).withColumn("asker", F.col("asker").cast("bigint"))
    found = both.groupBy("cell").cogroup(sent.groupBy("asker")).applyInArrow(_joined(degree, numbers + 1), _FOUND)
    aged = graph.select("node", "cell", "others", "scores", "fresh", "x").mapInArrow(_aged(taken), "node bigint, cell bigint, others binary, scores binary, fresh binary, x binary")
    return _with_found(aged, found, degree)


_STATE = "query bigint, batch string, x binary, beam binary, scores binary, seen binary"


def search(index: Index, starts: DataFrame, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """``(query, node, score)``: what a greedy walk finds for each node of ``starts(node)``, ``beam`` nodes at most.

    A walk begins at its own node and at the ``BEGINNINGS`` best of ``ENTRIES`` sampled ones, as the nearest of a short
    vector may be long ones far from it. In a step it looks at the neighbours of the ``step`` best nodes of its beam whose
    neighbours it hasn't seen, and it ends when there is none. Scores are inner products of the vectors as given, in double
    precision. Walks of one cell go in batches of about ``BATCH``; each list and vector is sent to a batch once.
    """
    width = index.width

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [v.tobytes() for v in _vectors(batch["vector"], width).astype("<f8")]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["cell"], pa.array(rows, _BIN)], ["node", "cell", "v"])

    # Double precision holds vectors of either kind as given.
    vectors = index.nodes.select("node", "cell", "vector").mapInArrow(packed, "node bigint, cell bigint, v binary")
    vectors = stage_table(vectors, "ann-vectors")
    graph = index.graph.select("node", "cell", "others")
    asking = starts.withColumn("cell", F.shiftright("node", 32))
    parts = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("parts"))
    walks = asking.join(vectors, ["node", "cell"]).join(parts, "cell").select(
        F.col("node").alias("query"),
        F.concat_ws("-", "cell", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).alias("batch"),
        F.col("v").alias("x"),
        "node",
    )

    entries = index.nodes.sparkSession.sparkContext.broadcast(index.entries)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = entries.value
        for batch in batches:
            rows = []
            for node, raw in zip(batch["node"].to_pylist(), batch["x"].to_pylist()):
                x = np.frombuffer(raw, "<f8")
                with np.errstate(all="ignore"):
                    near = (places * x).sum(1)
                    near[names == node] = -np.inf
                    best = np.argsort(-near, kind="stable")[:BEGINNINGS]
                    best = best[names[best] != node]
                    nodes, scores = np.r_[node, names[best]], np.r_[(x * x).sum(), near[best]]
                order = np.lexsort((nodes, -scores))
                rows.append((nodes[order].astype("<i8").tobytes(), scores[order].tobytes(), bytes(len(order))))
            arrays = [pa.array(list(c), _BIN) for c in zip(*rows)] if rows else [pa.array([], _BIN)] * 3
            yield pa.RecordBatch.from_arrays([batch["query"], batch["batch"], batch["x"], *arrays], _STATE_NAMES)

    state = stage_table(walks.mapInArrow(begin, _STATE), "ann-walks")
    while state.where(_open(F.col("seen"))).limit(1).count():
        going = state.where(_open(F.col("seen")))
        asked = going.select("batch", "beam", "seen").mapInArrow(_next_up(step), _ASK)
        lists = stage_table(fetched(asked, graph, "others", 8), "ann-next")
        known = lists.select("asker", "others").mapInArrow(_requests("asker", ["others"]), _ASK)
        # Lists and vectors come to a batch in one table, told apart by their columns.
        none = F.lit(None).cast("binary")
        sent = fetched(known, vectors, "v", 8).withColumn("others", none).unionByName(lists.withColumn("v", none))
        moved = going.groupBy("batch").cogroup(sent.groupBy("asker")).applyInArrow(_walk(step, beam, width), _STATE)
        after = stage_table(moved.unionByName(state.where(~_open(F.col("seen")))), "ann-walks")
        drop_staged(state)
        drop_staged(lists)
        state = after

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, "<i8") for b in batch["beam"].to_pylist()]
            query = np.repeat(batch["query"].to_numpy(), [len(f) for f in found])
            scores = np.frombuffer(b"".join(batch["scores"].to_pylist()), "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(found)), pa.array(scores)], ["query", "node", "score"])

    return state.select("query", "beam", "scores").mapInArrow(unpacked, "query bigint, node bigint, score double")


_STATE_NAMES = [part.split()[0] for part in _STATE.split(", ")]


def _open(seen: Column) -> Column:
    """Whether a beam has a node whose neighbours have not been looked at: a flag of zero."""
    return F.contains(seen, F.lit(b"\x00"))


def _chosen(seen: np.ndarray, step: int) -> np.ndarray:
    return np.flatnonzero(seen == 0)[:step]


def _next_up(step: int):
    """What the walks of a batch look at next, as requests."""
    request = _requests("batch", ["chosen"])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for beam, seen in zip(batch["beam"].to_pylist(), batch["seen"].to_pylist()):
                chosen.append(np.frombuffer(beam, "<i8")[_chosen(np.frombuffer(seen, "u1"), step)].tobytes())
            yield from request(iter([pa.RecordBatch.from_arrays([batch["batch"], pa.array(chosen, _BIN)], ["batch", "chosen"])]))

    return up


def _walk(step: int, most: int, width: int):
    """One step of the walks of a batch."""

    def walk(walks: pa.Table, sent: pa.Table) -> pa.Table:
        of_lists = pa.array([v is None for v in sent["v"].to_pylist()])
        named, lengths, others = _together(sent.filter(of_lists), "others", "<i8")
        ends = np.cumsum(lengths)
        lists = {n: others[e - k : e] for n, k, e in zip(named.tolist(), lengths.tolist(), ends.tolist())}
        ids, _, vectors = _together(sent.filter(pc.invert(of_lists)), "v", "<f8")
        vectors = vectors.reshape(-1, width)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        out = []
        for query, batch, x, beam, scores, seen in zip(*(walks[c].to_pylist() for c in _STATE_NAMES)):
            own, value, done = np.frombuffer(beam, "<i8"), np.frombuffer(scores, "<f8"), np.frombuffer(seen, "u1").copy()
            chosen = _chosen(done, step)
            done[chosen] = 1
            more = np.unique(np.concatenate([lists[n] for n in own[chosen].tolist()]))
            more = more[~np.isin(more, own)]
            with np.errstate(all="ignore"):
                near = (vectors[np.searchsorted(ids, more)] * np.frombuffer(x, "<f8")).sum(1)
            own, value = np.concatenate((own, more)), np.concatenate((value, near))
            done = np.concatenate((done, np.zeros(len(more), "u1")))
            order = np.lexsort((own, -value))[:most]
            out.append((query, batch, x, own[order].tobytes(), value[order].tobytes(), done[order].tobytes()))
        kinds = [_INT, pa.string(), _BIN, _BIN, _BIN, _BIN]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], _STATE_NAMES)

    return walk


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, degree: int = DEGREE, taken: int = TAKEN, cell_rows: int = CELL, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``is_query`` holds.

    Nearest first, ties to the smaller id, fewer if there are no more. Every row but those with the id of the query is a
    candidate. Queries of one vector walk once. What takes no part is said at ``build``; a query without a vector has no
    rows, and a repeated one has them once.
    """
    index = build(embeddings, k + 1, degree, taken, cell_rows)
    asked = embeddings.where(is_query).select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & is_vector(F.col("vector"))).distinct()
    asked = stage_table(asked.join(index.nodes.select("node", "vector"), "vector").select("query_id", F.col("node").alias("query")), "ann-asked")
    found = search(index, asked.select(F.col("query").alias("node")).distinct(), beam)
    ids = index.nodes.select("node", "ids")
    each = found.join(ids, "node").select("query", "score", F.explode("ids").alias("vec_id"))
    first = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    own = asked.join(lists, "query").select("query_id", F.filter("found", lambda f: f["vec_id"] != F.col("query_id")).alias("found"))
    return own.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )

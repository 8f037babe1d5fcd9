"""Byte-level BPE with public vocabularies: encode texts to ids and decode ids to bytes.

A text is cut into pieces by a pattern. The pieces that are not yet known to the worker are laid out as padded matrices
of token ids, one matrix per class of length. Every round each row merges its leftmost pair of least rank; rows without
a pair leave, and the columns close up. Pairs are looked up in a hash table held in two arrays.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
_FREE = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one matrix, pieces kept by a worker, bytes from which a single piece is merged with a heap, characters taken at a time.
CELLS, KNOWN, WIDE, TEXT = 1 << 20, 200_000, 2048, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file; its size, some 50,000 tokens, is that of the vocabulary and not of the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pairs:
    """Hash table from two token ids to the rank of the token they make."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _FREE)
        self.values = np.full(1 << self.bits, NONE)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == _FREE)
            taken = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[taken]], self.values[slot[taken]] = key[taken], value[taken]
            rest = np.ones(len(key), bool)
            rest[taken] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the two make no token or one of them is padding."""
        out = np.full(left.shape, NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slot = self._slot(key)
        while len(at):
            found = self.keys[slot]
            hit = found == key
            out.ravel()[at[hit]] = self.values[slot[hit]]
            more = ~hit & (found != _FREE)
            at, key, slot = at[more], key[more], (slot[more] + 1) & (len(self.keys) - 1)
        return out


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for bytes {missing}")
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.split = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        spelled = [b""] * size
        for token, rank in ranks.items():
            spelled[rank] = token
        self.length = np.array([len(t) for t in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers one after another."""
        pieces = [self.split(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = set().union(*pieces).difference(self.known)
        self.known.update(self._encode_pieces(sorted(new)))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        token = np.frombuffer(ids, "<u4").astype(np.int64)
        length = self.length[token]
        ends = np.cumsum(length)
        shift = np.repeat(self.start[token] - (ends - length), length)
        return self.spelling[shift + np.arange(len(shift))].tobytes()

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        by_class: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                yield piece, whole.to_bytes(4, "little")
            elif len(raw) > WIDE:
                yield piece, self._merge_wide(raw)
            else:
                by_class.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, members in by_class.items():
            step = max(1, CELLS >> size)
            for i in range(0, len(members), step):
                block = members[i : i + step]
                yield from zip([p for p, _ in block], self._merge_rows([r for _, r in block]))

    def _merge_rows(self, raw: list[bytes]) -> list[bytes]:
        lengths = np.array([len(r) for r in raw])
        width = int(lengths.max())
        ids = np.full((len(raw), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(raw))
        out: list[bytes] = [b""] * len(raw)
        while True:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            for r, line in zip(rows[done], ids[done]):
                out[r] = line[line >= 0].astype("<u4").tobytes()
            if done.all():
                return out
            going = ~done
            rows, ids, rank, best, least = rows[going], ids[going], rank[going], best[going], least[going]
            r = np.arange(len(rows))
            ids[r, best] = least
            width = ids.shape[1] - 1
            column = np.arange(width)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= best[:, None]), 1)
            if width > 1:
                for side in (best - 1, best):
                    fits = (side >= 0) & (side < width - 1)
                    a, s = r[fits], side[fits]
                    rank[a, s] = self.pairs.ranks(ids[a, s], ids[a, s + 1])

    def _merge_wide(self, raw: bytes) -> bytes:
        """One very wide row: the same merges, with a heap of pairs, as a matrix would take a round per byte."""
        ids = [int(i) for i in self.single[np.frombuffer(raw, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        row = np.array(ids, np.int32)
        first = self.pairs.ranks(row[:-1], row[1:])
        heap = [(int(k), i, ids[i], ids[i + 1]) for i, k in enumerate(first) if k != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    pair = np.array([ids[a]], np.int32), np.array([ids[after[a]]], np.int32)
                    found = int(self.pairs.ranks(*pair)[0])
                    if found != NONE:
                        heapq.heappush(heap, (found, a, ids[a], ids[after[a]]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


#: A vocabulary with its pattern, and the tokenizer made of it, which serves all tasks of this worker.
_worker: list = []


def _tokenizer(vocabulary: tuple[dict[bytes, int], str]) -> Tokenizer:
    if not _worker or _worker[0] is not vocabulary:
        _worker[:] = [vocabulary, Tokenizer(*vocabulary)]
    return _worker[1]


def coded(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``documents(doc_id, text)``: the ids of the text, and the bytes they spell.

    As by both functions of ``codec``, but a task has one worker and one tokenizer for the two, and what it made leaves it
    after some hundred thousand characters, so memory follows the longest text and neither the batch nor the steps.
    """
    shared = documents.sparkSession.sparkContext.broadcast((ranks, pattern))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, column, at = batch["doc_id"], batch["text"], 0
            while at < len(of):
                texts, size = [], 0
                while at + len(texts) < len(of) and size <= TEXT:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                own = _tokenizer(shared.value)
                ids = own.encode(texts)
                values = [of.slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "ids", "decoded"])
                at += len(texts)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(code, f"doc_id {kind}, ids binary, decoded binary")


def codec(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> tuple[Callable[..., Column], Callable[..., Column]]:
    """Column functions ``encode(text)`` and ``decode(ids)``; ids are bytes, four for each token, lowest first.

    A null text is empty and an empty text has no ids; null ids decode to nothing. Special tokens are ordinary text.
    The vocabulary reaches the executors as a broadcast, whose size is bounded by the vocabulary. Texts are taken a few
    hundred thousand characters at a time, so memory follows the longest text and not the batch.
    """
    shared = spark.sparkContext.broadcast((ranks, pattern))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, group, size = [], [], 0
            for text in texts:
                group.append(text or "")
                size += len(group[-1])
                if size > TEXT:
                    out += _tokenizer(shared.value).encode(group)
                    group, size = [], 0
            out += _tokenizer(shared.value).encode(group)
            yield pd.Series(out, dtype=object)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([_tokenizer(shared.value).decode(i or b"") for i in ids], dtype=object)

    return encode, decode

"""Alignment of the tokens that two tokenizers make of the same texts, and how usual each link of two tokens is.

Both token sequences spell the same bytes, so each is an array of the offsets where its tokens end. Where both end, a group
of tokens closes. The arrays are walked at the current shift of their indexes: as long as they are equal there, tokens are
one to one, and such a stretch is found by probing windows that grow by a factor, the last of which tells where it ends.
What is not one to one is resolved token by token up to the next common end, which gives the shift for the next stretch.

Links are then counted over the corpus: chunks of documents send each pair of ids once with the number of documents that
hold it, and ask for the sums of the pairs they have.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.sources.sinks import stage_table

#: Characters encoded at a time, tokens of both kinds in one chunk of documents, pairs of one group listed one by one, and
#: tokens of the first probe of a stretch.
TEXT, CHUNK, PAIRS, PROBE = 400_000, 8_000_000, 4096, 16
SPACE_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: a printable one for itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, and the bytes of every token.

    The byte-level vocabulary is read from its own file. As its ids rise in the order of its merges, which is checked, they
    are ranks, and a tokenizer by ranks cuts and merges as the file says, some times faster than one that reads merges.
    """

    def __init__(self, byte_bpe: str, pieces: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as source:
            model = json.load(source)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][x + y] for x, y in pairs]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        merged = {bytes(alphabet[c] for c in x + y) for x, y in pairs}
        if order != sorted(order) or any(len(t) > 1 and t not in merged for t in ranks if ranks[t] <= order[-1]):
            raise ValueError(f"the ids of {byte_bpe} do not follow its merges")
        # What comes after the last merge is special, and special tokens are plain text here.
        ranks = {t: i for t, i in ranks.items() if i <= order[-1]}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text; none where a text is empty or the tokens don't spell it with a space before it."""
        second = self.b.encode(texts, num_threads=1)
        out, none = [], np.zeros(0, np.int64)
        for text, b in zip(texts, second):
            raw = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            # Every byte has a token of A, so its tokens always spell the text.
            same = text and _spelled(self.b_bytes, b) == raw
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else (none, none))
        return out

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return common_cuts(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))


def _spelled(table: list[bytes], ids: list[int]) -> bytes:
    """The entries of all ids, one after another."""
    return b"".join(itemgetter(*ids)(table)) if len(ids) > 1 else b"".join(table[i] for i in ids)


def common_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side are done at each common end; both arrays rise and end alike."""
    n, m = len(a), len(b)
    # Ends that are alike nowhere, so that no stretch goes beyond the last token.
    a_list, b_list = [*a.tolist(), -1], [*b.tolist(), -2]
    starts, others, stops = [], [], []
    i = j = 0
    while i < n:
        # An irregular group: step on whichever side is behind until both end.
        x, y = a_list[i], b_list[j]
        while x != y:
            if x < y:
                i += 1
                x = a_list[i]
            else:
                j += 1
                y = b_list[j]
        starts.append(i)
        others.append(j)
        # A stretch at this shift: windows that grow until one holds a difference, whose place ends the stretch.
        i, j, width = i + 1, j + 1, PROBE
        while a_list[i : i + width] == b_list[j : j + width]:
            i, j, width = i + width, j + width, 4 * width
        if width == PROBE:
            while a_list[i] == b_list[j]:
                i, j = i + 1, j + 1
        else:
            room = min(width, n - i, m - j)
            differs = a[i : i + room] != b[j : j + room]
            at = int(differs.argmax()) if differs.any() else room
            i, j = i + at, j + at
        stops.append(i)
    run = np.array(stops, np.int64) - np.array(starts, np.int64)
    done = np.arange(1, run.sum() + 1)
    # What lies between the stretches are the tokens that end within a group.
    first = np.cumsum(run) - run
    return tuple(done + np.repeat(np.array(at, np.int64) - first, run) for at in (starts, others))


#: The tokenizers of this worker, by their paths.
_workers: dict[tuple[str, str, str], Pair] = {}


def _pair(of: tuple[str, str, str]) -> Pair:
    if of not in _workers:
        _workers[of] = Pair(*of)
    return _workers[of]


def _u4(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


_Row = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _rows(of: tuple[str, str, str]):
    """Ids of documents, and for each both kinds of tokens and both kinds of cuts, some hundred thousand characters at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[_Row]]]:
        pair = _pair(of)
        for batch in batches:
            ids, column = batch["doc_id"], batch["text"]
            at = 0
            while at < len(ids):
                texts, size = [], 0
                while at + len(texts) < len(ids) and (not texts or size <= TEXT):
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                yield ids.slice(at, len(texts)), [(a, b, *pair.cuts(a, b)) for a, b in pair.encode(texts)]
                at += len(texts)

    return rows


def _aligned(of: tuple[str, str, str]):
    rows = _rows(of)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in rows(batches):
            columns = zip(*(map(_u4, row) for row in group))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), pa.binary()) for c in columns)], _NAMES)

    return align


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))


def aligned(documents: DataFrame, byte_bpe: str, pieces: str, pattern: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_cuts, b_cuts`` of every row; each is a run of little-endian unsigned 32-bit numbers.

    ``a_ids`` are the ids of the byte-level vocabulary for a space and the text, ``b_ids`` those of the piece model for the
    text, before which the model itself puts a space; ``pattern`` cuts a text for the former. Special tokens in texts are
    plain text. The cuts tell how many tokens are done where a group ends. Null and empty texts, and texts whose tokens
    don't spell the text, have none. Rows are not merged and other columns are not looked at. The files are read by each
    worker and must be there. Some hundred thousand characters, or one longer text, are encoded at a time.
    """
    return _texts(documents).mapInArrow(
        _aligned((byte_bpe, pieces, pattern)), "doc_id bigint, a_ids binary, b_ids binary, a_cuts binary, b_cuts binary"
    )


_NAMES = ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"]


def links(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of linked ids, as ``a << bits | b``, rising, and how many links each has."""
    n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    pairs = n_a * n_b
    one = pairs == 1
    keys = [a[a_cuts[one] - 1] << bits | b[b_cuts[one] - 1]]
    listed = np.flatnonzero(~one & (pairs <= PAIRS))
    if len(listed):
        size = pairs[listed]
        start_a, start_b, wide = (a_cuts - n_a)[listed], (b_cuts - n_b)[listed], n_b[listed]
        group = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        of_a = within // wide[group]
        keys.append(a[start_a[group] + of_a] << bits | b[start_b[group] + within - of_a * wide[group]])
    key, count = _counts(np.concatenate(keys))
    wide_groups = np.flatnonzero(pairs > PAIRS)
    if not len(wide_groups):
        return key, count
    keys, counts = [key], [count]
    for g in wide_groups:
        (x, x_n), (y, y_n) = (np.unique(s[c[g] - n[g] : c[g]], return_counts=True) for s, c, n in ((a, a_cuts, n_a), (b, b_cuts, n_b)))
        keys.append((x[:, None] << bits | y).ravel())
        counts.append((x_n[:, None] * y_n).ravel())
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(count, start)


def _counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and how often each is there."""
    key = np.sort(key)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[start], np.diff(start, append=len(key))


class Spelling:
    """Groups as text: ids of either side with commas, a bar between the sides, a semicolon after each group."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.n_b = n_a, n_b
        self.table = [f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]

    def __call__(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> bytes:
        n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        shown = a.copy()
        shown[a_cuts - 1] += self.n_a
        out[np.arange(len(a)) + np.repeat(b_cuts - n_b, n_a)] = shown
        shown = b + 2 * self.n_a
        shown[b_cuts - 1] += self.n_b
        out[np.arange(len(b)) + np.repeat(a_cuts, n_b)] = shown
        return _spelled(self.table, out.tolist())[:-1]


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Steps between keys, and counts in as few bytes as the largest needs."""
    wide = next(k for k in ("u1", "<u2", "<u4", "<u8") if counts.max(initial=0) <= np.iinfo(k).max)
    return np.diff(keys, prepend=0).astype("<u8" if keys.max(initial=0) >> 32 else "<u4").tobytes(), counts.astype(wide).tobytes()


def _unpacked(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(keys, f"<u{len(keys) // n}").astype(np.int64)
    return np.cumsum(steps), np.frombuffer(counts, f"<u{len(counts) // n}").astype(np.int64)


_COUNTED = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs bigint, pairs binary, times binary"


def _counted(of: tuple[str, str, str], n_a: int, n_b: int):
    bits, aligned_rows = (n_b - 1).bit_length(), _rows(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(n_a, n_b)
        chunk, held = TaskContext.get().partitionId() << 33, 0
        names = [part.split()[0] for part in _COUNTED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]
        for ids, group in aligned_rows(batches):
            rows = []
            for doc_id, (a, b, a_cuts, b_cuts) in zip(ids.to_pylist(), group):
                held += len(a) + len(b)
                if held > CHUNK:
                    chunk, held = chunk + 1, len(a) + len(b)
                keys, times = links(a, b, a_cuts, b_cuts, bits)
                digest = hashlib.sha256(spelling(a, b, a_cuts, b_cuts)).hexdigest() if len(a) else ""
                rows.append((chunk, doc_id, len(a), len(b), len(a_cuts), int(times.sum()), digest, len(keys), *_packed(keys, times)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return count


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, pair, docs)``: every pair of a chunk with the number of its documents in the batch that hold it."""
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        rows = list(zip(*(batch[c].to_pylist() for c in ("n_pairs", "pairs", "times"))))
        for chunk in np.unique(chunks):
            keys = [_unpacked(*rows[i])[0] for i in np.flatnonzero(chunks == chunk) if rows[i][0]]
            if keys:
                pair, docs = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(docs)], ["chunk", "pair", "docs"])


_WEIGHED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _answered(documents: pa.Table, answers: pa.Table) -> pa.Table:
    order = np.argsort(answers["pair"].to_numpy(), kind="stable")
    pair, docs, best = (answers[c].to_numpy()[order] for c in ("pair", "docs", "best"))
    n_best, count_sum = [], []
    for n, keys, times in zip(*(documents[c].to_pylist() for c in ("n_pairs", "pairs", "times"))):
        if not n:
            n_best.append(0)
            count_sum.append(0)
            continue
        key, time = _unpacked(n, keys, times)
        at = np.searchsorted(pair, key)
        n_best.append(int(time[best[at]].sum()))
        count_sum.append(int((time * docs[at]).sum()))
    own = {c: documents[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    every = own | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({c: every[c] for c in (part.split()[0] for part in _WEIGHED.split(", "))})


def weighed(documents: DataFrame, byte_bpe: str, pieces: str, pattern: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``documents``.

    Texts are aligned as by ``aligned``. A link is a pair of occurrences in one group; the count of its ids is the number of
    rows in which they are linked, over the whole table, and it is best if no other pair with that id of A has a higher
    one. A row without tokens has zeros and an empty digest.

    Tokens are turned into pairs as they come, so they never leave the task. A chunk holds documents of about ``CHUNK``
    tokens, or one longer document. Counts are summed before they are sent, so a pair that stands in every document has
    one row for each chunk; the best of an id are at most as many rows as the vocabulary has ids.
    """
    of = (byte_bpe, pieces, pattern)
    pair = Pair(*of)
    n_a, n_b = len(pair.a_bytes), len(pair.b_bytes)
    bits = (n_b - 1).bit_length()
    counted = stage_table(_texts(documents).mapInArrow(_counted(of, n_a, n_b), _COUNTED), "align-documents")
    asked = counted.select("chunk", "n_pairs", "pairs", "times").mapInArrow(_asked, "chunk bigint, pair bigint, docs bigint")
    asked = stage_table(asked, "align-pairs")
    sums = stage_table(asked.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", bits)), "align-counts")
    highest = sums.groupBy("a").agg(F.max("docs").alias("most"))
    sums = sums.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    answers = asked.select("chunk", "pair").distinct().join(sums, "pair")
    return counted.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_answered, _WEIGHED)

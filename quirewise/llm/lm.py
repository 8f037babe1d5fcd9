"""Scores of texts under a word model by deleted interpolation.

The chance of a word after another mixes the maximum-likelihood bigram and unigram estimates with a uniform share; the
weights of the mix depend on the bucket (power of two) of the context's frequency and are learned by expectation
maximisation on counts held out of the training texts.

Counts grow with the corpus, so no task and no broadcast holds them. Texts are written once as compressed chunks of some
8 MB. Each chunk asks for the counts of its distinct words and bigrams: it sends their sorted 64-bit hashes, cut by
range, to the buckets that sum them over all chunks, and gets the sums back in the same order. A frequent word is one
key per chunk, so hot words, hot sources and copies make no hot task. Number of chunks and of buckets follow the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.sources.sinks import stage_table

CHUNK_BYTES = 8 << 20
#: Distinct keys that a bucket is to sum, and keys expected of a chunk.
BUCKET_KEYS, CHUNK_KEYS = 1_000_000, 1_000_000
#: What texts are for: scored only, counted for the weights, counted for the estimates.
TEST, DELETED, RETAINED = 0, 1, 2
CONTEXTS = 64
_STEP = 8
_BLOCK = 1 << 19

_random = np.random.default_rng(6)
_SYMBOL = _random.integers(0, 2**64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SYMBOL = _SYMBOL[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
END, START = np.uint64(1), np.uint64(2)

_powers: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        known = np.full(max(n, _BLOCK + (1 << 16)), base)
        known[0] = 1
        _powers[kind] = known = np.cumprod(known)
    return known[:n]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of some bytes, A-Z taken as a-z."""
    n = len(data)
    word = ~_SPACE[data]
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    change = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = change[::2], change[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * _power("up", _BASE, n), out=sums[1:])
    return starts, _mixed((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of the texts, an end behind each text, and the number of tokens of each text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, counts = [], np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK)))
        last = min(last, len(texts))
        # A space goes between texts, so that words end with their text.
        own = offsets[first : last + 1] - offsets[first]
        block = np.full(own[-1] + last - first, 32, np.uint8)
        shift = np.repeat(np.arange(last - first), np.diff(own))
        block[np.arange(own[-1]) + shift] = data[offsets[first] : offsets[last]]
        starts, hashes = _word_hashes(block)
        upto = np.searchsorted(starts, own + np.arange(len(own)))
        n = np.diff(upto) + 1
        out = np.full(int(n.sum()), END, np.uint64)
        out[np.arange(len(starts)) + np.repeat(np.arange(last - first), n - 1)] = hashes
        parts.append(out)
        counts[first:last] = n
        first = last
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


@dataclass
class Keyed:
    """Tokens of some texts with the keys of their contexts and bigrams."""

    word: np.ndarray
    context: np.ndarray
    bigram: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Keyed:
        word, lengths = tokens(texts)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[(np.cumsum(lengths) - lengths)] = START
        return Keyed(word, context, _mixed(context * _BASE + word), lengths)


def _zip(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unzip(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _zip_sorted(values: np.ndarray) -> bytes:
    """Steps between sorted keys, byte plane by byte plane: the high planes are nearly all zero."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unzip_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _frozen(texts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(texts)
    return sink.getvalue().to_pybytes()


def _thawed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(table: pa.Table) -> pa.Array:
    column = table["text"].cast(pa.large_string()).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def chunked(documents: DataFrame) -> DataFrame:
    """``(chunk, texts, deleted)``: texts in chunks as they are read, and those kept for the weights once more."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    role = F.when(remainder == 1, DELETED).when(remainder > 1, RETAINED).otherwise(TEST)
    rows = documents.select("doc_id", role.cast("int").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, done = [], 0, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            deleted = table.filter(pc.equal(table["role"], DELETED))
            name = f"{TaskContext.get().partitionId()}-{done}"
            return pa.RecordBatch.from_pydict({"chunk": [name], "texts": [_frozen(table)], "deleted": [_frozen(deleted)]})

        for batch in batches:
            at = 0
            ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(ends, before + CHUNK_BYTES - size)) + 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= CHUNK_BYTES:
                    yield out()
                    held, size, done = [], 0, done + 1
        if held:
            yield out()

    return rows.mapInArrow(pack, "chunk string, texts binary, deleted binary")


def _asked(chunks: DataFrame, bits: int) -> DataFrame:
    """``(bucket, kind, chunk, keys, retained, deleted)``: keys of a chunk in the range of a bucket, with its own counts.

    Kinds: words and bigrams of all texts (0, 1), and of those kept for the weights (2, 3), which carry no counts.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, frozen, apart in zip(*(batch[c].to_pylist() for c in ("chunk", "texts", "deleted"))):
                for first, data in ((0, frozen), (2, apart)):
                    table = _thawed(data)
                    keyed = Keyed.of(_texts(table))
                    role = np.repeat(table["role"].to_numpy().astype(np.uint8), keyed.lengths) if first == 0 else None
                    rows = []
                    for kind, keys in ((first, keyed.word), (first + 1, keyed.bigram)):
                        if kind == first:
                            # Every context is a word and as frequent as it, but for the start.
                            keys = np.concatenate((keys, np.full(len(keyed.lengths), START)))
                            own = None if role is None else np.concatenate((role, table["role"].to_numpy().astype(np.uint8)))
                        else:
                            own = role
                        if own is None:
                            distinct = np.unique(keys)
                            counts = [np.zeros(len(distinct), np.uint32)] * 2
                        else:
                            distinct, place = np.unique(keys, return_inverse=True)
                            counts = [
                                np.bincount(place[own == r], minlength=len(distinct)).astype(np.uint32)
                                for r in (RETAINED, DELETED)
                            ]
                        bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
                        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                        for b in range(1 << bits):
                            lo, hi = cuts[b], cuts[b + 1]
                            if lo < hi:
                                part = _zip_sorted(distinct[lo:hi]), _zip(counts[0][lo:hi]), _zip(counts[1][lo:hi])
                                rows.append((b, kind, chunk, *part))
                    del keyed, table, keys, own
                    pa.default_memory_pool().release_unused()
                    if rows:
                        names = ["bucket", "kind", "chunk", "keys", "retained", "deleted"]
                        arrays = dict(zip(names, map(list, zip(*rows))))
                        yield pa.RecordBatch.from_pydict(
                            {n: pa.array(v, pa.int32()) if n in ("bucket", "kind") else v for n, v in arrays.items()}
                        )

    return chunks.mapInArrow(
        ask, "bucket int, kind int, chunk string, keys binary, retained binary, deleted binary"
    )


def _answered(asked: DataFrame) -> DataFrame:
    """``(chunk, kind, bucket, retained, whole, tokens, types)``: sums over all chunks, in the order they were asked.

    A row without a chunk carries the number of training tokens and of distinct ones in the bucket.
    """

    def count(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        kind = rows["kind"].to_numpy()
        out = []
        for pair in (0, 1):
            mine = [int(i) for i in np.flatnonzero(kind % 2 == pair)]
            if not mine:
                continue
            keys = [_unzip_sorted(rows["keys"][i].as_py()) for i in mine]
            ends = np.cumsum([len(k) for k in keys])
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = []
            for name in ("retained", "deleted"):
                own = np.concatenate([_unzip(rows[name][i].as_py(), np.uint32) for i in mine])
                sums.append(np.bincount(place, weights=own, minlength=len(distinct)).astype(np.uint64))
            whole = sums[0] + sums[1]
            if pair == 0:
                real = distinct != START
                out.append((None, 0, None, None, int(whole[real].sum()), int((whole[real] > 0).sum()), int(sums[0][real].sum())))
            for i, end, own in zip(mine, ends, keys):
                at = place[end - len(own) : end]
                out.append((rows["chunk"][i].as_py(), int(kind[i]), _zip(sums[0][at]), _zip(whole[at]), 0, 0, 0))
        names = ["chunk", "kind", "retained", "whole", "tokens", "types", "retained_tokens"]
        table = dict(zip(names, map(list, zip(*out))))
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = {n: pa.array(table[n], t) for n, t in zip(names, kinds)}
        columns["bucket"] = pa.array([bucket] * len(out), pa.int32())
        return pa.table(columns)

    return asked.groupBy("bucket").applyInArrow(
        count,
        "chunk string, kind int, retained binary, whole binary, tokens bigint, types bigint, retained_tokens bigint, "
        "bucket int",
    )


def _counts(answers: pa.Table, kind: int, column: str) -> np.ndarray:
    rows = answers.filter(pc.equal(answers["kind"], kind)).sort_by("bucket")
    parts = [_unzip(data.as_py(), np.uint64) for data in rows[column]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _looked_up(keyed: Keyed, answers: pa.Table, first: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the word, the context and the bigram of every token."""
    n = len(keyed.word)
    everything = np.concatenate((keyed.word, np.full(len(keyed.lengths), START)))
    distinct, place = np.unique(everything, return_inverse=True)
    word = _counts(answers, first, column)
    begins = word[place[n]] if len(place) > n else np.uint64(0)
    of_word = word[place[:n]]
    of_context = np.empty_like(of_word)
    of_context[1:] = of_word[:-1]
    of_context[keyed.context == START] = begins
    place = np.unique(keyed.bigram, return_inverse=True)[1]
    return of_word, of_context, _counts(answers, first + 1, column)[place]


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of the log to base 2."""
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0).clip(0, CONTEXTS - 1)


def weights(events: np.ndarray, types: int, rounds: int = 100) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate per context bucket, by expectation maximisation.

    ``events`` has rows of bucket, bigram chance, unigram chance and number. Buckets without events get the weights
    learned from all events. A context that was never seen has no bigram share.
    """

    def learn(rows: np.ndarray) -> np.ndarray:
        mix = np.array([0.4, 0.4, 0.2])
        chances = np.stack([rows[:, 1], rows[:, 2], np.full(len(rows), 1 / (types + 1))], 1)
        for _ in range(rounds):
            share = chances * mix
            share *= (rows[:, 3] / share.sum(1))[:, None]
            mix = share.sum(0) / share.sum()
        return np.maximum(mix, [0, 0, 1e-6]) / np.maximum(mix, [0, 0, 1e-6]).sum()

    every = learn(events) if len(events) else np.array([0.4, 0.4, 0.2])
    out = np.tile(every, (CONTEXTS, 1))
    for bucket in np.unique(events[:, 0]).astype(int) if len(events) else ():
        out[bucket] = learn(events[events[:, 0] == bucket])
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def _events(chunks: DataFrame, answers: DataFrame, retained: int) -> np.ndarray:
    """What the deleted texts show: numbers of (context bucket, bigram chance, unigram chance), chances on a log grid.

    The grid has eight steps to the doubling, so at most some ten thousand rows reach the driver whatever the input.
    """

    def see(texts: pa.Table, own: pa.Table) -> pa.Table:
        keyed = Keyed.of(_texts(_thawed(texts["deleted"][0].as_py())))
        word, context, bigram = _looked_up(keyed, own, 2, "retained")
        with np.errstate(divide="ignore"):
            two = np.round(_STEP * np.log2(bigram / np.maximum(context, 1))).clip(-1000, 0)
            one = np.round(_STEP * np.log2(word / max(1, retained))).clip(-1000, 0)
        rows, n = np.unique(np.stack([context_bucket(context), two, one], 1).astype(np.int32), axis=0, return_counts=True)
        return pa.table({"bucket": rows[:, 0], "two": rows[:, 1], "one": rows[:, 2], "n": n.astype(np.int64)})

    left = chunks.select("chunk", "deleted").groupBy("chunk")
    seen = left.cogroup(answers.where("kind >= 2").groupBy("chunk")).applyInArrow(see, "bucket int, two int, one int, n bigint")
    rows = seen.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).orderBy("bucket", "two", "one").collect()
    table = np.array([(r["bucket"], r["two"], r["one"], r["n"]) for r in rows], np.float64).reshape(-1, 4)
    for column in (1, 2):
        table[:, column] = np.where(table[:, column] <= -1000, 0.0, 2.0 ** (table[:, column] / _STEP))
    return table


def scored(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``documents``.

    Learned from the texts whose crc32(doc_id) mod 10 is not 0; of these the ones with remainder 1 give the weights, and
    the final estimates count them all. A row with a null id is scored, not learned from, and not held out. A null text
    is empty: one token, the end. Repeated rows count and score each. With no training text every token has the uniform
    chance. An empty table gives no rows; other columns are not looked at.
    """
    chunks = stage_table(chunked(documents), "lm-chunks")
    n_chunks = chunks.count()
    bits = max(0, (n_chunks * CHUNK_KEYS // BUCKET_KEYS)).bit_length()
    answers = stage_table(_answered(_asked(chunks, bits)), "lm-counts")
    total = answers.where("chunk is null").agg(F.sum("tokens"), F.sum("types"), F.sum("retained_tokens")).first()
    n, types, retained = (x or 0 for x in total)
    answers = answers.where("chunk is not null")
    mix = weights(_events(chunks, answers, retained), types)

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        table = _thawed(texts["texts"][0].as_py())
        keyed = Keyed.of(_texts(table))
        word, context, bigram = _looked_up(keyed, own, 0, "whole")
        kind = context_bucket(context)
        chance = mix[:, 0][kind] * (bigram / np.maximum(context, 1))
        chance += mix[:, 1][kind] * (word / max(1, n))
        chance += mix[:, 2][kind] / (types + 1)
        base = np.log10((word + 0.1) / (n + 0.1 * (types + 1)))
        starts = np.cumsum(keyed.lengths) - keyed.lengths
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_tokens": keyed.lengths,
                "n_known": np.add.reduceat((word > 0).astype(np.int64), starts),
                "train_tokens": np.full(len(starts), n, np.int64),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(np.log10(chance), starts),
            }
        )

    left = chunks.select("chunk", "texts").groupBy("chunk")
    found = left.cogroup(answers.where("kind < 2").groupBy("chunk")).applyInArrow(
        score,
        "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

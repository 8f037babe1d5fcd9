"""Alignment of two tokenizers against sets of offsets and plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirewise.llm import align

ROOT = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B, public_tokenizers.PATTERN)


def test_cuts_are_the_common_ends():
    rng = random.Random(5)
    for n in list(range(1, 40)) + [300, 1000]:
        for share in (0.05, 0.5, 0.95, 1.0):
            common = sorted(rng.sample(range(1, 4 * n + 1), n))
            a, b = ({x for x in common if rng.random() < share} | {4 * n + 1} for _ in range(2))
            a, b = (np.array(sorted(s | set(rng.sample(range(1, 4 * n + 1), n // 5)))) for s in (a, b))
            both = sorted(set(a.tolist()) & set(b.tolist()))
            cuts = align.common_cuts(a, b)
            assert a[cuts[0] - 1].tolist() == both == b[cuts[1] - 1].tolist()
    assert [len(c) for c in align.common_cuts(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def plain(rows):
    """The contract, word for word, with dictionaries."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = align.byte_alphabet()
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            a = [(i, bytes(alphabet[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in pieces.encode(text):
                piece = pieces.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
            if b"".join(t for _, t in a) == (" " + text).encode() == b"".join(t for _, t in b):
                ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
                for end in sorted(ends[0] & ends[1]):
                    sides = []
                    for side in (a, b):
                        at, own = 0, []
                        for i, t in side:
                            at += len(t)
                            if (groups[-1][2] if groups else 0) < at <= end:
                                own.append(i)
                        sides.append(own)
                    groups.append((*sides, end))
        docs.append((doc_id, groups))
    found = [Counter((x, y) for a, b, _ in groups for x in a for y in b) for _, groups in docs]
    count = Counter(p for links in found for p in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, groups), linked in zip(docs, found):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        out.append((
            doc_id, sum(len(a) for a, _, _ in groups), sum(len(b) for _, b, _ in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def run(df, pair):
    got = align.weighed(df, A, B, public_tokenizers.PATTERN)
    return sorted((tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_whole_table(spark, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").where("n_chars < 6000").select("doc_id", "text").collect()]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string"), pair) == plain(rows)


ODD = [
    (1, "Hello <|endoftext|> </s> <0x41> world"), (1, "Hello <|endoftext|> </s> <0x41> world"), (2, None), (3, ""), (4, "  two  spaces \n\n\t"),
    (5, "▁mark"), (6, "日本語のテキスト、漢字とかな。" * 30), (7, "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 é é ﬁ"), (8, "\x00\x01 a"),
    (None, "no id"), (9, "aaaaaaaa" * 400), (10, " "), (11, "\r\n Ġ Ċ"), (12, "1234567890" * 20 + " " * 70 + "x"),
]


def test_odd_rows(spark, pair):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("chunk", "pairs", "n_a", "a_ids")})
    got = run(df, pair)
    assert got == plain(ODD) and len(got) == len(ODD)
    zeros = {r[0] for r in got if r[1:] == (0, 0, 0, 0, 0, 0, "")}
    assert {2, 3} <= zeros and 4 not in zeros
    assert run(df.limit(0), pair) == []


def test_chunks_and_wide_groups(spark, pair, monkeypatch):
    rows = [(i, t) for i, t in ODD if t and len(t) < 600] * 3
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string").coalesce(1)
    whole = run(df, pair)
    monkeypatch.setattr(align, "PAIRS", 0)
    a = np.array([1, 2, 1, 3], np.int64)
    wide = align.links(a, a, np.array([4]), np.array([4]), 4)
    monkeypatch.setattr(align, "PAIRS", 100)
    listed = align.links(a, a, np.array([4]), np.array([4]), 4)
    assert [x.tolist() for x in wide] == [x.tolist() for x in listed] and wide[1].sum() == 16
    assert whole == plain([(i, t) for i, (_, t) in enumerate(rows)])


def test_rows_read_back(spark, pair):
    text = "Reading back, token by token: naïve façade 漢字."
    row = align.aligned(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), A, B, public_tokenizers.PATTERN).first()
    ids = {c: np.frombuffer(row[c], "<u4").tolist() for c in ("a_ids", "b_ids", "a_cuts", "b_cuts")}
    at, spelled = (0, 0), b""
    for cut in zip(ids["a_cuts"], ids["b_cuts"]):
        a, b = (b"".join(table[i] for i in ids[c][f:t]) for c, table, f, t in (("a_ids", pair.a_bytes, at[0], cut[0]), ("b_ids", pair.b_bytes, at[1], cut[1])))
        assert a == b != b""
        spelled, at = spelled + a, cut
    assert spelled.decode() == " " + text


def test_tokens_are_counted_without_being_packed(pair, monkeypatch):
    """Packing tokens and cuts between two steps of one task cost CPU time and is for ``aligned`` only."""

    class Task:
        get = staticmethod(lambda: type("Of", (), {"partitionId": staticmethod(lambda: 3)}))

    def packs(values):
        raise AssertionError("packed")

    texts = ["one two  three", "", None, "ünï \U0001f600 <|endoftext|> 42", "a" * 700 + " b" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(align, "TaskContext", Task)
    monkeypatch.setattr(align, "_u4", packs)
    got = pa.Table.from_batches(align._counted((A, B, public_tokenizers.PATTERN), len(pair.a_bytes), len(pair.b_bytes))(iter([batch]))).to_pylist()
    assert [r["doc_id"] for r in got] == list(range(5)) and {r["chunk"] for r in got} == {3 << 33}
    for row, (a, b) in zip(got, pair.encode([t or "" for t in texts])):
        cuts = pair.cuts(a, b)
        n_a, n_b = (np.diff(c, prepend=0) for c in cuts)
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (len(a), len(b), len(cuts[0]), int((n_a * n_b).sum()))


def test_links_of_groups_of_any_size(monkeypatch):
    rng = np.random.default_rng(8)
    for most in (1, 4, 4096):
        monkeypatch.setattr(align, "PAIRS", most)
        for n in (1, 2, 9, 60):
            ends = [np.unique(np.r_[rng.integers(1, n + 1, n), n]) for _ in range(2)]
            cuts = align.common_cuts(*ends)
            a, b = (rng.integers(0, 5, len(e)) for e in ends)
            want, i, j = Counter(), 0, 0
            for x, y in zip(*cuts):
                want.update(int(p) << 4 | int(q) for p in a[i:x] for q in b[j:y])
                i, j = x, y
            keys, counts = align.links(a, b, *cuts, 4)
            assert dict(zip(keys.tolist(), counts.tolist())) == want and keys.tolist() == sorted(want)

"""The prefix trie against a plain walk over all prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quirewise.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROOT = "/root/testdata/sf0.001"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_leaves = leaves.get(node, 0) if children.get(node) else 1
        own_saved = saved.get(node, 0) + (len(members[node]) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
        leaves[node], saved[node] = own_leaves, own_saved
        if node:
            up = node[:-1]
            children[up], leaves[up], saved[up] = children.get(up, 0) + 1, leaves.get(up, 0) + own_leaves, saved.get(up, 0) + own_saved
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), up, len(convs), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def both(spark, rows, **parameters):
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("depth", "p1", "at", "pid", "words", "n")}), **parameters).collect()]
    assert len(got) == len(set(got))
    return set(got), brute(rows)


def random_rows(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 4 * convs), convs):
        for t in range(rng.randrange(0, longest)):
            rows.append((c, t if rng.random() < 0.95 else rng.choice([None, 0, t - 1]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice(words)))
    rng.shuffle(rows)
    return rows


WORDS = ["a b", "a", "", None, " x\ty\n", "long " * 50]


@pytest.mark.parametrize("shard_rows, piece, seed", [(100_000, 50_000, 1), (6, 3, 2), (0, 1, 2), (40, 2, 1)])
def test_equals_a_plain_walk(spark, shard_rows, piece, seed):
    got, expected = both(spark, random_rows(seed, 80, 9, WORDS if seed == 1 else ["a", "b"]), shard_rows=shard_rows, piece=piece)
    assert got == expected


def test_copies_chains_and_ties(spark):
    copies = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(5)]
    chain = [(7, t, "user", "x" if t % 3 else None) for t in range(700)]
    ties = [(3, 1, r, x) for r in ("b", "a", None) for x in ("z", "y", "y")] + [(3, None, "user", "first")] * 3
    got, expected = both(spark, copies + chain + ties, shard_rows=50, piece=16)
    assert got == expected


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got, expected = both(spark, rows)
    assert got == expected and len(got) > 50


def test_spans_of_long_conversations(spark):
    rows = [(c, d, bytes([c, d % 7]), 1, 40) for c in (1, 2) for d in range(1, 41)]
    df = spark.createDataFrame(rows, "conv_id bigint, depth bigint, turn_key binary, words bigint, length bigint")
    whole, cut = ({(r.conv_id, r.depth): (r.p1, r.p2, r.q1, r.q2) for r in trie.prefixes(df, span).collect()} for span in (1 << 16, 4))
    assert whole == cut and len(set(whole.values())) == 80
    assert all(whole[c, d][2:] == whole[c, d - 1][:2] for c in (1, 2) for d in range(2, 41))


def test_odd_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0
    got, expected = both(spark, [(21, 0, None, None), (2**62, None, None, ""), (41, 5, "user", "w " * 100_000)])
    assert got == expected


def test_queue_spills():
    queue, rng = trie.SpillingQueue(2, rows=5), random.Random(3)
    rows = [(rng.randrange(50), i) for i in range(200)]
    out = []
    for i, row in enumerate(rows):
        queue.push(row)
        if i % 7 == 0:
            out.append(queue.pop())
    assert queue.runs
    while queue.least() is not None:
        out.append(queue.pop())
    assert sorted(out) == sorted(rows) and out[29:] == sorted(out[29:])

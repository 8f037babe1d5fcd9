"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.llm import ann

ROOT = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k=20):
    """The nearest of every query, all candidates compared in double precision."""
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in rows), default=1)
    rows = sorted(rows)
    ids = np.array([i for i, _ in rows], np.int64)
    x = np.array([v + (0.0,) * (width - len(v)) for _, v in rows], np.float32).astype(np.float64).reshape(-1, width)
    out = {}
    for i in sorted({i for i in ids.tolist() if i % 20 == 0}):
        score = (x * x[ids == i][0]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df, **parameters):
    out = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, **parameters).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, expected):
    return got.keys() == expected.keys() and all(
        [a for a, _ in got[q]] == [a for a, _ in expected[q]] and np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], rtol=1e-12)
        for q in expected
    )


def recall(got, expected):
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) / len(expected[q]) for q in expected])


def test_whole_table_in_one_cell(spark):
    df = spark.read.parquet(f"{ROOT}/embeddings.parquet")
    assert same(found(df), brute([(r.vec_id, r.embedding) for r in df.collect()]))


@pytest.mark.parametrize("lengths, least", [("one", 0.95), ("many", 0.9)])
def test_many_cells(spark, lengths, least):
    source = np.random.default_rng(4)
    x = source.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "many":
        x *= source.uniform(0.5, 2.0, size=(1200, 1))
    x[900:] = x[17]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, expected = found(spark.createDataFrame(rows, SCHEMA), cell_rows=150, degree=24, taken=12, beam=48), brute(rows)
    assert got.keys() == expected.keys() and recall(got, expected) > least
    assert [a for a, _ in got[920]] == [17, *range(900, 919)]
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and len({a for a, _ in hits}) == 20 and q not in {a for a, _ in hits}
        known = dict(expected[q])
        assert all(abs(known.get(a, s) - s) < 1e-12 for a, s in hits)


def test_index_holds_every_vector(spark):
    source = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(source.normal(size=(500, 8)).astype(np.float32).tolist())]
    index = ann.build(spark.createDataFrame(rows, SCHEMA), degree=12, taken=6, cell_rows=80)
    assert index.nodes.count() == index.graph.count() == 500 and index.rounds >= 1
    for r in index.graph.collect():
        others, scores = np.frombuffer(r.others, "<i8"), np.frombuffer(r.scores, "<f4")
        assert len(set(others.tolist())) == len(others) == 12 and r.node not in others and (np.diff(scores) <= 0).all()


ODD = [
    (0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (40, [0.0, 0.0]),
    (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [2.0]), (60, None),
    (10, [1e30, 1e30]), (11, [1e-30, 0.0]), (-20, [0.0, 1.0, 0.0]),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("node", "cell", "vector", "ids", "query", "score", "x")})
    got = found(df)
    assert same(got, brute(ODD)) and set(got) == {0, 20, -20}
    assert found(df.limit(0)) == {} and found(df.where("vec_id = 20")) == {}
    assert found(df.where("vec_id in (20, 1)")) == {20: [(1, 0.5)]}


def test_messages_of_a_round_follow_the_cells(spark):
    source = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(source.normal(size=(600, 8)).astype(np.float32).tolist())]
    index = ann.build(spark.createDataFrame(rows, SCHEMA), degree=12, taken=6, cell_rows=80)
    graph = index.graph.select("node", "cell", "others", F.expr("cast(repeat(char(1), 12) as binary)").alias("fresh")).coalesce(1).cache()
    named = graph.mapInArrow(ann._named(6, 1), ann._NAMED).collect()
    cells = {r.cell for r in graph.collect()}
    assert sorted(r.home for r in named) == sorted(cells) and 1 < len(cells) < 30
    by = {}
    for r in graph.collect():
        for other in np.frombuffer(r.others, "<i8")[:6].tolist():
            by.setdefault(other, set()).add(r.node)
    got = {}
    for r in named:
        assert not r.old_to and {n >> 32 for n in np.frombuffer(r.fresh_to, "<i8").tolist()} == {r.home}
        for to, node in zip(np.frombuffer(r.fresh_to, "<i8").tolist(), np.frombuffer(r.fresh_by, "<i8").tolist()):
            got.setdefault(to, set()).add(node)
    assert got.keys() == by.keys() and all(got[n] <= by[n] and len(got[n]) == min(6, len(by[n])) for n in by)

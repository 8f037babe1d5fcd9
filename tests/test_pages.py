from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.operators import pages as ops
from quirewise.sources import corpus
from quirewise.sources.parts import write_parts
from quirewise.sources.tolerant import read_tolerant


def _pages(table, texts, doc=1):
    return table("doc_pages", *[(doc, i, t) for i, t in enumerate(texts, start=1)])


def _docs(table, *texts):
    return table("doc_id bigint, text string", *enumerate(texts, start=1))


def test_read_error_names_path(spark):
    with pytest.raises(corpus.CorpusReadError, match="/nowhere/documents.parquet"):
        corpus.read_corpus(spark, "/nowhere", "documents")


def test_a_broken_file_costs_its_own_rows(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = tmp_path / "documents.parquet"
    documents.repartition(4, "doc_id").write.parquet(str(folder))
    files = sorted(folder.glob("*.parquet"))
    lost = {r.doc_id for f in files[:2] for r in spark.read.parquet(str(f)).collect()}
    files[0].write_bytes(b"not a table")
    files[1].write_bytes(files[1].read_bytes()[:-200])
    (folder / "part-empty.parquet").write_bytes(b"PAR1")
    spark.range(1).select(F.col("id").alias("doc_id")).write.parquet(str(folder / "narrow"))
    got = read_tolerant(spark, str(tmp_path), "documents")
    bad = {r.source_file.rsplit("/", 1)[-1]: r.error for r in got.where("error is not null").collect()}
    assert set(bad) == {files[0].name, files[1].name, "part-empty.parquet"} and all(bad.values())
    kept = got.where("error is null")
    assert rows(kept.where("text is not null or lang is not null").drop("source_file", "error")) == rows(documents.where(~F.col("doc_id").isin(lost)))
    assert kept.where("lang is null and text is null and doc_id = 0").count() == 1
    with pytest.raises(corpus.CorpusReadError, match="/nowhere/documents.parquet"):
        read_tolerant(spark, "/nowhere", "documents")


def test_paginate(table):
    docs = _docs(table, "a\nb\nc\nd\ne", "", None, "x\n\n\n\n")
    assert rows(corpus.paginate(docs), "doc_id", "page", "text", "n_pages") == [
        (1, 1, "a\nb\nc\nd", 2), (1, 2, "e", 2), (2, 1, "", 1), (4, 1, "x\n\n\n", 2), (4, 2, "", 2),
    ]
    assert rows(ops.page_count(docs)) == [(1, 2), (2, 1), (3, 0), (4, 2)]
    assert rows(ops.page_count(docs, corpus.paginate(docs))) == [(1, 2), (2, 1), (3, 0), (4, 2)]


def test_layout_offsets(table):
    spans = corpus.layout_spans(_pages(table, ["ab\n\ncde"]), with_offsets=True)
    assert rows(spans, "span", "text", "x", "y", "char_start") == [
        (0, "ab", 24.0, 756.0, 0), (1, "", 24.0, 744.0, 3), (2, "cde", 24.0, 732.0, 4),
    ]


@pytest.mark.parametrize(
    ("total", "points", "want"),
    [
        (10, [3, 6], [(1, 1, 3), (2, 4, 6), (3, 7, 10)]),
        (5, [0, 3, 3, 5, 99], [(1, 1, 3), (2, 4, 5)]),
        (4, [], [(1, 1, 4)]),
    ],
)
def test_split_at(table, total, points, want):
    docs = _docs(table, "\n".join(["x"] * (4 * total)))
    assert rows(ops.split_manifest(docs, points), "part", "first_page", "last_page") == want
    parts = ops.split_at(corpus.paginate(docs), points).groupBy("part").agg({"page": "min"})
    assert [r[1] for r in rows(parts)] == [w[1] for w in want]


def test_split_of_a_document_without_pages(table):
    assert rows(ops.split_manifest(_docs(table, None), [1]), "part", "error") == [(None, "document has no pages")]


def test_split_ranges(table):
    pages = _pages(table, list("abcdefg"))
    assert rows(ops.split_ranges(pages, "2-3,3,7"), "part", "page") == [(1, 2), (1, 3), (2, 3), (3, 7)]
    assert rows(ops.split_ranges(pages, "every:3"), "part", "page")[-1] == (3, 7)
    for bad in ("every:0", "5-2", "0-3", "a", "1,,2"):
        with pytest.raises(ValueError):
            ops.split_ranges(pages, bad)


def test_split_by_size_against_a_loop(table):
    rng = random.Random(2)
    texts = ["\n".join("é" * rng.randrange(0, 40) for _ in range(rng.randrange(1, 60))) for _ in range(30)] + [None]
    docs = _docs(table, *texts)
    want = []
    for doc, page, text, _ in rows(corpus.paginate(docs), "doc_id", "page", "text", "n_pages"):
        size = len(text.encode())
        if page == 1:
            part, used = 1, size
        elif used + size > 150:
            part, used = part + 1, size
        else:
            used += size
        want.append((doc, page, size, part))
    assert rows(ops.split_by_size(docs, 150), "doc_id", "page", "bytes", "part") == want
    with pytest.raises(ValueError):
        ops.split_by_size(docs, 0)


def test_split_by_size_has_no_python_and_many_parts(table):
    docs = _docs(table, *["\n".join("x" * (n % 7) for n in range(lines)) for lines in (1, 2000, 6001)], None)
    got = ops.split_by_size(docs, 9)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want, sizes = [], rows(corpus.paginate(docs).select("doc_id", "page", F.octet_length("text").alias("n")))
    for doc, page, size in sizes:
        part, used = (1, size) if page == 1 else (part, used + size) if used + size <= 9 else (part + 1, size)
        want.append((doc, page, size, part))
    assert rows(got, "doc_id", "page", "bytes", "part") == want and max(w[3] for w in want) > 512


def test_remove_and_extract_by_list_and_by_table(table):
    pages = _pages(table, list("abcde"))
    listed = table("doc_id bigint, page bigint", (1, 2), (1, 4), (1, 9))
    want = [(1, 1, "a"), (2, 3, "c"), (3, 5, "e")]
    assert rows(ops.remove_pages(pages, [4, 2, 2, 9, 0]), "page", "source_page", "text") == want
    assert rows(ops.remove_pages(pages, listed), "page", "source_page", "text") == want
    want = [(1, 2, "b"), (2, 4, "d")]
    assert rows(ops.extract_pages(pages, [4, 2, 2, 9, 0]), "page", "source_page", "text") == want
    assert rows(ops.extract_pages(pages, listed), "page", "source_page", "text") == want


def test_merge_keeps_order_counts_and_markers(table):
    pages = _pages(table, ["A-1", "A-2"], 1).union(_pages(table, ["B-1"], 2))
    docs = table("doc_id bigint, text string", (1, "x"), (2, "y"), (3, None))
    merged = ops.merge_docs(
        table("merge_list", (7, 2, 1), (7, 1, 2), (7, 4, 1), (7, 3, 3)), ops.page_count(docs, pages), pages
    )
    assert rows(merged, "out_page", "text") == [(1, "B-1"), (2, "A-1"), (3, "A-2"), (4, "A-1"), (5, "A-2")]
    plain = ops.merge_docs([2, 1], ops.page_count(docs, pages), pages)
    assert rows(plain, "out_page", "text") == [(1, "B-1"), (2, "A-1"), (3, "A-2")]
    with pytest.raises(ValueError, match="no input"):
        ops.merge_docs([], ops.page_count(docs, pages), pages)


def test_reorder_checks(table):
    pages = table("doc_pages", *[(d, p, f"{d}.{p}") for d in range(1, 6) for p in (1, 2, 3)])
    counts = table("doc_id bigint, n_pages bigint", *[(d, 3) for d in range(1, 6)])
    orders = {1: [3, 1, 2], 2: [1, 2], 3: [1, 1, 9], 4: [9, 1, 1], 5: [2, 2, 2]}
    order = table("page_order", *[(d, i, p) for d, ps in orders.items() for i, p in enumerate(ps, start=1)])
    got = ops.reorder_pages(pages, order, counts)
    assert rows(got.where("error is null"), "new_page", "text") == [(1, "1.3"), (2, "1.1"), (3, "1.2")]
    assert rows(got.where("error is not null"), "doc_id", "error") == [
        (2, "the order leaves out some of the 3 pages"),
        (3, "the order names page 1 more than once"),
        (4, "the order names page 9 of a document with 3 pages"),
        (5, "the order names page 2 more than once"),
    ]


def test_duplicates(table):
    pages = _pages(table, list("ABACB"))
    assert rows(ops.dup_pages(pages), "page") == [(3,), (5,)]
    kept = ops.drop_dup_pages(pages)
    assert rows(kept, "page", "source_page", "text") == [(1, 1, "A"), (2, 2, "B"), (3, 4, "C")]


def test_missing_text_counts_as_empty(table):
    pages = _pages(table, [None, "", "x", None])
    assert rows(ops.dup_pages(pages), "page") == [(2,), (4,)]


def test_corpus_scope(table):
    pages = _pages(table, ["A", "B"], 1).union(_pages(table, ["C", "A"], 2))
    assert rows(ops.dup_pages(pages, "corpus"), "doc_id", "page") == [(2, 2)]
    assert rows(ops.drop_dup_pages(pages, "corpus"), "doc_id", "page", "text") == [(1, 1, "A"), (1, 2, "B"), (2, 1, "C")]
    with pytest.raises(ValueError):
        ops.dup_pages(pages, "galaxy")


def test_blank_pages(table):
    pages = _pages(table, ["", " \n\t", "a ", None, "ab"])
    assert rows(ops.blank_pages(pages), "page") == [(1,), (2,), (4,)]
    assert rows(ops.remove_blank_pages(pages, 0.5), "page", "source_page") == [(1, 5)]


def _nodes(table, *boxes):
    return table("page_nodes", *[(1, i, None, i, b, None) for i, b in enumerate(boxes, start=1)])


@pytest.mark.parametrize(("count", "n", "sheets"), [(6, 2, 3), (8, 4, 2), (9, 9, 1), (7, 6, 2)])
def test_n_up_sheets(table, count, n, sheets):
    placed = ops.n_up(_nodes(table, *[[0.0, 0.0, 612.0, 792.0]] * count), n)
    assert placed.agg({"sheet": "max"}).first()[0] == sheets


def test_n_up_cells(table):
    nodes = _nodes(table, [10.0, 10.0, 400.0, 600.0], None, [0.0, 0.0, 100.0, 300.0])
    got = rows(ops.n_up(nodes, 4), "page", "slot", "scale", "x", "y", "sheet_width", "sheet_height")
    assert got == [
        (1, 0, 0.508, 0.847, 300.0, 400.0, 600.0),
        (2, 1, 1.0, 200.0, 300.0, 400.0, 600.0),
        (3, 2, 1.0, 50.0, 0.0, 400.0, 600.0),
    ]
    with pytest.raises(ValueError, match="2, 4, 6 and 9"):
        ops.n_up(nodes, 3)


def test_labels(table):
    pages = _pages(table, ["a", "b"])
    got = rows(ops.page_labels(pages, None, "bottom-left", "Page {n} of {total}", 1, 12), "label", "x", "y")
    assert got == [("Page 1 of 2", 24.0, 24.0), ("Page 2 of 2", 24.0, 24.0)]
    odd = rows(ops.page_labels(pages, None, "somewhere", "{n}", 5, 10), "label", "x", "y")
    assert odd == [("5", 303.5, 24.0), ("6", 303.5, 24.0)]
    top = rows(ops.page_labels(pages, None, "top-right", "{n}", 1, 10), "x", "y")
    assert top == [(583.0, 758.0)] * 2


def test_write_parts(table, tmp_path):
    pages = ops.split_at(_pages(table, list("abcde")), [2]).select("doc_id", "part", "page", "text")
    manifest = write_parts(pages, f"{tmp_path}/parts")
    assert rows(manifest, "doc_id", "part", "pages", "first_page", "last_page") == [(1, 1, 2, 1, 2), (1, 2, 3, 3, 5)]
    assert all(f.startswith("file:") for (f,) in rows(manifest, "first_file"))


def test_every_part_is_a_file(table, spark, tmp_path):
    pages = table("doc_pages", *[(d, p, f"text {d} {p}") for d in (1, 2, 30) for p in range(1, 8 * d % 23)], (None, 1, None))
    parted = ops.split_at(pages, [3, 5]).select("doc_id", "part", "page", "text")
    manifest = write_parts(parted, f"{tmp_path}/parts", file_pages=4)
    files = sorted(tmp_path.glob("parts/parts/*/*.parquet"))
    for file in files:
        own = spark.read.parquet(str(file)).collect()
        doc, part, *chunk = file.stem.split("-")
        assert {(str(r.doc_id), r.part, r.page // 4) for r in own} == {(doc, int(part), int(chunk[0]) if chunk else 0)}
        assert [r.page for r in own] == sorted(r.page for r in own)
    assert len(files) == parted.select("doc_id", "part", F.floor(F.col("page") / 4)).distinct().count()
    assert rows(spark.read.parquet(f"{tmp_path}/parts/parts").drop("task")) == rows(parted)
    want = parted.groupBy("doc_id", "part").agg(F.count("page"), F.min("page").cast("bigint"), F.max("page").cast("bigint"))
    assert rows(manifest.drop("first_file", "last_file")) == rows(want) and not (tmp_path / "parts" / "_temporary").exists()
    with pytest.raises(ValueError):
        write_parts(parted, f"{tmp_path}/parts")
    assert write_parts(parted.limit(0), f"{tmp_path}/none").count() == 0


def test_a_failed_write_leaves_no_file(table, tmp_path):
    pages = table("doc_pages", (1, 1, "a"), (2, 1, "b")).withColumn("part", F.lit(1).cast("bigint"))
    broken = pages.withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_parts(broken, f"{tmp_path}/parts")
    assert not list(tmp_path.glob("parts/**/*.parquet"))

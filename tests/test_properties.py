"""Invariants over random documents whose pages carry unique markers."""

from __future__ import annotations

import csv
import json
import random
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.operators import forms, geometry, pages, redact
from quirewise.sources import corpus
from quirewise.sources.sinks import write_form_csv, write_form_json

SIZES = {doc: random.Random(doc).randrange(1, 13) for doc in range(1, 61)}


@pytest.fixture(scope="module")
def marked(table):
    """Documents of 1 to 12 pages; every page holds its marker and three empty lines."""
    docs = [(d, "\n".join(f"M{d}-{p}\n\n\n" for p in range(1, n + 1))) for d, n in SIZES.items()]
    return table("doc_id bigint, text string", *docs)


@pytest.fixture(scope="module")
def doc_pages(marked):
    return corpus.paginate(marked).withColumn("text", F.regexp_replace("text", "\n", "")).cache()


def test_merged_pages_are_the_sum_and_all_markers_survive(table, marked, doc_pages):
    rng = random.Random(1)
    lists = {out: [rng.choice(list(SIZES)) for _ in range(rng.randrange(1, 7))] for out in range(40)}
    entries = table("merge_list", *[(o, i, d) for o, docs in lists.items() for i, d in enumerate(docs)])
    got = rows(pages.merge_docs(entries, pages.page_count(marked), doc_pages), "out_id", "out_page", "text")
    want = []
    for out, docs in lists.items():
        markers = [f"M{d}-{p}" for d in docs for p in range(1, SIZES[d] + 1)]
        want += [(out, i, m) for i, m in enumerate(markers, start=1)]
    assert got == sorted(want)


def test_split_counts(marked, doc_pages):
    for k in (1, 3, 7):
        counts = pages.split_at(doc_pages, [k]).groupBy("doc_id", "part").count()
        want = [(d, i, n) for d, size in SIZES.items() for i, n in enumerate((min(k, size), size - k), start=1) if n > 0]
        assert rows(counts) == sorted(want)


def test_remove_and_extract_are_complements(doc_pages):
    rng = random.Random(2)
    for _ in range(3):
        listed = [rng.randrange(0, 14) for _ in range(5)]
        gone = pages.remove_pages(doc_pages, listed)
        kept = pages.extract_pages(doc_pages, listed)
        assert rows(gone.unionByName(kept), "doc_id", "text") == rows(doc_pages, "doc_id", "text")
        for part in (gone, kept):
            shape = part.groupBy("doc_id").agg(F.min("page"), F.max("page"), F.count_distinct("page"), F.count("*"))
            assert all((lo, hi, n) == (1, n, total) for _, lo, hi, n, total in rows(shape))


def test_reversing_twice_changes_nothing(marked, doc_pages):
    counts = pages.page_count(marked)

    def reverse(df):
        order = df.join(counts.withColumnRenamed("n_pages", "n"), "doc_id").select(
            "doc_id", (F.col("n") + 1 - F.col("page")).alias("new_page"), "page"
        )
        moved = pages.reorder_pages(df.select("doc_id", "page", "text"), order, counts)
        return moved.select("doc_id", F.col("new_page").alias("page"), "text")

    assert rows(reverse(reverse(doc_pages))) == rows(doc_pages, "doc_id", "page", "text")


def test_four_quarter_turns_are_none(marked):
    nodes = corpus.page_nodes(marked)
    turned = nodes
    for _ in range(4):
        turned = geometry.rotate_pages(turned, 90)
    assert rows(turned, "doc_id", "page", "rotate") == rows(geometry.rotate_pages(nodes, 0), "doc_id", "page", "rotate")


def test_masking_keeps_length_and_is_stable(marked):
    patterns = [r"regex:M\d+", "text:-1"]
    once = redact.pii_mask(marked, patterns)
    assert rows(once, "doc_id", F.length("text")) == rows(marked, "doc_id", F.length("text"))
    assert rows(redact.pii_mask(once, patterns)) == rows(once)


def test_form_files(table, tmp_path):
    fields = forms.form_fields(
        table("form_nodes", (1, 1, None, 1, "a,b", "Tx", 'q"x"', None, 1), (1, 2, None, 2, "n", "Tx", None, None, 2))
    )
    write_form_csv(fields, f"{tmp_path}/csv")
    lines = [row for f in Path(f"{tmp_path}/csv").glob("*.csv") for row in csv.reader(f.open())]
    assert sorted(r for r in lines if r[0] != "doc_id") == [["1", "a,b", "Tx", 'q"x"', "1"], ["1", "n", "Tx", "", "2"]]
    write_form_json(forms.form_json_entries(fields), f"{tmp_path}/json")
    found = [json.loads(line) for f in Path(f"{tmp_path}/json").glob("*.json") for line in f.open()]
    assert {f["name"]: json.loads(f["entry"])["value"] for f in found} == {"a,b": 'q"x"', "n": ""}

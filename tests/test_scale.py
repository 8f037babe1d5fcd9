"""Small inputs are spread, larger ones are not; hot keys give the same results as plain ones."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.operators import pages, redact, spread
from quirewise.session import shared_folder
from quirewise.sources import corpus
from quirewise.sources.sinks import stage_table


def test_only_small_inputs_are_spread(spark, monkeypatch):
    root = "/root/testdata/sf0.001"
    assert corpus.read_corpus(spark, root, "documents", "doc_id").rdd.getNumPartitions() == 8
    monkeypatch.setattr(corpus, "SMALL_INPUT", 0)
    assert corpus.read_corpus(spark, root, "documents", "doc_id").rdd.getNumPartitions() < 8


def _session(folder: str | None, master: str):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" and folder else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_follows_the_session():
    assert shared_folder(_session("hdfs://shared/dir/", "yarn")) == "hdfs://shared/dir"
    assert shared_folder(_session("/mnt/shared", "local[8]")) == "/mnt/shared"
    local = shared_folder(_session(None, "local[8]"))
    assert local.startswith("/tmp/spark-") and shared_folder(_session(None, "local[8]")) == local
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_session(None, "yarn"))


def test_staged_tables_come_back_whole(spark):
    assert rows(stage_table(spark.range(3), "three")) == [(0,), (1,), (2,)]


@pytest.fixture
def low_limit(monkeypatch):
    """Every key with more than 20 rows counts as hot."""
    real = spread.hot_keys
    monkeypatch.setattr(spread, "hot_keys", lambda df, on, rows=0: real(df, on, 20))


def test_hot_page_of_areas(table, low_limit):
    spans = table("spans", *[(1, p, 0, "x" * 200, 0.0, 100.0, 10.0) for p in (1, 2)])
    hot = [(1, 1, float(5 * i), 100.0, 5.0, 5.0) for i in range(0, 150, 3)]
    got = rows(redact.redact_areas(spans, table("areas", *hot, (1, 2, 0.0, 100.0, 5.0, 5.0))), "page", "text")
    assert got == [(1, " xx" * 50 + "x" * 50), (2, " " + "x" * 199)]


def test_hot_document_in_merge_and_totals(table, low_limit):
    content = table("doc_pages", (1, 1, "cover"), (2, 1, "a"), (2, 2, "b"))
    counts = content.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    entries = [(out, 0, 1) for out in range(60)] + [(out, 1, 2) for out in range(5)]
    got = rows(pages.merge_docs(table("merge_list", *entries), counts, content), "out_id", "out_page", "text")
    want = [(out, 1, "cover") for out in range(60)] + [(o, p, t) for o in range(5) for p, t in ((2, "a"), (3, "b"))]
    assert got == sorted(want)
    long = table("doc_pages", *[(7, p, "t") for p in range(1, 61)], (8, 1, "t"))
    assert rows(pages.with_page_total(long).select("doc_id", "n_pages").distinct()) == [(7, 60), (8, 1)]


def test_a_group_of_copies_collapses_before_the_shuffle(spark):
    many = spark.range(200_000).select(
        F.lit(1).cast("bigint").alias("doc_id"), (F.col("id") + 1).alias("page"), F.lit("").alias("text")
    )
    df = pages.drop_dup_pages(many)
    assert rows(df, "page", "source_page") == [(1, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan

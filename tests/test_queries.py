"""Every registered query against its SQL twin, and the shape of the plans that must not shuffle."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest
from compare import differences, duck

from quirewise.plans import registry

ROOT = "/root/testdata/sf0.001"

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES

# Work inside the row of a document or page; the only exchange may be the spread of a small input over the cores.
ROW_LOCAL = [
    "paginate", "layout_spans", "page_count", "split_at", "split_manifest", "split_ranges", "split_every",
    "split_by_size", "remove_pages", "extract_pages", "rotate_pages", "scale_pages", "crop_pages", "pii_spans",
    "auto_redact", "pii_mask", "sanitize", "sanitize_report", "digest_manifest", "metadata_extract",
    "resource_inventory", "extract_resources", "conformance_validate", "conformance_fix", "fit_budget", "to_xml",
    "to_html", "page_fragments", "extract_text", "ocr_boxes", "ocr_text", "tool_chain", "form_flatten",
]


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_registry():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, ROOT), con, ORACLES[name]) == []


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_queries_do_not_shuffle(spark, name):
    plan = _plan(QUERIES[name](spark, ROOT))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges


def test_scans_read_only_what_they_need(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in _plan(QUERIES["page_count"](spark, ROOT))
    assert "ReadSchema: struct<doc_id:bigint>" in _plan(QUERIES["merge_docs"](spark, ROOT))


def test_cutoff_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in _plan(QUERIES["prune_older"](spark, ROOT))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["recent_per_subject"](spark, ROOT))
    assert "TakeOrderedAndProject" in _plan(QUERIES["recent_items"](spark, ROOT))


def test_no_nested_loop_or_cross_joins(spark):
    for name in ("merge_docs", "reorder_pages", "match_boxes", "redact_areas", "overlay_align", "form_fields", "n_up"):
        plan = _plan(QUERIES[name](spark, ROOT))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_flagship(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    driver = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(driver)
    df = driver.entry(spark)
    assert set(QUERIES) <= set(driver.queries())
    assert df.columns[:4] == ["doc_id", "page", "span", "text"] and df.count() > 0

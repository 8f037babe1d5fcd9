"""Every operator on rows that are easily forgotten: nulls, empty and very long texts, repeats, no rows, odd columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quirewise.llm import bpe, html, langid, lm, minhash, near, packing, quality, simhash, toxicity, urls

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "Plain words stand here, one after another, twenty of them or so, to be long enough for the rules at hand.", "en", "a"),
    (1, "Plain words stand here, one after another, twenty of them or so, to be long enough for the rules at hand.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n\x0b\r ", "de", None),
    (5, LONG, None, None),
    (None, "No id at all \U0001f600 é", "en", "a"),
    (None, None, None, None),
    (-7, "12 34 !! ***", "de", "b"),
    (2**62, "x", "en", "b"),
]
CLASHES = ["score", "row", "found", "ids", "n", "k", "key", "fp", "node", "bits", "m", "_text", "_id", "_cell", "_n", "kept", "toxic", "chunk"]


def _coded(df):
    encode, decode = bpe.codec(df.sparkSession, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return df.select("doc_id", encode("text").alias("ids")).select("doc_id", "ids", decode("ids").alias("back"))


def _labels(df):
    return df.sparkSession.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 0), (-7, 0)], "doc_id bigint, toxic int")


ALL_ROWS = {
    "quality": quality.judged,
    "minhash": minhash.fingerprints,
    "bpe": _coded,
    "lm": lm.scored,
    "simhash": simhash.grouped,
    "langid": lambda df: langid.judged(df, langid.fit(df)),
    "toxicity": lambda df: toxicity.judged(df, toxicity.fit(df, _labels(df))),
}
FILTERS = {
    "language": langid.with_known_language,
    "toxic": lambda df: toxicity.without_toxic(df, _labels(df)),
    "near": near.one_of_each,
}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.mark.parametrize("name", list(ALL_ROWS))
def test_every_row_gets_a_row(odd, name):
    got = ALL_ROWS[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*ALL_ROWS, *FILTERS])
def test_no_rows(spark, name):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert (ALL_ROWS | FILTERS)[name](empty).count() == 0


@pytest.mark.parametrize("name", list(FILTERS))
def test_filters_keep_columns_and_rows_as_they_came(odd, name):
    got = FILTERS[name](odd)
    assert got.columns == odd.columns
    before = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in got.collect()} <= before


def test_defined_results(odd):
    by_id = {r.doc_id: r for r in quality.judged(odd).collect()}
    assert by_id[5].n_words == 60_000 and not by_id[2].kept and by_id[2].n_words == 0 and by_id[1].n_words == 21
    prints = {r.doc_id: r for r in minhash.fingerprints(odd).collect()}
    assert prints[2].fingerprint == prints[3].fingerprint == prints[4].fingerprint == "" and len(prints[5].fingerprint) == 512
    coded = {r.doc_id: r for r in _coded(odd).collect()}
    assert coded[5].back.decode() == LONG and coded[2].ids == b"" and coded[4].back == b" \t\n\x0b\r "
    groups = {r.doc_id: r for r in simhash.grouped(odd).collect()}
    assert groups[2].component_id == groups[3].component_id == groups[4].component_id == 2 and groups[2].fp == 0
    known = {r.doc_id: r for r in langid.judged(odd, langid.fit(odd)).collect()}
    assert known[2].lang_pred == known[3].lang_pred == known[-7].lang_pred == "und" and known[1].lang_pred in ("en", "de")
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in near.one_of_each(odd).collect())
    assert kept == [(False, -7), (False, 1), (False, 2), (False, 5), (False, 2**62), (True, 0), (True, 0)]


def test_packing_of_odd_rows(spark, odd):
    got = packing.packed(odd).collect()
    assert sum(r.n_tokens for r in got if r.doc_id == 5) == 60_001
    assert sorted(r.n_tokens for r in got if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    assert packing.packed(odd.limit(0)).count() == 0


PAGES = [
    (1, "HTTP://Www.Example.COM/De/x?y#z", "<article><p>a&amp;b</article>"),
    (1, "HTTP://Www.Example.COM/De/x?y#z", "<article><p>a&amp;b</article>"),
    (2, None, None),
    (3, "no scheme", ""),
    (None, "a://b", "<p>" + "very long " * 50_000 + "</p>"),
    (4, "http://" + "a" * 50_000 + "/", "<"),
    (5, "://://?", "<p a='b>c"),
]


def test_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    df = df.withColumns({c: F.lit("clash") for c in ("host", "path", "text", "n_chars", "rule", "verdict")})
    found = html.extracted(df).collect()
    assert [r.text for r in found if r.page_id == 1] == ["a&b", "a&b"]
    assert [(r.text, r.n_chars) for r in found if r.page_id == 2] == [("", 0)] and len(found) == len(PAGES)
    judged = {r.page_id: r for r in urls.judged(df).collect()}
    assert (judged[1].host, judged[1].path, judged[1].rule) == ("www.example.com", "/De/x", None)
    assert (judged[2].host, judged[2].path, judged[2].verdict) == ("", "", "allow") == (judged[3].host, judged[3].path, judged[3].verdict)
    assert (judged[5].host, judged[5].path) == (":", "//") and len(judged[4].host) == 50_000
    assert html.extracted(df.limit(0)).count() == 0 and urls.judged(df.limit(0)).count() == 0

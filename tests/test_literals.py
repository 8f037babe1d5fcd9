from __future__ import annotations

import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.operators import literals, redact


def _plain(text, wanted):
    return [(w, m.start(), m.end()) for w in dict.fromkeys(wanted) for m in re.finditer(re.escape(w), text or "")]


def test_equal_to_a_scan_for_each(table):
    rng = random.Random(4)
    letters = "ab é\U0001f600\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + [None, "", "aaaaaa"]
    wanted = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(150)}) + ["aa", "aa", "\x00"]
    pages = table("doc_pages", *[(1, i, t) for i, t in enumerate(texts)])
    got = literals.literal_spans(pages, wanted)
    want = [(1, i, f"text:{w}", a, b, w) for i, t in enumerate(texts) for w, a, b in _plain(t, wanted)]
    assert rows(got, "doc_id", "page", "pattern", "start", "end", "match") == sorted(want)
    masked = dict(rows(literals.literal_mask(pages, wanted), "page", "text"))
    for i, text in enumerate(texts):
        covered = {k for _, a, b in _plain(text, wanted) for k in range(a, b)}
        assert masked[i] == (None if text is None else "".join(" " if k in covered else c for k, c in enumerate(text)))


def test_same_rows_as_text_patterns(spark, table):
    pages = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).select("doc_id", F.lit(1).alias("page"), "text")
    wanted = ["the", "on the", "tion", ".com", "\n"]
    patterns = redact.pii_spans(pages, [f"text:{w}" for w in wanted])
    assert rows(literals.literal_spans(pages, wanted).select(*patterns.columns)) == rows(patterns)


def test_a_thousand_cost_little_more_than_one(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text").repartition(4).cache()
    pages.count()
    many = [f"{a}{b}{c}zq" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]

    def seconds(wanted):
        start = time.perf_counter()
        literals.literal_spans(pages, wanted).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(["zqzq"])
    one, thousand = (min(seconds(w) for _ in range(3)) for w in (["zqzq"], many))
    assert thousand < 2 * one + 0.5


def test_bad_lists(table):
    for wanted in ([], ["a", ""]):
        with pytest.raises(ValueError):
            literals.literal_spans(table("doc_pages"), wanted)
    assert "Exchange" not in literals.literal_spans(table("doc_pages"), ["a"])._jdf.queryExecution().executedPlan().toString()

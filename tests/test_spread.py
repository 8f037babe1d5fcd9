from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quirewise.operators.spread import hot_keys, number_within, running_total, spread_join


def _skewed(spark, n=600):
    rng = random.Random(5)
    data = [(0 if i % 3 == 0 else rng.randrange(1, 40), i, rng.randrange(9)) for i in range(n)]
    return data, spark.createDataFrame(data, "k int, o bigint, v int")


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_running_total(spark, width):
    data, df = _skewed(spark)
    want, sums = [], {}
    for k, o, v in data:
        want.append((k, o, v, sums.get(k, 0)))
        sums[k] = sums.get(k, 0) + v
    assert rows(running_total(df, ["k"], "o", "v", "t", width), "k", "o", "v", "t") == sorted(want)


def test_number_within_is_dense(spark):
    data, df = _skewed(spark)
    want, seen = [], {}
    for k, o, _ in data:
        seen[k] = seen.get(k, 0) + 1
        want.append((k, o, seen[k]))
    assert rows(number_within(df, ["k"], "o", "n", 16), "k", "o", "n") == sorted(want)


def test_hot_keys(spark):
    _, df = _skewed(spark)
    assert rows(hot_keys(df, ["k"], 100), "k", "_parts") == [(0, 2)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    _, df = _skewed(spark)
    one = spark.createDataFrame([(k, f"n{k}-{i}") for k in range(0, 30) for i in range(2)], "k int, name string")
    got = spread_join(df, one, ["k"], ["o"], how, rows=50)
    assert rows(got, "k", "o", "name") == rows(df.join(one, "k", how), "k", "o", "name")


def test_spread_join_splits_the_hot_key(spark):
    _, df = _skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.createDataFrame([(k, f"n{k}") for k in range(40)], "k int, name string")
        got = spread_join(df, one, ["k"], ["o"], rows=10)
        tasks = got.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spread_join_refuses_other_kinds(spark):
    _, df = _skewed(spark)
    with pytest.raises(ValueError, match="supports"):
        spread_join(df, df, ["k"], ["o"], "full")

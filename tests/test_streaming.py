from __future__ import annotations

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quirewise.operators.redact import pii_mask
from quirewise.streaming import intake

DAY = dt.datetime(2024, 1, 1)


def _source(spark, tmp_path, schema, batches):
    """One file per batch, taken one at a time."""
    path = f"{tmp_path}/in"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_redact_equals_batch(spark, tmp_path):
    schema = "doc_id bigint, text string"
    batches = [[(1, "mail a@b.co"), (2, None)], [(3, "123-45-6789 x"), (4, "plain")]]
    got = intake.run_available(intake.stream_redact(_source(spark, tmp_path, schema, batches), ["email", "ssn"]), "t-redact")
    want = pii_mask(spark.createDataFrame(sum(batches, []), schema), ["email", "ssn"])
    assert rows(got) == rows(want)


def _parts(spark, schema, batches):
    return [spark.createDataFrame(batch, schema).coalesce(1) for batch in batches]


def test_first_arrival_of_every_period(spark):
    schema = "doc_id bigint, text string, arrived timestamp"
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [
        [(2, "A\n\n\n", at(1)), (1, "A\n\n\n\nB", at(1))],
        [(3, "B", at(0.5)), (4, "C", at(1.2)), (5, "A\n\n\n", at(2.5))],  # an earlier arrival of an open period
        [(6, "Z", at(9))],
        [(7, "late", at(1)), (8, "Z", at(8.5)), (9, None, at(9)), (10, "no time", None)],  # no page, no time
        [(11, "Z", at(10.1))],
    ]
    build = lambda s: intake.stream_dedupe(s, "1 hour", "2 hours")
    got = intake.run_arrivals(_parts(spark, schema, batches), build, intake.open_firsts, "t-dedupe")
    assert rows(got, "doc_id", "page") == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 1), (11, 1)]
    assert rows(got.where("doc_id = 3"), "arrived") == [(at(0.5),)]


def test_dedupe_state_does_not_grow(spark, tmp_path):
    """A hundred batches, an hour of new pages each: the state holds the open periods and no more."""
    schema = "doc_id bigint, text string, arrived timestamp"
    path = f"{tmp_path}/in"
    hours = [[(20 * h + i, f"page {20 * h + i}", DAY + dt.timedelta(hours=h)) for i in range(20)] for h in range(100)]
    for n, batch in enumerate(hours):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/{n:03}")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
        query = (
            intake.stream_dedupe(source, "2 hours", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "500")
        query.awaitTermination()
        kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(kept) >= 90 and max(kept) <= 100 and max(kept[:20]) == max(kept[-20:])
    left = intake.open_firsts(spark.read.format("statestore").load(f"{tmp_path}/state")).count()
    assert left + spark.read.parquet(f"{tmp_path}/out").count() == 2000 and left <= 100


def test_parts_arrive_by_ranges(spark):
    df = spark.range(0, 40).withColumnRenamed("id", "k")
    parts = [[r.k for r in p.collect()] for p in intake.arrival_parts(df, "k")]
    assert sorted(sum(parts, [])) == list(range(40)) and parts[0] == [0, 1, 2, 3, 4, 5, 6, 8, 9] and 7 in parts[1] and 37 in parts[3]
    assert [p.count() for p in intake.arrival_parts(df.limit(0), "k")] == [0]
    build = lambda s: intake.stream_history(s)
    empty = spark.createDataFrame([], "started_at timestamp, tool_id string")
    assert intake.run_arrivals([empty], build, intake.open_counts, "t-empty").count() == 0


def test_history_drops_late_runs(spark, tmp_path):
    schema = "tool_id string, started_at timestamp"
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [[("a", at(0.1)), ("a", at(0.2)), ("b", at(1.1))], [("a", at(5))], [("c", at(5))]]
    batches.append([("a", at(0.3)), ("a", at(9))])
    source = _source(spark, tmp_path, schema, batches)
    got = intake.run_available(intake.stream_history(source, "1 hour"), "t-history")
    hour = F.hour("window_start").alias("hour")
    assert rows(got, hour, "tool_id", "runs") == [(0, "a", 2), (1, "b", 1), (5, "a", 1), (5, "c", 1)]


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for root in (str(tmp_path), "/root/testdata/sf0.001"):
        stream = intake.stream_redact(intake.stream_table(spark, root, "documents", files_per_batch=2), ["email"])
        assert intake.run_available(stream, "t-folder").count() == documents.count()


def test_open_windows_come_out_at_the_end(spark):
    schema = "started_at timestamp, tool_id string"
    batches = [
        [(DAY, "a"), (DAY, "b")],
        [(DAY + dt.timedelta(minutes=1), "a"), (DAY + dt.timedelta(days=1), "a")],
        [(DAY + dt.timedelta(minutes=2), "a"), (DAY + dt.timedelta(days=1), "c")],  # the first is late by now
    ]
    build = lambda s: intake.stream_history(s, "1 hour")
    got = intake.run_arrivals(_parts(spark, schema, batches), build, intake.open_counts, "t-end")
    assert rows(got, "tool_id", "runs") == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]

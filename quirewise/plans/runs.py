"""Run history, chains of tools and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions.patterns import NAMED_PATTERNS
from quirewise.operators import history as ops
from quirewise.operators.pages import remove_pages, split_at
from quirewise.operators.redact import pii_mask
from quirewise.plans.redaction import mask_sql
from quirewise.plans.tables import HISTORY, PAGES, Tables, query, with_
from quirewise.sources import corpus
from quirewise.streaming import intake

PATTERNS = list(NAMED_PATTERNS)
CUTOFF = "2024-01-24 00:00:00"
DELAY = "1 hour"
DEDUPE_DELAY, PERIOD = "1 minute", "10 minutes"


def _time() -> Column:
    return F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at")


def _upserted(t: Tables) -> DataFrame:
    """Latest run per user and tool, runs of the last days replacing the older ones."""
    keyed = t.history.withColumn("item", F.concat("tool_id", F.lit("/"), "subject_id"))
    cutoff = F.lit(CUTOFF).cast("timestamp")
    old, new = keyed.where(F.col("started_at") < cutoff), keyed.where(F.col("started_at") >= cutoff)
    return ops.upsert_latest(old, new, "item", ["started_at", "id"]).select("item", "id", "status", _time())


def _chained(t: Tables) -> DataFrame:
    chain = [
        ("remove_pages", lambda df: remove_pages(df, [1])),
        ("pii_mask", lambda df: pii_mask(df, PATTERNS)),
        ("split_at", lambda df: split_at(df, [2])),
    ]
    done = ops.tool_chain(t.doc_pages, chain)
    return done.select("doc_id", "page", "source_page", "part", "text", F.array_join("steps", " > ").alias("steps"))


def _stream_redact(t: Tables) -> DataFrame:
    documents = intake.stream_table(t.spark, t.root, "documents")
    redacted = intake.stream_redact(documents, PATTERNS).select("doc_id", "text")
    return intake.run_available(redacted, "redact")


def _stream_dedupe(t: Tables) -> DataFrame:
    """Documents are made one per second in the order of their ids and arrive in four parts, some in the next one."""
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    documents = t.documents.select("doc_id", "text", arrived.alias("arrived"))
    build = lambda stream: intake.stream_dedupe(stream, DEDUPE_DELAY, PERIOD)
    kept = intake.run_arrivals(intake.arrival_parts(documents, "doc_id"), build, intake.open_firsts, "dedupe")
    return kept.select("doc_id", "page", "h")


def _stream_history(t: Tables) -> DataFrame:
    """Runs arrive in four parts, some of them one part late."""
    parts = intake.arrival_parts(t.history, "id")
    counted = intake.run_arrivals(parts, lambda s: intake.stream_history(s, DELAY), intake.open_counts, "history")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool_id", "runs")


QUERIES = {
    "recent_items": query(lambda t: ops.recent_items(t.history).select("id", "tool_id", "subject_id", _time())),
    "recent_per_subject": query(
        lambda t: ops.recent_per_subject(t.history).select("subject_id", "rank", "id", "tool_id", _time())
    ),
    "upsert_latest": query(_upserted),
    "prune_older": query(
        lambda t: ops.prune_older(t.history, F.lit(CUTOFF).cast("timestamp")).select("id", "tool_id", _time())
    ),
    "history_status": query(lambda t: ops.history_status(t.history)),
    "tool_chain": query(_chained),
    "stream_redact": query(_stream_redact),
    "stream_dedupe": query(_stream_dedupe),
    "stream_history": query(_stream_history),
}

_SQL_TIME = "strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at"

def _arrivals(table: str, key: str, made: str, delay: str) -> str:
    """``marked``: rows with their time ``made`` and the watermark ``mark`` that all earlier parts have left."""
    return f"""
ends AS (SELECT min({key}) AS least, max({key}) AS most FROM {table}),
parts AS (
  SELECT t.*, {made} AS made,
    least(({key} - least) * 4 // (most - least + 1) + (abs({key}) % 10 = 7)::INT, 3) AS part FROM {table} t, ends),
latest AS (SELECT part, max(made) AS made FROM parts GROUP BY part),
marked AS (
  SELECT p.*, (SELECT date_trunc('milliseconds', max(l.made)) - INTERVAL {delay} FROM latest l WHERE l.part < p.part) AS mark
  FROM parts p)"""


ORACLES = {
    "recent_items": with_(HISTORY)
    + f"""SELECT id, tool_id, subject_id, {_SQL_TIME} FROM (SELECT * FROM history ORDER BY started_at DESC, id LIMIT 20)""",
    "recent_per_subject": with_(HISTORY)
    + f"""SELECT subject_id, rank, id, tool_id, {_SQL_TIME} FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY started_at DESC, id) AS rank FROM history) WHERE rank <= 3""",
    "upsert_latest": with_(HISTORY)
    + f"""SELECT item, id, status, {_SQL_TIME} FROM (
  SELECT *, tool_id || '/' || subject_id AS item,
    row_number() OVER (PARTITION BY tool_id, subject_id ORDER BY started_at DESC, id DESC) AS n FROM history) WHERE n = 1""",
    "prune_older": with_(HISTORY)
    + f"SELECT id, tool_id, {_SQL_TIME} FROM history WHERE started_at >= TIMESTAMP '{CUTOFF}'",
    "history_status": with_(HISTORY)
    + """SELECT tool_id, status, count(*) AS runs, count(*) FILTER (value > 100) AS slow_runs,
  sum(value::DECIMAL(18, 2))::DOUBLE AS total_value, max(value) AS max_value FROM history GROUP BY ALL""",
    "tool_chain": with_(PAGES, "\nkept AS (SELECT * FROM doc_pages WHERE page > 1)", f"\nmasked AS ({mask_sql('kept')})")
    + """SELECT doc_id, page - 1 AS page, page AS source_page, 1 + (page - 1 > 2)::BIGINT AS part, text,
  'remove_pages > pii_mask > split_at' AS steps FROM masked""",
    "stream_redact": "SELECT doc_id, text FROM ("
    + mask_sql("(SELECT doc_id, 1 AS page, text FROM documents)")
    + ")",
    "stream_dedupe": with_(PAGES, _arrivals("documents", "doc_id", "to_timestamp(1700000000 + doc_id)", "1 MINUTE"))
    + """SELECT arg_min(doc_id, (doc_id, page)) AS doc_id, arg_min(page, (doc_id, page)) AS page, h FROM (
  SELECT doc_id, page, sha256(coalesce(p.text, '')) AS h, time_bucket(INTERVAL '10 minutes', made) AS w, mark
  FROM doc_pages p JOIN marked USING (doc_id))
WHERE mark IS NULL OR w + INTERVAL '10 minutes' > mark GROUP BY h, w""",
    "stream_history": with_(HISTORY, _arrivals("history", "id", "started_at", "1 HOUR"))
    + """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, tool_id, count(*) AS runs
FROM (SELECT *, date_trunc('hour', made) AS w FROM marked)
WHERE mark IS NULL OR w + INTERVAL '1 hour' > mark GROUP BY ALL""",
}

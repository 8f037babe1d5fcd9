"""Writing results; inputs are never touched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.session import shared_folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate table that many joins use to the shared folder and read it back.

    It is computed once, survives lost executors, and its size on disk tells Spark whether a join may broadcast it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def drop_staged(staged: DataFrame) -> None:
    """Remove the files of a table that ``stage_table`` returned, once nothing reads it any more."""
    remove_folder(staged.sparkSession, staged.staged_at)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_form_csv(fields: DataFrame, path: str) -> None:
    """Bulk form export as CSV files with quotes doubled."""
    fields.select(
        "doc_id",
        F.col("name").alias("Name"),
        F.col("field_type").alias("Type"),
        F.coalesce("value", F.lit("")).alias("Value"),
        F.col("page").alias("Page"),
    ).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_form_json(entries: DataFrame, path: str) -> None:
    """Bulk form export as JSON lines."""
    entries.write.mode("errorifexists").json(path)

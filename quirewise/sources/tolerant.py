"""Reading a table of many files so that a broken one costs its own rows and nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from quirewise.model import input_schema
from quirewise.sources.corpus import CorpusReadError

#: Rows of one batch, and what is told of a reason.
ROWS, REASON = 2_000, 300


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_tolerant(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of one table with its declared schema, and ``source_file`` and ``error`` beside them.

    A file that cannot be opened, or breaks off, gives the rows before the break and one row with nothing but its path and
    the reason. Columns that a file lacks are null, others are not read, values are cast to the declared types. Files are
    listed by Spark and read by the tasks, a batch of rows at a time, so neither their number nor their size matters to
    the driver; they must lie in a store that pyarrow opens (local, S3, GCS, HDFS, Azure). A missing table is an error
    while the plan is built, as in ``read_corpus``. Spark lists no files of zero bytes, so such a file counts as absent.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as err:
        raise CorpusReadError(f"cannot read {path}: {err}") from err
    declared = input_schema(name)
    schema = StructType(declared.fields).add("source_file", StringType()).add("error", StringType())
    wanted = to_arrow_schema(schema)
    plain = [f.name for f in declared.fields]

    def shaped(batch: pa.RecordBatch, uri: str) -> pa.RecordBatch:
        columns = []
        for field in wanted:
            if field.name == "source_file":
                columns.append(pa.array([uri] * batch.num_rows, pa.string()))
            elif field.name in plain and field.name in batch.schema.names:
                columns.append(batch.column(field.name).cast(field.type))
            else:
                columns.append(pa.nulls(batch.num_rows, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for uri in listed["path"].to_pylist():
                try:
                    store, place = _opened(uri)
                    with store.open_input_file(place) as source:
                        file = pq.ParquetFile(source)
                        found = [c for c in file.schema_arrow.names if c in plain]
                        for batch in file.iter_batches(ROWS, columns=found):
                            yield shaped(batch, uri)
                except Exception as err:  # whatever a broken file makes the reader say is its reason
                    reason = f"{type(err).__name__}: {err}"[:REASON]
                    lost = [pa.array([{"source_file": uri, "error": reason}.get(f.name)], f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(lost, schema=wanted)

    names = files.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).select("path")
    return names.mapInArrow(read, schema)

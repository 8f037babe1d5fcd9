"""A sink that writes one Parquet file for each part of a document, named by the part."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Pages of one file; a part with more has numbered files, so no task writes an unbounded one.
FILE_PAGES = 100_000

MANIFEST = "doc_id bigint, part bigint, chunk bigint, file string, pages bigint, first_page bigint, last_page bigint"


def file_name(doc_id: int | None, part: int, chunk: int) -> str:
    """``7-2.parquet`` for the second part of document 7; ``7-2-1.parquet`` for its pages in the next ``FILE_PAGES``."""
    return f"{doc_id}-{part}" + (f"-{chunk}" if chunk else "") + ".parquet"


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task; its files and its part of the manifest are in there."""

    folder: str


class PartFiles(DataSource):
    """``df.write.format("part_files").mode("append").save(path)`` for rows with ``doc_id, part, page`` and more."""

    @classmethod
    def name(cls) -> str:
        return "part_files"

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        if overwrite:
            raise ValueError("part files are never overwritten; take a new folder")
        return PartWriter(self.options["path"])


class PartWriter(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own below ``_temporary``; the commit moves the folders of the
    attempts that count, so files of lost or repeated attempts are never seen. What the driver handles is one name for
    each task, whatever the number of parts."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.temporary = f"{path}/_temporary"

    def _store(self) -> tuple[fs.FileSystem, str]:
        plain = self.path[5:] if self.path.startswith("file:") else self.path
        if "://" in plain:
            return fs.FileSystem.from_uri(plain)
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        folder = uuid.uuid4().hex
        own = f"{root}/_temporary/{folder}"
        store.create_dir(f"{own}/parts")
        store.create_dir(f"{own}/manifest")
        found: list[list] = []
        writer, at = None, None
        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            keys = list(zip(*(rows[c].to_pylist() for c in ("doc_id", "part", "_chunk"))))
            pages = rows["page"].to_pylist()
            rows = rows.drop_columns(["_chunk"])
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != at:
                    if writer:
                        writer.close()
                    at = keys[start]
                    writer = pq.ParquetWriter(f"{own}/parts/{file_name(*at)}", rows.schema, filesystem=store)
                    found.append([*at, file_name(*at), 0, pages[start], None])
                writer.write_table(rows.slice(start, stop - start))
                found[-1][4] += stop - start
                found[-1][6] = pages[stop - 1]
                start = stop
        if writer:
            writer.close()
        if found:
            names = [column.split()[0] for column in MANIFEST.split(", ")]
            kinds = [pa.string() if name == "file" else pa.int64() for name in names]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)]
            pq.write_table(pa.table(columns, names), f"{own}/manifest/manifest.parquet", filesystem=store)
        return Written(folder if found else "")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for kind in ("parts", "manifest"):
            store.create_dir(f"{root}/{kind}")
        for number, message in enumerate(m for m in messages if m and m.folder):
            for kind in ("parts", "manifest"):
                store.move(f"{root}/_temporary/{message.folder}/{kind}", f"{root}/{kind}/task={number}")
        store.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary")


def write_parts(parted: DataFrame, path: str, file_pages: int = FILE_PAGES) -> DataFrame:
    """Write pages with a ``part`` column, one file for each part, and return the manifest
    ``(doc_id, part, pages, first_page, last_page, first_file, last_file)``.

    Pages are dealt by the hash of their part, so a part is written by one task, in the order of its pages and a batch at a
    time; a part of more than ``file_pages`` pages has a file for every so many, dealt like parts of their own. Files
    appear together when all are written. The folder must be new and one that all executors reach; names hold the id
    and the number of the part, and ``first_file`` and ``last_file`` say where they are. No pages give an empty manifest.
    """
    spark = parted.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(folder):
        raise ValueError(f"{path} is there already")
    root = store.makeQualified(folder).toString()
    spark.dataSource.register(PartFiles)
    key = ["doc_id", "part", "_chunk"]
    cut = parted.withColumn("_chunk", F.expr(f"cast(page as bigint) div {file_pages}L"))
    dealt = cut.repartition(*key).sortWithinPartitions(*key, "page")
    dealt.write.format("part_files").mode("append").save(root)
    manifest = spark.read.schema(f"{MANIFEST}, task int").parquet(f"{root}/manifest")
    file = F.concat(F.lit(f"{root}/parts/task="), "task", F.lit("/"), "file")
    return manifest.groupBy("doc_id", "part").agg(
        F.sum("pages").alias("pages"),
        F.min("first_page").alias("first_page"),
        F.max("last_page").alias("last_page"),
        F.min_by(file, "first_page").alias("first_file"),
        F.max_by(file, "first_page").alias("last_file"),
    )
